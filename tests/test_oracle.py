"""Every registered query against its SQL twin, on whole tables."""

import pytest

from checks.oracle import ORACLE
from checks.queries import QUERIES
from tests.conftest import rows

def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, folder, duck, name):
    result = duck.execute(ORACLE[name])
    columns = [d[0] for d in result.description]
    order = sorted(columns)
    expected = sorted((tuple(r[columns.index(c)] for c in order) for r in result.fetchall()), key=repr)
    frame = QUERIES[name](spark, folder)
    assert sorted(frame.columns) == order
    assert rows(frame, *[f"`{c}`" for c in order]) == expected
