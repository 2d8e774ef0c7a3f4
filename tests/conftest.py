import pytest

from tidemark.session import local_session, release

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", folder=str(tmp_path_factory.mktemp("shared")))
    yield session
    release(session)
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(folder):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


@pytest.fixture
def fresh(tmp_path):
    return str(tmp_path)


def rows(frame, *columns):
    """Sorted rows as tuples."""
    columns = columns or tuple(frame.columns)
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
