"""Looking ids up in a table that is much larger than the list of ids.

An anti join can only broadcast its right side. With few ids on the left and a
whole index on the right it would shuffle the index; so the index is first cut
down to the ids in question, which broadcasts them if they are few. If they are
many, both joins are ordinary shuffled joins and the result is the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the (few) keys."""
    return rows.join(keys.select(key), key, "left_anti")


def present(ids: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Keys of the large table that are among the ids."""
    return table.select(key).join(ids.select(key), key, "left_semi")


def absent_from(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """The (few) rows whose key the large table does not have."""
    return without(rows, present(rows, table, key), key)
