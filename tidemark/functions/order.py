"""The feed order: commit time first, ties broken by id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
UNKNOWN_TX = 9_223_372_036_854_775_807  # "transaction not known" on a node
NONE_SENTINEL = -1  # "no such commit time"


def to_millis(column: str | Column) -> Column:
    """Epoch milliseconds of a timestamp column (session zone UTC), floored."""
    column = F.col(column) if isinstance(column, str) else column
    return F.unix_millis(column.cast("timestamp"))


def feed_order(id_col: str, time_col: str = "commit_time_ms") -> Column:
    """Sortable, comparable key; ``max`` and ``min`` on it are lexicographic."""
    return F.struct(F.col(time_col), F.col(id_col))
