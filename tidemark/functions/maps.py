"""Flat pair lists as maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairs_to_map(pairs: Column) -> Column:
    """``[k, v, k, v, ...]`` as a map: an odd tail is dropped, the last duplicate wins.

    A null key becomes the text ``null``. Duplicates rely on the session's
    LAST_WIN map policy (see ``tidemark.session``).
    """
    whole = F.size(pairs) - F.size(pairs) % 2
    keys = F.filter(pairs, lambda _, i: (i % 2 == 0) & (i < whole))
    values = F.filter(pairs, lambda _, i: (i % 2 == 1) & (i < whole))
    named = F.transform(keys, lambda k: F.coalesce(k, F.lit("null")))
    return F.map_from_arrays(named, values)
