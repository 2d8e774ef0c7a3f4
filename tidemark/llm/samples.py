"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int, key: str = "doc_id"
) -> DataFrame:
    """(id, text, label) of at most ``rows`` labelled documents that ``learn`` (over labels' columns) lets in.

    Those with the smallest hashes of their ids are taken, so the sample is the same whenever it is drawn and does not
    depend on the order of rows. Rows without a label or id are left out.
    """
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & learn)
    chosen = (
        usable.groupBy(F.col(key).alias("id"))
        .agg(F.max(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    # ``rows`` ids and labels: bounded by the parameter.
    return documents.select(F.col(key).alias("id"), "text").join(F.broadcast(chosen), "id")
