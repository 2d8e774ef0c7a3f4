"""From batches of the feed to the nodes, ACLs and readers they touch.

No join here carries a broadcast hint: the optimizer broadcasts a side whose
measured size is below its threshold and otherwise shuffles both, and a hot
transaction or ACL is split at run time by the skew-join rule.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_store(nodes: DataFrame, store: str | None = None, shard_property: str | None = None) -> DataFrame:
    """Nodes of one store (``protocol://identifier``) and, if given, one shard property."""
    if store is not None:
        protocol, identifier = store.split("://", 1)
        nodes = nodes.filter((F.col("store_protocol") == protocol) & (F.col("store_identifier") == identifier))
    if shard_property is not None:
        nodes = nodes.filter(F.col("shard_property") == shard_property)
    return nodes


def nodes_of_transactions(
    transactions: DataFrame, nodes: DataFrame, store: str | None = None, shard_property: str | None = None
) -> DataFrame:
    """Nodes touched by the given transactions, with the commit time of each."""
    wanted = transactions.select("tx_id", "commit_time_ms")
    return in_store(nodes, store, shard_property).join(wanted, "tx_id")


def nodes_of_transaction(nodes: DataFrame, tx_id: int | Column, store: str | None = None) -> DataFrame:
    """Every node of one transaction in the store, whatever shard it belongs to."""
    return in_store(nodes, store).filter(F.col("tx_id") == tx_id)


def acls_of_change_sets(change_sets: DataFrame, acls: DataFrame) -> DataFrame:
    return acls.join(change_sets.select("change_set_id"), "change_set_id", "left_semi")


def acls_of_change_set(change_sets: DataFrame, acls: DataFrame, change_set_id: int | Column) -> DataFrame:
    """ACL ids of one change set, if the feed has it."""
    known = change_sets.filter(F.col("change_set_id") == change_set_id)
    return acls_of_change_sets(known, acls.filter(F.col("change_set_id") == change_set_id))


def readers_of_acls(acls: DataFrame, readers: DataFrame) -> DataFrame:
    """Readers of the given ACLs, one row per (ACL, authority).

    The long form is the stored form: an ACL with a great many readers never
    has to fit into one row.
    """
    return readers.join(acls.select("acl_id"), "acl_id", "left_semi").select("acl_id", "authority").distinct()


def visible_nodes(nodes: DataFrame, readers: DataFrame, authorities: Sequence[str]) -> DataFrame:
    """Nodes whose ACL one of the caller's authorities may read.

    Readers decide alone; owner and deny rules are outside the data model.
    """
    readable = readers.filter(F.col("authority").isin(list(authorities))).select("acl_id")
    return nodes.join(readable, "acl_id", "left_semi")


#: Buckets of ACL ids, each a bitmap of 4 KB, that are sent to every task; with more of them both sides are shuffled.
SENT_BUCKETS = 4096


def authority_bitmaps(readers: DataFrame) -> DataFrame:
    """(authority, bucket, bits): the ACLs that each authority may read, 32,768 neighbouring ids to a bitmap.

    Kept beside the readers, it answers every caller; a null ACL is nobody's.
    """
    known = readers.where(F.col("acl_id").isNotNull())
    return known.groupBy("authority", F.bitmap_bucket_number("acl_id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("acl_id")).alias("bits")
    )


def readable_acls(bitmaps: DataFrame, authorities: Sequence[str]) -> DataFrame:
    """(bucket, words): the ACLs that one of the authorities may read, as 512 longs per bucket."""
    either = (
        bitmaps.where(F.col("authority").isin(list(authorities))).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    )
    # Eight bytes as hexadecimal digits, read as one signed number; a word's first byte holds its highest bits.
    word = lambda i: F.conv(F.hex(F.substr("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    return either.select("bucket", F.transform(F.sequence(F.lit(0), F.lit(511)), word).alias("words"))


def visible_by_bitmap(nodes: DataFrame, bitmaps: DataFrame, authorities: Sequence[str]) -> DataFrame:
    """``visible_nodes`` by stored bitmaps: a node looks its ACL's bit up, and nodes are not shuffled."""
    readable = readable_acls(bitmaps, authorities)
    if readable.count() <= SENT_BUCKETS:
        readable = F.broadcast(readable)
    position = F.bitmap_bit_position("acl_id")
    word = F.element_at("words", F.shiftright(position, 6).cast("int") + 1)
    # Bit 0 of a byte is its lowest, while bytes come in order: position 0 is bit 56 of its word.
    shift = (F.lit(7) - F.shiftright(position, 3) % 8) * 8 + position % 8
    held = F.call_function("getbit", word, shift.cast("int")) == 1
    place = F.bitmap_bucket_number("acl_id")
    return nodes.join(readable, (place == F.col("bucket")) & held, "left_semi")
