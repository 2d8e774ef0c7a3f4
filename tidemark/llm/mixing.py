"""Mixing sources to target weights.

Words of a source are packed, in an order fixed by hashes, into blocks of equal
length. The mix has output shards of slots; each shard draws its slot counts per
source from a multinomial. A source's slots are numbered through; slot k goes to
round k div blocks, and a keyed pseudorandom permutation of that round maps it to a
block. Slots join blocks by (source, index). What the draws leave over or short of a
source's quota is dealt with in closed form: slots beyond the quota fall away and a
last shard brings those that lack, so each source meets its target to the word.

Nulls: a null text has no words, a null source is a source of its own (the last one),
a null doc_id is an id like any other. Repeated rows are separate documents. Sources
without words have target 0.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import WORD, freed, stored, unused

#: Words in a block.
BLOCK = 128
#: Slots of an output shard.
SHARD = 4096
WEIGHTS = (3, 1, 2)
#: The mix against all words, and a source's target against its own, at most.
SHARE, MOST = 1.5, 2.0
SEED = 20
#: Documents of one source that one task orders, about.
_BUCKET = 50_000


def with_sizes(documents: DataFrame, size: str) -> DataFrame:
    return documents.withColumn(size, F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): one row per source.

    Sources take the weights in code-point order, null last. Targets stop at ``most`` times their source's size; the
    excess is shared out again by weight until none is above. In closed form: sorted by size over weight, a source is
    capped as long as the share that it would get, with all before it capped, exceeds its cap; the level that the
    others get per weight is the largest such share. Only one row per source meets in one task.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(most))
    ranked = per.select("source", "source_size", rank.alias("rank"), weight.alias("weight"), cap.alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    leveled = ranked.withColumn("level", left / F.sum("weight").over(after))
    level = F.max("level").over(every)
    return leveled.withColumn("level", level).select(
        "source", "source_size", "rank", F.least("cap", F.col("weight") * F.col("level")).alias("target")
    )


def placed(sizes: DataFrame) -> DataFrame:
    """(id, source, of, nth, size, begin): where each document's words begin among its source's.

    A source's order is that of (bucket, hash, id). Buckets spread a hot source over many tasks; one row per bucket and
    source is summed over all buckets of a source.
    """
    rows = sizes.count()
    buckets = max(256, rows // _BUCKET)
    spread = sizes.withColumn("bucket", F.pmod(F.xxhash64("id", "of"), F.lit(buckets)))
    within = (
        Window.partitionBy("source", "bucket")
        .orderBy(F.xxhash64(F.lit(7), "id", "of"), "id", "of", "nth")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        spread.groupBy("source", "bucket")
        .agg(F.sum("size").alias("words"))
        .select("source", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    )
    local = spread.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = local["source"].eqNullSafe(offsets["source"]) & (local["bucket"] == offsets["bucket"])
    return local.join(offsets, same).select(
        "id", local["source"], "of", "nth", "size", (F.col("local") + F.col("offset")).alias("begin")
    )


def _scrambled(half: np.ndarray, turn: int, key: np.ndarray, low: np.ndarray) -> np.ndarray:
    x = (half + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15) ^ key
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) & low


def permuted(index: np.ndarray, size: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """A keyed permutation of range(size), value by value: a Feistel network, walked until it lands inside.

    ``back`` gives its inverse.
    """
    bits = np.maximum(1, np.ceil(np.log2(np.maximum(size, 2)) / 2)).astype(np.uint64)
    low = (np.uint64(1) << bits) - np.uint64(1)
    limit = size.astype(np.uint64)
    value, done = index.astype(np.uint64), np.zeros(len(index), bool)
    while not done.all():
        left, right = value >> bits, value & low
        for turn in (3, 2, 1, 0) if back else (0, 1, 2, 3):
            if back:
                left, right = right ^ _scrambled(left, turn, key, low), left
            else:
                left, right = right, left ^ _scrambled(right, turn, key, low)
        value = np.where(done, value, (left << bits) | right)
        done |= value < limit
    return value.astype(np.int64)


def quotas(per_source: DataFrame, block: int) -> DataFrame:
    """Slots that each source fills: whole rounds over all blocks, and a last round cut where the target is met."""
    size, target = F.col("source_size"), F.col("target")
    rounds = F.when(size > 0, F.floor(target / size)).otherwise(F.lit(0)).cast("long")
    blocks = F.ceil(size / F.lit(block)).cast("long")
    rest = F.floor(target).cast("long") - rounds * size
    # A round's slots that may be needed: all blocks are full but the last one.
    slots = rounds * blocks + F.least(blocks, F.ceil(rest / F.lit(block)).cast("long") + F.when(rest > 0, 1).otherwise(0))
    return per_source.select("*", rounds.alias("rounds"), blocks.alias("blocks"), rest.alias("rest"), slots.alias("slots"))


def draw(spark: SparkSession, quota: DataFrame, shard: int, seed: int) -> DataFrame:
    """(rank, k): the numbered slots of each source, from multinomial draws per shard.

    Each shard draws by itself, seeded by its number, so shards are drawn in parallel and again alike. The weights are
    one row per source. A source's draws are numbered over shards; numbers from its quota on fall away, and what is
    short comes as a last shard.
    """
    rows = [(r["rank"], r["slots"]) for r in quota.select("rank", "slots").where("slots > 0").collect()]
    rows.sort()
    total = sum(n for _, n in rows)
    shards = math.ceil(total / shard)
    ranks, chances = [r for r, _ in rows], np.array([n for _, n in rows], float) / max(total, 1)

    def counts(batches):
        for batch in batches:
            for number in batch["id"].to_pylist():
                size = min(shard, total - number * shard)
                found = np.random.Generator(np.random.Philox(key=[seed, number])).multinomial(size, chances)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number] * len(ranks), pa.int64()), pa.array(ranks, pa.int64()), pa.array(found)],
                    ["shard", "rank", "n"],
                )

    parts = max(1, min(shards, spark.sparkContext.defaultParallelism * 4))
    drawn = spark.range(0, max(shards, 0), 1, parts).mapInArrow(counts, "shard long, rank long, n long")
    order = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    numbered = drawn.withColumn("first", F.coalesce(F.sum("n").over(order), F.lit(0)))
    short = quota.join(drawn.groupBy("rank").agg(F.sum("n").alias("n")), "rank").where(F.col("slots") > F.col("n"))
    missing = short.select(
        F.lit(shards).cast("long").alias("shard"), "rank", (F.col("slots") - F.col("n")).alias("n"), F.col("n").alias("first")
    )
    # A shard's range is a row until here; slots are made of it in many tasks, whichever source they belong to.
    spread = max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = numbered.unionByName(missing).where("n > 0").repartition(spread, "rank", "shard")
    within = F.expr("explode(sequence(first, first + n - 1))")
    return ranges.select("shard", "rank", within.alias("k"))


def mix(
    documents: DataFrame,
    key: str = "doc_id",
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block: int = BLOCK,
    shard: int = SHARD,
    seed: int = SEED,
) -> tuple[DataFrame, DataFrame]:
    """(plan, pieces): what each document gives, and which words go to which output slot.

    plan: (id, of, nth, source, source_size, size, target, taken), one row per document; ``of`` is the hash of its
    text and ``nth`` tells rows apart that repeat in full. pieces: (id, of, nth, rank, shard, k, from_word, to_word),
    ``rank`` being the source's place among all and k its slot.
    """
    spark = documents.sparkSession
    sizes = stored(
        with_sizes(documents.select(F.col(key).alias("id"), "source", "text"), "size")
        .select("id", "source", F.xxhash64("text").alias("of"), "size")
        .withColumn("nth", occurrence("id", "of")),
        "mix-sizes",
    )
    quota = stored(quotas(targets(sizes, weights, share, most), block), "mix-quota")
    ranks = quota.select(F.col("source").alias("s"), "rank")
    ranked = placed(sizes.where("size > 0")).join(ranks, F.col("source").eqNullSafe(F.col("s")))
    first_block = F.floor(F.col("begin") / F.lit(block))
    last_block = F.floor((F.col("begin") + F.col("size") - 1) / F.lit(block))
    packed = ranked.select("id", "of", "nth", "rank", "begin", "size", F.explode(F.sequence(first_block, last_block)).alias("index"))
    slots = draw(spark, quota, shard, seed).join(
        quota.select("rank", "rounds", "blocks", "rest", "slots", "source_size"), "rank"
    )

    def mapped(batches):
        for batch in batches:
            c = {n: np.asarray(batch[n]).astype(np.int64) for n in batch.schema.names}
            turn, place = np.divmod(c["k"], c["blocks"])
            salt = (c["rank"] * 1_000_003 + turn * 7_919 + seed).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
            at = permuted(place, c["blocks"], salt)
            # Only a source's last block is short; with its place, a slot knows what its round took before it.
            short = block * c["blocks"] - c["source_size"]
            before = place * block - np.where(permuted(c["blocks"] - 1, c["blocks"], salt, back=True) < place, short, 0)
            own = block - np.where(at == c["blocks"] - 1, short, 0)
            take = np.where(turn < c["rounds"], own, np.clip(c["rest"] - before, 0, own))
            taken = take > 0
            columns = [c["shard"], c["rank"], c["k"], at, take]
            yield pa.RecordBatch.from_arrays([pa.array(x[taken]) for x in columns], ["shard", "rank", "k", "index", "take"])

    chosen = slots.where("k < slots").mapInArrow(mapped, "shard long, rank long, k long, index long, take long")
    begins = F.greatest(F.col("begin"), F.col("index") * block)
    ends = F.least(F.col("begin") + F.col("size"), F.col("index") * block + F.col("take"))
    pieces = (
        packed.join(chosen, ["rank", "index"])
        .select("id", "of", "nth", "rank", "shard", "k", (begins - F.col("begin")).alias("from_word"), (ends - F.col("begin")).alias("to_word"))
        .where("to_word > from_word")
    )
    taken = pieces.groupBy("id", "of", "nth").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    taken = taken.select(F.col("id").alias("i"), F.col("of").alias("o"), F.col("nth").alias("n"), "taken")
    own = sizes["id"].eqNullSafe(taken["i"]) & (sizes["of"] == taken["o"]) & (sizes["nth"] == taken["n"])
    shares = quota.select(F.col("source").alias("s"), "source_size", "target")
    plan = (
        sizes.join(taken, own, "left")
        .join(shares, sizes["source"].eqNullSafe(F.col("s")))
        .select("id", "of", "nth", "source", "source_size", "size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
    return plan, pieces


def occurrence(key: str, of: str) -> Column:
    """1, 2, ... for rows of the same key and text."""
    return F.row_number().over(Window.partitionBy(key, of).orderBy(key))


def mixed_documents(documents: DataFrame, key: str = "doc_id", **settings) -> DataFrame:
    """Documents with the words that the mix takes from them, in the mix's rounds, as their text; others go.

    All columns stay as they are but ``text`` and, where it is there, ``n_chars``. Words of a piece keep what stands
    between them; pieces are joined by a space.
    """
    of, nth, takes = (unused(n, documents.columns) for n in ("_of", "_nth", "_pieces"))
    _, pieces = mix(documents, key, **settings)
    # A document's own pieces only: at most about twice its words over the block length.
    gathered = pieces.groupBy("id", "of", "nth").agg(
        F.sort_array(F.collect_list(F.struct("k", "from_word", "to_word"))).alias(takes)
    )
    numbered = documents.withColumn(of, F.xxhash64("text")).withColumn(nth, occurrence(key, of))
    same = numbered[key].eqNullSafe(gathered["id"]) & (numbered[of] == gathered["of"]) & (numbered[nth] == gathered["nth"])
    joined = numbered.join(gathered, same).select(*[numbered[f"`{c}`"] for c in documents.columns], takes)
    place = documents.columns.index("text")

    def rebuilt(batches):
        word = re.compile(WORD)
        for batch in batches:
            texts = []
            for text, chosen in zip(batch["text"].to_pylist(), batch[takes].to_pylist(), strict=True):
                spans = [m.span() for m in word.finditer(text)]
                texts.append(" ".join(text[spans[p["from_word"]][0] : spans[p["to_word"] - 1][1]] for p in chosen))
            columns = batch.columns[:-1]
            columns[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    out = joined.mapInArrow(freed(rebuilt), documents.schema)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.length("text").cast(documents.schema["n_chars"].dataType))
    return out


def digest(plan: DataFrame) -> DataFrame:
    return plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
