"""Core counts, request and cache statistics, and their long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.ordered import with_running_sum

PERCENTILES = {"median": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99, "p999": 0.999}


def core_doc_counts(docs: DataFrame, cores: Sequence[str]) -> DataFrame:
    """Documents of each listed core; 0 for one that has none yet.

    The list is a handful of configured names, added to the counts as literal
    rows instead of being joined.
    """
    counted = docs.filter(F.col("core").isin(list(cores))).groupBy("core").agg(F.count("*").alias("n"))
    spark = docs.sparkSession
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in cores])).alias("core"), F.lit(0).alias("n"))
    return counted.unionByName(listed).groupBy("core").agg(F.sum("n").alias("docs"))


def total_docs(status: DataFrame) -> DataFrame:
    """Documents over all cores of a status map ``core -> {index: {numDocs}}``; 0 without any."""
    cores = status.select(F.explode_outer("status").alias("core", "state"))
    return cores.agg(F.coalesce(F.sum("state.index.numDocs"), F.lit(0)).alias("total_docs"))


def core_status(docs: DataFrame) -> DataFrame:
    """Status record of each core: a one-entry map, as a core reports it."""
    counted = docs.groupBy("core").agg(F.count("*").alias("numDocs"))
    return counted.select(
        F.create_map(F.col("core"), F.struct(F.struct("numDocs").alias("index"))).alias("status")
    )


def searcher_counts(docs: DataFrame) -> DataFrame:
    """Live and deleted documents of each core, and both together (this library's reading of maxDoc)."""
    return docs.groupBy("core").agg(
        F.count_if(F.col("status") != "DELETED").alias("num_docs"),
        F.count_if(F.col("status") == "DELETED").alias("deleted_docs"),
        F.count("*").alias("max_doc"),
    )


def exact_percentiles(
    rows: DataFrame, group: str, value: str, fractions: dict[str, float], parts: int | None = None
) -> DataFrame:
    """Interpolated percentiles of each group that has values, however large it is.

    Values are counted first, then ranked by a running sum of the counts over
    (group, value); only the two values around each wanted rank leave that step.
    A group is never collected, and its size comes from the counts.
    """
    histogram = rows.filter(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    ranked = with_running_sum(histogram, [group, value], F.col("_n"), "_before", parts)
    # One row per group; the ranks are made from the stored counts each time.
    sizes = ranked.groupBy(group).agg(F.min("_before").alias("_begin"), F.sum("_n").alias("_size"))
    sized = sizes.select(F.col(group).alias("_group"), "_begin", "_size")
    placed = ranked.join(sized, F.col(group).eqNullSafe(F.col("_group"))).withColumn(
        "_first", F.col("_before") - F.col("_begin")
    )

    def value_at(rank):
        return F.max(F.when((F.col("_first") <= rank) & (rank < F.col("_first") + F.col("_n")), F.col(value)))

    bounds = []
    for name, fraction in fractions.items():
        rank = F.lit(fraction) * (F.col("_size") - 1)
        bounds += [
            value_at(F.floor(rank)).alias(f"_lo_{name}"),
            value_at(F.ceil(rank)).alias(f"_hi_{name}"),
            F.max(rank - F.floor(rank)).alias(f"_w_{name}"),
        ]
    around = placed.groupBy(group).agg(*bounds)
    return around.select(
        group,
        *[
            (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_w_{n}")).alias(n)
            for n in fractions
        ],
    )


#: Size parameter of the sketches: a rank is off by less than one in a hundred, whatever the number of requests.
SKETCH_K = 400
RANK_ERROR = 0.01
HOUR_MS = 3_600_000


def handler_sketches(requests: DataFrame) -> DataFrame:
    """(handler, hour, requests, errors, timeouts, total_time, times): one row per handler and hour, to be stored.

    ``times`` is a mergeable quantile sketch of a few KB, so a month is read from some hundred rows per handler and no
    request is read again. Requests without a time count, but not in the sketch.
    """
    hour = F.call_function("div", F.col("ts_ms"), F.lit(HOUR_MS)).alias("hour")
    return requests.groupBy("handler", hour).agg(
        F.count("*").alias("requests"),
        F.count_if("is_error").alias("errors"),
        F.count_if("is_timeout").alias("timeouts"),
        F.sum("elapsed_ms").alias("total_time"),
        F.kll_sketch_agg_double(F.col("elapsed_ms").cast("double"), SKETCH_K).alias("times"),
    )


def stats_of_sketches(sketches: DataFrame, from_ms: int | None = None, to_ms: int | None = None) -> DataFrame:
    """Counts, times and percentiles of each handler over whole hours of ``[from, to)``, from stored sketches.

    A percentile is a time whose rank is within ``RANK_ERROR`` of the one asked for; handlers without times have none.
    """
    hours = sketches
    if from_ms is not None:
        hours = hours.where(F.col("hour") >= from_ms // HOUR_MS)
    if to_ms is not None:
        hours = hours.where(F.col("hour") < to_ms // HOUR_MS)
    merged = hours.groupBy("handler").agg(
        *[F.sum(c).alias(c) for c in ("requests", "errors", "timeouts", "total_time")],
        F.kll_merge_agg_double("times", SKETCH_K).alias("_times"),
    )
    known = F.kll_sketch_get_n_double("_times") > 0
    quantiles = [
        F.when(known, F.kll_sketch_get_quantile_double("_times", F.lit(q))).alias(n) for n, q in PERCENTILES.items()
    ]
    return merged.select("handler", "requests", "errors", "timeouts", "total_time", *quantiles)


def handler_stats(requests: DataFrame, exact: bool = True, parts: int | None = None) -> DataFrame:
    """Counts, times, percentiles and rate of each request handler, the null handler too.

    Exact percentiles come from ``exact_percentiles``; without ``exact`` a
    mergeable sketch takes their place in the same aggregation. Requests that
    span no time have no rate, handlers without times no percentiles.
    """
    aggregates = [
        F.count("*").alias("requests"),
        F.count_if("is_error").alias("errors"),
        F.count_if("is_timeout").alias("timeouts"),
        F.sum("elapsed_ms").alias("total_time"),
        F.avg("elapsed_ms").alias("avg_time_per_request"),
        F.try_divide(F.count("*") * 1000, F.max("ts_ms") - F.min("ts_ms")).alias("avg_requests_per_second"),
    ]
    if not exact:
        aggregates += [F.percentile_approx("elapsed_ms", q).alias(n) for n, q in PERCENTILES.items()]
    stats = requests.groupBy("handler").agg(*aggregates)
    if exact:
        found = exact_percentiles(requests, "handler", "elapsed_ms", PERCENTILES, parts)
        found = found.withColumnRenamed("handler", "_handler")
        stats = stats.join(found, F.col("handler").eqNullSafe(F.col("_handler")), "left").drop("_handler")
    return stats


def cache_stats(events: DataFrame) -> DataFrame:
    """Lookups, hits, ratio, inserts, evictions and resulting size of each cache."""
    counts = events.groupBy("cache").agg(
        F.count("*").alias("lookups"),
        F.count_if("hit").alias("hits"),
        F.count_if("insert").alias("inserts"),
        F.count_if("evict").alias("evictions"),
    )
    ratio = F.when(F.col("lookups") > 0, F.col("hits") / F.col("lookups"))
    return counts.withColumn("hitratio", ratio).withColumn("size", F.col("inserts") - F.col("evictions"))


def cumulative_cache_stats(events: DataFrame, period_ms: int = 3_600_000) -> DataFrame:
    """Running totals of each cache at the end of every period it was used in.

    The window sees one row per cache and period, never the events themselves.
    """
    period = F.expr(f"ts_ms div {period_ms}")
    counts = events.groupBy("cache", period.alias("period")).agg(
        F.count("*").alias("lookups"),
        F.count_if("hit").alias("hits"),
        F.count_if("insert").alias("inserts"),
        F.count_if("evict").alias("evictions"),
    )
    so_far = Window.partitionBy("cache").orderBy("period").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(c).over(so_far).alias(f"cumulative_{c}") for c in ("lookups", "hits", "inserts", "evictions")]
    totals = counts.select("cache", "period", *sums)
    return totals.withColumn("cumulative_hitratio", F.col("cumulative_hits") / F.col("cumulative_lookups"))


def field_cache_stats(entries: DataFrame) -> DataFrame:
    """Entries of the field cache, and those cached more than once ("insanity")."""
    per_entry = entries.groupBy("entry").agg(F.count("*").alias("n"))
    return per_entry.agg(
        F.count("*").alias("entries_count"), F.count_if(F.col("n") > 1).alias("insanity_count")
    )


def metric_long_form(metrics: DataFrame, prefix: str, name: str) -> DataFrame:
    """One (alias, value) row per attribute of a wide metric row.

    The alias is ``prefix.name.attribute``, with the name column's value in the middle.
    """
    attributes = [c for c in metrics.columns if c != name]
    wide = metrics.select(name, *[F.col(c).cast("double").alias(c) for c in attributes])
    long = wide.unpivot([name], attributes, "attribute", "value")
    return long.select(F.concat_ws(".", F.lit(prefix), F.col(name), F.col("attribute")).alias("alias"), "value")
