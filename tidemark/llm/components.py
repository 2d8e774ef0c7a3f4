"""Connected components of links, by contraction level by level.

Every task joins the links it reads (union-find), so that chains become stars. A node
that several tasks have seen has several roots; these roots are linked, and the links
between roots, of which there are far fewer, are contracted again, until there are none.
A node's root is then followed through the levels. Links and components stay in tables
of the shared folder; the driver sees counts only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import stored

#: Links that one task joins, about (some 200 bytes each while it runs).
PER_TASK = 200_000


def _root(parent: dict[int, int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def _contracted(batches):
    """(node, root) for every node of this task's links; a root has itself."""
    parent: dict[int, int] = {}
    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            a, b = _root(parent, parent.setdefault(u, u)), _root(parent, parent.setdefault(v, v))
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    for i in range(0, len(nodes), 50_000):
        part = nodes[i : i + 50_000]
        roots = pa.array([_root(parent, x) for x in part], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), roots], ["node", "root"])


def components(links: DataFrame) -> DataFrame:
    """(node, root) from links (u, v): the smallest node that each linked node reaches, itself too."""
    edges = stored(links.select("u", "v").where("u != v"), "links")
    levels = []
    while rows := edges.count():
        # Links of one smaller end are joined in one task, as far as a task takes them.
        tasks = -(-rows // PER_TASK)
        dealt = edges.coalesce(1) if tasks == 1 else edges.repartition(tasks, F.least("u", "v"), F.xxhash64("u", "v") % 4)
        seen = dealt.mapInArrow(_contracted, "node long, root long")
        # As many roots as tasks have seen the node, at most.
        roots = seen.groupBy("node").agg(F.sort_array(F.collect_set("root")).alias("roots")) if tasks > 1 else seen.select("node", F.array("root").alias("roots"))
        level = stored(roots, "roots")
        levels.append(level.select("node", F.col("roots")[0].alias("root")))
        if tasks == 1:
            break
        least, others = F.col("roots")[0], F.slice("roots", 2, F.greatest(F.size("roots") - 1, F.lit(0)))
        edges = stored(level.select(F.explode(others).alias("u"), least.alias("v")).distinct(), "links")
    if not levels:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = levels[0]
    for level in levels[1:]:
        higher = level.select(F.col("node").alias("at"), F.col("root").alias("top"))
        joined = found.join(higher, F.col("root") == F.col("at"), "left")
        found = stored(joined.select("node", F.coalesce("top", "root").alias("root")), "components")
    return found
