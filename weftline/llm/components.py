"""Connected components of a graph of links, by alternating large-star and small-star steps.

Every step is a shuffle of the links with pre-aggregated minima, and its result is written
to the shared folder, so a lost executor costs at most one step. A node that holds a third of all
links is a skewed join key, which Spark splits, since both sides of the join are freshly read tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from weftline.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, max_steps: int = 60) -> DataFrame:
    """(node, root) for every node of links (u, v); root is the smallest node of its component."""
    low, high = F.least("u", "v"), F.greatest("u", "v")
    edges = scratch.save(links.filter("u <> v").select(high.alias("u"), low.alias("v")).distinct(), "links")
    before = None
    for k in range(max_steps):
        large = _star(edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), scratch, f"large{k}", only_larger=True)
        seen = Observation()
        edges = _star(large, scratch, f"small{k}", only_larger=False, seen=seen)
        now = seen.get
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _star(pairs: DataFrame, scratch: Scratch, name: str, only_larger: bool, seen: Observation | None = None) -> DataFrame:
    """Link the neighbours v of each u to the smallest of u and its neighbours.

    only_larger: pairs hold both directions, and only neighbours above u are linked (large star);
    else pairs are (u, v) with v below u, and u itself is linked as well (small star).
    seen: gets the number and two sums of hashes of the links.
    """
    least = scratch.save(pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), f"{name}-min", free=False)
    joined = pairs.join(least, "u")
    if only_larger:
        out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    out = out.filter("u <> v").distinct()
    if seen:
        out = out.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v") % 1000003).alias("a"), F.sum(F.xxhash64("v", "u") % 999983).alias("b"))
    return scratch.save(out, name, free=False)
