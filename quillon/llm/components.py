"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import shared_root


def components(edges: DataFrame, limit: int = 200) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest reachable node.

    Both columns are longs.  A large-star step hangs every larger neighbour of
    a node on the smallest node of its neighbourhood, a small-star step does
    the same for the smaller ones; each step aggregates minima before it joins,
    so that no neighbourhood is ever gathered in one task.  Iterates are
    checkpointed in the shared folder.  Ends when a round changes nothing.
    """
    shared_root(edges.sparkSession)
    now = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct().checkpoint()
    seen = None
    for _ in range(limit):
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        now = small.unionByName(low.select("u", F.col("low").alias("v"))).where("u != v").distinct().checkpoint()
    else:
        raise RuntimeError("components: no fixpoint")
    # At the fixpoint every node hangs on its root directly.
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
