"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from upkeep.llm import scratch


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``: the smallest node that can be reached.

    Every round hangs the larger neighbours of a node, then its smaller ones, on the
    smallest of them, until nothing moves; the number of rounds grows with the logarithm
    of the longest path. Nodes without edges aren't returned. Minima are found by partial
    aggregation, so a node may have any number of edges.
    """
    now = scratch.table(_clean(edges), "edges")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = _clean(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.select("b", "m").unionByName(small.select(F.col("a").alias("b"), "m")).toDF("a", "b")
        now = scratch.table(_clean(small), "edges")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        before = state


def _clean(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger node to the smaller one."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
