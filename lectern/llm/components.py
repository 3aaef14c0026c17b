"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm._shared import drop_stored, stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b); the component is the smallest node reachable.

    Large-star and small-star steps alternate until the edges no longer change: each hangs neighbours on the smallest
    one, so that the number of steps grows with the logarithm of the longest path, and edges never grow in number.
    Every step is written to the shared folder. Loops and repeated edges are harmless; null ends are left out.
    """
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = stored(now.distinct(), "edges")
    mark = _mark(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        hub = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(hub, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = stored(small.unionByName(hub.withColumnRenamed("m", "v")).distinct(), "edges")
        new = _mark(after)
        drop_stored(now)
        now = after
        if new == mark:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = new
