"""Connected components by alternating large-star and small-star steps, all as DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import discard, materialize


def _stamp(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return (row[0], row[1])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least")).hint("merge")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("least"))
    moved = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v")
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(u, v)`` of integers to ``(node, root)``, root the least node reachable; nodes without edges have no row.

    Loops and repeated or reversed edges change nothing. Each round's edges are written to the shared folder, so a
    round that loses executors reruns alone. Only a count and a checksum reach the driver; no join is a broadcast, since
    the edges grow with the input.
    """
    now = materialize(edges.where("u <> v").select("u", "v"), "edges")
    seen = None
    while (stamp := _stamp(now)) != seen:
        seen, before = stamp, now
        large = materialize(_large_star(before), "large-star")
        now = materialize(_small_star(large), "small-star")
        discard(before, large)
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()
