"""Connected components of an edge table, all in DataFrames.

Alternates the large-star and small-star steps of Kiveris et al. (2014): every node points at the smallest node it knows
of. Each round is written to the shared folder, so lost executors cost one round; the driver sees only a sum of the edges' ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch


def _largest(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _smallest(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
    return moved.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """node, component (smallest node that can be reached) for each node of edges (a long, b long).
    Nulls and loops count for nothing. The result is read from scratch."""
    edges = scratch.saved(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    now, rows = edges, edges.count()
    sign = None
    for _ in range(rounds):
        now = scratch.saved(_smallest(_largest(now)), "cc", rows)
        row = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.bit_xor(F.xxhash64("b", "a", F.lit(1))).alias("s")).first()
        if sign == (row["n"], row["x"], row["s"]):
            break
        sign = (row["n"], row["x"], row["s"])
    else:
        raise RuntimeError(f"no end after {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
