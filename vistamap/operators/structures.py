"""Collective variables of atoms (frame, atom, x array of three coordinates), as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistamap.functions.geometry import bins, shell_volume, torsion
from vistamap.functions.metrics import Metric


def torsions(atoms: DataFrame, quadruples: DataFrame) -> DataFrame:
    """frame, name, angle for each of quadruples (name, a, b, c, d: atoms), by joins on the atoms' numbers."""
    rows = quadruples
    for c in "abcd":
        one = atoms.select(*(["frame"] if c != "a" else [F.col("frame")]), F.col("atom").alias(c), F.col("x").alias(f"x{c}"))
        rows = rows.join(one, [c] if c == "a" else ["frame", c])
    return rows.select("frame", "name", torsion(*(F.col(f"x{c}") for c in "abcd")).alias("angle"))


def contacts(atoms: DataFrame, cutoff: float, metric: Metric = Metric()) -> DataFrame:
    """frame, i, j (j < i), d of atoms of one frame nearer than cutoff: candidates come from neighbouring cells of that size."""
    if metric.kind == "torus":
        size = max(1, int(metric.period // cutoff))
        cell = lambda k: F.pmod(F.floor(F.col("x")[k] / (metric.period / size)), F.lit(size)).cast("int")
        near = lambda c: F.array_distinct(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda s: F.pmod(c + s, F.lit(size))))
    else:
        cell = lambda k: F.floor(F.col("x")[k] / cutoff).cast("int")
        near = lambda c: F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda s: c + s)
    placed = atoms.select("frame", "atom", "x", *(cell(k).alias(f"c{k}") for k in range(3)))
    left = placed.select("frame", F.col("atom").alias("i"), F.col("x").alias("xi"), "c0", "c1", "c2")
    for k in range(3):
        left = left.withColumn(f"c{k}", F.explode(near(F.col(f"c{k}"))))
    right = placed.select("frame", F.col("atom").alias("j"), F.col("x").alias("xj"), "c0", "c1", "c2")
    both = left.join(right, ["frame", "c0", "c1", "c2"]).where(F.col("i") > F.col("j"))
    return both.select("frame", "i", "j", metric.column(F.col("xi"), F.col("xj")).alias("d")).where(F.col("d") < cutoff)


def radial_distribution(atoms: DataFrame, cutoff: float, count: int, metric: Metric = Metric()) -> DataFrame:
    """bin, low, high, pairs and density (pairs per frame over the shell's volume) of distances below cutoff."""
    frames = atoms.agg(F.count_distinct("frame").alias("frames"))
    counts = contacts(atoms, cutoff, metric).groupBy(F.floor(F.col("d") / cutoff * count).cast("int").alias("bin")).agg(F.count("*").alias("pairs"))
    shells = atoms.sparkSession.createDataFrame([(k, a, b, shell_volume(a, b)) for k, (a, b) in enumerate(bins(0.0, cutoff, count))], "bin int, low double, high double, volume double")
    return counts.join(F.broadcast(shells), "bin").crossJoin(F.broadcast(frames)).select("bin", "low", "high", "pairs", (F.col("pairs") / F.col("frames") / F.col("volume")).alias("density"))
