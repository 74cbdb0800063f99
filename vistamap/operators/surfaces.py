"""Free-energy surfaces: grids (x, z) or (x, y, z), one or many frames of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Boltzmann's constant by unit of energy (fixed values).
BOLTZMANN = {"kj": 0.0083144621, "kcal": 0.0019872041, "ev": 8.6173324e-5, "lj": 1.0, "hartree": 3.1668114e-6, "joule": 1.3806488e-23}


def thermal_energy(temperature: float, unit: str = "kj") -> float:
    if unit not in BOLTZMANN:
        raise ValueError(f"unknown unit {unit}")
    return temperature * BOLTZMANN[unit]


def free_energy(z: Column, kt: float, low: Column) -> Column:
    """-kT ln of the sum of exp(-z / kT), an aggregate; `low` is the smallest z, kept out of the exponent."""
    return low - kt * F.ln(F.sum(F.exp(-(z - low) / kt)))


def integrate(surface: DataFrame, kt: float, *by: str) -> DataFrame:
    """free_energy of the rows, by groups if columns are named. Two aggregations: the smallest z first, so that nothing overflows."""
    low = surface.groupBy(*by).agg(F.min("z").alias("__low"))
    rows = surface.join(low, list(by)) if by else surface.crossJoin(F.broadcast(low))
    return rows.groupBy(*by, "__low").agg(F.sum(F.exp(-(F.col("z") - F.col("__low")) / kt)).alias("s")).select(*by, (F.col("__low") - kt * F.ln("s")).alias("free_energy"))


def inside(box: dict[str, tuple[float, float]]) -> Column:
    """Strictly within every range."""
    on = F.lit(True)
    for name, (a, b) in box.items():
        on &= (F.col(name) > a) & (F.col(name) < b)
    return on


def box_difference(surface: DataFrame, kt: float, one: dict[str, tuple[float, float]], two: dict[str, tuple[float, float]] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Free energy of one box, less that of another if given; per frame with `by`: the convergence of a run of surfaces."""
    low = surface.groupBy(*by).agg(F.min("z").alias("__low"))
    rows = surface.join(low, list(by)) if by else surface.crossJoin(F.broadcast(low))
    term = F.exp(-(F.col("z") - F.col("__low")) / kt)
    sums = rows.groupBy(*by, "__low").agg(F.sum(F.when(inside(one), term)).alias("s1"), F.sum(F.when(inside(two or one), term)).alias("s2"))
    value = -kt * F.ln("s1") + kt * F.ln("s2") if two else F.col("__low") - kt * F.ln("s1")
    return sums.select(*by, value.alias("free_energy"))


def difference(a: DataFrame, b: DataFrame, axes: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """z of a less z of b on one grid; grids that differ are refused."""
    n, m = a.count(), b.count()
    both = a.join(b.withColumnRenamed("z", "__z"), list(axes)).select(*axes, (F.col("z") - F.col("__z")).alias("z"))
    if n != m or both.count() != n:
        raise ValueError("the surfaces have different grids")
    return both


def indexed(surface: DataFrame) -> DataFrame:
    """surface with i and j, the places of x and y among their distinct values: the axes are few, the rows are joined."""
    def axis(name: str, at: str) -> DataFrame:
        return surface.select(name).distinct().withColumn(at, F.row_number().over(Window.orderBy(name)) - 1)

    return surface.join(axis("x", "i"), "x").join(axis("y", "j"), "y").select("i", "j", "x", "y", "z")


def clipped(grid: DataFrame, x: tuple[float, float], y: tuple[float, float], most: int = 100) -> DataFrame:
    """Grid nodes in a range; more than `most` cells along an axis are refused."""
    part = grid.where(F.col("x").between(*x) & F.col("y").between(*y))
    size = part.agg((F.max("i") - F.min("i")).alias("i"), (F.max("j") - F.min("j")).alias("j")).first()
    if max(size["i"] or 0, size["j"] or 0) > most:
        raise ValueError(f"more than {most} cells along an axis")
    return part


def cells(grid: DataFrame, low: float, high: float, colors: int) -> DataFrame:
    """i, j, z (mean of the four corners, held within [low, high]) and color of each cell."""
    corner = [grid.select((F.col("i") - p).alias("i"), (F.col("j") - q).alias("j"), "z") for p in (0, 1) for q in (0, 1)]
    joined = corner[0]
    for c in corner[1:]:
        joined = joined.unionByName(c)
    means = joined.groupBy("i", "j").agg(F.avg("z").alias("m"), F.count("*").alias("n")).where("n = 4")
    z = F.greatest(F.lit(low), F.least(F.lit(high), F.col("m")))
    return means.select("i", "j", z.alias("z"), F.least(F.lit(colors - 1), F.floor((z - low) / (high - low) * colors)).cast("int").alias("color"))
