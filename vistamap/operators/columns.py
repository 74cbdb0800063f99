"""Operations on tables of named columns with a `frame` index, as an explorer of trajectories needs them."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def add_column(table: DataFrame, other: DataFrame, name: str, frame: str = "frame") -> DataFrame:
    """table with the column `name` of other, which must have the same frames; the name must be new."""
    if name in table.columns:
        raise ValueError(f"{name} exists")
    missing = table.select(frame).join(other.select(frame), frame, "full_outer").count()
    if not missing == table.count() == other.count():
        raise ValueError("the columns have different frames")
    return table.join(other.select(frame, name), frame)


def get_row(table: DataFrame, frame_number: int, frame: str = "frame", time: str = "time") -> DataFrame:
    """One frame's values, without its time."""
    return table.where(F.col(frame) == frame_number).drop(time)


def select_columns(table: DataFrame, names: Sequence[str]) -> DataFrame:
    absent = [n for n in names if n not in table.columns]
    if absent:
        raise ValueError(f"no such columns: {', '.join(absent)}")
    return table.select(*names)


def row_range(table: DataFrame, low: int, high: int, frame: str = "frame") -> DataFrame:
    return table.where(F.col(frame).between(low, high))


def clone_frames(table: DataFrame, frames: DataFrame, frame: str = "frame") -> DataFrame:
    """Rows of a list of frames (pos, frame): in its order, with its repetitions; new frames are positions."""
    return table.join(frames.select("pos", F.col(frame)), frame).drop(frame).withColumnRenamed("pos", frame)


def lasso(table: DataFrame, x: str, y: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows in xmin, ymin, xmax, ymax, edges included."""
    return table.where(F.col(x).between(box[0], box[2]) & F.col(y).between(box[1], box[3]))


def append_selection(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def first_frames(table: DataFrame, points: DataFrame, keys: Sequence[str], frame: str = "frame") -> DataFrame:
    """The first frame with each of the points' values."""
    return points.join(table, list(keys)).groupBy(*keys).agg(F.min(frame).alias(frame))


def padded_range(table: DataFrame, column: str, share: float = 0.05) -> DataFrame:
    """One row: low and high, wider than the data by a share of their range on each side, or by 1 if they are constant."""
    r = table.agg(F.min(column).alias("a"), F.max(column).alias("b"))
    pad = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise((F.col("b") - F.col("a")) * share)
    return r.select((F.col("a") - pad).alias("low"), (F.col("b") + pad).alias("high"))


def bounds(parts: Sequence[tuple[DataFrame, str, str]]) -> DataFrame:
    """One row: x_low, x_high, y_low, y_high over several data sets (table, x, y)."""
    rows = append_selection(*(t.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for t, x, y in parts))
    return rows.agg(F.min("x").alias("x_low"), F.max("x").alias("x_high"), F.min("y").alias("y_low"), F.max("y").alias("y_high"))


def half_width(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: half of the range over all columns together and 0."""
    low = F.least(F.lit(0.0), *(F.min(c) for c in columns))
    high = F.greatest(F.lit(0.0), *(F.max(c) for c in columns))
    return table.agg(((high - low) / 2).alias("half_width"))


def grid_width(table: DataFrame, x: str, y: str, factor: float = 1.2) -> DataFrame:
    """One row: the largest distance from the origin, times a factor."""
    return table.agg((F.max(F.hypot(F.col(x), F.col(y))) * factor).alias("width"))


def point_sizes(table: DataFrame, weight: str | None, low: float, high: float) -> DataFrame:
    """table with share (0 to 1 over the range of weights; 0 if they are constant, 1 without weights) and size."""
    if weight is None:
        return table.withColumns({"share": F.lit(1.0), "size": F.lit(high)})
    r = F.broadcast(table.agg(F.min(weight).alias("__a"), F.max(weight).alias("__b")))
    share = F.when(F.col("__a") == F.col("__b"), F.lit(0.0)).otherwise((F.col(weight) - F.col("__a")) / (F.col("__b") - F.col("__a")))
    return table.crossJoin(r).withColumn("share", share).withColumn("size", low + (high - low) * F.col("share")).drop("__a", "__b")


def color_index(table: DataFrame, column: str, colors: int) -> DataFrame:
    """table with color: the part of the column's range, `colors` at its top; 0 if the column is constant."""
    r = F.broadcast(table.agg(F.min(column).alias("__a"), F.max(column).alias("__b")))
    part = F.floor((F.col(column) - F.col("__a")) / ((F.col("__b") - F.col("__a")) / colors))
    return table.crossJoin(r).withColumn("color", F.when(F.col("__a") == F.col("__b"), F.lit(0)).otherwise(part).cast("int")).drop("__a", "__b")


def segments(table: DataFrame, x: str, y: str, order: str = "frame", series: str | None = None) -> DataFrame:
    """Lines between consecutive rows: x0, y0, x1, y1, per series if one is named; else rows are numbered by ranges and joined with
    the next, so that no task holds all."""
    if series is None:
        rows = numbered(table.select(order, F.col(x).alias("x1"), F.col(y).alias("y1")), order)
        before = rows.select((F.col("rank") + 1).alias("rank"), F.col("x1").alias("x0"), F.col("y1").alias("y0"))
        return rows.join(before, "rank").where(F.col("x0").isNotNull()).select(order, "x0", "y0", "x1", "y1")
    by = Window.partitionBy(series).orderBy(order)
    rows = table.select(series, order, F.lag(x).over(by).alias("x0"), F.lag(y).over(by).alias("y0"), F.col(x).alias("x1"), F.col(y).alias("y1"))
    return rows.where(F.col("x0").isNotNull())


def steps(table: DataFrame, x: str, y: str, series: str | None = None) -> DataFrame:
    """Bars of a step plot: x0, x1, height; the last is as wide as the one before."""
    if series is None:
        rows = numbered(table.select(F.col(x).alias("x0"), F.col(y).alias("height")), "x0")
        near = lambda by, name: rows.select((F.col("rank") + by).alias("rank"), F.col("x0").alias(name))
        both = rows.join(near(-1, "after"), "rank", "left").join(near(1, "before"), "rank", "left")
        return both.select("x0", F.coalesce("after", F.col("x0") + F.col("x0") - F.col("before")).alias("x1"), "height")
    by = Window.partitionBy(series).orderBy(x)
    end = F.coalesce(F.lead(x).over(by), F.col(x) + F.col(x) - F.lag(x).over(by))
    return table.select(series, F.col(x).alias("x0"), end.alias("x1"), F.col(y).alias("height"))


def centred(layout: DataFrame, column: str = "y") -> DataFrame:
    """layout (id, y) about its mean."""
    mean = layout.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.avg("v").alias("m"))
    one = mean.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda t: t["m"]).alias("__mean"))
    return layout.crossJoin(F.broadcast(one)).withColumn(column, F.zip_with(column, "__mean", lambda a, b: a - b)).drop("__mean")


def dataset(table: DataFrame, x: str, y: str, color: str | None = None, size: str | None = None) -> DataFrame:
    return table.select(F.col(x).alias("x"), F.col(y).alias("y"), *(F.col(c).alias(n) for c, n in ((color, "color"), (size, "size")) if c))


def frame_values(table: DataFrame, frame_number: int, names: Sequence[str], frame: str = "frame") -> DataFrame:
    """n, value: the columns of one frame in a row."""
    one = table.where(F.col(frame) == frame_number)
    return one.select(F.posexplode(F.array(*(F.col(n).cast("double") for n in names))).alias("n", "value"))


def around(frames: DataFrame, current: int, before: int, after: int) -> DataFrame:
    """side, place (1 nearest), point: the points of the frames before and after the current one, out of (frame, point). Each
    point once, at its nearest place, after rather than before, and without the current frame's own."""
    own = frames.where(F.col("frame") == current).select(F.col("point").alias("__own"))
    off = F.col("frame") - F.lit(current)
    near = frames.where(off.between(-before, after) & (off != 0)).crossJoin(F.broadcast(own)).where(F.col("point") != F.col("__own"))
    first = near.withColumn("off", off).groupBy("point").agg(F.min(F.struct((F.col("off") < 0).alias("back"), F.abs("off").alias("far"))).alias("at"))
    place = F.row_number().over(Window.partitionBy("side").orderBy("far"))
    return first.select(F.when(F.col("at.back"), "before").otherwise("after").alias("side"), F.col("at.far").alias("far"), "point").withColumn("place", place).select("side", "place", "point")


def unmap(place: Column, low: float, high: float, start: float, end: float) -> Column:
    """The inverse of `map_to`: data of a place on the plot."""
    return low + (place - start) * ((high - low) / (end - start))


def zoomed(table: DataFrame, x: str, y: str, window: tuple[float, float, float, float]) -> DataFrame:
    """Rows in xmin, ymin, xmax, ymax with px and py, their places in the unit square that the window fills."""
    a, b, c, d = window
    return lasso(table, x, y, window).withColumns({"px": map_to(F.col(x), a, c, 0.0, 1.0), "py": map_to(F.col(y), b, d, 0.0, 1.0)})


def map_to(value: Column, low: float, high: float, start: float, end: float) -> Column:
    """Linear map of [low, high] to [start, end], as plots have it."""
    return start + (value - low) * ((end - start) / (high - low))


def tics(low: float, high: float, count: int = 5) -> list[float]:
    """Round positions in a range: 1, 2 or 5 times a power of ten apart."""
    import math

    if high <= low:
        return [low]
    raw = (high - low) / count
    base = 10.0 ** math.floor(math.log10(raw))
    step = next(m * base for m in (1, 2, 5, 10) if m * base >= raw * (1 - 1e-12))
    return [k * step for k in range(math.ceil(low / step - 1e-9), math.floor(high / step + 1e-9) + 1)]


def colors(kind: str, t: Column) -> Column:
    """#rrggbb of a position in [0, 1]: hsv, hot, cool, grey or jet."""
    part = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    if kind == "grey":
        rgb = (t, t, t)
    elif kind == "cool":
        rgb = (t, 1 - t, F.lit(1.0))
    elif kind == "hot":
        rgb = (t * 3, t * 3 - 1, t * 3 - 2)
    elif kind == "jet":
        rgb = tuple(1.5 - F.abs(4 * t - c) for c in (3.0, 2.0, 1.0))
    elif kind == "hsv":  # hue round the circle at full saturation and value
        h = t * 6
        rgb = (F.abs(h - 3) - 1, 2 - F.abs(h - 2), 2 - F.abs(h - 4))
    else:
        raise ValueError(kind)
    return F.format_string("#%02x%02x%02x", *(F.round(part(c) * 255).cast("int") for c in rgb))
