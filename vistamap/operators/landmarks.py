"""Selection of landmarks and their Voronoi weights.

Points are (id, x, w); ids stand for positions. Selections return (rank, id), in order of selection.

Farthest-point selection runs on the driver up to IN_MEMORY numbers and in rounds over the cluster beyond: a round is one
pass that folds the landmarks found since the last save into each point's distance, and SAVED rounds share one save in the
checkpoint folder. Weighted draws (resample, staged) are sequential by definition and refuse more than IN_MEMORY numbers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistamap.functions.generators import Drand48
from vistamap.functions.metrics import Metric
from vistamap.sources.text import scientific, scientific_all

from .numbering import numbered, shared_path
from .pairs import matrix

IN_MEMORY = 20_000_000
SAVED = 16
#: Numbers in a set of landmarks that is sent to every task.
BROADCAST = 10_000_000


def ranked(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(map(int, ids))), "rank int, id long")


def first_point(n: int, seed: int = 12345) -> int:
    """A draw of the seeded generator, after one that is discarded."""
    draw = Drand48(seed)
    draw()
    return int(draw() * n)


def stride(points: DataFrame, n: int) -> DataFrame:
    """Rows 0, s, 2s, ... of ids 0 .. N - 1, s the whole part of N / n."""
    step = max(1, points.count() // n)
    return points.where((F.col("id") % step == 0) & (F.col("id") / step < n)).select((F.col("id") / step).cast("int").alias("rank"), "id")


#: Draws that a task makes in a row.
DRAWS = 1 << 16


def draws(spark: SparkSession, n: int, size: int, seed: int = 12345) -> DataFrame:
    """k (0 ..), id: n numbers below `size` from the seeded generator, after one that is discarded. Each task jumps ahead to its
    own part of the sequence, so the driver draws nothing."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in batch.column(0).to_pylist():
                u = Drand48(seed).jump(1 + part * DRAWS).take(min(DRAWS, n - part * DRAWS))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(u)) + part * DRAWS), pa.array((u * size).astype(np.int64))], ["k", "id"])

    parts = -(-n // DRAWS)
    return spark.range(0, parts, 1, max(1, min(parts, 4096))).mapInArrow(run, "k long, id long")


def random(points: DataFrame, n: int, seed: int = 12345, unique: bool = False) -> DataFrame:
    """n draws with replacement; `unique` draws again instead of repeating."""
    spark, size = points.sparkSession, points.count()
    if not unique:
        return draws(spark, n, size, seed).select(F.col("k").cast("int").alias("rank"), "id")
    if n > size:
        raise ValueError("more distinct landmarks than points")
    many = n + n // 4 + 16
    while True:  # as many draws as give n different ones; the first of each counts
        first = draws(spark, many, size, seed).groupBy("id").agg(F.min("k").alias("k"))
        if first.count() >= n:
            break
        many *= 2
    return numbered(first, "k").where(F.col("rank") < n).select(F.col("rank").cast("int").alias("rank"), "id")


def local(points: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, x and w on the driver, in order of ids; refused beyond IN_MEMORY numbers."""
    size = points.agg(F.sum(F.size("x"))).first()[0] or 0
    if size > IN_MEMORY:
        raise ValueError(f"{size} numbers: more than {IN_MEMORY} are not gathered")
    t = points.select("id", "x", "w").toArrow().sort_by("id")
    return t["id"].to_numpy(), matrix(t["x"]), t["w"].to_numpy()


def farthest_rows(x: np.ndarray, n: int, first: int, metric: Metric) -> tuple[list[int], np.ndarray, float]:
    """Rows in order of selection, each point's distance to them before the last joined, and the last's distance."""
    chosen, least, last = [first], metric.matrix(x, x[first : first + 1])[:, 0], 0.0
    while len(chosen) < min(n, len(x)):
        k = int(least.argmax())  # the lowest at a tie
        last = float(least[k])
        chosen.append(k)
        least = np.minimum(least, metric.matrix(x, x[k : k + 1])[:, 0])
    return chosen, least, last


def minmax(points: DataFrame, n: int, first: int = 0, metric: Metric = Metric()) -> DataFrame:
    """rank, id, distance (to the landmarks before it) by farthest-point selection from the point with id `first`."""
    spark = points.sparkSession
    size = points.agg(F.sum(F.size("x"))).first()[0] or 0
    if size <= IN_MEMORY:
        ids, x, _ = local(points)
        if not len(ids):
            return spark.createDataFrame([], "rank int, id long, distance double")
        rows, _, _ = farthest_rows(x, n, int(np.searchsorted(ids, first)), metric)
        d = [0.0] + [float(metric.matrix(x[rows[:k]], x[rows[k] : rows[k] + 1]).min()) for k in range(1, len(rows))]
        return spark.createDataFrame([(k, int(ids[r]), v) for k, (r, v) in enumerate(zip(rows, d))], "rank int, id long, distance double")
    return minmax_distributed(points, n, first, metric)


def minmax_of_pairs(pairs: DataFrame | Callable[[int], DataFrame], n: int, first: int = 0, spark: SparkSession | None = None) -> DataFrame:
    """rank, id, distance by farthest-point selection over a similarity relation: a table (i, j, d), or a function that gives j, d of an id's row, as
    `pairs.relation` does. A table is written once, sorted by i within files dealt by it, so that a round reads the newest landmark's pairs only;
    of a function's relation nothing but the landmarks' rows is made. Each point's least distance so far is a table that the round folds them
    into, -1 for landmarks."""
    schema = "j long, least double"
    if callable(pairs):
        row, spark = pairs, spark or SparkSession.active()
    else:
        spark = pairs.sparkSession
        both = pairs.select("i", "j", "d").union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
        path = shared_path(spark, "relation")
        both.repartition("i").sortWithinPartitions("i").write.parquet(path)
        row = lambda i: spark.read.parquet(path).where(F.col("i") == i)
    chosen, newest = [(0, first, 0.0)], first
    least = spark.createDataFrame([(first, -1.0)], schema)
    while len(chosen) < n:
        near = row(newest).groupBy("j").agg(F.min("d").alias("d"))
        marked = least.select("j", F.when(F.col("j") == newest, -1.0).otherwise(F.col("least")).alias("least"))
        table = shared_path(spark, "least")
        marked.join(near, "j", "full_outer").select("j", F.coalesce(F.least("least", "d"), "least", "d").alias("least")).write.parquet(table)
        least = spark.read.schema(schema).parquet(table)
        top = least.where("least >= 0").agg(F.max_by(F.struct("j", "least"), F.struct("least", -F.col("j"))).alias("t")).first()["t"]
        if top is None:
            break
        newest = int(top["j"])
        chosen.append((len(chosen), newest, float(top["least"])))
    return spark.createDataFrame(chosen, "rank int, id long, distance double")


def minmax_distributed(points: DataFrame, n: int, first: int, metric: Metric = Metric()) -> DataFrame:
    spark = points.sparkSession
    state = points.select("id", "x", F.lit(float("inf")).alias("least"))
    start = points.where(F.col("id") == first).select("id", "x").first()
    chosen, fresh = [(0, int(start["id"]), 0.0)], [start["x"]]

    def folded(fresh: list, best: bool):
        new = np.array(fresh, float)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = matrix(pa.chunked_array([batch.column(1)]))
                if not len(x):
                    continue
                least = np.minimum(batch.column(2).to_numpy(), metric.matrix(x, new).min(1))
                rows = batch
                if best:
                    k = np.flatnonzero(least == least.max())
                    k = k[batch.column(0).to_numpy()[k].argmin()]
                    rows, least = batch.slice(int(k), 1), least[k : k + 1]
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(least)], ["id", "x", "least"])

        return run

    schema = "id long, x array<double>, least double"
    n = min(n, points.count())
    while len(chosen) < n:
        top = state.mapInArrow(folded(fresh, True), schema).agg(F.max_by(F.struct("id", "x", "least"), F.struct("least", -F.col("id"))).alias("t")).first()["t"]
        if top is None:
            break
        if top["least"] == 0:  # from here on it stays the same, as in `farthest_rows`
            chosen += [(k, int(top["id"]), 0.0) for k in range(len(chosen), n)]
            break
        chosen.append((len(chosen), int(top["id"]), float(top["least"])))
        fresh.append(top["x"])
        if len(fresh) >= SAVED:
            path = shared_path(spark, "farthest")
            state.mapInArrow(folded(fresh, False), schema).write.parquet(path)
            state, fresh = spark.read.schema(schema).parquet(path), [fresh[-1]]
    return spark.createDataFrame(chosen, "rank int, id long, distance double")


def resample(points: DataFrame, n: int, gamma: float = 1.0, seed: int = 12345, metric: Metric = Metric()) -> DataFrame:
    """Each next point is drawn with probability w * m^-gamma, m the sum over landmarks so far of distance^-gamma (1e200 at 0)."""
    ids, x, w = local(points)
    draw = Drand48(seed)
    draw()
    chosen, crowd = [int(draw() * len(ids))], np.zeros(len(ids))
    while len(chosen) < n:
        d = metric.matrix(x, x[chosen[-1] : chosen[-1] + 1])[:, 0]
        crowd += np.where(d > 0, np.where(d > 0, d, 1.0) ** -gamma, 1e200)
        p = np.cumsum(w * crowd**-gamma)
        chosen.append(min(int(np.searchsorted(p, draw() * p[-1], "right")), len(ids) - 1))
    return ranked(points.sparkSession, ids[chosen].tolist())


def staged(points: DataFrame, n: int, gamma: float = 1.0, wgamma: float = 1.0, seed: int = 12345, metric: Metric = Metric()) -> DataFrame:
    """sqrt(n N) farthest points cut the space into cells; each landmark is a uniform member of a cell drawn with probability
    mass^gamma. Returns rank, id, weight: the cell's mass^(wgamma / gamma), normalised."""
    ids, x, w = local(points)
    draw = Drand48(seed)
    draw()
    centers, _, _ = farthest_rows(x, max(1, int((n * len(ids)) ** 0.5)), int(draw() * len(ids)), metric)
    cell = np.concatenate([metric.matrix(x[at : at + 1024], x[centers]).argmin(1) for at in range(0, len(x), 1024)])
    mass = np.bincount(cell, w, len(centers)) ** gamma
    left, chosen, weight = mass.copy(), [], []
    taken = np.zeros(len(ids), bool)
    while len(chosen) < min(n, len(ids)):
        p = np.cumsum(left)
        c = min(int(np.searchsorted(p, draw() * p[-1], "right")), len(centers) - 1)
        members = np.flatnonzero((cell == c) & ~taken)
        if not len(members):
            left[c] = 0
            continue
        k = int(members[int(draw() * len(members))])
        taken[k] = True
        chosen.append(int(ids[k]))
        weight.append(mass[c] ** (wgamma / gamma) if gamma else 1.0)
    total = sum(weight) or 1.0
    return points.sparkSession.createDataFrame([(k, i, float(v / total)) for k, (i, v) in enumerate(zip(chosen, weight))], "rank int, id long, weight double")


def nearest_landmark(points: DataFrame, landmarks: DataFrame, metric: Metric = Metric()) -> DataFrame:
    """points with rank (of the nearest landmark, the lowest at a tie) and distance. landmarks: rank, x.

    Map-only: a set of up to BROADCAST numbers goes to every task; more are refused."""
    size = landmarks.agg(F.sum(F.size("x"))).first()[0] or 0
    if size > BROADCAST:
        raise ValueError(f"{size} numbers of landmarks: more than {BROADCAST} are not broadcast")
    t = landmarks.select("rank", "x").toArrow().sort_by("rank")
    known = points.sparkSession.sparkContext.broadcast((t["rank"].to_numpy(), matrix(t["x"]) if len(t) else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, y = known.value
        for batch in batches:
            if y is None or not len(batch):
                continue
            x = matrix(pa.chunked_array([batch.column(1)]))
            best, d = [], []
            for at in range(0, len(x), 1024):
                m = metric.matrix(x[at : at + 1024], y)
                k = m.argmin(1)
                best.append(rank[k])
                d.append(m[np.arange(len(m)), k])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(best), pa.int32()), pa.array(np.concatenate(d))], ["id", "x", "w", "rank", "distance"])

    return points.select("id", "x", "w").mapInArrow(run, "id long, x array<double>, w double, rank int, distance double")


def voronoi_weights(points: DataFrame, landmarks: DataFrame, metric: Metric = Metric()) -> DataFrame:
    """rank, weight: the share of all weight in the cell of each landmark that has any."""
    cells = nearest_landmark(points, landmarks, metric).groupBy("rank").agg(F.sum("w").alias("w"))
    return cells.crossJoin(F.broadcast(cells.agg(F.sum("w").alias("total")))).select("rank", (F.col("w") / F.col("total")).alias("weight"))


def coverage_radius(points: DataFrame, landmarks: DataFrame, metric: Metric = Metric()) -> DataFrame:
    """One row: the largest distance of a point to its landmark."""
    return nearest_landmark(points, landmarks, metric).agg(F.max("distance").alias("radius"))


def placed(points: DataFrame, chosen: DataFrame) -> DataFrame:
    """rank, id, x of selected ids; a point that was drawn twice appears twice."""
    return points.join(F.broadcast(chosen) if chosen.count() <= 100_000 else chosen, "id").select("rank", "id", "x")


def landmark_lines(chosen: DataFrame, index: bool = False, input_weight: bool = False, weight: bool = False, digits: int = 10) -> DataFrame:
    """rank, value: a line for each landmark (rank, id, x, and w, weight where asked): its id if `index`, x, which are coordinates or its row of a
    similarity block, the input weight if `index` and `input_weight`, the landmark's own weight if `weight`."""
    show = lambda c: scientific(c, digits)
    parts = [F.col("id").cast("string")] if index else []
    parts.append(F.array_join(scientific_all(F.col("x"), digits), " "))
    parts += ([show(F.col("w"))] if index and input_weight else []) + ([show(F.col("weight"))] if weight else [])
    return chosen.select("rank", F.concat_ws(" ", *parts).alias("value"))


def similarity_block(pairs: DataFrame, chosen: DataFrame, all_points: bool = False) -> DataFrame:
    """id, x: distances of a point to the landmarks, in order of their ranks; of landmarks (with their rank), or of all points, for the
    projection of what is out of the sample. pairs: i, j, d, each once; a point is at distance 0 from itself."""
    marks = chosen.select("rank", F.col("id").alias("mark"))
    both = pairs.select("i", "j", "d").union(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    ids = both.select("i").distinct()
    both = both.union(ids.select("i", F.col("i").alias("j"), F.lit(0.0).alias("d")))
    near = both.join(F.broadcast(marks) if chosen.count() <= 100_000 else marks, F.col("j") == F.col("mark"))
    rows = near.groupBy(F.col("i").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "d"))), lambda t: t["d"]).alias("x"))
    return rows if all_points else rows.join(chosen.select("rank", "id"), "id").select("rank", "id", "x")
