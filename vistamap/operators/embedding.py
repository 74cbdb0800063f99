"""Spectral embeddings: classical, spherical and toroidal scaling; locally linear embeddings.

Distances, centring and local weights are distributed. Classical scaling of points goes by their principal axes beyond MOST of them. Other
eigenproblems are solved on the driver and therefore bounded to MOST points: embed landmarks and project the rest (see projection)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistamap.functions.metrics import STRIP, Metric

from .numbering import shared_path
from .pairs import BLOCK, Sent, matrix, pair_join, pair_rows, self_tiles, sent

MOST = 6000
#: Weights of a sparse eigenproblem on the driver, 24 bytes each.
SPARSE = 20_000_000
#: Row means that are sent to points instead of a shuffle of both.
MEANS = 500_000


def centred(points: DataFrame, metric: Metric = Metric(), digits: int | None = None) -> DataFrame:
    """i, j (j <= i), m: -D^2 / 2 with column and row means taken off, without a matrix anywhere: row means come from tiles. digits: decimals that
    m is rounded to, in the tile."""
    def squares(a: pa.Table, b: pa.Table, on: np.ndarray) -> pa.Table:
        d = metric.matrix(matrix(a["x"]), matrix(b["x"])) if on.size else np.zeros(on.shape)
        d *= d
        if not on.all():
            d[~on] = 0
        return pa.table([np.concatenate([a["id"].to_numpy(), b["id"].to_numpy()]), np.concatenate([d.sum(1), d.sum(0)])], ["id", "s"])

    def pairs(a: pa.Table, b: pa.Table, on: np.ndarray) -> pa.Table:
        x, y = a["id"].to_numpy(), b["id"].to_numpy()
        own = x[:, None] == y[None]
        d = metric.matrix(matrix(a["x"]), matrix(b["x"])) if on.size else np.zeros(on.shape)
        ma, mb = a["mean"].to_numpy(), b["mean"].to_numpy()
        for at in range(0, len(d), STRIP):
            m, same = d[at : at + STRIP], own[at : at + STRIP]
            if same.any():
                m[same] = 0
            m *= m
            m -= ma[at : at + STRIP, None]
            m -= mb
            m *= -0.5
            m -= half
        t = pair_rows(x, y, d, on | own, digits, "m")
        return t if digits is None else t.set_column(2, "m", pc.add(t["m"], 0.0))  # no -0.0

    p = points.select("id", "x")
    n = p.count()
    path, spark = shared_path(points.sparkSession, "means"), points.sparkSession
    known = sent(p)
    self_tiles(known or p, squares, "id long, s double").groupBy("id").agg((F.sum("s") / n).alias("mean")).write.parquet(path)  # else each use goes over all pairs
    if known:
        known.rows.destroy()
    means = spark.read.schema("id long, mean double").parquet(path)
    half = means.agg(F.avg("mean") / 2).first()[0] or 0.0
    return self_tiles(p.join(F.broadcast(means) if n <= MEANS else means, "id"), pairs, "i long, j long, m double")


def gathered(points: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n = points.count()
    if n > MOST:
        raise ValueError(f"{n} points: more than {MOST} are not embedded at once; select landmarks and project the rest")
    t = points.select("id", "x").toArrow().sort_by("id")
    return t["id"].to_numpy(), matrix(t["x"])


def from_pairs(pairs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """ids and the matrix of distances of a similarity relation (i, j, d), symmetric where only one order is given."""
    ids = np.sort(pairs.select(F.col("i").alias("id")).union(pairs.select("j")).distinct().limit(MOST + 1).toArrow()["id"].to_numpy())
    if len(ids) > MOST:
        raise ValueError(f"more than {MOST} points are not embedded at once")
    t = pairs.select("i", "j", "d").toArrow()
    hd = np.zeros((len(ids), len(ids)))
    i, j = np.searchsorted(ids, t["i"].to_numpy()), np.searchsorted(ids, t["j"].to_numpy())
    hd[i, j] = hd[j, i] = t["d"].to_numpy()
    return ids, hd


def related(pairs: DataFrame) -> np.ndarray:
    """ids of a relation in order."""
    return np.sort(pairs.select(F.explode(F.array("i", "j")).alias("id")).distinct().toArrow()["id"].to_numpy())


def mds_of_pairs(pairs: DataFrame, d: int = 2) -> tuple[DataFrame, dict]:
    """Classical scaling of a similarity relation; beyond MOST points, by products of the relation with columns."""
    ids = related(pairs)
    if len(ids) > MOST:
        return scaled_relation(pairs, ids, d)
    ids, hd = from_pairs(pairs)
    y, report = scaling(hd, d)
    return layout(pairs.sparkSession, ids, y), report


#: Numbers in the columns that are multiplied with a relation, which every task gets.
COLUMNS = 10_000_000
#: Pairs that are multiplied at once, and rows of a product that are summed at once.
BATCH, ROWS = 1 << 19, 4096


def scaled_relation(pairs: DataFrame, ids: np.ndarray, d: int) -> tuple[DataFrame, dict]:
    """The leading eigenvectors of the centred matrix, by a block Krylov method whose products go over the cluster: the pairs, which are read
    once a product, are kept nowhere and made into no matrix. A relation that gives both orders of a pair counts it once."""
    n, spark = len(ids), pairs.sparkSession
    if n * (min(d + 8, n) + 1) > COLUMNS:
        raise ValueError(f"{n} points in {d} dimensions: more than {COLUMNS} numbers are not multiplied with a relation")
    pairs = pairs.where("i <> j").select("i", "j", "d")
    if pairs.agg(F.count_distinct(F.col("i") > F.col("j"))).first()[0] > 1:
        pairs = pairs.select(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j"), "d").dropDuplicates(["i", "j"])
    return scaled_products(spark, ids, d, lambda x: multiplied(pairs, ids, x), lambda y: misfit(pairs, ids, y))


def scaled_products(spark: SparkSession, ids: np.ndarray, d: int, times: Callable[[np.ndarray], np.ndarray], missed: Callable[[np.ndarray], float]) -> tuple[DataFrame, dict]:
    """scaled_relation of squared distances that are known by their products with columns."""
    n = len(ids)
    sums = np.zeros(n)

    def apply(x: np.ndarray) -> np.ndarray:
        centred = np.ones((n, x.shape[1] + 1))
        np.subtract(x, x.mean(0), out=centred[:, :-1])
        y = times(centred)
        sums[:] = y[:, -1]
        y = y[:, :-1]
        y -= y.mean(0)
        y *= -0.5
        return y

    values, vectors = leading(apply, n, d, min(d + 8, n))
    y = oriented(vectors) * np.sqrt(np.maximum(values, 0))
    trace = sums.sum() / (2 * n)
    y = np.pad(y, ((0, 0), (0, min(d, n) - y.shape[1])))
    report = Report({"eigenvalues": values, "explained": values.sum() / trace if trace else math.nan}, lambda: 2 * missed(y) / max(n * (n - 1), 1))
    return layout(spark, ids, y), report


def mds_of_distances(points: DataFrame, d: int = 2, metric: Metric = Metric()) -> tuple[DataFrame, dict]:
    """mds_of_pairs of the relation of all distances of points. Beyond MOST points that can be sent to every task, the relation has no rows:
    each product makes its distances a tile at a time and multiplies them there."""
    p = points.select("id", "x")
    n = p.count()
    if n <= MOST or (known := sent(p)) is None:
        return mds_of_pairs(pair_join(points, metric), d)
    if n * (min(d + 8, n) + 1) > COLUMNS:
        raise ValueError(f"{n} points in {d} dimensions: more than {COLUMNS} numbers are not multiplied with a relation")
    ids = np.sort(p.select("id").toArrow()["id"].to_numpy())
    return scaled_products(p.sparkSession, ids, d, lambda x: multiplied_tiles(known, x, metric), lambda y: misfit(pair_join(p, metric), ids, y))


def multiplied_tiles(known: Sent, x: np.ndarray, metric: Metric) -> np.ndarray:
    """The product of the matrix of squared distances of points with columns x, in order of ids. A task makes whole rows of the product, so
    nothing is shuffled or summed."""
    rows, n = known.rows, len(x)
    columns = known.spark.sparkContext.broadcast(x)
    blocks = -(-n // BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, x = matrix(rows.value["x"]), columns.value
        for batch in batches:
            for at in batch.column(0).to_numpy() * BLOCK:
                own = points[at : at + BLOCK]
                out = np.zeros((len(own), x.shape[1]))
                for k in range(0, n, BLOCK):
                    square = metric.matrix(own, points[k : k + BLOCK])
                    square *= square
                    if k == at:
                        np.fill_diagonal(square, 0)
                    out += square @ x[k : k + BLOCK]
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([out.tobytes()], pa.binary())], ["at", "part"])

    out = np.zeros(x.shape)
    for row in known.spark.range(0, blocks, 1, blocks).mapInArrow(run, "at long, part binary").collect():
        out[row["at"] : row["at"] + BLOCK] = np.frombuffer(row["part"]).reshape(-1, x.shape[1])
    columns.destroy()
    return out


def leading(apply: Callable[[np.ndarray], np.ndarray], n: int, d: int, width: int, rounds: int = 200, tolerance: float = 1e-9, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The d largest eigenvalues and vectors of a symmetric matrix known by its products with columns: a basis grows by the residuals of its
    leading vectors until these are within tolerance of the largest value, and starts anew from the vectors at six blocks."""
    new = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    kept, k = [np.empty((n, 7 * width), order="F") for _ in range(2)], 0  # memory is used as far as columns are filled
    for _ in range(rounds):
        for table, part in zip(kept, (new, apply(new))):
            table[:, k : k + part.shape[1]] = part
        k += new.shape[1]
        del new, part
        basis, image = (table[:, :k] for table in kept)
        t = basis.T @ image
        values, u = np.linalg.eigh((t + t.T) / 2)
        size, values, u = np.abs(values).max(), values[::-1][:width], u[:, ::-1][:, :width]
        left = image @ u
        less(left, basis, u * values)
        if np.sqrt(np.einsum("ij,ij->j", left[:, :d], left[:, :d])).max() <= tolerance * size or k == n:
            return values[:d], basis @ u[:, :d]
        if k >= 6 * width:
            for table in kept:
                table[:, :width] = table[:, :k] @ u
            k = width
            basis = kept[0][:, :k]
        for _ in range(2):
            less(left, basis, basis.T @ left)
        _, s, v = np.linalg.svd(np.linalg.qr(left, mode="r"))
        v = (v[s > 1e-13 * size] / s[s > 1e-13 * size, None])[: n - k].T
        new = left @ v
        del left
        less(new, basis, basis.T @ new)
        new = np.linalg.qr(new)[0]
        if not new.shape[1]:
            return values[:d], basis @ (u[:, :d] if len(u) == k else np.eye(k)[:, :d])
    raise ValueError(f"{d} eigenvectors of {n} points didn't settle in {rounds} products")


def less(x: np.ndarray, basis: np.ndarray, by: np.ndarray) -> None:
    """x -= basis @ by, some rows at a time."""
    for at in range(0, len(x), ROWS):
        x[at : at + ROWS] -= basis[at : at + ROWS] @ by


def places(ids: np.ndarray, of: np.ndarray) -> np.ndarray:
    return of - ids[0] if ids[-1] - ids[0] + 1 == len(ids) else np.searchsorted(ids, of)


def packed(of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The different places in `of`, and each one's position among them."""
    there = np.zeros(n, bool)
    there[of] = True
    different = np.flatnonzero(there)
    at = np.empty(n, np.int64)
    at[different] = np.arange(len(different))
    return different, at[of]


def gathered_batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j and d of about `most` pairs at a time."""
    kept, rows = [], 0
    for batch in batches:
        kept.append(batch)
        rows += len(batch)
        if rows >= most:
            t = pa.Table.from_batches(kept)
            yield t["i"].to_numpy(), t["j"].to_numpy(), t["d"].to_numpy()
            kept, rows = [], 0
    if rows:
        t = pa.Table.from_batches(kept)
        yield t["i"].to_numpy(), t["j"].to_numpy(), t["d"].to_numpy()


def multiplied(pairs: DataFrame, ids: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The product of the symmetric matrix of squared distances with columns x, in order of ids. Pairs that meet few points, as those of a tile
    do, are multiplied as a matrix."""
    n, width = x.shape
    known = pairs.sparkSession.sparkContext.broadcast((ids, x))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = known.value
        out, touched = np.zeros((n, width)), np.zeros(n, bool)
        for i, j, distance in gathered_batches(batches, BATCH):
            i, j, square = places(ids, i), places(ids, j), np.square(distance)
            rows, r = packed(i, n)
            columns, c = packed(j, n)
            if len(rows) * len(columns) <= 8 * len(i):
                m = np.zeros((len(rows), len(columns)))
                m[r, c] = square
                out[rows] += m @ x[columns]
                out[columns] += m.T @ x[rows]
            else:
                for k in range(width):
                    out[rows, k] += np.bincount(r, square * x[j, k], len(rows))
                    out[columns, k] += np.bincount(c, square * x[i, k], len(columns))
            touched[rows] = touched[columns] = True
        for at in range(0, n, ROWS):
            if touched[at : at + ROWS].any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([out[at : at + ROWS].tobytes()], pa.binary())], ["at", "part"])

    def total(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = 0
        for batch in batches:
            for part in batch["part"]:
                s = s + np.frombuffer(part.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([s.tobytes()], pa.binary())], ["at", "part"])

    out = np.zeros((n, width))
    for row in pairs.mapInArrow(run, "at long, part binary").groupBy("at").applyInArrow(total, "at long, part binary").toLocalIterator():
        out[row["at"] : row["at"] + ROWS] = np.frombuffer(row["part"]).reshape(-1, width)
    known.destroy()
    return out


def misfit(pairs: DataFrame, ids: np.ndarray, y: np.ndarray) -> float:
    """The sum over pairs of the squared difference of distance and distance in a layout."""
    known = pairs.sparkSession.sparkContext.broadcast((ids, y))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y = known.value
        s = sum(float(((d - Metric().rows(y[places(ids, i)], y[places(ids, j)])) ** 2).sum()) for i, j, d in gathered_batches(batches, BATCH >> 3))
        yield pa.RecordBatch.from_arrays([pa.array([float(s)])], ["s"])

    return pairs.mapInArrow(run, "s double").agg(F.sum("s")).first()[0] or 0.0


def linear_map(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The affine map (last row: shift) that takes rows of x nearest to rows of y, by the pseudo-inverse."""
    return np.linalg.pinv(np.column_stack([x, np.ones(len(x))])) @ y


def oriented(v: np.ndarray) -> np.ndarray:
    """Columns with their largest component positive."""
    return v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1, 1)


def top(m: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    values, vectors = np.linalg.eigh(m)
    return values[::-1][:d], oriented(vectors[:, ::-1][:, :d])


def scaling(hd: np.ndarray, d: int = 2) -> tuple[np.ndarray, dict]:
    """Classical scaling of a matrix of distances: layout, and eigenvalues, explained fraction and residual per pair."""
    m = -0.5 * hd * hd
    m = m - m.mean(0)
    m = m - m.mean(1)[:, None]
    values, vectors = top(m, d)
    y = vectors * np.sqrt(np.maximum(values, 0))
    trace = np.trace(m)
    n = len(hd)
    residual = ((hd - Metric().matrix(y, y)) ** 2).sum() / max(n * (n - 1), 1)
    return y, {"eigenvalues": values, "explained": values.sum() / trace if trace else math.nan, "residual": residual}


def spherical(hd: np.ndarray, d: int = 2) -> tuple[np.ndarray, float]:
    """Angles on a d-sphere of radius max(D) / pi: the leading d + 1 eigenvectors of R^2 cos(D / R), normalised; the radius."""
    r = hd.max() / math.pi or 1.0
    m = r * r * np.cos(hd / r)
    np.fill_diagonal(m, r * r)
    values, vectors = top(m, d + 1)
    x = vectors * np.sqrt(np.maximum(values, 0))
    x /= np.maximum(np.linalg.norm(x, axis=1), 1e-300)[:, None]
    angles = np.empty((len(x), d))
    for k in range(d - 1):
        angles[:, k] = np.arctan2(np.linalg.norm(x[:, k + 1 :], axis=1), x[:, k])
    angles[:, d - 1] = np.arctan2(x[:, d], x[:, d - 1])
    return angles / math.pi, r


def toroidal(hd: np.ndarray, d: int = 2) -> np.ndarray:
    """One angle after the other: a circle is fitted, and its squared arcs are taken off the squared distances."""
    left, out = hd**2, []
    for _ in range(d):
        angle, r = spherical(np.sqrt(np.abs(left)), 1)
        out.append(angle[:, 0])
        arc = Metric("torus", 2.0).matrix(angle, angle) * math.pi * r
        left = left - arc**2
    return np.stack(out, 1)


def mds(points: DataFrame, d: int = 2, metric: Metric = Metric(), mode: str = "classical") -> tuple[DataFrame, dict]:
    """(id, y) and a report. Signs are fixed by `oriented`."""
    if mode == "classical" and metric.kind == "euclid" and points.count() > MOST:
        return principal(points, d)
    ids, x = gathered(points)
    hd = metric.matrix(x, x) * (1 - np.eye(len(x)))
    report: dict = {}
    if mode == "classical":
        y, report = scaling(hd, d)
    elif mode == "sphere":
        y, report["radius"] = spherical(hd, d)
    elif mode == "torus":
        y = toroidal(hd, d)
    else:
        raise ValueError(mode)
    return layout(points.sparkSession, ids, y), report


class Report(dict):
    """A report whose residual, a pass over all pairs, is made when it is asked for."""

    def __init__(self, known: dict, residual: Callable[[], float]):
        super().__init__(known)
        self._residual = residual

    def __missing__(self, key: str) -> float:
        if key != "residual":
            raise KeyError(key)
        self[key] = self._residual()
        return self[key]


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum of part(x) over batches of points x; a task returns one array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(shape)
        for batch in batches:
            if len(batch):
                out += part(matrix(pa.chunked_array([batch.column(0)])))
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["s"])

    out = np.zeros(shape)
    for row in rows.select("x").mapInArrow(run, "s binary").toLocalIterator():
        out += np.frombuffer(row["s"]).reshape(shape)
    return out


def principal(points: DataFrame, d: int = 2) -> tuple[DataFrame, dict]:
    """Classical scaling of Euclidean distances by the principal axes of the points: x x' and x' x, x centred, have the same eigenvalues, and the
    layout is x along the axes. Points stay on the cluster; a matrix of coordinates by coordinates is on the driver."""
    p = points.select("id", "x")
    n, dims = p.agg(F.count("*"), F.max(F.size("x"))).first()
    if dims > MOST:
        raise ValueError(f"{n} points of {dims} coordinates: more than {MOST} of either are not embedded at once")
    mean = summed(p, lambda x: x.sum(0), (dims,)) / n
    gram = summed(p, lambda x: (x - mean).T @ (x - mean), (dims, dims))
    values, axes = top(gram, d)
    values, axes = np.pad(values, (0, d - len(values))), np.pad(axes, ((0, 0), (0, d - axes.shape[1])))

    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                ids, y = batch.column(0).to_numpy(), (matrix(pa.chunked_array([batch.column(1)])) - mean) @ axes
                size = np.abs(y)
                at = [min(np.flatnonzero(size[:, k] == size[:, k].max()), key=lambda r: ids[r]) for k in range(d)]
                yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array(ids[at]), pa.array(y[at, range(d)])], ["k", "id", "y"])

    best = p.mapInArrow(extremes, "k int, id long, y double").groupBy("k").agg(F.max_by("y", F.struct(F.abs("y"), -F.col("id"))).alias("y"))
    for row in best.collect():
        axes[:, row["k"]] *= -1 if row["y"] < 0 else 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                y = (matrix(pa.chunked_array([batch.column(1)])) - mean) @ axes
                yield pa.RecordBatch.from_arrays([batch.column(0), lists(y)], ["id", "y"])

    def residual() -> float:
        both = self_tiles(p.join(y.withColumnRenamed("id", "yid"), F.col("id") == F.col("yid")).select("id", "x", "y"), squares, "s double")
        return 2 * (both.agg(F.sum("s")).first()[0] or 0.0) / max(n * (n - 1), 1)

    def squares(a: pa.Table, b: pa.Table, on: np.ndarray) -> pa.Table:
        hd, ld = Metric().matrix(matrix(a["x"]), matrix(b["x"])), Metric().matrix(matrix(a["y"]), matrix(b["y"]))
        return pa.table([[float(((hd - ld)[on] ** 2).sum())]], ["s"])

    y, trace = p.mapInArrow(run, "id long, y array<double>"), np.trace(gram)
    return y, Report({"eigenvalues": values, "explained": values.sum() / trace if trace else math.nan}, residual)


def lists(y: np.ndarray) -> pa.ListArray:
    """Rows of a matrix as arrays."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), pa.array(np.ascontiguousarray(y, float).ravel()))


def layout(spark, ids: np.ndarray, y: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table([pa.array(ids), lists(y)], ["id", "y"]))


def local_weights(points: DataFrame, edges: DataFrame, smooth: float = -1e-5, tangent: int = 0) -> DataFrame:
    """i, j, v: weights that rebuild each point from its neighbours, one group of neighbours a task row.

    The Gram matrix of the neighbourhood gets a ridge: `smooth`, or |smooth| times its Frobenius norm if negative. `tangent` > 0
    first projects the neighbourhood on that many principal directions."""
    p = points.select("id", "x")
    rows = edges.select("i", "j").join(p.select(F.col("id").alias("j"), F.col("x").alias("xj")), "j").join(p.select(F.col("id").alias("i"), F.col("x").alias("xi")), "i")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("j")
        g = matrix(t["xj"]) - matrix(t["xi"])
        if tangent:
            u, s, v = np.linalg.svd(g, full_matrices=False)
            g = u[:, :tangent] * s[:tangent]
        c = g @ g.T
        c = c + np.eye(len(c)) * (smooth if smooth >= 0 else -smooth * np.linalg.norm(c) or 1e-12)
        w = np.linalg.lstsq(c, np.ones(len(c)), rcond=None)[0]
        return pa.table([t["i"], t["j"], w / w.sum()], ["i", "j", "v"])

    return rows.select("i", "j", "xi", "xj").groupBy("i").applyInArrow(run, "i long, j long, v double")


def rebuilt_errors(points: DataFrame, weights: DataFrame, column: str = "x") -> DataFrame:
    """id, error: the length of the difference between each point's array and the weighted sum of its neighbours' (i, j, v). The root of
    the mean of its squares is the error of the embedding."""
    p = points.select("id", F.posexplode(column).alias("k", "a"))
    near = weights.join(p.select(F.col("id").alias("j"), "k", "a"), "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("a")).alias("s"))
    both = near.join(p.select(F.col("id").alias("i"), "k", "a"), ["i", "k"])
    return both.groupBy(F.col("i").alias("id")).agg(F.sqrt(F.sum((F.col("s") - F.col("a")) * (F.col("s") - F.col("a")))).alias("error"))


def smallest(apply: Callable[[np.ndarray], np.ndarray], n: int, k: int, rounds: int = 60, tolerance: float = 1e-9, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """The k smallest eigenvalues and vectors of a symmetric matrix without negative ones, known by its products with columns: inverse iteration on a
    block, each solved by conjugate gradients, with a Ritz step a round. Memory is that of a few blocks, not of the matrix."""
    x = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, min(n, 2 * k + 2))))[0]
    values = np.full(x.shape[1], np.inf)
    for _ in range(rounds):
        shift = max(1e-12, 1e-3 * min(values[min(k, len(values)) - 1], 1.0)) if np.isfinite(values[0]) else 1e-3
        x = np.linalg.qr(solved(lambda v, s=shift: apply(v) + s * v, x))[0]
        q, u = np.linalg.eigh(x.T @ apply(x))
        x, before, values = x @ u, values, q
        if np.abs(values[:k] - before[:k]).max() <= tolerance * max(1.0, abs(values[k - 1])):
            break
    return values[:k], oriented(x[:, :k])


def solved(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int = 400, tolerance: float = 1e-10) -> np.ndarray:
    """Conjugate gradients for several right sides at once."""
    x, r = np.zeros_like(b), b.copy()
    p, size = r.copy(), (r * r).sum(0)
    for _ in range(steps):
        if (size <= tolerance**2 * (b * b).sum(0)).all():
            break
        m = apply(p)
        a = np.where(size > 0, size / np.maximum((p * m).sum(0), 1e-300), 0)
        x, r = x + a * p, r - a * m
        new = (r * r).sum(0)
        p, size = r + np.where(size > 0, new / np.maximum(size, 1e-300), 0) * p, new
    return x


def hessian_rows(points: DataFrame, edges: DataFrame, d: int = 2) -> DataFrame:
    """r, j, v: rows of the local Hessian estimators of each neighbourhood."""
    p = points.select("id", "x")
    rows = edges.select("i", "j").join(p.select(F.col("id").alias("j"), F.col("x").alias("xj")), "j").join(p.select(F.col("id").alias("i"), F.col("x").alias("xi")), "i")

    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by("j")
        g = matrix(t["xj"]) - matrix(t["xi"])
        u = np.linalg.svd(g - g.mean(0), full_matrices=False)[0][:, :d]
        u = np.pad(u, ((0, 0), (0, d - u.shape[1])))
        products = [u[:, a] * u[:, b] for a in range(d) for b in range(a, d)]
        q = np.linalg.qr(np.column_stack([np.ones(len(g)), u, *products]))[0][:, d + 1 :]
        r, c = np.meshgrid(np.arange(q.shape[1]), np.arange(len(g)), indexing="ij")
        name = t["i"].to_numpy()[0] * (d * (d + 1) // 2) + r.ravel()
        return pa.table([name, t["j"].to_numpy()[c.ravel()], q.T.ravel()], ["r", "j", "v"])

    return rows.select("i", "j", "xi", "xj").groupBy("i").applyInArrow(run, "r long, j long, v double")


def lle(points: DataFrame, edges: DataFrame, d: int = 2, mode: str = "lle", smooth: float = -1e-5, tangent: int = 2) -> tuple[DataFrame, dict]:
    """(id, y) of points with edges, and a report. mode: lle, llte (tangent space) or hlle (Hessian)."""
    path, kinds = shared_path(points.sparkSession, "edges"), edges.select("i", "j").schema
    edges.select("i", "j").write.parquet(path)  # else each use finds the neighbours anew
    edges = points.sparkSession.read.schema(kinds).parquet(path)
    kept = points.join(edges.select(F.col("i").alias("id")), "id", "left_semi")
    if mode != "hlle" and kept.count() > MOST:
        return lle_large(kept, edges, d, smooth, tangent if mode == "llte" else 0)
    ids, _ = gathered(kept)
    n = len(ids)
    m = np.zeros((n, n))
    if mode == "hlle":
        t = hessian_rows(points, edges, d).toArrow()
        r, row = np.unique(t["r"].to_numpy(), return_inverse=True)
        h = np.zeros((len(r), n))
        h[row, np.searchsorted(ids, t["j"].to_numpy())] = t["v"].to_numpy()
        m = h.T @ h
    else:
        t = local_weights(points, edges, smooth, tangent if mode == "llte" else 0).toArrow()
        w = np.eye(n)
        w[np.searchsorted(ids, t["i"].to_numpy()), np.searchsorted(ids, t["j"].to_numpy())] -= t["v"].to_numpy()
        m = w.T @ w
    values, vectors = np.linalg.eigh(m)
    y = oriented(vectors[:, 1 : d + 1]) * math.sqrt(n)
    if mode == "hlle":  # coordinates of unit length in each neighbourhood
        e = edges.toArrow()
        near = np.zeros((n, n))
        near[np.searchsorted(ids, e["i"].to_numpy()), np.searchsorted(ids, e["j"].to_numpy())] = 1
        r = (y * near.sum(0)[:, None]).T @ y
        q, u = np.linalg.eigh(r / len(y))
        y = y @ (u * q**-0.5) @ u.T
    report = {"eigenvalues": values[: d + 2], "error": float(np.trace(y.T @ m @ y)) / n, "next": float(values[d + 1]) if n > d + 1 else None}
    return layout(points.sparkSession, ids, y), report


def lle_large(points: DataFrame, edges: DataFrame, d: int = 2, smooth: float = -1e-5, tangent: int = 0) -> tuple[DataFrame, dict]:
    """LLE of more points than MOST: the weights, and a few columns, are on the driver as sparse rows; more than SPARSE weights are refused."""
    weights = local_weights(points, edges, smooth, tangent)
    n_weights = edges.count()
    if n_weights > SPARSE:
        raise ValueError(f"{n_weights} weights: more than {SPARSE} are not gathered")
    ids = np.sort(points.select("id").distinct().toArrow()["id"].to_numpy())
    t = weights.toArrow()
    i, j, v = np.searchsorted(ids, t["i"].to_numpy()), np.searchsorted(ids, t["j"].to_numpy()), t["v"].to_numpy()
    n = len(ids)

    def times(r: np.ndarray, c: np.ndarray, x: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(r, v * x[c, k], n) for k in range(x.shape[1])], 1)

    def apply(x: np.ndarray) -> np.ndarray:
        y = x - times(i, j, x)
        return y - times(j, i, y)

    values, vectors = smallest(apply, n, d + 2)
    y = vectors[:, 1 : d + 1] * math.sqrt(n)
    return layout(points.sparkSession, ids, y), {"eigenvalues": values, "error": float((y * apply(y)).sum()) / n, "next": float(values[d + 1])}
