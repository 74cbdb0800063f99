"""All-pairs operators over points (id, x array<double>, other columns).

A blocked operator deals the points to groups, and groups that meet are cut into tiles of two blocks; a tile's function gets two Arrow tables and
returns little, so no row is made for a pair. Up to BROADCAST numbers, points are sent to every task and nothing is shuffled; beyond, a task holds
two groups and a tile. A lost executor costs its groups' meetings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vistamap.functions.metrics import Metric, rounded

BLOCK = 1024
#: Groups that rows are dealt to, and so copies of a row in the shuffle.
GROUPS = 16
#: Numbers of points that are sent to every task.
BROADCAST = 10_000_000
#: Rows of a meeting's tiles that are merged at once.
MERGED = 400_000


def points(df: DataFrame, id: str, x: str, w: Column | None = None) -> DataFrame:
    """id long, x array<double>, w double (1 by default). Rows with a null id or point are left out."""
    return df.where(F.col(id).isNotNull() & F.col(x).isNotNull()).select(F.col(id).cast("long").alias("id"), F.col(x).cast("array<double>").alias("x"), (F.lit(1.0) if w is None else w.cast("double")).alias("w"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def meetings(df: DataFrame, block: int) -> DataFrame:
    """Rows for each meeting (i <= j) of their group with another or itself; `second` marks those of group j where i < j."""
    groups = max(1, min(GROUPS, -(-df.count() // block)))
    dealt = df.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    return dealt.select(F.least("group", "other").alias("i"), F.greatest("group", "other").alias("j"), (F.col("group") > F.col("other")).alias("second"), *df.columns)


class Sent(NamedTuple):
    """Rows in order of id that every task gets."""

    spark: SparkSession
    rows: Broadcast


def sent(df: DataFrame) -> Sent | None:
    """The rows of df; None if they hold more than BROADCAST numbers."""
    sizes = [F.coalesce(F.size(c), F.lit(0)) if kind.startswith("array") else F.lit(1) for c, kind in df.dtypes]
    if (df.agg(F.sum(sum(sizes, F.lit(0)).cast("long"))).first()[0] or 0) > BROADCAST:
        return None
    return Sent(df.sparkSession, df.sparkSession.sparkContext.broadcast(df.toArrow().sort_by("id").combine_chunks()))


def tiles(function: Callable[[pa.Table, pa.Table, np.ndarray], pa.Table], first: pa.Table, second: pa.Table | None, block: int) -> Iterator[pa.RecordBatch]:
    """What the function returns for the blocks of two groups without a row in common, or of one group with itself."""
    a_blocks, b_blocks = ([t.slice(at, block) for at in range(0, len(t), block)] for t in (first, first if second is None else second))
    for m, a in enumerate(a_blocks):
        for k, b in enumerate(b_blocks[m:] if second is None else b_blocks):
            x, y = a["id"].to_numpy(), b["id"].to_numpy()
            on = x[:, None] > y[None] if second is None and k == 0 else x[:, None] != y[None]
            yield from function(a, b, on).to_batches()


def merged(found: Iterator[pa.RecordBatch], merge: Callable[[pa.Table], pa.Table] | None) -> Iterator[pa.RecordBatch]:
    """What the tiles of a meeting return, merged whenever MERGED rows have come."""
    if merge is None:
        yield from found
        return
    kept, rows = [], 0
    for batch in found:
        kept.append(batch)
        rows += len(batch)
        if rows >= MERGED:
            kept, rows = merge(pa.Table.from_batches(kept)).to_batches(), 0
    if kept:
        yield from merge(pa.Table.from_batches(kept)).to_batches()


def self_tiles(df: DataFrame | Sent, function: Callable[[pa.Table, pa.Table, np.ndarray], pa.Table], schema: str, block: int = BLOCK, *, merge: Callable[[pa.Table], pa.Table] | None = None) -> DataFrame:
    """function(a, b, on) for each tile of two blocks; on[r, c] marks the pairs of rows of a and b that count, so that each unordered
    pair of different ids counts once.

    Rows are in at most GROUPS groups, and two groups that meet are cut into blocks where they lie; what a function returns goes on before the
    next tile, or with those of the same meeting through `merge`. Rows that aren't sent are shuffled, GROUPS times at most however many there are."""
    if known := df if isinstance(df, Sent) else sent(df):
        rows = known.rows
        n = len(rows.value)
        groups = max(1, min(GROUPS, -(-n // block)))
        cuts = [n * k // groups for k in range(groups + 1)]
        met = [(i, j) for i in range(groups) for j in range(i, groups)]

        def made(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            i, j = met[key[0].as_py()]
            first, second = (rows.value.slice(cuts[g], cuts[g + 1] - cuts[g]) for g in (i, j))
            yield from merged(tiles(function, first, None if i == j else second, block), merge)

        return known.spark.range(0, len(met), 1, len(met)).groupBy("id").applyInArrow(made, schema)  # a range is dealt by its ids already
    columns = df.columns

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))
        first, second = (rows.filter(pc.equal(rows["second"], s)).select(columns).combine_chunks() for s in (False, True))
        yield from merged(tiles(function, first, None if key[0].as_py() == key[1].as_py() else second, block), merge)

    return meetings(df, block).groupBy("i", "j").applyInArrow(run, schema)


def pair_rows(x: np.ndarray, y: np.ndarray, d: np.ndarray, on: np.ndarray, digits: int | None, name: str = "d") -> pa.Table:
    """i, j and a value of the pairs of a tile that count, by rows of the tile; values that aren't numbers are null."""
    i, j = np.maximum(x[:, None], y[None]), np.minimum(x[:, None], y[None])
    i, j, d = (v.ravel() for v in (i, j, d)) if on.all() else (v[on] for v in (i, j, d))
    if digits is not None:
        d = rounded(d, digits)
    none = np.isnan(d)
    return pa.table([i, j, pa.array(d, mask=none if none.any() else None)], ["i", "j", name])


def pair_join(df: DataFrame, metric: Metric = Metric(), digits: int | None = None) -> DataFrame:
    """i, j, d for every pair i > j: the distance dump, a row for each pair by intent. digits: decimals that d is rounded to, in the tile, as
    Spark's own rounding of a double goes by decimal numbers and takes longer than all else."""
    def run(a: pa.Table, b: pa.Table, on: np.ndarray) -> pa.Table:
        if not on.any():
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["i", "j", "d"])
        return pair_rows(a["id"].to_numpy(), b["id"].to_numpy(), metric.matrix(matrix(a["x"]), matrix(b["x"])), on, digits)

    return self_tiles(df.select("id", "x"), run, "i long, j long, d double")


def relation(df: DataFrame, metric: Metric = Metric()) -> Callable[[int], DataFrame]:
    """The relation of distances of points by its rows: the function gives j, d of one id against all others."""
    def row(i: int) -> DataFrame:
        own = df.where(F.col("id") == i).select("x").first()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    d = metric.matrix(matrix(pa.chunked_array([batch.column(1)])), x)[:, 0]
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d, mask=np.isnan(d))], ["j", "d"])

        if own is None:
            return df.sparkSession.createDataFrame([], "j long, d double")
        x = np.array([own["x"]], float)
        return df.where(F.col("id") != i).select("id", "x").mapInArrow(run, "j long, d double")

    return row


def similarity_rows(df: DataFrame, metric: Metric = Metric()) -> DataFrame:
    """id, x: rows of the square matrix of distances, in which column k belongs to the k-th id in order. Each task makes rows of its points
    from all points, which are sent to it, up to BROADCAST numbers; beyond, rows are put together from pairs in a shuffle."""
    size = df.agg(F.sum(F.size("x"))).first()[0] or 0
    if size > BROADCAST:
        d = pair_join(df, metric)
        both = d.unionByName(d.select(F.col("j").alias("i"), F.col("i").alias("j"), "d")).unionByName(df.select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("d")))
        return both.groupBy(F.col("i").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "d"))), lambda x: x["d"]).alias("x"))
    t = df.select("id", "x").toArrow().sort_by("id")
    known = df.sparkSession.sparkContext.broadcast((t["id"].to_numpy(), matrix(t["x"]) if len(t) else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y = known.value
        at_once = max(1, (1 << 21) // max(1, len(ids)))
        for batch in batches:
            for at in range(0, len(batch), at_once):
                part = batch.slice(at, at_once)
                own, x = part.column(0).to_numpy(), matrix(pa.chunked_array([part.column(1)]))
                d = np.concatenate([metric.matrix(x, y[k : k + BLOCK]) for k in range(0, len(y), BLOCK)], 1)
                d[own[:, None] == ids[None]] = 0
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * len(ids), pa.int32()), pa.array(d.ravel(), mask=np.isnan(d.ravel())))], ["id", "x"])

    return df.select("id", "x").mapInArrow(run, "id long, x array<double>")


def similarity_pairs(df: DataFrame, id: str = "id", row: str = "x") -> DataFrame:
    """i, j, d from a table whose rows are rows of a square matrix; column j belongs to the j-th id in order. The ids, as many as a row has
    numbers, are sent to every task; rows are cut where they lie."""
    ids = np.sort(df.select(F.col(id).cast("long").alias("id")).toArrow()["id"].to_numpy())
    known = df.sparkSession.sparkContext.broadcast(ids)
    rows = df.select(F.col(id).cast("long").alias("i"), F.col(row).cast("array<double>").alias("x"))
    return rows.mapInArrow(lambda batches: cut_rows(batches, known.value), "i long, j long, d double")


def cut_rows(batches: Iterator[pa.RecordBatch], ids: np.ndarray, digits: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows of a square matrix, as pairs with the ids before each one's own."""
    for batch in batches:
        for at in range(len(batch)):
            i, x = batch.column(0)[at].as_py(), batch.column(1)[at].values
            n = min(int(np.searchsorted(ids, i)), len(x) if x is not None else 0)
            for k in range(0, n, 1 << 16):
                m = min(n - k, 1 << 16)
                d = x.slice(k, m)
                if digits is not None:
                    v = rounded(d.to_numpy(zero_copy_only=False), digits)
                    d = pa.array(v, mask=np.isnan(v) if d.null_count else None)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, i)), pa.array(ids[k : k + m]), d], ["i", "j", "d"])


#: Pairs of a part of the rows that one task makes and cuts, about.
PART = 1 << 23


def similarity_cut(df: DataFrame, metric: Metric = Metric(), digits: int | None = None) -> DataFrame:
    """similarity_pairs of similarity_rows: i, j, d. Up to BROADCAST numbers, a task cuts the rows that it makes, in its own memory, and makes them
    as far as they are cut, which is to their own places; blocks of rows are dealt in turn, as later ones are longer."""
    known = sent(df.select("id", "x"))
    if known is None:
        out = similarity_pairs(similarity_rows(df, metric))
        return out if digits is None else out.withColumn("d", F.round("d", digits))
    rows, n = known.rows, len(known.rows.value)
    parts = max(1, n * n // (2 * PART))
    high = max(1, (1 << 21) // max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y = rows.value["id"].to_numpy(), matrix(rows.value["x"]) if n else np.zeros((0, 0))

        def made(at: int) -> pa.RecordBatch:
            x = y[at : at + high]
            ends = np.arange(at, at + len(x))
            d = np.concatenate([metric.matrix(x, y[k : min(k + BLOCK, at + len(x))]) for k in range(0, at + len(x), BLOCK)], 1)
            flat = np.concatenate([row[:end] for row, end in zip(d, ends)])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends.cumsum()]), pa.int32()), pa.array(flat, mask=none if (none := np.isnan(flat)).any() else None))
            return pa.RecordBatch.from_arrays([pa.array(ids[at : at + high]), lists], ["id", "x"])

        for batch in batches:
            for part in batch.column(0).to_pylist():
                yield from cut_rows((made(at) for at in range(part * high, n, parts * high)), ids, digits)

    return known.spark.range(0, parts, 1, parts).mapInArrow(run, "i long, j long, d double")


def extremes(df: DataFrame, metric: Metric = Metric(), low: Metric | None = None) -> DataFrame:
    """One row: n pairs, largest and smallest distance d; with `low`, largest distance of the column y too."""
    def run(a: pa.Table, b: pa.Table, on: np.ndarray) -> pa.Table:
        d = metric.matrix(matrix(a["x"]), matrix(b["x"]))[on] if on.size else np.zeros(0)
        e = low.matrix(matrix(a["y"]), matrix(b["y"]))[on] if low is not None and on.size else np.zeros(0)
        best = lambda v, f: f(v[~np.isnan(v)], initial=None) if (~np.isnan(v)).any() else None
        return pa.table([pa.array([int(on.sum())]), *(pa.array([float(x) if x is not None else None], pa.float64()) for x in (best(d, _max), best(d, _min), best(e, _max)))], ["n", "d_max", "d_min", "y_max"])

    columns = ["id", "x"] + (["y"] if low is not None else [])
    return self_tiles(df.select(*columns), run, "n long, d_max double, d_min double, y_max double").agg(F.sum("n").alias("n"), F.max("d_max").alias("d_max"), F.min("d_min").alias("d_min"), F.max("y_max").alias("y_max"))


def _max(v: np.ndarray, initial: None) -> float:
    return v.max()


def _min(v: np.ndarray, initial: None) -> float:
    return v.min()


def per_point(df: DataFrame, metric: Metric = Metric()) -> DataFrame:
    """id, n, sum, least and greatest distance of each point to all others; undefined distances don't count."""
    def run(a: pa.Table, b: pa.Table, on: np.ndarray) -> pa.Table:
        if not on.any():
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), *(pa.array([], pa.float64()),) * 3], ["id", "n", "s", "lo", "hi"])
        d = np.where(on, metric.matrix(matrix(a["x"]), matrix(b["x"])), np.nan)
        parts = []
        for axis, t in ((1, a), (0, b)):
            n = (~np.isnan(d)).sum(axis)
            parts.append((t["id"].to_numpy(), n, np.nansum(d, axis), np.where(np.isnan(d), np.inf, d).min(axis), np.where(np.isnan(d), -np.inf, d).max(axis)))
        columns = [np.concatenate(c) for c in zip(*parts)]
        keep = columns[1] > 0
        return pa.table([c[keep] for c in columns], ["id", "n", "s", "lo", "hi"])

    tiles = self_tiles(df.select("id", "x"), run, "id long, n long, s double, lo double, hi double")
    return tiles.groupBy("id").agg(F.sum("n").alias("n"), F.sum("s").alias("sum"), F.min("lo").alias("least"), F.max("hi").alias("greatest"))
