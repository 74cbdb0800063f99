"""Approximate nearest neighbours by collision-counting hashing.

Every block of vectors has PROJECTIONS random projections, each kept as a sorted array. A query opens a window around its own
value in each array; virtual rehashing widens all windows together as the radius R grows. A vector that lies in THRESHOLD
of the windows or more is verified by its true distance. A query is done in a block when its k-th best verified distance is
at most R, so that all better vectors were within reach of the windows, or when all of the block is verified.

Half of a window is WIDTH / 2 * R: a vector at distance R or less is in each window with probability 0.826 or more, and passes
the threshold with probability 0.99. There is no cap on candidates.

Blocks meet chunks of queries in tiles of bounded size, each of which builds its block's arrays once, searches it for all
queries of the chunk and returns the k best; every row is indexed. A vector goes to as many tiles as there are chunks and a query
to as many as there are blocks, so both are as large as memory allows; of few vectors, smaller blocks keep all cores busy.

Vectors that are null, zero or hold null or non-finite components take no part, nor do rows with a null id. Vectors of different
length are never compared. A query is not its own neighbour, nor is any row with its id; of several query rows with one id
the smallest vector asks. Ties in distance go to the smaller id; repeated rows are returned as often as they come. Empty tables
give an empty result. Other columns stay out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import saved, small_batches, work_dir

PROJECTIONS = 64
THRESHOLD = 0.72
WIDTH = 2.719
GROWTH = 1.25
#: Numbers in a block of vectors (rows times dimensions) and in a chunk of queries at most; vectors in a block at least, where
#: there are fewer than TILES blocks for each core.
BLOCK = CHUNK = 1 << 20
LEAST, TILES = 2048, 3
#: Different lengths of vectors at most: the grid of tiles has a row for each and is broadcast.
LENGTHS = 10_000


class Block:
    def __init__(self, vectors: np.ndarray, seed: int = 17):
        self.vectors = vectors
        self.axes = np.random.Generator(np.random.PCG64([seed, vectors.shape[1]])).standard_normal((vectors.shape[1], PROJECTIONS))
        values = (vectors @ self.axes).T
        n = len(vectors)
        self.order = np.argsort(values, 1, kind="stable").astype(np.int32)
        sorted_ = np.take_along_axis(values, self.order, 1)
        # all arrays in a row, each in a range of its own, so that one search finds the edges of all windows
        self.low = sorted_[:, :1]
        self.range = float(np.ptp(sorted_, 1).max()) if n else 0.0
        self.lane = 2 * self.range + 1e-300
        self.base = (np.arange(PROJECTIONS) * self.lane)[:, None]
        self.all = ((sorted_ - self.low) + self.base).ravel()
        self.order = self.order.ravel()
        some = np.linspace(0, n - 1, min(n, 64)).astype(int)
        apart = np.sqrt(((vectors[some][:, None] - vectors[some][None]) ** 2).sum(-1))
        apart = apart[apart > 0]
        #: First radius: well below the distances in the block.
        self.radius = float(np.quantile(apart, 0.01)) / 4 if len(apart) else 1.0

    def edges(self, at: np.ndarray, half: float) -> tuple[np.ndarray, np.ndarray]:
        """First and last place (exclusive) of each array's window around `at`."""
        n = len(self.vectors)
        edge = np.clip(np.concatenate([at - half, at + half], 1) - self.low, -self.lane / 4, self.range + self.lane / 4) + self.base
        place = np.searchsorted(self.all, edge[:, 0]), np.searchsorted(self.all, edge[:, 1], "right")
        start = np.arange(PROJECTIONS) * n
        return np.clip(place[0], start, start + n), np.clip(place[1], start, start + n)

    def search(self, ids: np.ndarray, query_id: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k best of those that collide often enough."""
        n = len(self.vectors)
        at = (query @ self.axes)[:, None]
        need = int(np.ceil(THRESHOLD * PROJECTIONS))
        low, _ = self.edges(at, 0.0)
        high = low
        count, distance = np.zeros(n, np.int32), np.full(n, np.inf)
        own = ids == query_id
        verified = own.copy()
        radius = self.radius
        while True:
            a, b = self.edges(at, WIDTH / 2 * radius)
            a, b = np.minimum(a, low), np.maximum(b, high)
            begin, size = np.concatenate([a, high]), np.concatenate([low - a, b - high])
            low, high = a, b
            within = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            count += np.bincount(self.order[within], minlength=n).astype(np.int32)
            new = np.flatnonzero((count >= need) & ~verified)
            if len(new):
                verified[new] = True
                distance[new] = np.sqrt(((self.vectors[new] - query) ** 2).sum(1))
            if verified.all() or (len(distance) > k and np.partition(distance, k - 1)[k - 1] <= radius):
                break
            radius *= GROWTH
            if not (high - low < n).any():  # every window holds the block
                rest = np.flatnonzero(~verified)
                distance[rest] = np.sqrt(((self.vectors[rest] - query) ** 2).sum(1))
                break
        found = np.flatnonzero(np.isfinite(distance) & ~own)
        if len(found) > k:
            found = found[distance[found] <= np.partition(distance[found], k - 1)[k - 1]]
        found = found[np.lexsort((ids[found], distance[found]))][:k]
        return found, distance[found]


def matrix(column: pa.ChunkedArray, dimensions: int) -> np.ndarray:
    column = column.combine_chunks()
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimensions)


def tile(k: int):
    def run(key: tuple, rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(rows) and len(queries):
            dimensions = key[0].as_py()
            block, ids = Block(matrix(rows["vector"], dimensions)), rows["id"].to_numpy()
            for q, v in zip(queries["id"].to_pylist(), matrix(queries["vector"], dimensions)):
                found, distance = block.search(ids, q, v, k)
                out.append((np.full(len(found), q, np.int64), ids[found], distance))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(list(map(pa.array, columns)), ["query_id", "vec_id", "score"])

    return run


def usable(vector: Column) -> Column:
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(good, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance) of the k nearest rows of vectors found for each row of queries."""
    spark = vectors.sparkSession
    small_batches(spark)

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col(id).isNotNull())
        return rows.where(usable(F.col("vector"))).withColumn("dim", F.size("vector"))

    rows = saved(clean(vectors), work_dir(spark, "vectors"))
    asked = saved(clean(queries).groupBy("id", "dim").agg(F.min("vector").alias("vector")), work_dir(spark, "queries"))
    count = lambda df, name: df.groupBy("dim").agg(F.count("*").alias(name))
    if rows.select("dim").distinct().limit(LENGTHS + 1).count() > LENGTHS:
        raise ValueError(f"more than {LENGTHS} different vector lengths")
    fit = lambda numbers: F.greatest(F.lit(16), F.floor(F.lit(numbers) / F.col("dim")))
    size = F.least(fit(BLOCK), F.greatest(F.lit(LEAST), F.ceil(F.col("n") / (TILES * spark.sparkContext.defaultParallelism))))
    grid = count(rows, "n").join(count(asked, "q"), "dim").select("dim", F.ceil(F.col("n") / size).cast("int").alias("blocks"), F.ceil(F.col("q") / fit(CHUNK)).cast("int").alias("chunks"))
    grid = F.broadcast(grid)
    place = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    left = rows.join(grid, "dim").select("dim", place(1, "blocks").alias("block"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "id", "vector")
    right = asked.join(grid, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), place(2, "chunks").alias("chunk"), "id", "vector")
    keys = ["dim", "block", "chunk"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile(k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
