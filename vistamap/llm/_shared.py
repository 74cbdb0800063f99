"""Work folders shared by driver and executors, and small helpers on DataFrames."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY_BYTES = 1 << 20
#: Bytes of an Arrow batch between Spark and a worker.
BATCH_BYTES = 2 << 20
#: Bits of a key filter, in words of 64; the words are at most 1,048,576 rows.
FILTER_BITS = 1 << 26
#: Bytes of a row group in files that workers write.
GROUP_BYTES = 8 << 20
#: Rows of a few numbers that a file of a work table holds: less isn't worth a task.
ROWS_A_FILE = 200_000
_own: dict[str, str] = {}
_noted: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, as in tests, a local one is made, under a local master only."""
    conf = spark.sparkContext.getConf()
    given = conf.get("spark.checkpoint.dir", None) or _own.get("dir")
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    _own["dir"] = tempfile.mkdtemp(prefix="vistamap-")
    atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return _own["dir"]


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _noted:
        _noted[-1].append(path)
    return path


@contextmanager
def cleared(spark: SparkSession) -> Iterator[None]:
    """Work folders that operators make inside the block go at its end. What is lazy has to be written inside it, to a path from outside."""
    _noted.append([])
    try:
        yield
    finally:
        for path in _noted.pop():
            removed(spark, path)


def posix(path: str) -> str:
    """The mounted path of a shared folder, for files that workers map into memory.

    Memory mapping needs a mounted file system (NFS, Lustre, a FUSE mount); any other scheme is refused
    rather than copied to each worker's own disk."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    if "://" in path:
        raise ValueError(f"{path}: memory-mapped files need a mounted shared folder")
    return path


def saved(df: DataFrame, path: str) -> DataFrame:
    """The rows written to `path` as Parquet and read again: cuts the lineage and survives lost executors."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mapped(df: DataFrame, run: Callable, schema: str, path: str) -> DataFrame:
    """df.mapInArrow(run, schema) written to `path` and read again. Where the folder is mounted, workers write the files themselves: rows don't go
    back through the JVM, and it starts no process for the permissions of a file, which shares its memory for a moment. A file counts when
    the driver, which gets its name from the task that ended well, takes the underscore off it."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        return saved(df.mapInArrow(lean(run), schema), path)
    folder = where.toUri().getPath()

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, held, size = f"_{uuid.uuid4().hex}", None, [], 0
        for batch in run(batches):
            held.append(batch)
            size += batch.nbytes
            if size >= GROUP_BYTES:
                out = out or pq.ParquetWriter(f"{folder}/{name}", batch.schema)
                out.write_table(pa.Table.from_batches(held))
                held, size = [], 0
        if held:
            out = out or pq.ParquetWriter(f"{folder}/{name}", held[0].schema)
            out.write_table(pa.Table.from_batches(held))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    os.makedirs(folder)
    for k, row in enumerate(df.mapInArrow(lean(written), "name string").collect()):
        os.rename(f"{folder}/{row['name']}", f"{folder}/part-{k:05}.parquet")
    return spark.read.schema(schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a work folder whose tables nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """A work folder for tables that go when the block ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path, self.n = spark, work_dir(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        removed(self.spark, self.path)

    def mapped(self, df: DataFrame, run: Callable, schema: str, name: str, rows: int | None = None) -> DataFrame:
        self.n += 1
        return mapped(df if rows is None else fewer(df, rows), run, schema, f"{self.path}/{name}-{self.n}")

    def saved(self, df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
        """`rows`: how many narrow rows there are about, or would take as much room; keeps small tables in few files."""
        self.n += 1
        return saved(df if rows is None else fewer(df, rows), f"{self.path}/{name}-{self.n}")


def fewer(df: DataFrame, rows: int) -> DataFrame:
    """df in tasks of ROWS_A_FILE rows or more."""
    return df.coalesce(max(1, -(-rows // ROWS_A_FILE)))


def _bit(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))


class KeyFilter:
    """A bitmap of the hashes of keys, for picking rows of a wide table before any of them is shuffled.

    Its size is bounded whatever the number of keys, so it can be broadcast; with more keys it lets more other rows
    through, and joins that follow stay exact. A null key is a key like others."""

    def __init__(self, keys: DataFrame, scratch: Scratch):
        """keys: one column."""
        self.word, self.bits = (f"__{x}_{uuid.uuid4().hex}" for x in ("word", "bits"))  # no column of a split table has these names
        words = keys.select(_bit(keys[keys.columns[0]]).alias("h")).select(F.shiftright("h", 6).alias(self.word), F.expr("shiftleft(1L, cast(h & 63 as int))").alias("bit"))
        self.words = scratch.saved(words.groupBy(self.word).agg(F.bit_or("bit").alias(self.bits)), "filter", FILTER_BITS // 64)

    def split(self, df: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
        """Rows whose key may be among the keys, and rows whose key is not."""
        at = f"__at_{uuid.uuid4().hex}"
        marked = df.withColumn(at, _bit(key))
        marked = marked.join(F.broadcast(self.words), F.shiftright(at, 6) == F.col(self.word), "left")
        maybe = F.coalesce(F.expr(f"(shiftrightunsigned({self.bits}, cast({at} & 63 as int)) & 1) = 1"), F.lit(False))
        columns = [f"`{c}`" for c in df.columns]
        return marked.where(maybe).select(*columns), marked.where(~maybe).select(*columns)


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of this session by bytes, as Spark's own bounds (10,000 rows, 64 MB) let a batch of long texts take
    several hundred MB in an executor and as much in its worker. A lower bound of the session's stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < given <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def chunks(batch: pa.RecordBatch, column: str, most: int = KEY_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows whose texts together hold about `most` bytes; a longer text is a slice of its own."""
    values = batch.column(batch.schema.get_field_index(column))
    if not len(values):
        return
    size = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < len(size):
        to = int(size.searchsorted((size[at - 1] if at else 0) + most, "right"))
        to = max(to, at + 1)
        yield batch.slice(at, to - at)
        at = to


def lean(run: Callable) -> Callable:
    """A map over batches after which the worker gives free memory back: Spark keeps workers for later tasks, and their allocators keep
    what a task had at its height."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL(None).malloc_trim(0)

    return mapped


def one_thread() -> None:
    """Spark runs one task for each core; libraries in a worker get one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
