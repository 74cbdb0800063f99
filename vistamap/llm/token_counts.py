"""Token counts through a digest cache.

Each text gets a digest of its normalised content and of the tokenizer's version; counts of digests that the
cache holds are looked up, only distinct misses are encoded, and what they give is appended to the cache.
The content is normalised as far as counts can't change: null becomes empty, nothing else.

Nulls: a null text counts as empty (0 bytes, 0 tokens); a null id is kept. Repeated rows and ties: each row
gets its own result, its text is encoded once. An empty table gives an empty result. Other columns stay out."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._memo import Memo, version
from ._shared import chunks, lean, saved, small_batches, work_dir

CACHE = "digest string, tokens long"


def digest(text, tokenizer_version: str):
    return F.sha2(F.concat_ws(":", F.lit(tokenizer_version), F.coalesce(text, F.lit(""))), 256)


def encoder(path: str, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo(path, kind)
        for batch in batches:
            for part in chunks(batch, "text"):
                counts, _ = memo.encode(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64())], ["digest", "tokens"])

    return run


def cached(spark: SparkSession, cache: str) -> DataFrame | None:
    """What the cache holds, one row a digest; None before its first use."""
    where = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.schema(CACHE).parquet(cache).groupBy("digest").agg(F.max("tokens").alias("tokens"))


def token_counts(docs: DataFrame, cache: str, tokenizer: str, kind: str = "bytes", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) for each row of docs (doc_id, text).

    `cache`: a folder that the cluster shares; this call appends to it. A run that is cut short appends nothing,
    and digests that two runs append at once have equal counts, so a reader may take either."""
    spark, of = docs.sparkSession, version(tokenizer)
    small_batches(spark)
    keyed = docs.select("doc_id", "text", digest(F.col("text"), of).alias("digest"))
    known = cached(spark, cache)
    misses = keyed.select("digest", F.coalesce("text", F.lit("")).alias("text")).groupBy("digest").agg(F.first("text").alias("text"))
    if known is not None:
        misses = misses.join(known, "digest", "left_anti")
    misses.mapInArrow(lean(encoder(tokenizer, kind)), CACHE).write.mode("append").parquet(cache)
    # a plain table on this side lets the rows of a frequent text be split over tasks
    counts = saved(cached(spark, cache), work_dir(spark, "counts"))
    return (
        keyed.select("doc_id", "digest", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
        .join(counts, "digest", "left")
        .select("doc_id", "n_bytes", F.col("tokens").alias("n_tokens"), (F.col("tokens") > limit).alias("over_limit"))
    )
