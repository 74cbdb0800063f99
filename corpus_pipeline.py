"""Cleaning of a corpus, from documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last keep the columns of documents. The language models learn from the stage's own input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vistamap.llm import decontamination, language_id, line_dedup, near_dups, packing
from vistamap.llm._shared import KeyFilter, Scratch, cleared, fewer, removed, saved, work_dir
from vistamap.llm.queries import table, tokenizer_path


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no known language: null texts and texts without a letter."""
    needed = ["doc_id", "text", "lang"]
    rest = F.struct(F.lit(0).alias("_"), *(c for c in docs.columns if c not in needed)).alias("rest")
    named = language_id.language_id(docs.select(*needed, rest)).where(F.col("lang_pred") != language_id.UNKNOWN)
    return named.select(*(c if c in needed else F.col("rest")[c].alias(c) for c in docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without boilerplate lines, and without documents that consist of lines kept elsewhere."""
    left = line_dedup.line_dedup(docs)
    left = left.where((F.col("n_removed") == 0) | (F.trim("text", F.lit(" \n")) != ""))
    return left.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity of 0.8 or more), the one with the
    smallest doc_id; one row of rows alike in doc_id and text. Rows that neither go nor are repeated are not shuffled."""
    scratch = Scratch(spark, "distinct")  # ids only; the result reads them
    ids = near_dups.near_dups(docs).groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    found = scratch.saved(ids.where(~F.col("kept") | (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), "kept"), "found")
    n = found.count()
    maybe, alone = KeyFilter(found.select("__id"), scratch).split(docs, F.col("doc_id").cast("long"))
    left = maybe.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")), "left").where(F.coalesce("kept", F.lit(True)))
    left = left.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"])
    return alone.union(fewer(left.select(*docs.columns), 100 * n))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that hold a benchmark item."""
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("contaminated")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_texts(docs, tokenizer_path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identified),
    ("line_dedup", lines),
    ("near_dups", distinct),
    ("decontamination", decontaminated),
    ("packing", packed),
]
#: Hyperdimensional profiles, MinHash and tokenizers have no SQL form; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = work_dir(spark, name)
        with cleared(spark):
            docs = saved(stage(spark, docs, sf_dir), path)
        if before:
            removed(spark, before)
        before = path
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
