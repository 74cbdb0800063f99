"""The queries of this subpackage: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import work_dir
from .decontamination import decontaminate
from .html_extraction import main_text
from .language_id import language_id
from .line_dedup import SQL as LINE_DEDUP_SQL
from .line_dedup import line_dedup
from .near_dups import SQL as NEAR_DUPS_SQL
from .near_dups import near_dups
from .nearest import nearest
from .ngram_lm import score_held_out
from .packing import pack_texts
from .repeated_spans import SQL as REPEATED_SPANS_SQL
from .repeated_spans import repeated_spans
from .token_counts import token_counts


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Starts from an empty cache, so that every distinct text is encoded in each run."""
    return token_counts(table(spark, sf_dir, "documents"), work_dir(spark, "token-cache"), tokenizer_path("byte_bpe_50k.json"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = line_dedup(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_lines", "n_removed", F.char_length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "contaminated", "items", "n_windows")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_texts(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 100 == 0), 10)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_held_out(table(spark, sf_dir, "documents"))


def op10_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents")).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = (op1_token_counts, op2_line_dedup, op3_language_id, op4_decontamination, op5_packing, op6_html_extraction, op7_near_dups, op8_nearest, op9_lm_scoring, op10_repeated_spans)
    return {f.__name__: f for f in names}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": LINE_DEDUP_SQL, "op7_near_dups": NEAR_DUPS_SQL, "op10_repeated_spans": REPEATED_SPANS_SQL}
