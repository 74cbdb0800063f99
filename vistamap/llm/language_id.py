"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram inside a word (its ends count as a letter of their own)
is the product of its letters' vectors, each permuted by its place (rotated by 2, 1 and 0). A text's vector is the sum
over its trigrams; a language's prototype is the sum over its sample texts. A text gets the language whose prototype
has the largest cosine with its vector; ties go to the language that sorts first.

Each letter of any script has its own vector, made from a seeded hash of its code point. Lower case throughout. Texts are
bundled ROWS at a time, and their trigrams COLUMNS at a time, so junk with many different trigrams takes no more memory.

Learning takes about `per_language` texts of each language (a documented bound, drawn by a hash of the row); prediction
covers every row.

Nulls: a null text, or one without a letter, is "und" with score 0; null texts and null labels are not learned from.
If no language can be learned, every row is "und". Repeated rows are answered each; an empty table gives an empty
result; other columns are kept as they are unless they have the names of the result's columns, which replace them."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from ._shared import chunks, lean, small_batches
from ._text import U, mix

DIMENSIONS = 1024
PER_LANGUAGE = 4000
MOST_LANGUAGES = 2000
UNKNOWN = "und"
ROWS, COLUMNS = 1024, 4096
#: Code points of a text that are counted at a time.
PIECE = 1 << 20
_PART = 1 << 18
_POINTS = 0x110000


@cache
def is_letter(point: int) -> bool:
    return unicodedata.category(chr(point))[0] == "L"


def letters(points: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """Vectors of +1 and -1, a row for each code point; point 0 stands for the ends of a word."""
    words = np.arange(-(-dimensions // 64), dtype=np.uint64)
    bits = mix(mix(points.astype(np.uint64) + U(seed << 32))[:, None] + words * U(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.astype("<u8").view(np.uint8), axis=1, bitorder="little")[:, :dimensions].astype(np.int8) * 2 - 1


def pieces(texts: list[str]) -> Iterator[tuple[list[str], list[int], list[tuple[bool, bool]]]]:
    """Stretches of about PIECE characters of all texts: their parts, the text of each, and whether a part's first and last
    character are only there as neighbours."""
    out: list[str] = []
    of: list[int] = []
    only: list[tuple[bool, bool]] = []
    size = 0
    for i, x in enumerate(texts):
        for a in range(0, len(x), PIECE):
            b = min(a + PIECE, len(x))
            out.append(x[max(a - 1, 0) : b + 1])
            of.append(i)
            only.append((a > 0, b < len(x)))
            size += b - a
            if size >= PIECE:
                yield out, of, only
                out, of, only, size = [], [], [], 0
    if out:
        yield out, of, only


class Profiles:
    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 7):
        self.dimensions, self.seed = dimensions, seed
        self.class_of = np.zeros(_POINTS, np.int32)

    def trigrams(self, parts: list[str], of: list[int], only: list[tuple[bool, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text and place among the distinct ones of each trigram; code points of these, a row each."""
        code = np.frombuffer("\n".join(["", *parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        seen = np.zeros(_POINTS, bool)
        seen[code] = True
        there = np.array([0] + [c for c in np.flatnonzero(seen).tolist() if is_letter(c)], np.int64)
        self.class_of[there] = np.arange(len(there))
        classed = self.class_of[code].astype(np.int64)
        self.class_of[there] = 0
        size = np.array([len(x) + 1 for x in parts])
        doc = np.repeat(np.asarray(of), size)
        counted = classed[1:-1] > 0
        first = np.cumsum(size) - size
        edge = np.asarray(only, bool).reshape(-1, 2)
        counted[first[edge[:, 0]]] = False
        counted[(first + size - 2)[edge[:, 1]]] = False
        middle = np.flatnonzero(counted)
        n = len(there)
        gram = (classed[middle] * n + classed[middle + 1]) * n + classed[middle + 2]
        if n**3 <= 1 << 22:
            table = np.zeros(n**3, np.int64)
            table[gram] = 1
            distinct = np.flatnonzero(table)
            table[distinct] = np.arange(len(distinct))
            place = table[gram]
        else:
            distinct, place = np.unique(gram, return_inverse=True)
        return doc[middle], place, there[np.stack([distinct // n**2, distinct // n % n, distinct % n], 1)]

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of trigrams: the letters' vectors, rotated by their places and multiplied."""
        points, at = np.unique(grams, return_inverse=True)
        v, at = letters(points, self.dimensions, self.seed), at.reshape(grams.shape)
        return np.roll(v, 2, 1)[at[:, 0]] * np.roll(v, 1, 1)[at[:, 1]] * v[at[:, 2]]

    def bundle(self, texts: list[str]) -> np.ndarray:
        """Vectors of texts, a row each; all zero without a letter."""
        out = np.zeros((len(texts), self.dimensions), np.float32)
        for parts, of, only in pieces([x.lower() for x in texts]):
            doc, place, grams = self.trigrams(parts, of, only)
            for top in range(0, len(texts), ROWS):
                rows = min(ROWS, len(texts) - top)
                a, b = np.searchsorted(doc, [top, top + rows])
                if a < b:
                    out[top : top + rows] += self.summed(doc[a:b] - top, place[a:b], grams, rows)
        return out

    def summed(self, doc: np.ndarray, place: np.ndarray, grams: np.ndarray, rows: int) -> np.ndarray:
        out = np.zeros((rows, self.dimensions), np.float32)
        for at in range(0, len(grams), COLUMNS):
            on = (place >= at) & (place < at + COLUMNS) if len(grams) > COLUMNS else slice(None)
            width = min(COLUMNS, len(grams) - at)
            key = doc[on] * width + (place[on] - at)
            if not len(key):
                continue
            vectors = self.bound(grams[at : at + width])
            if len(key) * 64 < rows * width:  # few of many cells: one trigram after the other
                for k in range(0, len(key), COLUMNS):
                    part = np.sort(key[k : k + COLUMNS])
                    row = part // width
                    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                    out[row[first]] += np.add.reduceat(vectors[part % width], first, 0, np.int32)
            else:
                count = np.bincount(key, minlength=rows * width).reshape(rows, width).astype(np.float32)
                out += count @ vectors.astype(np.float32)
        return out


def _bundled(batch: pa.RecordBatch, profiles: Profiles, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for part in chunks(batch, column, _PART):
        for at in range(0, len(part), ROWS):
            rows = part.slice(at, ROWS)
            yield rows, profiles.bundle([x or "" for x in rows.column(rows.schema.get_field_index(column)).to_pylist()])


def learn(labelled: DataFrame, text: str, label: str, key: str, dimensions: int = DIMENSIONS, per_language: int = PER_LANGUAGE) -> dict[str, np.ndarray]:
    """Prototypes by language. The driver gets one vector for each language; more than MOST_LANGUAGES are refused."""
    small_batches(labelled.sparkSession)
    usable = labelled.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("string").alias("label"), F.xxhash64(F.lit("sample"), F.col(key)).alias("draw"))
    counts = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} distinct labels: not languages")
    if not counts:
        return {}
    share = F.coalesce(*(F.when(F.col("label") == k, F.lit(min(1.0, per_language / n))) for k, n in counts.items() if n > per_language), F.lit(1.0))
    sample = usable.where((F.col("draw") / F.lit(2.0**64) + 0.5) <= share).select("label", "text")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles, sums = Profiles(dimensions), {}
        for batch in batches:
            for rows, vectors in _bundled(batch, profiles, "text"):
                labels = np.array(rows.column(0).to_pylist(), object)
                for k in set(labels):
                    sums[k] = sums.get(k, 0) + vectors[labels == k].astype(np.int64).sum(0)
        for k, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k] * dimensions), pa.array(np.arange(dimensions), pa.int32()), pa.array(v, pa.int64())], ["label", "i", "v"])

    summed = sample.mapInArrow(lean(part), "label string, i int, v long").groupBy("label", "i").agg(F.sum("v").alias("v")).toPandas()
    out = {}
    for k, rows in summed.groupby("label"):
        v = np.zeros(dimensions)
        v[rows["i"].to_numpy()] = rows["v"].to_numpy()
        out[str(k)] = v
    return out


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """docs with lang_pred string and score double, the cosine, 0 at least."""
    small_batches(docs.sparkSession)
    names = sorted(prototypes)
    table = np.array([prototypes[k] / max(np.linalg.norm(prototypes[k]), 1e-30) for k in names], np.float32)
    dimensions = table.shape[1] if names else DIMENSIONS
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    schema = StructType([*(docs.schema[c] for c in kept), StructField("lang_pred", StringType()), StructField("score", DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(dimensions)
        for batch in batches:
            for rows, vectors in _bundled(batch, profiles, text):
                norm = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
                known = (norm > 0) & bool(names)
                best, score = np.zeros(len(norm), int), np.zeros(len(norm))
                if names:
                    cosine = (vectors @ table.T).astype(np.float64) / np.maximum(norm, 1e-30)[:, None]
                    best, score = cosine.argmax(1), np.clip(cosine.max(1), 0, 1) * known
                said = [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(said, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(lean(run), schema)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def language_id(docs: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """docs (doc_id, text, lang, ...) with held_out, lang_pred, score; rows of the held-out fold are not learned from.
    A null doc_id is in no fold."""
    marked = docs.withColumn("held_out", held_out(F.col("doc_id"), folds, fold))
    return predict(marked, learn(marked.where(~F.col("held_out")), "text", "lang", "doc_id"))
