"""Benchmark decontamination by template canonicalisation.

Texts are cut into words and numbers; numbers, units after a number and names (capitalised words inside a sentence) become
typed placeholders. Windows of WINDOW such tokens of a document and of a benchmark item are hash-joined, once with names as
placeholders and once with names as words, so that an item in other letter case is found too. Where a document follows an item
(same distance of positions), the values of the placeholders must be consistent: one value of the item always stands for
one value of the document, and different names for different names. That finds questions whose numbers, names or units were
changed, and lets texts of like shape alone. Windows whose values are those of the item count in any case.

Windows of more placeholders than words, or of fewer than LEAST words, are too common to be told by their template. They are
joined with their values as they are, so that a verbatim copy has all windows of its item, and by template only where another
window of the same item matches at the same distance and all values of both are consistent.

A document is contaminated by an item if consistent windows cover COVERED of the item's tokens, or all of a shorter item.
An item all of whose windows are poor in words is found with its own values only. Items of fewer than ALONE tokens, which are
ordinary phrases, count where they stand on lines of their own.

Of a document, only windows go on whose hash is in a bitmap of the benchmark's; its size is bounded whatever the benchmark's.

Letter case is folded for A-Z and U+00C0 to U+00DE.

Nulls: a null text has no windows; a null doc_id is kept; items with a null text are not searched. Rows alike in doc_id and
text are treated alike. Empty tables give nothing found. Other columns are kept by `decontaminate`, none by `find`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, chunks, lean, saved, small_batches, work_dir
from ._text import U, mix, prefix, raw, spans

WINDOW = 8
COVERED = 13
LEAST = 4
ALONE = 3
#: Bits of the bitmap of benchmark windows, a power of two: 8 MB for each worker and at most 1,048,576 words for the driver.
FILTER_BITS = 1 << 26

# Words for numbers and units in the languages of the corpus.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split()
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms tonne tonnes ton tons ounce ounces oz pound pounds lb lbs "
    "ml cl l litre litres liter liters gallon gallons cup cups second seconds sec minute minutes min hour hours h day days week weeks month months year years "
    "cent cents dollar dollars euro euros usd eur gbp percent degree degrees celsius fahrenheit metre metres meter meters kilometre kilometres kilometer kilometers "
    "kmh mph watt watts kw kwh volt volts joule joules newton newtons hz khz mhz ghz kb mb gb tb"
).split()

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:\n"]] = True
WINDOWS = "doc long, of long, pos int, mode int, size int, hash long, template string, slots array<string>, tokens int, own boolean"
#: Modes of windows: names as words, names as placeholders, all as it is.
PLAIN, NAMES, LITERAL = 0, 1, 2


def folded(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    high = np.zeros(len(data), bool)
    high[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    out[high] += 32
    return out


def _hashes(words: list[str]) -> np.ndarray:
    data, at = raw(pa.array(words))
    return np.sort(spans(prefix(data), at[:-1], at[1:]))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, h)
    at[at == len(known)] = 0
    return known[at] == h if len(known) else np.zeros(len(h), bool)


class Canonical:
    """Tokens of texts: row, hash as a word, kind (0 word, 1 number, 2 unit, 3 name), span."""

    numbers, units = _hashes(NUMBERS), _hashes(UNITS)

    def __init__(self, values: pa.Array):
        data, at = raw(values)
        self.data = folded(data)
        digit, letter = _DIGIT[data], _LETTER[data]
        if len(data) > 2:
            digit[1:-1] |= ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
        kind = np.where(letter, 1, np.where(digit, 2, 0)).astype(np.int8)
        begins = kind > 0
        begins[1:] &= kind[1:] != kind[:-1]
        inner = at[(at > 0) & (at < len(data))]
        begins[inner] = kind[inner] > 0
        last = kind > 0
        last[:-1] &= kind[1:] != kind[:-1]
        last[inner - 1] = kind[inner - 1] > 0
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.start, at)
        self.row = np.repeat(np.arange(len(at) - 1), np.diff(self.first))
        self.hash = spans(prefix(self.data), self.start, self.end)
        number = (kind[self.start] == 2) | _among(self.hash, self.numbers)
        same = np.zeros(len(self.start), bool)
        same[1:] = self.row[1:] == self.row[:-1]
        unit = np.zeros(len(self.start), bool)
        unit[1:] = number[:-1] & same[1:] & ~number[1:] & _among(self.hash[1:], self.units)
        stops = np.concatenate([[0], np.cumsum(_STOP[data])])
        opening = ~same
        if len(self.start) > 1:
            opening[1:] |= stops[self.start[1:]] > stops[self.end[:-1]]
        lead, after = data[self.start], np.append(data, np.uint8(0))[self.start + 1]
        capital = ((lead >= 65) & (lead <= 90)) | ((lead == 0xC3) & (after >= 0x80) & (after <= 0x9E))
        self.kind = np.where(number, 1, np.where(unit, 2, np.where(capital & ~opening, 3, 0))).astype(np.int8)
        lines = np.concatenate([[0], np.cumsum(data == 10)])
        self.begins, self.ends = ~same, np.append(~same[1:], True)[: len(same)]
        if len(self.start) > 1:
            apart = lines[self.start[1:]] > lines[self.end[:-1]]
            self.begins[1:] |= apart
            self.ends[:-1] |= apart

    def text(self, i: int) -> str:
        return self.data[self.start[i] : self.end[i]].tobytes().decode("utf-8", "replace")

    def windows(self, size: int, mode: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First tokens and hashes of windows, and whether each is told by itself: those with as many words as placeholders at
        least, and LEAST words or `size` if less. LITERAL has the windows that are not, as PLAIN ones, with their values."""
        kind = np.where((self.kind == 3) & (mode != NAMES), 0, self.kind)
        n = len(kind) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        k = np.flatnonzero(self.row[:n] == self.row[size - 1 :])
        if size < ALONE:
            k = k[self.begins[k] & self.ends[k + size - 1]]
        words = np.concatenate([[0], np.cumsum(kind == 0)])
        count = words[k + size] - words[k]
        own = (count * 2 >= size) & (count >= min(LEAST, size))
        if mode == LITERAL:
            k, own = k[~own], np.ones(int((~own).sum()), bool)
        if mode == NAMES:  # without a name it is what PLAIN has
            names = np.concatenate([[0], np.cumsum(kind == 3)])
            named = names[k + size] > names[k]
            k, own = k[named], own[named]
        h = self.hash if mode == LITERAL else np.where(kind == 0, self.hash, kind.astype(np.uint64) + U(10))
        out = np.full(len(k), size * 4 + mode, np.uint64)
        for i in range(size):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[k + i])
        return k, out, own

    def described(self, k: int, size: int, mode: int) -> tuple[str, list[str]]:
        shown, slots = [], []
        for i in range(k, k + size):
            kind = 0 if mode == LITERAL or self.kind[i] == 3 and mode == PLAIN else int(self.kind[i])
            shown.append(("", "<number>", "<unit>", "<name>")[kind] or self.text(i))
            if kind:
                slots.append("wnum"[kind] + ":" + self.text(i))
        return " ".join(shown), slots


def windowed(sizes: list[int] | None, known, reach: int = 0):
    """Window rows of (doc, of, text). `sizes` None: a benchmark, each item with its own size, WINDOW at most.
    `known`: broadcast of the bitmap of hashes to keep, or None. `reach`: tokens of the longest item; of a document, windows that
    are not told by themselves are left out where no other window is as near as that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = None if known is None else known.value
        for batch in batches:
            for part in chunks(batch, "text"):
                c = Canonical(part.column(2))
                tokens = np.diff(c.first)
                rows: list[tuple] = []
                doc, of = part.column(0).to_pylist(), part.column(1).to_pylist()
                for size in sizes if sizes is not None else sorted({min(WINDOW, int(t)) for t in tokens if t}):
                    found = {}
                    for mode in (PLAIN, NAMES, LITERAL):
                        k, h, own = c.windows(size, mode)
                        if sizes is None:
                            on = np.minimum(tokens[c.row[k]], WINDOW) == size
                            k, h, own = k[on], h[on], own[on]
                        if keep is not None:
                            at = h & U(len(keep) * 64 - 1)
                            on = (keep[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1
                            k, h, own = k[on], h[on], own[on]
                        found[mode] = k, h, own
                    told = np.sort(np.concatenate([found[m][0][found[m][2]] for m in (PLAIN, NAMES)]))
                    for mode, (k, h, own) in found.items():
                        if sizes is not None:
                            on = own | (np.searchsorted(told, k + reach, "right") > np.searchsorted(told, k - reach))
                            k, h, own = k[on], h[on], own[on]
                        for i, x, o in zip(k.tolist(), h.view(np.int64).tolist(), own.tolist()):
                            r = int(c.row[i])
                            rows.append((doc[r], of[r], i - int(c.first[r]), mode, size, x, *c.described(i, size, mode), int(tokens[r]), o))
                if rows:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.int32(), pa.bool_())
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), types)], ["doc", "of", "pos", "mode", "size", "hash", "template", "slots", "tokens", "own"])

    return run


def bitmap(items: DataFrame) -> np.ndarray:
    """FILTER_BITS bits in words of 64: the low bits of the hashes of windows. Words are made by the cluster; a bounded number comes
    to the driver."""
    bit = F.col("hash").bitwiseAND(F.lit(FILTER_BITS - 1))
    words = items.select(bit.alias("b")).groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def find(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """doc, of (hash of the text), items (sorted ids), n_windows (matched windows) of each contaminated row of docs. Reads from
    scratch."""
    spark = docs.sparkSession
    of = lambda df, k: df.where(F.col(text).isNotNull()).select(F.col(k).cast("long").alias("doc"), F.xxhash64(text).alias("of"), F.col(text).alias("text"))
    items = scratch.saved(of(benchmark.where(F.col(item).isNotNull()), item).mapInArrow(lean(windowed(None, None)), WINDOWS), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    known = spark.sparkContext.broadcast(bitmap(items))
    reach = items.agg(F.max("tokens")).first()[0] or 0
    seen = scratch.saved(of(docs, key).mapInArrow(lean(windowed(sizes, known, reach)), WINDOWS).drop("tokens"), "windows")
    there = items.select(F.col("doc").alias("item"), F.col("pos").alias("at"), "mode", "size", "hash", "template", F.col("slots").alias("values"), F.col("tokens").alias("length"), "own")
    shift = (F.col("pos") - F.col("at")).alias("shift")
    columns = ["doc", "of", "item", "length", "size", "mode", "at", shift, "own", "slots", "values"]
    told = scratch.saved(seen.where("own").drop("own").join(there.where("own"), ["hash", "mode", "size", "template"]).select(*columns), "matches")
    # where a window matches, those of its item that are not told by themselves are looked for at the same distance;
    # both sides grow with docs and are not broadcast
    places = told.where(F.col("mode") != LITERAL).select(F.col("doc").alias("d"), F.col("of").alias("o"), "item", "shift").distinct()
    awaited = places.join(there.where(~F.col("own")), "item").withColumnsRenamed({"mode": "m", "size": "z", "hash": "h", "template": "t"})
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("of") == F.col("o")) & (F.col("pos") == F.col("at") + F.col("shift"))
    same = same & (F.col("mode") == F.col("m")) & (F.col("size") == F.col("z")) & (F.col("hash") == F.col("h")) & (F.col("template") == F.col("t"))
    led = seen.where(~F.col("own")).drop("own").join(awaited.hint("merge"), same).select(*(c if isinstance(c, str) else "shift" for c in columns))
    met = scratch.saved(told.unionByName(led), "runs").withColumn("pairs", F.zip_with("values", "slots", lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    gathered = lambda c: F.array_distinct(F.flatten(F.collect_set(c)))
    whole = met.groupBy("doc", "of", "item", "mode", "shift").agg(gathered(F.when(F.col("own"), F.col("pairs"))).alias("told"), gathered("pairs").alias("all"))

    def fits(c: str) -> Column:
        names = F.filter(c, lambda p: p["a"].startswith("m:"))
        return (F.size(F.array_distinct(F.col(c)["a"])) == F.size(c)) & (F.size(F.array_distinct(F.transform(names, lambda p: p["b"]))) == F.size(names))

    # names of the joined columns are those of `whole`; a null doc is a value like others
    same = whole.select(F.col("doc").alias("d"), F.col("of").alias("o"), F.col("item").alias("t"), F.col("mode").alias("m"), F.col("shift").alias("s"), fits("told").alias("fits"), fits("all").alias("all_fit"))
    on = F.col("doc").eqNullSafe(F.col("d")) & (F.col("of") == F.col("o")) & (F.col("item") == F.col("t")) & (F.col("mode") == F.col("m")) & (F.col("shift") == F.col("s"))
    good = met.join(same.hint("merge"), on).where(F.when(F.col("own"), F.col("fits") | (F.col("slots") == F.col("values"))).otherwise(F.col("all_fit")))
    run = good.groupBy("doc", "of", "item", "length", "size", "shift").agg(
        F.max(F.col("own") & (F.col("mode") != LITERAL)).alias("leads"), F.collect_set("at").alias("every"), F.collect_set(F.when(F.col("own"), F.col("at"))).alias("alone")
    )
    good = run.select("doc", "of", "item", "length", "size", F.explode(F.when(F.col("leads"), F.col("every")).otherwise(F.col("alone"))).alias("at"))
    need = F.greatest(F.lit(1), F.least(F.lit(COVERED), F.col("length")) - F.col("size") + 1)
    each = good.groupBy("doc", "of", "item", "length", "size").agg(F.count_distinct("at").alias("n")).where(F.col("n") >= need)
    return each.groupBy("doc", "of").agg(F.array_sort(F.collect_set("item")).alias("items"), F.sum("n").alias("n_windows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text") -> DataFrame:
    """docs with contaminated boolean, items array<long> (empty if none) and n_windows long."""
    spark = docs.sparkSession
    small_batches(spark)
    with Scratch(spark, "decontamination") as scratch:
        found = saved(find(docs, benchmark, scratch, key, item, text).withColumnsRenamed({"doc": "__doc", "of": "__of"}), work_dir(spark, "contaminated"))
    kept = [c for c in docs.columns if c not in ("contaminated", "items", "n_windows")]
    base = docs.select(*kept).withColumn("__text", F.xxhash64(text))
    joined = base.join(found, base[key].cast("long").eqNullSafe(found["__doc"]) & (base["__text"] == found["__of"]), "left")
    return joined.select(
        *kept,
        F.col("__of").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast("array<long>")).alias("items"),
        F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"),
    )
