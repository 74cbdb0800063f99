"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as sorted hash arrays that workers map into memory.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end for each text; a start mark stands before the
first token. A word is its 64-bit hash.

Counting never makes a row for a token: each map task sorts and sums its own n-grams and sends one packed block for each
shard, so a frequent word costs every task one entry. Shards merge blocks:

1. words: hash -> count. A shard holds a range of hashes; its file is sorted, so the shards in a row are one sorted array,
   and a word's place in it is its id.
2. grams of each length up to the order: (id of the gram that is its history, id of its last word) -> count, sharded by a hash of
   both, so that the many successors of a frequent word are spread. A gram's place is its id, with which the next length is keyed.
3. Below the order, a gram's count is the number of distinct words before it; of one that begins with the start mark, which nothing
   precedes, it stays the count itself.
4. Of each gram as a history: the total of what follows, and how many distinct words follow once, twice and more often. These
   and the counts of 3. lie beside the gram's own array, at the gram's place.

The files lie in the shared folder; workers map them, look up the distinct n-grams of a block of texts at a time, and so
hold no more of the model than the pages they touch. Files are written under another name and then renamed, so a task
that runs twice or is lost half-way does no harm. The model knows the length of every file; one that is missing or has
another length is an error, never an empty shard.

Nulls: a null text is empty and scores its end. A null doc_id is in no fold and learned from. Repeated rows count as often
as they come. Without any training token all scores are those of a uniform model over one token. An empty table gives
an empty result. Other columns stay out."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import chunks, lean, posix, small_batches, work_dir
from ._text import mix, words

#: Bytes of packed n-grams that a shard is meant to hold.
SHARD_BYTES = 12 << 20
BLOCK = 1 << 20
#: The hash that stands for the end of a text; words that hash to it or to 0 are moved to the next value.
END = np.uint64(1)
BLOCKS = "shard int, block binary"


def write_array(path: str, a: np.ndarray) -> None:
    other = f"{path}.{uuid.uuid4().hex}"
    with open(other, "wb") as f:
        np.save(f, a)
    os.replace(other, path)


def tokens(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every token, ends included, in order."""
    w = words(values)
    h = np.where(w.hash < 2, w.hash + np.uint64(2), w.hash)
    rows = len(w.first) - 1
    at = np.arange(len(h)) + w.doc
    ends = w.first[1:] + np.arange(rows)
    out, doc = np.empty(len(h) + rows, np.uint64), np.empty(len(h) + rows, np.int64)
    out[at], doc[at] = h, w.doc
    out[ends], doc[ends] = END, np.arange(rows)
    return doc, out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their sums."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first)


def pack(keys: np.ndarray, *columns: np.ndarray) -> bytes:
    """Sorted keys as differences, bytes of one significance together, and counts likewise: the shuffle's compression shrinks what
    differs little."""
    parts = [np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel()]
    parts += [c.astype("<u8").view(np.uint8).reshape(-1, 8).T.ravel() for c in columns]
    return np.concatenate(parts).tobytes()


def unpack(block: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(block, np.uint8)
    n = len(raw) // (8 + 8 * columns)
    got = [np.ascontiguousarray(raw[8 * i * n : 8 * (i + 1) * n].reshape(8, n).T).view("<u8").ravel() for i in range(columns + 1)]
    return [np.cumsum(got[0], dtype=np.uint64), *(c.astype(np.int64) for c in got[1:])]


def sharded(keys: np.ndarray, shard_of: Callable, *columns: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """A block for each shard, of sorted keys."""
    shard = shard_of(keys)
    order = np.argsort(shard, kind="stable")
    keys, shard, columns = keys[order], shard[order], [c[order] for c in columns]
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(keys) else []
    for a, b in zip(cut, [*cut[1:], len(keys)]):
        yield int(shard[a]), pack(keys[a:b], *(c[a:b] for c in columns))


def rows_of(blocks: Iterator[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
    for shard, block in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([block], pa.binary())], ["shard", "block"])


class Pending:
    """Keys, counts and values that go with keys of a map task, summed whenever `most` have come together, sent on when as many
    distinct ones have."""

    def __init__(self, shard_of: Callable, most: int = 1_500_000):
        self.shard_of, self.most, self.parts, self.n = shard_of, most, [], 0

    def add(self, keys: np.ndarray, *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.parts.append((keys, *columns))
        self.n += len(keys)
        if self.n > self.most:
            merged = self.merged()
            if len(merged[0]) > self.most // 2:
                yield from rows_of(sharded(merged[0], self.shard_of, *merged[1:]))
            else:
                self.parts, self.n = [merged], len(merged[0])

    def merged(self) -> tuple[np.ndarray, ...]:
        got = united([np.concatenate(x) for x in zip(*self.parts)]) if self.parts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.parts, self.n = [], 0
        return got

    def end(self) -> Iterator[pa.RecordBatch]:
        keys, *columns = self.merged()
        yield from rows_of(sharded(keys, self.shard_of, *columns))


def united(columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, the sums of their counts, and of further columns, which are alike for a key, a value each."""
    keys, counts, *rest = columns
    if not len(keys):
        return tuple(columns)
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts[order], first), *(c[order[first]] for c in rest)


def merge(table: pa.Table, columns: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the sums of their columns, a row each if there are several."""
    got = [unpack(b, columns) for b in table["block"].to_pylist()]
    return summed(np.concatenate([g[0] for g in got]), np.stack([np.concatenate([g[1 + i] for g in got]) for i in range(columns)], 1) if columns > 1 else np.concatenate([g[1] for g in got]))


class Arrays:
    """Sorted shards of one level, mapped when first touched. `sizes`: the length of each shard's arrays, 0 for one without files."""

    def __init__(self, path: str, sizes: list[int], names: tuple[str, ...]):
        self.path, self.sizes, self.names = path, sizes, names
        self.starts = np.concatenate([[0], np.cumsum(np.asarray(sizes, np.int64))])
        self.open: dict[tuple[int, str], np.ndarray] = {}

    def array(self, i: int, name: str) -> np.ndarray:
        """One of `names`, or what else lies at the same places."""
        if (i, name) not in self.open:
            got = np.load(f"{self.path}/{i}.{name}.npy", mmap_mode="r") if self.sizes[i] else np.zeros(0, np.uint64)
            if len(got) != self.sizes[i]:
                raise ValueError(f"{self.path}/{i}.{name}.npy has {len(got)} values instead of {self.sizes[i]}")
            self.open[i, name] = got
        return self.open[i, name]

    def shard(self, i: int) -> list[np.ndarray]:
        return [self.array(i, n) for n in self.names]

    def find(self, keys: np.ndarray, shard: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """For sorted distinct keys, with their shards: places within all shards in a row (-1: absent) and each column's values (0: absent)."""
        order = np.argsort(shard, kind="stable")
        if (np.diff(shard) < 0).any():
            place, values = self.find(keys[order], shard[order])
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            return place[back], [v[back] for v in values]
        place, values = np.full(len(keys), -1, np.int64), [np.zeros(len(keys), np.int64) for _ in self.names[1:]]
        cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(keys) else []
        for a, b in zip(cut, [*cut[1:], len(keys)]):
            known, *columns = self.shard(int(shard[a]))
            if not len(known):
                continue
            at = np.searchsorted(known, keys[a:b])
            at[at == len(known)] = 0
            hit = np.flatnonzero(known[at] == keys[a:b])
            place[a + hit] = at[hit] + self.starts[int(shard[a])]
            for v, c in zip(values, columns):
                v[a + hit] = c[at[hit]]
        return place, values

    def shard_at(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1

    def at(self, place: np.ndarray, *names: str) -> list[np.ndarray]:
        """Values at places (-1: 0), for places in any order."""
        out = [np.zeros(len(place), np.int64) for _ in names]
        some, back = np.unique(place, return_inverse=True)
        found = [np.zeros(len(some), np.int64) for _ in names]
        skip = int(np.searchsorted(some, 0))
        shard = self.shard_at(some[skip:])
        cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) + skip if len(shard) else []
        for a, b in zip(cut, [*cut[1:], len(some)]):
            i = int(shard[a - skip])
            for v, n in zip(found, names):
                v[a:b] = self.array(i, n)[some[a:b] - self.starts[i]]
        for o, v in zip(out, found):
            o[:] = v[back]
        return out


def by_hash(shards: int) -> Callable:
    return lambda keys: ((keys >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


#: Arrays of a level's grams as histories.
HISTORY = ("total", "one", "two", "more")


class Model:
    """What a worker needs to score; pickled with paths, lengths and totals only.

    about: order, shards, train_tokens; sizes[k]: lengths of the files of level k (words: 1); discounts[k]; start: total, one,
    two, more of the start mark as a history; total: of the words' counts; uniform: the mass that they leave to each word."""

    def __init__(self, path: str, about: dict):
        self.path, self.about = path, about
        self.levels: dict[int, Arrays] = {}

    def __getstate__(self) -> tuple:
        return self.path, self.about

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def level(self, k: int) -> Arrays:
        if k not in self.levels:
            self.levels[k] = Arrays(f"{self.path}/{k}", self.about["sizes"][k], ("key", "count"))
        return self.levels[k]

    def types(self, k: int) -> int:
        return sum(self.about["sizes"][k])

    def by_key(self, keys: np.ndarray) -> np.ndarray:
        return by_hash(self.about["shards"])(mix(keys))

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (from 1; 0: unknown) and counts of hashes."""
        distinct, back = np.unique(hashes, return_inverse=True)
        place, (count,) = self.level(1).find(distinct, by_hash(self.about["shards"])(distinct))
        return (place + 1)[back], count[back]

    def grams(self, k: int, history: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids (0: unknown) and counts of grams of length k, from the ids of their histories and last words."""
        distinct, back = np.unique(packed_key(history, word), return_inverse=True)
        place, (count,) = self.level(k).find(distinct, self.by_key(distinct))
        return (place + 1)[back], count[back]


def packed_key(history: np.ndarray, word: np.ndarray) -> np.ndarray:
    return (history.astype(np.uint64) << np.uint64(32)) | word.astype(np.uint64)


def histories(ids: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """From the ids of grams of length k that end at each token: those that end before it, and where there are any. Of length 1,
    the first token of a text has the start mark, 0."""
    before, there = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    same = doc[1:] == doc[:-1]
    before[1:] = np.where(same, ids[:-1], 0)
    there[1:] = same & (ids[:-1] > 0)
    if k == 1 and len(ids):
        there[0] = True
        there[1:] |= ~same
    return before, there


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times; halves where a count is missing."""
    if min(n[:3]) == 0:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    raw = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


def gathered(df: DataFrame, function: Callable, schema: str, shards: int) -> DataFrame:
    """function(key, table) of each shard's blocks; every shard is a task of its own."""
    return df.repartitionById(shards, F.col("shard")).groupBy("shard").applyInArrow(function, schema)


ORDER = 2
MADE = "shard int, n long, total long, n1 long, n2 long, n3 long, n4 long"


def made(shard: int, counts: np.ndarray) -> pa.Table:
    few = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
    names = [x.split()[0] for x in MADE.split(", ")]
    return pa.table([pa.array([x], pa.int32() if i == 0 else pa.int64()) for i, x in enumerate([shard, len(counts), int(counts.sum()), *few])], names)


def train(docs: DataFrame, shards: int | None = None, order: int = ORDER) -> Model:
    """The model of all texts of docs (text), of grams up to `order` words (2 at least)."""
    if order < 2:
        raise ValueError(f"order {order}: 2 at least")
    spark = docs.sparkSession
    small_batches(spark)
    if shards is None:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = max(4, int(size // SHARD_BYTES))
    path = work_dir(spark, "ngrams")
    root = posix(path)
    docs = docs.select("text")

    def files(k: int, shard: int, **arrays: np.ndarray) -> None:
        os.makedirs(f"{root}/{k}", exist_ok=True)
        for name, a in arrays.items():
            most = int(a.max(initial=0))
            write_array(f"{root}/{k}/{shard}.{name}.npy", a.astype(np.min_scalar_type(most)) if name != "key" and most < 1 << 32 else a)

    def lengths(rows: list) -> list[int]:
        got = {r["shard"]: r["n"] for r in rows}
        return [got.get(i, 0) for i in range(shards)]

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = Pending(by_hash(shards))
        for batch in batches:
            for part in chunks(batch, "text", BLOCK):
                yield from pending.add(*np.unique(tokens(part.column(0))[1], return_counts=True))
        yield from pending.end()

    def merge_words(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = merge(table, 1)
        files(1, key[0].as_py(), key=keys, count=counts)
        return made(key[0].as_py(), counts)

    rows = gathered(docs.mapInArrow(lean(count_words), BLOCKS), merge_words, MADE, shards).collect()
    model = Model(root, {"order": order, "shards": shards, "train_tokens": sum(r["total"] for r in rows), "sizes": {1: lengths(rows)}, "discounts": {}})
    about = model.about

    def count_grams(k: int) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pending = Pending(model.by_key)
            for batch in batches:
                for part in chunks(batch, "text", BLOCK):
                    doc, h = tokens(part.column(0))
                    word = ids = model.ids(h)[0]
                    for j in range(2, k):
                        before, there = histories(ids, doc, j - 1)
                        ids = np.where(there, model.grams(j, before, word)[0], 0)
                    before, there = histories(ids, doc, k - 1)
                    # of words, the id is the lower half of the key; of longer grams, that of the gram without its first word goes along
                    keys, first, counts = np.unique(packed_key(before, word)[there], return_index=True, return_counts=True)
                    yield from pending.add(keys, counts, *([ids[there][first]] if k > 2 else []))
            yield from pending.end()

        return run

    def merge_grams(k: int) -> Callable:
        def run(key: tuple, table: pa.Table) -> pa.Table:
            got = [unpack(b, 1 + (k > 2)) for b in table["block"].to_pylist()]
            keys, counts, *shorter = united([np.concatenate(c) for c in zip(*got)])
            files(k, key[0].as_py(), key=keys, count=counts, **({"shorter": shorter[0]} if shorter else {}))
            return made(key[0].as_py(), counts)

        return run

    for k in range(2, order + 1):
        if model.types(k - 1) >= 1 << 32:
            raise ValueError(f"more than 2**32 distinct grams of {k - 1} words: widen the packed keys")
        rows = gathered(docs.mapInArrow(lean(count_grams(k)), BLOCKS), merge_grams(k), MADE, shards).collect()
        about["sizes"][k] = lengths(rows)
        about["discounts"][k] = discounts([sum(r[f"n{x}"] for r in rows) for x in (1, 2, 3, 4)])  # of the order; others below

    def counts_of(k: int, shard: int) -> np.ndarray:
        """Counts of grams as the model takes them."""
        own = np.asarray(model.level(k).array(shard, "count")).astype(np.int64)
        if k == order:
            return own
        before = np.asarray(model.level(k).array(shard, "before")).astype(np.int64)
        return np.where(before > 0, before, own)

    def each_shard(k: int, function: Callable) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column(0).to_pylist():
                    yield from rows_of([(shard, b"")])  # every shard gets its files
                    yield from rows_of(function(shard))

        return spark.range(0, shards, 1, min(shards, 4096)).select(F.col("id").cast("int")).mapInArrow(lean(run), BLOCKS)

    def placed(k: int, ids: np.ndarray) -> np.ndarray:
        """Shards of grams of length k; the start mark, 0, has one of its own."""
        shard = model.level(k).shard_at(ids.astype(np.int64) - 1)
        return np.where(shard < 0, shards, shard)

    def words_before(k: int) -> list:
        """Writes, for each gram of length k, the number of distinct words before it."""

        def part(shard: int) -> Iterator[tuple[int, bytes]]:
            longer = model.level(k + 1)
            ids = np.asarray(longer.array(shard, "key")) & np.uint64(0xFFFFFFFF) if k == 1 else np.asarray(longer.array(shard, "shorter")).astype(np.uint64)
            ids, counts = np.unique(ids, return_counts=True)
            return sharded(ids, lambda x: placed(k, x), counts)

        def run(key: tuple, table: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            ids, counts = merge(table, 1)
            out = np.zeros(about["sizes"][k][shard], np.int64)
            out[ids.astype(np.int64) - 1 - model.level(k).starts[shard]] = counts
            files(k, shard, before=out)
            own = np.asarray(model.level(k).array(shard, "count")).astype(np.int64)
            return made(shard, np.where(out > 0, out, own))

        return gathered(each_shard(k + 1, part), run, MADE, shards).collect()

    def as_histories(k: int) -> None:
        """Writes what follows each gram of length k - 1, of grams of length k."""

        def part(shard: int) -> Iterator[tuple[int, bytes]]:
            history, counts = np.asarray(model.level(k).array(shard, "key")) >> np.uint64(32), counts_of(k, shard)
            first = np.flatnonzero(np.r_[True, history[1:] != history[:-1]]) if len(history) else np.zeros(0, np.int64)
            by = [np.add.reduceat(v.astype(np.int64), first) if len(first) else first for v in (counts, counts == 1, counts == 2, counts > 2)]
            return sharded(history[first], lambda x: placed(k - 1, x), *by)

        def run(key: tuple, table: pa.Table) -> pa.Table:
            shard = key[0].as_py()
            ids, sums = merge(table, 4)
            if shard < shards:
                at = ids.astype(np.int64) - 1 - model.level(k - 1).starts[shard]
                for i, name in enumerate(HISTORY):
                    out = np.zeros(about["sizes"][k - 1][shard], np.int64)
                    out[at] = sums[:, i]
                    files(k - 1, shard, **{name: out})
            return pa.table([pa.array([shard], pa.int32()), *(pa.array([int(sums[0, i]) if shard == shards else 0], pa.int64()) for i in range(4))], ["shard", *HISTORY])

        done = gathered(each_shard(k, part), run, "shard int, total long, one long, two long, more long", shards + 1).collect()
        if k == 2:
            about["start"] = next(([r[n] for n in HISTORY] for r in done if r["shard"] == shards), [0, 0, 0, 0])

    for k in range(order, 0, -1):
        if k < order:
            rows = words_before(k)
            about["discounts"][k] = discounts([sum(r[f"n{x}"] for r in rows) for x in (1, 2, 3, 4)])
            if k == 1:
                total = sum(r["total"] for r in rows)
                d = about["discounts"][1]
                some = [sum(r["n1"] for r in rows), sum(r["n2"] for r in rows), sum(r["n"] - r["n1"] - r["n2"] for r in rows)]
                about["total"], about["uniform"] = total, sum(x * y for x, y in zip(d, some)) / max(total, 1) / (model.types(1) + 1)
        if k > 1:
            as_histories(k)
    return model


def discounted(count: np.ndarray, d: list[float]) -> np.ndarray:
    return count - np.array([0.0, *d])[np.minimum(count, 3)]


def log_probabilities(model: Model, doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token, and its count in training."""
    about = model.about
    word, known = model.ids(hashes)
    if not model.types(1):
        return np.zeros(len(word)), known
    (before,) = model.level(1).at(word - 1, "before")
    p = discounted(before, about["discounts"][1]) / about["total"] + about["uniform"]
    ids = word
    for k in range(2, about["order"] + 1):
        history, there = histories(ids, doc, k - 1)
        ids, count = model.grams(k, history, word)
        ids = np.where(there, ids, 0)
        if k < about["order"]:
            (before,) = model.level(k).at(ids - 1, "before")
            count = np.where(before > 0, before, count)
        total, *seen = model.level(k - 1).at(np.where(there, history, 0) - 1, *HISTORY)
        if k == 2:
            starts = there & (history == 0)
            total = np.where(starts, about["start"][0], total)
            seen = [np.where(starts, x, y) for x, y in zip(about["start"][1:], seen)]
        d = about["discounts"][k]
        left = sum(x * y for x, y in zip(d, seen))
        p = np.where(there & (total > 0), (discounted(count, d) + left * p) / np.maximum(total, 1), p)
    return np.log10(p), known


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The columns `keep`, n_tokens, n_known, train_tokens, base_score and score for each row of docs."""
    small_batches(docs.sparkSession)
    schema = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep) + "n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, types = model.about["train_tokens"], model.types(1)
        for batch in batches:
            for part in chunks(batch, "text", BLOCK):
                doc, h = tokens(part.column(len(keep)))
                logs, counts = log_probabilities(model, doc, h)
                first = np.searchsorted(doc, np.arange(len(part)))
                base = np.log10((counts + 1.0) / (n + 1.0 * (types + 1)))
                sums = [np.add.reduceat(x, first) for x in (np.ones(len(doc), np.int64), (counts > 0).astype(np.int64), base, logs)]
                columns = [*part.columns[: len(keep)], pa.array(sums[0]), pa.array(sums[1]), pa.array(np.full(len(part), n, np.int64)), pa.array(sums[2]), pa.array(sums[3])]
                yield pa.RecordBatch.from_arrays(columns, [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return docs.select(*keep, "text").mapInArrow(lean(run), schema)


def perplexity(score_: Column, n_tokens: Column) -> Column:
    return F.pow(F.lit(10.0), -score_ / n_tokens)


def score_held_out(docs: DataFrame, folds: int = 7, fold: int = 2, order: int = ORDER) -> DataFrame:
    """Scores all rows of docs (doc_id, text) with a model of those outside the held-out fold: doc_id, held_out, n_tokens,
    n_known, train_tokens, base_score (add-one unigram), score, perplexity."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
    marked = docs.select("doc_id", "text", held.alias("held_out"))
    model = train(marked.where(~F.col("held_out")), order=order)
    return score(marked, model, "doc_id", "held_out").withColumn("perplexity", perplexity(F.col("score"), F.col("n_tokens")))
