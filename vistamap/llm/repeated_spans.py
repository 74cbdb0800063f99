"""Removal of byte strings that occur earlier in the corpus: a hash-compared suffix sort.

Every string of `width` bytes that also starts earlier (smaller doc_id, or the same document and an earlier start) is
removed, on the input as it is. Equal strings of that width own equal anchors at the same place (see _anchors), so only
suffixes at the same anchor have to be sorted against each other:

1. Anchor hashes are counted, in packed sorted blocks as in ngram_lm; those that occur once are settled.
2. For every occurrence of the others, the bytes of the windows that the anchor owns go to the shard of its hash. A map task
   sends equal surroundings once, with their earliest place; what it saw later, and found equal byte by byte, is marked there and
   then. An anchor with more than HOT occurrences, whose surroundings may differ without end, is split: its windows by
   place into stretches, and each stretch by the bytes that all its windows share, which equal windows have in common.
   Stretches of one window are left where that isn't enough, and of equal ones each task sends one. So no group that is
   sorted has more than HOT * MILD rows, or than map tasks send; all of them are sorted and compared in the same way.
3. A shard sorts, for each anchor, the suffixes that start at it, and likewise the reversed prefixes that end at it, by mergesort.
   Two suffixes are compared by their longest common extension: a binary search over prefix polynomial hashes. The common
   extensions of neighbours in the two orders then tell for each window which earlier window it equals. The bytes of all
   neighbours are compared as well; if a hash ever lied, that block is sorted by its bytes instead.
4. Removed runs are merged per document into sorted arrays in the shared folder, which the last pass over the texts maps
   into memory: texts are never shuffled.

Nulls: a null text is empty; a null doc_id comes before all others. Rows that share a doc_id are ordered by a hash of their
texts; rows alike in both are one document and get the same result. An empty table gives an empty result. Other columns
stay out."""

from __future__ import annotations

import hashlib
import io
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._anchors import anchors
from ._shared import chunks, lean, posix, small_batches, work_dir
from ._text import U, mix, powers, prefix, raw, spans
from .ngram_lm import BLOCKS, Arrays, Pending, by_hash, gathered, merge, write_array

SHARD_BYTES = 8 << 20
#: Bytes of contexts that a map task gathers before it sends them on, and that a shard sorts at a time (whole anchors).
GATHERED = 12 << 20
SORTED = 1 << 20
#: Bytes of texts that a map task works on at a time.
READ = 1 << 19
#: Occurrences of an anchor up to which its contexts are sorted together; windows in a stretch of a more frequent one, and the
#: times HOT up to which that will do.
HOT, STRETCH, MILD = 5000, 7, 50
#: Contexts (of two widths at most) that are hashed at a time.
HASHED = 8192
NULL_ID = np.iinfo(np.int64).min


def common(sums: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the longest common extension of positions x and y, `most` at most: binary search over prefix hashes."""
    _, inverse = powers(len(sums))
    low, high = np.zeros(len(x), np.int64), most.copy()
    sx, sy, ix, iy = sums[x], sums[y], inverse[x], inverse[y]
    for _ in range(int(most.max(initial=0)).bit_length()):
        middle = (low + high + 1) >> 1
        same = (sums[x + middle] - sx) * ix == (sums[y + middle] - sy) * iy
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


class Suffixes:
    """Strings data[start:start + length] in groups; group numbers ascend."""

    def __init__(self, data: np.ndarray, start: np.ndarray, length: np.ndarray, group: np.ndarray):
        self.data = np.append(data, np.uint8(0))
        self.sums, self.start, self.length, self.group = prefix(data), start, length, group

    def less(self, x: np.ndarray, y: np.ndarray, or_equal: np.ndarray) -> np.ndarray:
        most = np.minimum(self.length[x], self.length[y])
        n = common(self.sums, self.start[x], self.start[y], most)
        end = n == most
        a, b = self.data[self.start[x] + np.where(end, 0, n)], self.data[self.start[y] + np.where(end, 0, n)]
        by_length = np.where(or_equal, self.length[x] <= self.length[y], self.length[x] < self.length[y])
        return np.where(end, by_length, a < b)

    def sort(self) -> np.ndarray:
        """A permutation into ascending order within groups: bottom-up mergesort, all pairs of runs at once."""
        n = len(self.start)
        order = np.arange(n)
        if not n:
            return order
        base = np.flatnonzero(np.r_[True, self.group[1:] != self.group[:-1]])
        size = np.diff(np.r_[base, n])
        base, size = np.repeat(base, size), np.repeat(size, size)
        own = np.arange(n) - base
        run = 1
        while run < size.max():
            busy = np.flatnonzero(size > run)
            b, k, s = base[busy], own[busy], size[busy]
            odd = (k // run) & 1
            other = (k // run + 1 - 2 * odd) * run
            low, high = np.minimum(other, s), np.minimum(other + run, s)
            first = low.copy()
            while True:  # how many of the other run come before
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) >> 1
                # an equal item of the left run stays ahead
                before = self.less(order[b[open_] + middle], order[busy[open_]], odd[open_] == 1)
                low[open_] = np.where(before, middle + 1, low[open_])
                high[open_] = np.where(before, high[open_], middle)
            to = b + (k // (2 * run)) * 2 * run + k % run + low - first
            merged = order.copy()
            merged[to] = order[busy]
            order = merged
            run *= 2
        return order

    def extensions(self, order: np.ndarray) -> np.ndarray | None:
        """Common bytes of each item with the one before it in the order, -1 at a group's first; None if a hash lied."""
        out = np.full(len(order), -1, np.int64)
        x, y = order[:-1], order[1:]
        k = np.flatnonzero(self.group[x] == self.group[y])
        x, y = x[k], y[k]
        most = np.minimum(self.length[x], self.length[y])
        n = common(self.sums, self.start[x], self.start[y], most)
        out[k + 1] = n
        wide = int(n.max(initial=0))
        for at in range(wide):
            on = n > at
            if (self.data[self.start[x[on]] + at] != self.data[self.start[y[on]] + at]).any():
                return None
        ended = n == most
        if (self.data[self.start[x[~ended]] + n[~ended]] >= self.data[self.start[y[~ended]] + n[~ended]]).any() or (self.length[x[ended]] > self.length[y[ended]]).any():
            return None
        return out

    def sorted(self) -> tuple[np.ndarray, np.ndarray]:
        """The order, and each item's common extension with the one before it."""
        order = self.sort()
        got = self.extensions(order)
        if got is None:
            texts = [self.data[s : s + n].tobytes() for s, n in zip(self.start.tolist(), self.length.tolist())]
            order = np.array(sorted(range(len(texts)), key=lambda i: (self.group[i], texts[i])), np.int64)
            got = np.full(len(order), -1, np.int64)
            for k in range(1, len(order)):
                if self.group[order[k]] == self.group[order[k - 1]]:
                    got[k] = len(os.path.commonprefix([texts[order[k]], texts[order[k - 1]]]))
        return order, got


def classes(order: np.ndarray, extension: np.ndarray, depth: int) -> np.ndarray:
    """Numbers that two items share exactly if their first `depth` bytes are equal (both that long) and their group is."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(extension < depth)
    return out


def repeated_windows(data: np.ndarray, start: np.ndarray, group: np.ndarray, before: np.ndarray, after: np.ndarray, rank: np.ndarray, width: int, gram: int) -> np.ndarray:
    """For contexts of `before` + width + `after`... bytes: whether each owned window equals one of a context with smaller rank.

    A context's bytes start at start; its anchor `before` bytes further; it owns windows at 0 .. before + after relative to its
    start, the last of which begins `after` bytes (0 or less) from the anchor. Column j is the window that begins
    j - (width - gram) bytes from the anchor."""
    reach = width - gram
    anchor = start + before
    right = Suffixes(data, anchor, width + after, group)
    order_r, ext_r = right.sorted()
    left = Suffixes(np.ascontiguousarray(data[::-1]), len(data) - anchor, before, group)
    order_l, ext_l = left.sorted()
    out = np.zeros((len(start), reach + 1), bool)
    for r in range(-reach, 1):
        own = np.flatnonzero((r >= -before) & (r <= after))
        if len(own) < 2:
            continue
        key = classes(order_r, ext_r, width + r)[own] * (len(start) + 1) + classes(order_l, ext_l, -r)[own]
        by = np.lexsort((rank[own], key))
        later = np.zeros(len(own), bool)
        later[by[1:]] = key[by[1:]] == key[by[:-1]]
        out[own, r + reach] = later
    return out


def shard_key(doc: np.ndarray, text: np.ndarray) -> np.ndarray:
    return mix(mix(doc.view(np.uint64)) + text)


def ids(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column.cast(pa.int64()), int(NULL_ID)).to_numpy(zero_copy_only=False)


def text_hash(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    return spans(prefix(data), at[:-1], at[1:])


CONTEXT = pa.schema([("hash", pa.uint64()), ("doc", pa.int64()), ("text", pa.uint64()), ("p", pa.int64()), ("before", pa.int16()), ("after", pa.int16()), ("bytes", pa.large_binary())])
DECIDED = pa.schema([("doc", pa.int64()), ("text", pa.uint64()), ("from", pa.int64()), ("to", pa.int64())])


def packed(table: pa.Table) -> bytes:
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(table)
    return sink.getvalue()


def ragged(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the ranges in a row, and their n + 1 offsets."""
    at = np.concatenate([[0], np.cumsum(length)])
    return data[np.arange(at[-1]) + np.repeat(start - at[:-1], length)], at


def binary(data: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])


def surroundings_hash(t: pa.Table) -> np.ndarray:
    out = np.empty(len(t), np.uint64)
    for at in range(0, len(t), HASHED):  # prefix hashes take eight bytes for each byte
        part = t.slice(at, HASHED)
        data, cut = raw_bytes(part["bytes"])
        out[at : at + HASHED] = mix(spans(prefix(data), cut[:-1], cut[1:]) + mix(part["hash"].to_numpy() + part["before"].to_numpy().astype(np.uint64)))
    return out


def alike(t: pa.Table, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows x and y have the same anchor hash, place of the anchor and bytes."""
    h, before = t["hash"].to_numpy(), t["before"].to_numpy()
    data, cut = raw_bytes(t["bytes"])
    size = np.diff(cut)
    out = (h[x] == h[y]) & (before[x] == before[y]) & (size[x] == size[y])
    for at in range(0, len(x), HASHED):
        k = at + np.flatnonzero(out[at : at + HASHED])
        if len(k):
            one, first = ragged(data, cut[x[k]], size[x[k]])
            other, _ = ragged(data, cut[y[k]], size[y[k]])
            out[k] = np.add.reduceat((one != other).astype(np.int64), first[:-1]) == 0
    return out


def first_of_equal(t: pa.Table) -> tuple[pa.Table, pa.Table]:
    """Contexts with the earliest place of each (hash, surroundings); the rest. Equal hashes only propose what is equal: the
    rest is compared byte by byte, and what differs stays with the first."""
    t = t.combine_chunks()
    doc, p, text, same = t["doc"].to_numpy(), t["p"].to_numpy(), t["text"].to_numpy(), surroundings_hash(t)
    order = np.lexsort((p, text, doc, same))
    first = np.r_[True, same[order][1:] != same[order][:-1]] if len(order) else np.zeros(0, bool)
    lead = order[np.flatnonzero(first)[np.cumsum(first) - 1]]
    equal = ~first
    equal[equal] = alike(t, order[equal], lead[equal])
    # a repeated row is no earlier place of its own
    later = equal & ((doc[order] != doc[lead]) | (text[order] != text[lead]) | (p[order] != p[lead]))
    return t.take(pa.array(np.sort(order[~equal]))), t.take(pa.array(order[later]))


def stretched(t: pa.Table, width: int, size: np.ndarray) -> pa.Table:
    """Contexts cut into stretches of `size` windows; the hash of each is that of its anchor, its place and the bytes that all
    windows of such a stretch share."""
    out = []
    for at in range(0, len(t), HASHED):
        part, step = t.slice(at, HASHED), size[at : at + HASHED]
        data, cut = raw_bytes(part["bytes"])
        before, after = part["before"].to_numpy().astype(np.int64), part["after"].to_numpy().astype(np.int64)
        count = before // step - -after // step + 1  # stretches are numbered from the anchor backwards
        of = np.repeat(np.arange(len(part)), count)
        number = (-after // step)[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
        step, before, after = step[of], before[of], after[of]
        lo, hi = np.maximum(-before, -(number + 1) * step + 1), np.minimum(after, -number * step)  # first and last window
        anchor, sums = cut[of] + before, prefix(data)
        # what the first and the last window of a whole stretch share
        core = spans(sums, anchor - number * step, anchor - (number + 1) * step + 1 + width)
        h = mix(part["hash"].to_numpy()[of] + mix(core + mix(number.astype(np.uint64) + U(1))))
        pieces = binary(*ragged(data, anchor + lo, hi - lo + width))
        columns = [h, part["doc"].to_numpy()[of], part["text"].to_numpy()[of], part["p"].to_numpy()[of], (-lo).astype(np.int16), hi.astype(np.int16), pieces]
        out.append(pa.table(columns, schema=CONTEXT))
    return pa.concat_tables(out) if out else CONTEXT.empty_table()


def raw_bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def decided(t: pa.Table, width: int) -> pa.Table:
    """Removed runs of contexts all of whose windows are repeated."""
    p, before, after = (t[c].to_numpy().astype(np.int64) for c in ("p", "before", "after"))
    return pa.table([t["doc"], t["text"], pa.array(p - before), pa.array(p + after + width)], schema=DECIDED)


def by_shard(t: pa.Table, key: np.ndarray, shard_of: Callable, kind: str) -> Iterator[pa.RecordBatch]:
    order = np.argsort(key, kind="stable")
    t, shard = t.take(pa.array(order)), shard_of(key[order])
    cut = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if len(shard) else []
    for a, b in zip(cut, [*cut[1:], len(shard)]):
        yield pa.RecordBatch.from_arrays([pa.array([int(shard[a])], pa.int32()), pa.array([kind]), pa.array([packed(t.slice(a, b - a))], pa.binary())], ["shard", "kind", "block"])


def unpacked(table: pa.Table, kind: str, schema: pa.Schema) -> pa.Table:
    got = [pa.ipc.open_stream(b.as_buffer()).read_all() for b, k in zip(table["block"], table["kind"].to_pylist()) if k == kind]
    return pa.concat_tables(got) if got else schema.empty_table()


def sorted_out(t: pa.Table, width: int) -> Iterator[pa.Table]:
    """Removed runs among the contexts of a shard."""
    t, later = first_of_equal(t)
    yield decided(later, width)
    h = t["hash"].to_numpy()
    order = np.lexsort((t["p"].to_numpy(), t["text"].to_numpy(), t["doc"].to_numpy(), h))
    h = h[order]
    base = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    size = np.diff(np.r_[base, len(h)])
    several = np.repeat(size > 1, size)
    t, h = t.take(pa.array(order[several])), h[several]
    if not len(h):
        return
    ends = np.flatnonzero(np.r_[h[1:] != h[:-1], True]) + 1
    weight = np.cumsum(pc.binary_length(t["bytes"]).to_numpy())
    a = 0
    while a < len(h):
        b = int(ends[min(np.searchsorted(weight[ends - 1], (weight[a - 1] if a else 0) + SORTED), len(ends) - 1)])
        part = t.slice(a, b - a)
        data, at = raw_bytes(part["bytes"])
        before, after = part["before"].to_numpy().astype(np.int64), part["after"].to_numpy().astype(np.int64)
        group = np.cumsum(np.r_[True, h[a + 1 : b] != h[a : b - 1]])
        found = repeated_windows(data, at[:-1], group, before, after, np.arange(b - a), width, width // 2)
        edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, begin = np.nonzero(edge == 1)
        _, end = np.nonzero(edge == -1)
        p = part["p"].to_numpy()[row] - (width - width // 2)
        yield pa.table([part["doc"].to_numpy()[row], part["text"].to_numpy()[row], p + begin, p + end - 1 + width], schema=DECIDED)
        a = b


def joined(t: pa.Table) -> pa.Table:
    """Maximal runs of each document, in order."""
    doc, text, begin, end = (c.to_numpy() for c in t.columns)
    order = np.lexsort((begin, text, doc))
    doc, text, begin, end = doc[order], text[order], begin[order], end[order]
    if not len(doc):
        return DECIDED.empty_table()
    change = np.r_[True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1])]
    number = np.cumsum(change)
    step = int(end.max()) + 1
    reach = np.maximum.accumulate(end + number * step) - number * step  # furthest end so far within the document
    fresh = change.copy()
    fresh[1:] |= begin[1:] > reach[:-1]
    first = np.flatnonzero(fresh)
    return pa.table([doc[first], text[first], begin[first], np.maximum.reduceat(end, first)], schema=DECIDED)


def runs_key(t: pa.Table) -> np.ndarray:
    return shard_key(t["doc"].to_numpy(), t["text"].to_numpy())


def repeated_spans(docs: DataFrame, width: int = 100) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes left) and kept, the bytes left,
    for each row of docs (doc_id long, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    shards = max(4, int((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    root = posix(work_dir(spark, "repeats"))
    shard_of = by_hash(shards)

    def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending = Pending(shard_of, 1_000_000)
        for batch in batches:
            for part in chunks(batch, "text", READ):
                data, at = raw(part.column(1))
                keys, counts = np.unique(anchors(data, at, width)[2], return_counts=True)
                yield from pending.add(keys, counts)
        yield from pending.end()

    def merge_anchors(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = merge(table, 1)
        os.makedirs(f"{root}/anchors", exist_ok=True)
        write_array(f"{root}/anchors/{key[0].as_py()}.count.npy", np.minimum(counts[counts > 1], 1 << 30).astype(np.int32))
        write_array(f"{root}/anchors/{key[0].as_py()}.key.npy", keys[counts > 1])
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([int((counts > 1).sum())], pa.int64())], ["shard", "n"])

    def arrays(name: str, rows: list, *names: str) -> Arrays:
        sizes = {r["shard"]: r["n"] for r in rows}
        return Arrays(f"{root}/{name}", [sizes.get(i, 0) for i in range(shards)], names)

    repeated = arrays("anchors", gathered(docs.mapInArrow(lean(count_anchors), BLOCKS), merge_anchors, "shard int, n long", shards).collect(), "key", "count")

    def contexts(part: pa.RecordBatch) -> pa.Table:
        data, at = raw(part.column(1))
        row, p, h, lo, hi = anchors(data, at, width)
        distinct, back = np.unique(h, return_inverse=True)
        place, _ = repeated.find(distinct, shard_of(distinct))
        on = np.flatnonzero(place[back] >= 0)
        row, p, h, lo, hi = row[on], p[on], h[on], lo[on], hi[on]
        surroundings = binary(*ragged(data, lo, hi - lo + width))
        columns = [h, ids(part.column(0))[row], text_hash(data, at)[row], p - at[row], (p - lo).astype(np.int16), (hi - p).astype(np.int16), surroundings]
        return pa.table(columns, schema=CONTEXT)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            t, later = first_of_equal(pa.concat_tables(held))
            runs = [decided(later, width)]
            distinct, back = np.unique(t["hash"].to_numpy(), return_inverse=True)
            often = repeated.find(distinct, shard_of(distinct))[1][0][back]
            hot = often > HOT
            yield from by_shard(t.filter(pa.array(~hot)), t["hash"].to_numpy()[~hot], shard_of, "context")
            if hot.any():
                t, later = first_of_equal(stretched(t.filter(pa.array(hot)), width, np.where(often[hot] > HOT * MILD, 1, STRETCH)))
                yield from by_shard(t, t["hash"].to_numpy(), shard_of, "context")
                runs.append(decided(later, width))
            runs = joined(pa.concat_tables(runs))
            yield from by_shard(runs, runs_key(runs), shard_of, "decided")

        for batch in batches:
            for part in chunks(batch, "text", READ):
                t, later = first_of_equal(contexts(part))
                runs = joined(decided(later, width))
                yield from by_shard(runs, runs_key(runs), shard_of, "decided")
                held.append(t)
                size += t.nbytes
                if size > GATHERED:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def sort_shard(key: tuple, table: pa.Table) -> pa.Table:
        got = joined(pa.concat_tables([unpacked(table, "decided", DECIDED), *sorted_out(unpacked(table, "context", CONTEXT), width)]))
        out = list(by_shard(got, runs_key(got), shard_of, "decided"))
        return pa.Table.from_batches(out) if out else pa.table([pa.array([], pa.int32()), pa.array([], pa.string()), pa.array([], pa.binary())], ["shard", "kind", "block"])

    def merge_runs(key: tuple, table: pa.Table) -> pa.Table:
        got = joined(unpacked(table, "decided", DECIDED))
        os.makedirs(f"{root}/runs", exist_ok=True)
        for name in DECIDED.names:
            write_array(f"{root}/runs/{key[0].as_py()}.{name}.npy", got[name].to_numpy())
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([len(got)], pa.int64())], ["shard", "n"])

    block = "shard int, kind string, block binary"
    runs = gathered(docs.mapInArrow(lean(send), block), sort_shard, block, shards)
    removed = arrays("runs", gathered(runs, merge_runs, "shard int, n long", shards).collect(), *DECIDED.names)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text", READ):
                data, at = raw(part.column(1))
                doc, of = ids(part.column(0)), text_hash(data, at)
                rows: list[tuple] = []
                for i, s in enumerate(shard_of(shard_key(doc, of)).tolist()):
                    text = data[at[i] : at[i + 1]]
                    known, texts, begin, end = removed.shard(s)
                    a, b = np.searchsorted(known, doc[i]), np.searchsorted(known, doc[i], "right")
                    a, b = a + np.searchsorted(texts[a:b], of[i]), a + np.searchsorted(texts[a:b], of[i], "right")
                    keep = np.concatenate([text[x:y] for x, y in zip([0, *end[a:b].tolist()], [*begin[a:b].tolist(), len(text)])]).tobytes() if b > a else text.tobytes()
                    rows.append((len(text), len(text) - len(keep), int(b - a), hashlib.sha256(keep).hexdigest(), keep))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(lean(apply), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


#: The same over DuckDB's `documents`: every string of 100 bytes, as hexadecimal digits. For small tables.
SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents), w as (select doc_id, unnest(range(length(h) // 2 - 99)) p, h from d where length(h) >= 200),
s as (select doc_id, p, substring(h, 2 * p + 1, 200) t from w), f as (select t, min((doc_id, p)) first, count(*) c from s group by t having count(*) > 1),
r as (select doc_id, p from s join f using (t) where (s.doc_id, s.p) <> f.first), o as (select *, lag(p) over (partition by doc_id order by p) before from r),
i as (select *, sum((before is null or p > before + 100)::int) over (partition by doc_id order by p) run from o),
j as (select doc_id, run, min(p) a, max(p) + 100 b from i group by 1, 2),
k as (select *, lag(b, 1, 0) over (partition by doc_id order by a) kept_from from j),
g as (select doc_id, sum(b - a) removed, count(*) n, string_agg(substring(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' order by a) || substring(any_value(h), 2 * max(b) + 1) left_ from k join d using (doc_id) group by doc_id)
select doc_id, length(h) // 2 n_bytes, coalesce(removed, 0)::bigint n_removed, coalesce(n, 0)::bigint n_spans, sha256(unhex(coalesce(left_, h))) kept_sha256 from d left join g using (doc_id)
"""
