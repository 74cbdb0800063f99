"""Words and hashes of Arrow string arrays, vectorised over bytes with NumPy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
#: Odd multiplier of the polynomial hash and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BYTES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least; one table for each worker."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        _powers[:] = []
        for base in (BASE, BASE_INVERSE):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            with np.errstate(over="ignore"):
                _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


def raw(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, nulls as empty, and the n + 1 offsets into them."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    values = pc.fill_null(values.cast(pa.large_string()), "")
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1] if len(values) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def prefix(data: np.ndarray, fold: bool = False) -> np.ndarray:
    """Prefix polynomial hashes: n + 1 values."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTES)[data] * powers(len(data) + 1)[0][: len(data)], out=out[1:])
    return out


def spans(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, alike wherever they lie."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start] + (end - start).astype(np.uint64) * U(0xD6E8FEB86659FD93))


@dataclass
class Words:
    doc: np.ndarray  #: row of each word
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  #: n + 1 offsets of rows into the words
    data: np.ndarray
    at: np.ndarray  #: n + 1 offsets of rows into the bytes


def words(values: pa.Array, fold: bool = True) -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z hashed as a-z if `fold`."""
    data, at = raw(values)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] = inside[cut]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[cut - 1] = inside[cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    return Words(doc, spans(prefix(data, fold), start, end), start, end, first, data, at)


def grams(w: Words, n: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all word n-grams; a text of fewer words, but one at least, gives its whole sequence if `short`."""
    if n > 1:
        keep = w.doc[n - 1 :] == w.doc[: len(w.doc) - n + 1] if len(w.doc) >= n else np.zeros(0, bool)
        k = np.flatnonzero(keep)
    else:
        k = np.arange(len(w.doc))
    h = np.zeros(len(k), np.uint64)
    for i in range(n):
        h = mix(h * U(BASE) + w.hash[k + i] + U(i + 1))
    doc = w.doc[k]
    if short:
        count = np.diff(w.first)
        few = np.flatnonzero((count > 0) & (count < n))
        extra = np.zeros(len(few), np.uint64)
        for i in range(n - 1):
            on = count[few] > i
            extra[on] = mix(extra[on] * U(BASE) + w.hash[w.first[few[on]] + i] + U(i + 1))
        if len(few):
            doc, h = np.concatenate([doc, few]), np.concatenate([h, mix(extra ^ U(0xA5A5A5A5A5A5A5A5))])
            order = np.argsort(doc, kind="stable")
            doc, h = doc[order], h[order]
    return doc, h
