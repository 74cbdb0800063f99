"""Token ids by distinct unit: each worker encodes a unit of text once and assembles texts from the results.

A unit is a stretch of text that the tokenizer never joins with its neighbours, so the ids of a text are the
ids of its units in a row. Units that are single words for the tokenizer are encoded many at a time and told apart by
the tokens that only begin (or only end) a word. Tests compare the result with encodings of whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from ._shared import one_thread
from ._text import _SPACE, prefix, raw, spans

#: Units that a worker remembers; beyond that it forgets those that it has met only once or twice since the last time.
REMEMBERED = 200_000
JOINED = 128
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: Marks that end a word of letters in both kinds of tokenizer and occur in no special token.
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".,!?;:%&*#$()"]] = True


def version(path: str) -> str:
    """SHA-256 of a tokenizer file: two versions never share counts."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class Memo:
    """`kind` "bytes": byte-level BPE, where a space belongs to the word after it. `kind` "words": words end in "</w>",
    white space is dropped and A-Z count as a-z. `ids` keeps token ids, else counts only."""

    def __init__(self, path: str, kind: str, ids: bool = False):
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.kind, self.ids = kind, ids
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.border = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.border[i] = token.startswith("Ġ") if kind == "bytes" else token.endswith("</w>")
        self.keys = np.zeros(0, np.uint64)  # sorted; of each: place in the next three
        self.place = np.zeros(0, np.int64)
        self.count = np.zeros(0, np.int64)
        self.begin = np.zeros(0, np.int64)
        self.met = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def forget(self) -> None:
        old = self.met > 2
        if old.sum() > REMEMBERED // 2:
            old[:] = False
        keep = old[self.place]
        place = self.place[keep]
        self.keys, self.count, self.met = self.keys[keep], self.count[place], np.zeros(int(keep.sum()), np.int64)
        if self.ids:
            self.flat = self.flat[runs(self.begin[place], self.count)]
        self.place = np.arange(len(self.keys))
        self.begin = np.cumsum(self.count) - self.count

    def units(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        inner = at[(at > 0) & (at < n)]
        mark = _LETTER[data[:-1]] & _MARK[data[1:]] if n else np.zeros(0, bool)
        if self.kind == "bytes":
            cut = np.zeros(n + 1, bool)
            cut[1:n] = mark
            if n > 2:  # a space between two characters of U+0021 to U+007E or U+00C0 to U+00FF (0xC3 and another byte)
                latin = data == 0xC3
                before = (data > 32) & (data < 127)
                after = before | latin
                before[1:] |= latin[:-1]
                cut[1 : n - 1] |= (data[1:-1] == 32) & before[:-2] & after[2:]
            cut[inner] = True
            cut[:1] = n > 0
            start = np.flatnonzero(cut[:n])
            return start, np.append(start[1:], n) if len(start) else start
        space = _SPACE[data]
        begins, ends = ~space, ~space
        begins[1:] &= space[:-1] | mark
        begins[inner] = ~space[inner]
        ends[:-1] &= space[1:] | mark
        ends[inner - 1] = ~space[inner - 1]
        return np.flatnonzero(begins), np.flatnonzero(ends) + 1

    def encode_units(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Counts of each text, and all ids in a row."""
        body = [x[1:] if self.kind == "bytes" and x[:1] == " " else "" if self.kind == "bytes" else x for x in texts]
        single = np.fromiter((b.isalpha() for b in body), bool, len(texts))
        counts = np.zeros(len(texts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        words = np.flatnonzero(single)
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        between = "" if self.kind == "bytes" else " "
        alone = [np.flatnonzero(~single)]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast([between.join([texts[i] for i in g.tolist()]) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            border = np.flatnonzero(self.border[ids])
            if len(border) != len(g):  # a word that normalisation takes apart
                alone.append(g)
                continue
            counts[g] = np.diff(np.append(border, len(ids))) if self.kind == "bytes" else np.diff(border, prepend=-1)
            parts.append((g, ids))
        rest = np.concatenate(alone)
        for i, e in zip(rest.tolist(), self.tokenizer.encode_batch_fast([texts[i] for i in rest.tolist()], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            counts[i] = len(ids)
            parts.append((np.array([i]), ids))
        if not self.ids:
            return counts, np.zeros(0, np.uint32)
        order = np.concatenate([g for g, _ in parts]) if parts else np.zeros(0, np.int64)
        begin = np.zeros(len(texts), np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        flat = np.concatenate([x for _, x in parts]) if parts else np.zeros(0, np.uint32)
        return counts, flat[runs(begin, counts)]

    def encode(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Token counts of each text; with `ids`, also all ids in a row."""
        data, at = raw(values)
        start, end = self.units(data, at)
        if len(self.keys) > REMEMBERED:
            self.forget()
        keys, index, back = np.unique(spans(prefix(data, self.kind == "words"), start, end), return_index=True, return_inverse=True)
        found = np.searchsorted(self.keys, keys)
        hit = np.zeros(len(keys), bool)
        inside = np.flatnonzero(found < len(self.keys))
        hit[inside] = self.keys[found[inside]] == keys[inside]
        place = np.zeros(len(keys), np.int64)
        place[hit] = self.place[found[hit]]
        new = np.flatnonzero(~hit)
        if len(new):
            whole = data.tobytes()
            counts, flat = self.encode_units([whole[a:b].decode("utf-8", "replace") for a, b in zip(start[index[new]].tolist(), end[index[new]].tolist())])
            place[new] = len(self.count) + np.arange(len(new))
            self.begin = np.append(self.begin, np.cumsum(counts) - counts + len(self.flat))
            self.count = np.append(self.count, counts)
            self.met = np.append(self.met, np.zeros(len(new), np.int64))
            self.flat = np.append(self.flat, flat)
            self.keys = np.insert(self.keys, found[new], keys[new])
            self.place = np.insert(self.place, found[new], place[new])
        self.met[place] += 1
        unit = place[back]
        sizes = self.count[unit]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        first = np.searchsorted(start, at)
        counted = sums[first[1:]] - sums[first[:-1]]
        return counted, self.flat[runs(self.begin[unit], sizes)] if self.ids else self.flat


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for size[0] values, then those of the next."""
    if not len(begin):
        return np.zeros(0, np.int64)
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(begin - before, size)
