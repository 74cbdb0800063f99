"""Content-defined anchors: any two equal strings of `width` bytes have an anchor at the same place.

An anchor is the least hash (leftmost at a tie) among the grams of half the width in some window of `width` bytes
(winnowing). Every window is owned by the one anchor that it selects; an anchor owns a run of consecutive windows."""

from __future__ import annotations

import numpy as np

from ._text import U, mix, prefix, spans


def _slide(x: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of each `width` consecutive values."""
    f, done = (np.minimum if least else np.maximum), 1
    while done * 2 <= width:
        x = f(x[: len(x) - done], x[done:])
        done *= 2
    return f(x[: len(x) - (width - done)], x[width - done :]) if done < width else x


def anchors(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts data[at[i]:at[i + 1]]: row, position, hash, first and last owned window of each anchor (positions in data).
    Texts shorter than `width` have none."""
    gram = width // 2
    reach = width - gram + 1  # grams in a window
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < width:
        return none, none, np.zeros(0, np.uint64), none, none
    sums = prefix(data)
    start = np.arange(n - gram + 1)
    h = spans(sums, start, start + gram)
    least = _slide(h, reach, True)  # of window i: n - width + 1 values
    inside = np.zeros(n + 1, np.int32)
    size = np.diff(at)
    long = np.flatnonzero(size >= width)
    np.add.at(inside, at[long], 1)
    np.add.at(inside, at[long + 1] - width + 1, -1)
    ok = np.cumsum(inside)[: len(least)] > 0
    least[~ok] = 0
    pad = np.zeros(reach - 1, np.uint64)
    most = _slide(np.concatenate([pad, least, pad]), reach, False)  # over windows that hold gram p
    p = np.flatnonzero((most == h) & (most > 0))
    row = np.searchsorted(at, p, "right") - 1
    hp = h[p]
    lo = np.maximum(p - (reach - 1), at[row])
    hi = np.minimum(p, at[row + 1] - width)
    if len(p) > 1:
        same = row[1:] == row[:-1]
        left = same & (hp[:-1] <= hp[1:])
        lo[1:] = np.where(left, np.maximum(lo[1:], p[:-1] + 1), lo[1:])
        right = same & (hp[1:] < hp[:-1])
        hi[:-1] = np.where(right, np.minimum(hi[:-1], p[1:] - reach), hi[:-1])
    keep = lo <= hi
    # least hashes lie low: mixed once more, they spread evenly over shards
    return row[keep], p[keep], mix(hp[keep] ^ U(0x8C72E1A5D3B9F467)), lo[keep], hi[keep]
