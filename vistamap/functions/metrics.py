"""Distances between points held as arrays of doubles.

Each metric has two forms that agree: `column` builds a Spark expression from two array columns, for joins whose number of
rows is proportionate; `matrix` and `rows` are NumPy twins for blocked operators.

Null arrays give null in the column form. Arrays of different length are not compared by position beyond the shorter one in
NumPy; the column form pads with null and gives null."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


#: Rows of a table of distances, and numbers, that are finished at once, in the cache.
STRIP, CHUNK = 64, 1 << 15


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def half_away(x: np.ndarray) -> np.ndarray:
    """Nearest integer, halves away from zero, as Spark's round() has it."""
    return np.sign(x) * np.floor(np.abs(x) + 0.5)


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """x with so many decimals, as SQL's round() has it: the nearest integer of the product with a power of ten, halves away from zero."""
    x, unit = np.asarray(x, float), 10.0**digits
    out = np.empty_like(x)
    with np.errstate(over="ignore", invalid="ignore"):
        for at in range(0, len(x), CHUNK):
            p, r = x[at : at + CHUNK], out[at : at + CHUNK]
            negative = (p < 0).any()
            v = np.abs(p) * unit if negative else p * unit
            np.floor(v, out=r)
            np.subtract(v, r, out=v)
            r += v >= 0.5
            r /= unit
            if negative:
                np.copysign(r, p, out=r)
            if not (whole := np.isfinite(r)).all():
                r[~whole] = p[~whole]
    return out


@dataclass(frozen=True)
class Metric:
    """`kind`: euclid, torus, sphere, dot or null. `period`: of every coordinate, for torus and sphere."""

    kind: str = "euclid"
    period: float = 0.0

    @classmethod
    def of(cls, period: float = 0.0, sphere: float = 0.0, dot: bool = False) -> Metric:
        """From options: neither period is Euclid, `period` alone is a torus, `sphere` a hypersphere; dot excludes both."""
        if dot:
            if period or sphere:
                raise ValueError("the dot product takes no period")
            return cls("dot")
        return cls("sphere", sphere) if sphere else cls("torus", period) if period else cls()

    def difference(self, a: Column, b: Column) -> Column:
        """a - b; on a torus the wrapped b - a; on a sphere b - a with only the last coordinate wrapped."""
        wrap = lambda d: (d / self.period - F.round(d / self.period)) * self.period
        if self.kind == "torus":
            return F.zip_with(a, b, lambda x, y: wrap(y - x))
        if self.kind == "sphere":
            plain = F.zip_with(a, b, lambda x, y: y - x)
            return F.transform(plain, lambda d, i: F.when(i == F.size(a) - 1, wrap(d)).otherwise(d))
        return F.zip_with(a, b, lambda x, y: x - y)

    def column(self, a: Column, b: Column) -> Column:
        if self.kind == "null":
            return F.when(a.isNotNull() & b.isNotNull(), F.lit(0.0))
        if self.kind == "euclid":
            return F.sqrt(total(F.zip_with(a, b, lambda x, y: (y - x) * (y - x))))
        if self.kind == "torus":
            d = F.zip_with(a, b, lambda x, y: (y - x) / self.period)
            return F.sqrt(total(F.transform(d, lambda u: F.pow((u - F.round(u)) * self.period, F.lit(2.0)))))
        if self.kind == "dot":  # null where the product is not positive
            return -F.ln(total(F.zip_with(a, b, lambda x, y: x * y)))
        k = 2 * math.pi / self.period
        start = F.struct(F.lit(1.0).alias("p"), F.lit(1.0).alias("q"), F.lit(0.0).alias("s"))

        def step(t: Column, ab: Column) -> Column:
            x, y = ab["a"] * k, ab["b"] * k
            return F.struct((t["p"] * F.sin(x)).alias("p"), (t["q"] * F.sin(y)).alias("q"), (t["s"] + t["p"] * F.cos(x) * t["q"] * F.cos(y)).alias("s"))

        pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
        return F.aggregate(pairs, start, step, lambda t: F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), t["s"] + t["p"] * t["q"]))))

    def embedded(self, a: np.ndarray) -> np.ndarray:
        """Points of the unit hypersphere for rows of angles."""
        angle = a * (2 * math.pi / self.period)
        s = np.cumprod(np.sin(angle), 1)
        return np.concatenate([np.cos(angle[:, :1]), s[:, :-1] * np.cos(angle[:, 1:]), s[:, -1:]], 1)

    def matrix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of all rows of a to all rows of b."""
        if self.kind == "null":
            return np.zeros((len(a), len(b)))
        if self.kind == "dot":
            with np.errstate(divide="ignore", invalid="ignore"):
                s = a @ b.T
                return np.where(s > 0, -np.log(np.where(s > 0, s, 1.0)), np.nan)
        if self.kind == "sphere":
            return np.arccos(np.clip(self.embedded(a) @ self.embedded(b).T, -1, 1))
        if self.kind == "torus":
            return self.wrapped(a, b)
        na, nb = (a * a).sum(1), (b * b).sum(1)
        out = a @ b.T
        for at in range(0, len(a), STRIP):  # in the cache, and without temporary tables of the whole size
            s, sums, own = out[at : at + STRIP], na[at : at + STRIP, None] + nb, a[at : at + STRIP]
            s *= 2
            np.subtract(sums, s, out=s)
            sums *= 1e-6
            close = np.nonzero(s < sums)  # cancellation: taken exactly; what is left isn't negative
            if len(close[0]):
                s[close] = ((own[close[0]] - b[close[1]]) ** 2).sum(1)
            np.sqrt(s, out=s)
        return out

    def wrapped(self, a: np.ndarray, b: np.ndarray, height: int = 32) -> np.ndarray:
        """Distances on a torus, a strip of rows at a time, so that a coordinate's differences stay in the cache. Halves are as far either way."""
        a, b = a / self.period, np.ascontiguousarray((b / self.period).T)
        out = np.zeros((len(a), b.shape[1]))
        u, whole = np.empty((2, height, b.shape[1]))
        for at in range(0, len(a), height):
            strip, p = out[at : at + height], a[at : at + height]
            d, r = u[: len(p)], whole[: len(p)]
            for k in range(len(b)):
                np.subtract(b[k], p[:, k, None], out=d)
                np.rint(d, out=r)
                np.subtract(d, r, out=d)
                np.multiply(d, d, out=d)
                np.add(strip, d, out=strip)
        np.sqrt(out, out=out)
        out *= self.period
        return out

    def rows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of rows of a to the same rows of b."""
        if self.kind == "null":
            return np.zeros(len(a))
        if self.kind == "dot":
            s = (a * b).sum(1)
            return np.where(s > 0, -np.log(np.where(s > 0, s, 1.0)), np.nan)
        if self.kind == "sphere":
            return np.arccos(np.clip((self.embedded(a) * self.embedded(b)).sum(1), -1, 1))
        d = b - a
        if self.kind == "torus":
            d = (d / self.period - half_away(d / self.period)) * self.period
        return np.sqrt((d * d).sum(1))
