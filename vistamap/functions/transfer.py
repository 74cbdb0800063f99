"""Transfer functions of distances, with derivatives: Spark expressions and NumPy twins of the same closed forms."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .interpolation import Spline


@dataclass(frozen=True)
class Transfer:
    """identity; sigmoid(s) 1-1/(1+(x/s)^2); compress(s) 1-1/(1+x/s); xsigmoid(s, a, b) 1-(1+(2^(a/b)-1)(x/s)^a)^(-b/a);
    gamma(s, n), the regularised upper incomplete Q(n/2, x^2/2s^2); warp(s, a, b, c, d): the inverse of xsigmoid(s, c, d) of xsigmoid(s, a, b)."""

    kind: str = "identity"
    pars: tuple[float, ...] = ()

    @classmethod
    def of(cls, pars: tuple[float, ...]) -> Transfer:
        """By the number of parameters: 0 identity, 2 gamma, 3 xsigmoid."""
        kinds = {0: "identity", 2: "gamma", 3: "xsigmoid"}
        if len(pars) not in kinds:
            raise ValueError("a transfer function takes 0, 2 or 3 parameters")
        return cls(kinds[len(pars)], tuple(pars))

    def value(self, x: Column) -> Column:
        p = self.pars
        if self.kind == "identity":
            return x
        if self.kind == "sigmoid":
            return 1 - 1 / (1 + (x / p[0]) * (x / p[0]))
        if self.kind == "compress":
            return 1 - 1 / (1 + x / p[0])
        if self.kind == "xsigmoid":
            return 1 - F.pow(1 + F.pow(x / p[0], F.lit(p[1])) * (2 ** (p[1] / p[2]) - 1), F.lit(-p[2] / p[1]))
        if self.kind == "warp":
            s, a, b, c, d = p
            y = Transfer("xsigmoid", (s, a, b)).value(x)
            return F.pow((F.pow(1 - y, F.lit(-c / d)) - 1) / (2 ** (c / d) - 1), F.lit(1 / c)) * s
        if p[1] > 0 and p[1] % 2 == 0 and p[1] <= 40:  # a finite sum
            y = x * x / (2 * p[0] * p[0])
            term, whole = F.lit(1.0), F.lit(1.0)
            for k in range(1, int(p[1]) // 2):
                term = term * y / k
                whole = whole + term
            return F.exp(-y) * whole
        # no closed form in Spark: an Arrow-batched function
        numpy_value = self.f
        return F.pandas_udf(lambda v: pd.Series(numpy_value(v.to_numpy())), DoubleType())(x)

    def slope(self, x: Column) -> Column:
        p = self.pars
        if self.kind == "identity":
            return F.lit(1.0)
        if self.kind == "sigmoid":
            u = 1 + (x / p[0]) * (x / p[0])
            return 2 * x / (p[0] * p[0]) / (u * u)
        if self.kind == "compress":
            return 1 / p[0] / ((1 + x / p[0]) * (1 + x / p[0]))
        if self.kind == "xsigmoid":
            s = F.pow(x / p[0], F.lit(p[1])) * (2 ** (p[1] / p[2]) - 1)
            return F.when(x == 0, F.lit(_start(p))).otherwise(p[2] * s / F.when(x == 0, F.lit(1.0)).otherwise(x) * F.pow(1 + s, F.lit(-p[2] / p[1] - 1)))
        if self.kind == "gamma":
            k, y = p[1] / 2, x * x / (2 * p[0] * p[0])
            return -F.pow(y, F.lit(k - 1)) * F.exp(-y) / math.gamma(k) * x / (p[0] * p[0])
        numpy_slope = self.df
        return F.pandas_udf(lambda v: pd.Series(numpy_slope(v.to_numpy())), DoubleType())(x)

    def f(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        p = self.pars
        if self.kind == "identity":
            return x
        if self.kind == "sigmoid":
            return 1 - 1 / (1 + (x / p[0]) ** 2)
        if self.kind == "compress":
            return 1 - 1 / (1 + x / p[0])
        if self.kind == "xsigmoid":
            return 1 - (1 + (2 ** (p[1] / p[2]) - 1) * (x / p[0]) ** p[1]) ** (-p[2] / p[1])
        if self.kind == "gamma":
            return upper_gamma(p[1] / 2, x * x / (2 * p[0] ** 2))
        s, a, b, c, d = p
        y = Transfer("xsigmoid", (s, a, b)).f(x)
        return s * (((1 - y) ** (-c / d) - 1) / (2 ** (c / d) - 1)) ** (1 / c)

    def df(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        p = self.pars
        if self.kind == "identity":
            return np.ones_like(x)
        if self.kind == "sigmoid":
            return 2 * x / p[0] ** 2 / (1 + (x / p[0]) ** 2) ** 2
        if self.kind == "compress":
            return 1 / p[0] / (1 + x / p[0]) ** 2
        if self.kind == "xsigmoid":
            s = (2 ** (p[1] / p[2]) - 1) * (x / p[0]) ** p[1]
            safe = np.where(x == 0, 1.0, x)
            return np.where(x == 0, _start(p), p[2] * s / safe * (1 + s) ** (-p[2] / p[1] - 1))
        if self.kind == "gamma":
            k, y = p[1] / 2, x * x / (2 * p[0] ** 2)
            return -(y ** (k - 1)) * np.exp(-y) / math.gamma(k) * x / p[0] ** 2
        s, a, b, c, d = p
        return Transfer("xsigmoid", (s, a, b)).df(x) / np.maximum(Transfer("xsigmoid", (s, c, d)).df(self.f(x)), 1e-300)


class Tabulated:
    """A transfer function and its slope from a table: a cubic spline through `count` values on [0, high], for functions that
    cost more than a look-up."""

    def __init__(self, function: Transfer, high: float, count: int = 4096):
        self.function, knots = function, np.linspace(0.0, high, count)
        self.table, self.high = Spline(knots, function.f(knots)), high

    def f(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.asarray(x) <= self.high, self.table(x), self.function.f(x))

    def df(self, x: np.ndarray) -> np.ndarray:
        return np.where(np.asarray(x) <= self.high, self.table.slope(x), self.function.df(x))


def _start(p: tuple[float, ...]) -> float:
    """Slope of xsigmoid at 0."""
    return 0.0 if p[1] > 1 else p[2] * (2 ** (p[1] / p[2]) - 1) / p[0] if p[1] == 1 else math.inf


def upper_gamma(k: float, y: np.ndarray) -> np.ndarray:
    """Q(k, y): a power series below y = k + 1, a continued fraction (modified Lentz) above."""
    y = np.asarray(y, float)
    out = np.ones_like(y)
    low = (y > 0) & (y < k + 1)
    if low.any():
        v, term = y[low], np.full(int(low.sum()), 1 / k)
        total = term.copy()
        for n in range(1, 500):
            term = term * v / (k + n)
            total += term
            if (term < total * 1e-17).all():
                break
        out[low] = 1 - total * np.exp(-v + k * np.log(v) - math.lgamma(k))
    high = y >= k + 1
    if high.any():
        v = y[high]
        b = v + 1 - k
        c, d = np.full_like(v, 1e300), 1 / b
        h = d.copy()
        for n in range(1, 500):
            a = -n * (n - k)
            b = b + 2
            d = 1 / np.where(np.abs(a * d + b) < 1e-300, 1e-300, a * d + b)
            c = np.where(np.abs(b + a / c) < 1e-300, 1e-300, b + a / c)
            h = h * d * c
            if (np.abs(d * c - 1) < 1e-16).all():
                break
        out[high] = h * np.exp(-v + k * np.log(v) - math.lgamma(k))
    return out
