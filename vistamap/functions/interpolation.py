"""Tables of values as smooth functions: natural cubic splines and bicubic patches."""

from __future__ import annotations

import numpy as np


def locate(knots: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Interval of each value, the end intervals for values outside."""
    return np.clip(np.searchsorted(knots, x, "right") - 1, 0, len(knots) - 2)


class Spline:
    """Natural cubic spline through (x, y)."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.x, self.y = np.asarray(x, float), np.asarray(y, float)
        n, h = len(self.x), np.diff(self.x)
        self.second = np.zeros(n)
        if n > 2:
            m = np.diag((h[:-1] + h[1:]) / 3) + np.diag(h[1:-1] / 6, 1) + np.diag(h[1:-1] / 6, -1)
            self.second[1:-1] = np.linalg.solve(m, np.diff(np.diff(self.y) / h))

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        k = locate(self.x, x)
        h = self.x[k + 1] - self.x[k]
        return k, h, (self.x[k + 1] - x) / h, (x - self.x[k]) / h

    def __call__(self, x: np.ndarray) -> np.ndarray:
        k, h, a, b = self.parts(np.asarray(x, float))
        return a * self.y[k] + b * self.y[k + 1] + ((a**3 - a) * self.second[k] + (b**3 - b) * self.second[k + 1]) * h * h / 6

    def slope(self, x: np.ndarray) -> np.ndarray:
        k, h, a, b = self.parts(np.asarray(x, float))
        return (self.y[k + 1] - self.y[k]) / h + ((3 * b * b - 1) * self.second[k + 1] - (3 * a * a - 1) * self.second[k]) * h / 6


class Bicubic:
    """Cubic Hermite patches over a regular grid of values and gradients (differences where none are given). The mixed
    derivative is a central difference of the gradients inside and 0 on the boundary."""

    def __init__(self, x: np.ndarray, y: np.ndarray, value: np.ndarray, dx: np.ndarray | None = None, dy: np.ndarray | None = None):
        self.x, self.y, self.f = np.asarray(x, float), np.asarray(y, float), np.asarray(value, float)
        self.fx = np.gradient(self.f, self.x, axis=0) if dx is None else np.asarray(dx, float)
        self.fy = np.gradient(self.f, self.y, axis=1) if dy is None else np.asarray(dy, float)
        self.fxy = np.zeros_like(self.f)
        if min(self.f.shape) > 2:
            self.fxy[1:-1, 1:-1] = (self.fx[1:-1, 2:] - self.fx[1:-1, :-2]) / (self.y[2:] - self.y[:-2])

    def __call__(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Values at all pairs of x and y: a matrix."""
        bx, i, hx = _hermite(self.x, np.asarray(x, float))
        by, j, hy = _hermite(self.y, np.asarray(y, float))
        out = np.zeros((len(i), len(j)))
        for p in (0, 1):
            for q in (0, 1):
                at = np.ix_(i + p, j + q)
                for k, (table, sx, sy) in enumerate(((self.f, 0, 0), (self.fx, 1, 0), (self.fy, 0, 1), (self.fxy, 1, 1))):
                    u = bx[2 * sx + p] * (hx if sx else 1)
                    v = by[2 * sy + q] * (hy if sy else 1)
                    out += u[:, None] * table[at] * v[None]
        return out


def _hermite(knots: np.ndarray, x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    k = locate(knots, x)
    h = knots[k + 1] - knots[k]
    t = (x - knots[k]) / h
    return [(1 + 2 * t) * (1 - t) ** 2, t * t * (3 - 2 * t), t * (1 - t) ** 2, t * t * (t - 1)], k, h
