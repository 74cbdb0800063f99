"""Geometry of atoms: torsions, unit cells, bins of distribution functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def _cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def torsion(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Dihedral angle of four points, in (-pi, pi]."""
    u, v, w = _minus(b, a), _minus(c, b), _minus(d, c)
    n, m = _cross(u, v), _cross(v, w)
    return F.atan2(_dot(_cross(n, m), v) / F.sqrt(_dot(v, v)), _dot(n, m))


def angle(a: Column, b: Column, c: Column) -> Column:
    """Angle at b, in [0, pi]."""
    u, v = _minus(a, b), _minus(c, b)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(u, v) / F.sqrt(_dot(u, u) * _dot(v, v)))))


def orthorhombic(cell: tuple[float, ...], tolerance: float = 1e-6) -> tuple[float, float, float]:
    """Edges of a cell a, b, c, alpha, beta, gamma (degrees); other than right angles are refused."""
    if any(abs(x - 90) > tolerance for x in cell[3:]):
        raise ValueError("only orthorhombic cells are supported")
    return cell[0], cell[1], cell[2]


def bins(low: float, high: float, count: int) -> list[tuple[float, float]]:
    """Edges of equal bins, of distances (radial) or angles (angular distribution functions)."""
    edges = np.linspace(low, high, count + 1).tolist()
    return list(zip(edges[:-1], edges[1:]))


def shell_volume(low: float, high: float) -> float:
    return 4 / 3 * math.pi * (high**3 - low**3)
