"""Tensors as tables (place, v): row-major places of indices, and back."""

from __future__ import annotations

from collections.abc import Sequence
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def place(indices: Sequence[Column], sizes: Sequence[int]) -> Column:
    """The row-major place of an element; null where an index lies outside."""
    out, inside = F.lit(0).cast("long"), F.lit(True)
    for i, n in zip(indices, sizes, strict=True):
        out, inside = out * n + i, inside & i.between(0, n - 1)
    return F.when(inside, out)


def indices(at: Column, sizes: Sequence[int]) -> Column:
    """An array of the indices of a place."""
    steps = [prod(sizes[k + 1 :]) for k in range(len(sizes))]
    return F.array(*(F.floor(at / step) % n for n, step in zip(sizes, steps)))


def resized(tensor: DataFrame, sizes: Sequence[int], new: Sequence[int]) -> DataFrame:
    """The elements that a tensor of other sizes has too, at their places in it; others are 0 and not stored."""
    i = indices(F.col("place"), sizes)
    return tensor.select(place([i[k] for k in range(len(sizes))], new).alias("place"), "v").where(F.col("place").isNotNull())
