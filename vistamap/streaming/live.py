"""Structured Streaming forms: projection of arriving points, and online autocorrelation of keyed series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from vistamap.functions.metrics import Metric
from vistamap.operators.projection import path_project, project
from vistamap.operators.stress import Terms

STATE = "n long, total double, squares double, head array<double>, ring array<double>, sums array<double>"


def project_stream(points: DataFrame, landmarks: DataFrame, terms: Terms = Terms(), **options) -> DataFrame:
    """Stateless: the batch operator on a stream of (id, x); landmarks are a static table."""
    return project(points, landmarks, terms, **options)


def path_stream(points: DataFrame, landmarks: DataFrame, scale: float, metric: Metric = Metric()) -> DataFrame:
    return path_project(points, landmarks, scale, metric)


class Online:
    """Sums for one series in order of arrival: constant memory, whatever its length."""

    def __init__(self, lags: int, state: tuple | None = None):
        self.lags = lags
        self.n, self.total, self.squares, self.head, self.ring, self.sums = state or (0, 0.0, 0.0, [], [], [0.0] * lags)
        self.head, self.ring, self.sums = list(self.head), list(self.ring), list(self.sums)

    def add(self, values: np.ndarray) -> None:
        """Appends values: each lag is one product of arrays."""
        known = np.concatenate([self.ring, values])
        back = len(self.ring)
        for h in range(self.lags):
            start = max(back, h)
            if start < len(known):
                self.sums[h] += float(known[start:] @ known[start - h : len(known) - h])
        self.head += values[: max(0, self.lags - len(self.head))].tolist()
        self.n, self.total, self.squares = self.n + len(values), self.total + float(values.sum()), self.squares + float(values @ values)
        self.ring = known[-self.lags :].tolist()

    def state(self) -> tuple:
        return self.n, self.total, self.squares, self.head, self.ring, self.sums

    def acf(self) -> list[float | None]:
        """Normalised function at lags 0 .. lags - 1; none before the series is longer than that."""
        if self.n <= self.lags:
            return [None] * self.lags
        mu = self.total / self.n
        variance = self.squares / self.n - mu * mu
        ends = np.concatenate([[0], np.cumsum(np.array(self.head) + np.array(self.ring[::-1]))])
        return [float(((self.sums[h] + mu * (ends[h] - 2 * self.total)) / (self.n - h) + mu * mu) / variance) if variance else None for h in range(self.lags)]


def autocorrelation_stream(events: DataFrame, lags: int, key: str = "series", order: str = "t", value: str = "v") -> DataFrame:
    """series, n, acf after each micro-batch in which a series has new values. Within a micro-batch values are ordered by `order`;
    later batches follow earlier ones, and no watermark drops late values."""
    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        online = Online(lags, state.get if state.exists else None)
        rows = pd.concat(list(frames)).sort_values([order])
        online.add(rows[value].dropna().to_numpy(float))
        state.update(online.state())
        yield pd.DataFrame({"series": [name[0]], "n": [online.n], "acf": [online.acf()]})

    rows = events.selectExpr(f"cast({key} as string) as series", f"{order}", f"cast({value} as double) as {value}")
    return rows.groupBy("series").applyInPandasWithState(update, "series string, n long, acf array<double>", STATE, "update", GroupStateTimeout.NoTimeout)
