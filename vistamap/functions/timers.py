"""Counts and mean times of named parts of a run on the driver; tasks are timed by Spark itself."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass


@dataclass
class Timer:
    calls: int = 0
    seconds: float = 0.0

    @property
    def mean(self) -> float:
        return self.seconds / self.calls if self.calls else 0.0


class Timers:
    """`with timers("part"):` adds a call; `report` has name, calls, seconds and mean of each, the slowest first."""

    def __init__(self, clock=time.perf_counter):
        self.clock, self.known = clock, {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[Timer]:
        timer, began = self.known.setdefault(name, Timer()), self.clock()
        try:
            yield timer
        finally:
            timer.calls += 1
            timer.seconds += self.clock() - began

    def report(self) -> list[tuple[str, int, float, float]]:
        return sorted(((k, t.calls, t.seconds, t.mean) for k, t in self.known.items()), key=lambda r: (-r[2], r[0]))
