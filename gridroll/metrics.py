"""Counters, timers and gauges of a cube, and what a table of cells says about its rollups."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from threading import Lock
from typing import Any

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class Registry:
    """Named figures; their full names are ``group:type=scope,name=...``."""

    def __init__(self, scope: str, group: str = "gridroll"):
        self.scope, self.group, self.lock = scope, group, Lock()
        self.counts: dict[str, int] = {}
        self.samples: dict[str, list[float]] = {}
        self.gauges: dict[str, Callable[[], Any]] = {}

    def mark(self, name: str, n: int = 1) -> None:
        with self.lock:
            self.counts[name] = self.counts.get(name, 0) + n

    def sample(self, name: str, value: float, most: int = 1024) -> None:
        """A histogram's sample; the latest ``most`` are kept."""
        with self.lock:
            self.samples.setdefault(name, []).append(value)
            del self.samples[name][:-most]

    @contextmanager
    def timer(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.sample(name, time.perf_counter() - began)

    def gauge(self, name: str, read: Callable[[], Any]) -> None:
        self.gauges[name] = read

    def report(self) -> dict[str, Any]:
        name = lambda n: f"{self.group}:type={self.scope},name={n}"
        out: dict[str, Any] = {name(k): v for k, v in self.counts.items()}
        for k, v in self.samples.items():
            s = sorted(v)
            out[name(k)] = {"n": len(s), "median": s[len(s) // 2], "max": s[-1]}
        return out | {name(k): f() for k, f in self.gauges.items()}


class StreamMetrics(StreamingQueryListener):
    """Puts the progress of streaming queries into a registry."""

    def __init__(self, registry: Registry):
        self.registry = registry

    def onQueryStarted(self, event: Any) -> None:
        self.registry.mark("stream.started")

    def onQueryProgress(self, event: Any) -> None:
        self.registry.mark("stream.rows", int(event.progress.numInputRows))
        self.registry.sample("stream.batchMillis", float(event.progress.batchDuration))

    def onQueryIdle(self, event: Any) -> None: ...

    def onQueryTerminated(self, event: Any) -> None:
        self.registry.mark("stream.failed" if event.exception else "stream.ended")


def by_rollup(cells: DataFrame) -> DataFrame:
    """(rollup_id, cells): how many cells each rollup has."""
    return cells.groupBy("rollup_id").agg(F.count("*").alias("cells"))


def observed(cells: DataFrame, name: str = "cells") -> tuple[DataFrame, Observation]:
    """``cells`` and an observation that holds their number once they were computed, at no further pass."""
    o = Observation(name)
    return cells.observe(o, F.count(F.lit(1)).alias("cells")), o
