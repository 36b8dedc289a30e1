"""What a long run needs around its queries: a time budget, a trial log, the latest run, latency samples, stage costs."""

from __future__ import annotations

import json
import resource
import sqlite3
import time
from collections.abc import Callable, Iterable
from contextlib import closing
from dataclasses import dataclass, field
from typing import Any

import numpy as np


@dataclass
class Budget:
    """Seconds that a session may take, less a margin; a step is only begun if it fits."""

    seconds: float
    margin: float = 0.0
    clock: Callable[[], float] = time.monotonic
    began: float = field(init=False)

    def __post_init__(self) -> None:
        self.began = self.clock()

    def left(self) -> float:
        return self.seconds - self.margin - (self.clock() - self.began)

    def fits(self, step: float) -> bool:
        return self.left() >= step


class TrialLog:
    """Trials in a SQLite file: appended as they end, read back to resume a search."""

    def __init__(self, path: str):
        self.path = path
        with closing(sqlite3.connect(path)) as db, db:
            db.execute("CREATE TABLE IF NOT EXISTS trials (number INTEGER PRIMARY KEY, record TEXT NOT NULL)")

    def add(self, trial: dict[str, Any]) -> None:
        with closing(sqlite3.connect(self.path)) as db, db:
            db.execute("INSERT OR REPLACE INTO trials VALUES (?, ?)", (trial["number"], json.dumps(trial, sort_keys=True)))

    def read(self) -> list[dict[str, Any]]:
        with closing(sqlite3.connect(self.path)) as db:
            return [json.loads(r) for (r,) in db.execute("SELECT record FROM trials ORDER BY number")]

    def snapshot(self, path: str) -> None:
        """A consistent copy, even while trials are added."""
        with closing(sqlite3.connect(self.path)) as source, closing(sqlite3.connect(path)) as target:
            source.backup(target)


def latest_run(names: Iterable[str], prefix: str = "") -> str | None:
    """The last run by name among those with a prefix: names begin with their date."""
    return max((n for n in names if n.startswith(prefix)), default=None)


def batch_times(score: Callable[[np.ndarray], Any], rows: np.ndarray, warm: int = 50, runs: int = 500) -> list[float]:
    """Milliseconds of each scoring of a batch, after a warm-up; metrics.latency() makes percentiles of them."""
    for _ in range(warm):
        score(rows)
    out = []
    for _ in range(runs):
        began = time.perf_counter()
        score(rows)
        out.append((time.perf_counter() - began) * 1000)
    return out


def peak_memory_mb() -> float:
    """The largest memory that this process has held."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


def measured(name: str, step: Callable[[], Any], costs: list[dict[str, Any]]) -> Any:
    """Runs a step and appends its seconds, the peak so far and the rise of it."""
    before, began = peak_memory_mb(), time.perf_counter()
    try:
        return step()
    finally:
        costs.append({"stage": name, "seconds": time.perf_counter() - began, "peak_mb": peak_memory_mb(), "rise_mb": peak_memory_mb() - before})
