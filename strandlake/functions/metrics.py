"""Rates, sizes and their reports, in the units of 10^6, as rows of a DataFrame."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REPORT = "step int, mb double, seconds double, mb_s double, interval_mb_s double, done_pct double"


class Stopwatch:
    """Seconds since the start and since the last look, of a monotonic clock."""

    def __init__(self, clock: Callable[[], float] = time.monotonic):
        self.clock = clock
        self.began = self.last = clock()

    def lap(self) -> float:
        now = self.clock()
        out, self.last = now - self.last, now
        return out

    def total(self) -> float:
        return self.clock() - self.began


def million_items_per_second(n: int, seconds: float) -> float:
    return n / max(seconds, 1e-9) / 1e6


def megabytes_per_second(n_bytes: int, seconds: float) -> float:
    return n_bytes / max(seconds, 1e-9) / 1e6


def overhead_pct(held_bytes: float, items: int, width: int) -> float:
    """What is held beyond the items themselves (width bytes each), in percent of them."""
    return 100.0 * (held_bytes / (items * width) - 1) if items else 0.0


def peak_memory(spark: SparkSession) -> int:
    """The largest peak of execution memory of any stage so far, in bytes, summed over its tasks."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return max((int(stages.apply(k).peakExecutionMemory()) for k in range(stages.size())), default=0)


class SpeedReport:
    """Reports of a run: MB and seconds so far, running and interval rates, percent done; the last row is the final one."""

    def __init__(self, total_bytes: int | None = None, clock: Callable[[], float] = time.monotonic):
        self.watch, self.total, self.done, self.rows = Stopwatch(clock), total_bytes, 0, []

    def add(self, n_bytes: int) -> dict:
        lap, so_far = self.watch.lap(), self.watch.total()
        self.done += n_bytes
        row = {"step": len(self.rows), "mb": self.done / 1e6, "seconds": so_far, "mb_s": megabytes_per_second(self.done, so_far), "interval_mb_s": megabytes_per_second(n_bytes, lap), "done_pct": 100.0 * self.done / self.total if self.total else None}
        self.rows.append(row)
        return row

    def final(self) -> float:
        """MB a second over the whole run."""
        return self.rows[-1]["mb_s"] if self.rows else 0.0

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(r.values()) for r in self.rows], REPORT)

