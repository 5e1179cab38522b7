"""Figures of running work (W4, C8): what a job or a stream counts as it goes, kept as a table.

Counts are observed where rows pass (``DataFrame.observe``), so nothing is read a second time.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

SCHEMA = "run string, step long, rows long, errors long, done long, total long, percent double, seconds double, rate double, eta double"


def counted(df: DataFrame) -> list[Column]:
    """What is observed: rows, and those with an ``error``."""
    failed = F.count_if(F.col("error").isNotNull()) if "error" in df.columns else F.lit(0).cast("long")
    return [F.count(F.lit(1)).alias("rows"), failed.alias("errors")]


def figures(rows: int, errors: int, done: int, total: int | None, seconds: float) -> dict:
    """rate: rows a second of the whole run; eta: seconds to its end, -1 where the rate or the total isn't known."""
    rate = done / seconds if seconds > 0 else 0.0
    eta = (total - done) / rate if total is not None and rate > 0 else -1.0
    return {"rows": rows, "errors": errors, "done": done, "total": total, "percent": None if total is None else 100.0 * done / total if total else 100.0, "seconds": seconds, "rate": rate, "eta": float(eta)}


class RunTable:
    """One appended row for each step of a run."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, lines: list[dict]) -> None:
        if lines:
            self.spark.createDataFrame([tuple(x[c.split(" ")[0]] for c in SCHEMA.split(", ")) for x in lines], SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(self.path)


class Run:
    """Steps of one run: ``step`` runs an action over a part of the work and records what passed."""

    def __init__(self, table: RunTable, name: str, total: int | None = None, clock: Callable[[], float] = time.monotonic):
        self.table, self.name, self.total, self.clock = table, name, total, clock
        self.began, self.done, self.steps = clock(), 0, 0

    def step(self, df: DataFrame, action: Callable[[DataFrame], object]) -> dict:
        seen = Observation()
        action(df.observe(seen, *counted(df)))
        got = seen.get
        self.done += got["rows"]
        line = {"run": self.name, "step": self.steps, **figures(got["rows"], got["errors"], self.done, self.total, self.clock() - self.began)}
        self.steps += 1
        self.table.append([line])
        return line


class StreamFigures(StreamingQueryListener):
    """Collects the observed counts of a named observation, a line for each batch of one stream."""

    def __init__(self, observation: str, run: str, total: int | None = None):
        self.observation, self.run, self.total = observation, run, total
        self.lines: list[dict] = []
        self.done, self.seconds = 0, 0.0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        got = event.progress.observedMetrics.get(self.observation)
        if got is None:
            return
        self.done += got.rows
        self.seconds += event.progress.batchDuration / 1000
        self.lines.append({"run": self.run, "step": event.progress.batchId, **figures(got.rows, got.errors, self.done, self.total, self.seconds)})
