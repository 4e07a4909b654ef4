"""A document as a whole: quick statistics, a performance snapshot, and jobs that can be watched and stopped."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .profile import column_statistics


class Cancelled(RuntimeError):
    """A job that was stopped on request."""


def quick_stats(base: DataFrame, view: DataFrame, columns: list[str], order: str | None = None, sample: int | None = None) -> DataFrame:
    """One row per column, with the document's counts: rows_visible, rows_total, columns, column, type, non_null_count, unique_count."""
    counts = F.broadcast(base.agg(F.count(F.lit(1)).alias("rows_total")).join(view.agg(F.count(F.lit(1)).alias("rows_visible"))))  # one row
    stats = column_statistics(view, columns, order, sample).select("slot", "column", "type", "non_null_count", "unique_count")
    return counts.join(stats).select("slot", "rows_visible", "rows_total", F.lit(len(columns)).cast("long").alias("columns"), "column", "type", "non_null_count", "unique_count")


def shown_bytes(n: int) -> str:
    """Bytes with a decimal unit."""
    size, unit = float(n), "bytes"
    for unit in ("bytes", "KB", "MB", "GB", "TB"):
        if size < 1000 or unit == "TB":
            break
        size /= 1000
    return f"{int(size):,} {unit}" if unit == "bytes" else f"{size:,.1f} {unit}"


@dataclass(frozen=True)
class Snapshot:
    """What a document holds and how fast it was indexed."""

    file_bytes: int
    total_rows: int
    visible_rows: int
    columns: int
    storage: str = "Disk"
    seconds: float | None = None
    complete: bool = True
    memory_bytes: int | None = None

    def lines(self) -> list[str]:
        rows = f"{self.total_rows:,}" if self.visible_rows == self.total_rows else f"{self.visible_rows:,} / {self.total_rows:,}"
        out = [f"File: {shown_bytes(self.file_bytes)}", f"Rows: {rows}", f"Columns: {self.columns:,}", f"Storage: {self.storage}"]
        if self.memory_bytes is not None:
            out.append(f"Memory: {shown_bytes(self.memory_bytes)}")
        if not self.complete:
            return [*out, "Indexing: in progress"]
        if self.seconds is None:
            return [*out, "Indexing: complete"]
        out.append(f"Indexing: complete in {self.seconds:.3f} s")
        if self.seconds > 0 and self.total_rows > 0:
            out.append(f"Throughput: {round(self.total_rows / self.seconds):,} rows/s")
        return out


@dataclass
class Job:
    """Spark work under a tag of its own: ``run`` does it, ``cancel`` stops it, ``progress`` tells how far it is."""

    spark: SparkSession
    tag: str = field(default_factory=lambda: f"gridlore-{uuid.uuid4().hex}")
    stopped: threading.Event = field(default_factory=threading.Event)

    def check(self) -> None:
        if self.stopped.is_set():
            raise Cancelled(self.tag)

    def run(self, work: Callable[[], object]):
        """The work's result; ``Cancelled`` if it was stopped before or while it ran."""
        self.check()
        context = self.spark.sparkContext
        context.addJobTag(self.tag)
        try:
            return work()
        except Exception:
            self.check()
            raise
        finally:
            context.removeJobTag(self.tag)

    def cancel(self) -> None:
        self.stopped.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def progress(self) -> tuple[int, int]:
        """(tasks done, tasks known) of the stages that run now in the application."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [tracker.getStageInfo(s) for s in tracker.getActiveStageIds()]
        return sum(s.numCompletedTasks for s in stages if s), sum(s.numTasks for s in stages if s)


def indexed(open_table: Callable[[], object], file_bytes: int) -> tuple[object, Snapshot]:
    """(table, snapshot) of opening a document and counting its rows."""
    began = time.perf_counter()
    table = open_table()
    rows = table.df.count()
    return table, Snapshot(file_bytes, rows, rows, len(table.names), seconds=time.perf_counter() - began)
