"""Metrics of streams, standing queries, and cancellation."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class StreamMetrics(StreamingQueryListener):
    """Totals over all batches of the streams that run in a session."""

    def __init__(self):
        self.batches = self.rows = self.errors = 0
        self.longest_ms = 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        self.batches += 1
        self.rows += p.numInputRows
        self.longest_ms = max(self.longest_ms, p.batchDuration)

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.errors += event.exception is not None


def observed(changes: DataFrame, name: str = "changes") -> DataFrame:
    """``changes`` with counters of kinds of records, computed while they pass by."""
    has = lambda r: F.count_if(F.array_contains("reasons", r))
    return changes.observe(name, F.count("*").alias("records"), has("FILE_CREATE").alias("created"), has("FILE_DELETE").alias("deleted"), has("RENAME_NEW_NAME").alias("renamed"))


def standing(query: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A query to run on every new version of a catalog; for ``stream_into(then=...)``."""
    return lambda catalog, batch: sink(query(catalog), batch)


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Work inside carries a tag; ``spark.interruptTag(tag)`` from elsewhere stops it."""
    spark.addTag(tag)
    try:
        yield
    finally:
        spark.removeTag(tag)


class Debounce:
    """Whether a search is due: the input has changed since the last one, and then stood still for ``wait`` seconds."""

    def __init__(self, wait: float = 0.2):
        self.wait, self.changed, self.shown = wait, None, None

    def due(self, text: str, now: float) -> bool:
        if self.changed is None or self.changed[0] != text:
            self.changed = text, now
        if self.shown == text or now - self.changed[1] < self.wait:
            return False
        self.shown = text
        return True
