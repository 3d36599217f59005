"""Progress of a long action, and a watchdog that stops it when nothing moves."""

from __future__ import annotations

import threading
import time
import uuid

from pyspark.sql import SparkSession

from quern.errors import Stalled
from quern.protocols import Cancellation, Observer


class Watchdog:
    """``with Watchdog(spark, 600): df.write…`` fails if no task ends for so many seconds.

    Jobs of the block run under a tag of their own, which is cancelled on a stall or when
    ``cancellation`` is wanted; ``observer`` is told of every look.
    """

    def __init__(self, spark: SparkSession, stall_seconds: float, observer: Observer | None = None, cancellation: Cancellation | None = None, every: float = 1.0) -> None:
        self.spark, self.limit, self.every = spark, stall_seconds, every
        self.observer, self.cancellation = observer, cancellation
        self.tag = f"quern-{uuid.uuid4().hex}"
        self.why: str | None = None
        self._over = threading.Event()

    def _look(self) -> tuple[int, int, list[str]]:
        tracker = self.spark.sparkContext.statusTracker()
        infos = [i for s in tracker.getActiveStageIds() if (i := tracker.getStageInfo(s))]
        return sum(i.numCompletedTasks for i in infos), sum(i.numTasks for i in infos), [i.name for i in infos]

    def _watch(self) -> None:
        last, since = None, time.monotonic()
        while not self._over.wait(self.every):
            seen = self._look()
            if self.observer:
                self.observer(*seen)
            if seen != last:
                last, since = seen, time.monotonic()
            if self.cancellation and self.cancellation.wanted:
                self.why = "cancelled"
            elif time.monotonic() - since > self.limit:
                self.why = f"no task ended in {self.limit:g} seconds"
            if self.why:
                self.spark.sparkContext.cancelJobsWithTag(self.tag)
                return

    def __enter__(self) -> Watchdog:
        self.spark.addTag(self.tag)
        self.spark.sparkContext.addJobTag(self.tag)
        self._thread = threading.Thread(target=self._watch, daemon=True)
        self._thread.start()
        return self

    def __exit__(self, kind, value, trace) -> None:
        self._over.set()
        self._thread.join()
        self.spark.sparkContext.removeJobTag(self.tag)
        self.spark.removeTag(self.tag)
        if self.why:
            raise Stalled(self.why) from value
