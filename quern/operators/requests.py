"""Request packing and retries for external providers."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import IndexFailure

R = TypeVar("R")


def pack_texts(lengths: list[int], max_texts: int, max_chars: int) -> list[int]:
    """The request of each text: requests fill up in order; a text that is too long goes alone."""
    out, request, count, chars = [], 0, 0, 0
    for n in lengths:
        if count and (count >= max_texts or chars + n > max_chars):
            request, count, chars = request + 1, 0, 0
        count, chars = count + 1, chars + n
        out.append(request)
    return out


def pack(df: DataFrame, group: str, order: str, length: str, max_texts: int, max_chars: int) -> DataFrame:
    """``df`` with ``request``, numbered within each group in order; a group is one worker's batch, bounded by the caller."""
    schema = T.StructType([*df.schema.fields, T.StructField("request", T.IntegerType())])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(order, "ascending")])
        return table.append_column("request", pa.array(pack_texts(table.column(length).to_pylist(), max_texts, max_chars), pa.int32()))

    return df.groupBy(group).applyInArrow(run, schema)


def batches(df: DataFrame, key: str, size: int, name: str = "batch") -> DataFrame:
    """``df`` with a batch number of ``size`` consecutive keys."""
    return df.withColumn(name, F.floor(F.col(key) / size).cast("long"))


class Retry:
    """Bounded attempts with growing, jittered delays, within a time budget."""

    def __init__(self, attempts: int = 4, first: float = 0.25, longest: float = 30.0, budget: float = 90.0, jitter: float = 0.2, seed: int | None = None, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic) -> None:
        if not 1 <= attempts <= 10:
            raise ValueError("attempts must lie between 1 and 10")
        self.attempts, self.first, self.longest, self.budget, self.jitter = attempts, first, longest, budget, jitter
        self.random, self.sleep, self.clock = random.Random(seed), sleep, clock

    def delay(self, attempt: int) -> float:
        return min(self.longest, self.first * 2**attempt) * (1 + self.jitter * (2 * self.random.random() - 1))

    def run(self, call: Callable[[], R]) -> R:
        """The call's result; failures are tried again as they advise (never, immediate, or a delay in seconds)."""
        end = self.clock() + self.budget
        for attempt in range(self.attempts):
            try:
                return call()
            except IndexFailure as failure:
                wait = 0.0 if failure.retry == "immediate" else min(self.longest, max(float(failure.retry), self.delay(attempt))) if failure.retry != "never" else None
                if wait is None or attempt + 1 == self.attempts or self.clock() + wait > end:
                    raise
                self.sleep(wait)
        raise AssertionError("unreachable")
