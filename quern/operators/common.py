"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Rows up to which a side of a join may be broadcast.
BROADCAST_ROWS = 100_000


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, which one bounded job checks."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def nonblank(column: Column | str) -> Column:
    """Whether a text holds anything but white space of any script; false for null."""
    c = F.col(column) if isinstance(column, str) else column
    return F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def require(df: DataFrame, condition: Column, message: Column | str) -> DataFrame:
    """``df``, failing as soon as a row is read for which ``condition`` isn't true."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(text).cast("boolean")))


def top_k(df: DataFrame, partition: list[str], score: str, tie: str, limit: int, rank: str = "rank") -> DataFrame:
    """The best ``limit`` rows of each partition, ranked from 1 by score and, for ties, the least ``tie``."""
    w = Window.partitionBy(*partition).orderBy(F.col(score).desc(), F.col(tie).asc())
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= limit)
