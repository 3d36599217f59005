"""Document fingerprints by Order MinHash.

A text is the sequence of its k-mers of ``K`` code points (a shorter text is one
k-mer), each numbered from 0 by how often it occurred before, so that a k-mer's first
occurrence is the same element however often it recurs.  For each of ``SKETCHES``
hash functions the ``L`` numbered k-mers of least hash are selected and put back in
text order; the tuple of their k-mers is hashed to 16 bits.  The share of equal
entries estimates the weighted order-sensitive likeness of two texts, which falls
with their edit distance also where k-mers are merely moved.

Scale: a fingerprint needs one text.  To compare a document with its neighbour in
descending doc_id, rows are split into ranges of doc_id at quantiles of that column
alone, one shuffle of the rows; a range also gets a copy of the first row of the
range that follows, so tasks need nothing of one another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import documents, field, partitions

K, L, SKETCHES = 16, 2, 64
#: 32-bit words of hash values that one NumPy step makes.
STEP = 1 << 17

_ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def _multipliers(sketches: int) -> np.ndarray:
    """Odd multipliers: each orders mixed 32-bit values in its own way."""
    rng = np.random.Generator(np.random.PCG64(20_190_101))
    return rng.integers(0, 1 << 31, sketches, np.uint32) * np.uint32(2) + np.uint32(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def kmers(text: str, k: int = K) -> np.ndarray:
    """Hashes of the text's k-mers in order; k is a power of two."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    if len(codes) < k:
        return _mix(np.array([hash_of_short(text)], np.uint64)) if len(codes) else codes
    h, width = _mix(codes + np.uint64(1)) if len(codes) < 64 else _symbol_hashes(codes), 1
    while width < k:
        # a k-mer's hash is made from those of its halves
        left = h[:-width] * _ODD
        left += h[width:]
        left ^= left >> np.uint64(31)
        h, width = left, width * 2
    return _mix(h)


def hash_of_short(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def _symbol_hashes(codes: np.ndarray) -> np.ndarray:
    small = _mix(np.arange(1, 1 << 12, dtype=np.uint64))
    return small[codes.astype(np.int64)] if codes.max() < (1 << 12) - 1 else _mix(codes + np.uint64(1))


def numbered(h: np.ndarray) -> np.ndarray:
    """32-bit hashes of (k-mer, how often it occurred before); those of first occurrences are the k-mers' own."""
    out = h
    ordered = np.sort(h)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again):
        where = np.flatnonzero(np.isin(h, np.unique(again)))
        order = where[np.argsort(h[where], kind="stable")]
        values = h[order]
        first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        out = h.copy()
        later = nth > 0
        out[order[later]] = _mix(values[later] + nth[later].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return (out >> np.uint64(32)).astype(np.uint32)


def sketch(text: str | None, k: int = K, l: int = L, sketches: int = SKETCHES) -> np.ndarray:
    """The fingerprint as 16-bit entries; all zero for a null or empty text."""
    h = kmers(text or "", k)
    if not len(h):
        return np.zeros(sketches, np.uint16)
    base = numbered(h)
    mul = _multipliers(sketches)
    n = len(base)
    take = min(l, n)
    out = np.empty(sketches, np.uint16)
    rows = max(1, STEP // n)
    for i in range(0, sketches, rows):
        values = base[None, :] * mul[i : i + rows, None]
        each = np.arange(len(values))
        chosen = np.empty((len(values), take), np.int64)
        for j in range(take):
            chosen[:, j] = values.argmin(axis=1)
            values[each, chosen[:, j]] = 0xFFFFFFFF
        chosen.sort(axis=1)
        entry = np.zeros(len(values), np.uint64)
        for j in range(take):
            entry = _mix(entry * _ODD + h[chosen[:, j]])
        out[i : i + rows] = (entry >> np.uint64(48)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, nxt: str) -> str:
    """The last third's code points replaced by the first as many, or all, of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + nxt[:n]


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) for each row: entries of 4 hexadecimal digits; null and empty texts: zeros."""
    src = documents(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [as_hex(sketch(t)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.string())], ["doc_id", "fingerprint"])

    return src.mapInArrow(run, T.StructType([field(src, "doc_id"), T.StructField("fingerprint", T.StringType())]))


def as_hex(entries: np.ndarray) -> str:
    return entries.astype(">u2").tobytes().hex()


def _ranges(src: DataFrame, n: int) -> list[int]:
    """Ids that occur and start a range when ids descend: the greatest first."""
    shares = [i / n for i in range(1, n)]
    row = src.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", shares, 10_000).alias("q"), F.max("doc_id").alias("top")).head()
    if row.top is None:
        return []
    return sorted({row.top, *(row.q or [])}, reverse=True)


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_ranges: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    Documents follow each other by descending doc_id, those without one last, and
    the first follows the last; rows with equal ids in order of their text's
    hash, equal rows in any.  The edited text has its last floor(n_chars / 3) code
    points replaced by the first as many, or all, of the next document.  A null
    text counts as empty; the only document follows itself.  Ids are integers.
    """
    src = documents(docs, id_col, text_col)
    spark = docs.sparkSession
    starts = _ranges(src, max(1, n_ranges or partitions(spark)))
    nulls = not src.where("doc_id IS NULL").limit(1).isEmpty()
    # range i holds the ids from starts[i] down to above starts[i + 1]; ids that are null have the last
    total = len(starts) + nulls
    if not total:
        return spark.createDataFrame([], _schema(src))
    ends = np.array(starts[::-1], np.int64)
    last = len(starts)

    @F.pandas_udf("int")
    def range_of(ids):
        return pd.Series((len(ends) - 1 - np.searchsorted(ends, ids.to_numpy(np.int64), "left")).astype("int32"))

    src = src.withColumn("__h", F.xxhash64("text"))
    placed = src.withColumn("__range", F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(range_of(F.coalesce(F.col("doc_id").cast("long"), F.lit(starts[-1] if starts else 0)))))
    # the first row of each range is needed by the range before as well
    heads = placed.where(F.col("doc_id").isin(*starts) | F.col("doc_id").isNull()) if nulls else placed.where(F.col("doc_id").isin(*starts))
    first = heads.groupBy("__range").agg(F.max_by("text", F.struct("doc_id", "__h")).alias("text"), F.lit(True).alias("__peek"))
    first = first.withColumn("__range", F.pmod(F.col("__range") - 1, F.lit(total)).cast("int"))
    rows = placed.withColumn("__peek", F.lit(False)).unionByName(first, allowMissingColumns=True)
    rows = rows.repartitionById(total, "__range").sortWithinPartitions("__peek", F.desc_nulls_last("doc_id"), F.desc("__h"))
    schema = _schema(src)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        kind = None
        out: list[list] = [[] for _ in schema.names]

        def emit(doc_id, text, own, nxt, nxt_own) -> None:
            changed = edited(text, nxt)
            theirs = own if changed == text else sketch(changed)
            values = (doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), as_hex(own), as_hex(theirs), likeness(own, theirs), likeness(own, nxt_own))
            for column, value in zip(out, values):
                column.append(value)

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = text or ""
                own = held[2] if held and held[1] == text else sketch(text)
                if held:
                    emit(*held, text, own)
                held = (doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [kind, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])], schema.names)
            out = [[] for _ in schema.names]

    return rows.select("doc_id", "text").mapInArrow(run, schema)


def _schema(src: DataFrame) -> T.StructType:
    text, real = T.StringType(), T.DoubleType()
    return T.StructType([field(src, "doc_id"), T.StructField("n_chars", T.LongType()), T.StructField("edited_sha256", text), T.StructField("fingerprint", text), T.StructField("edited_fingerprint", text), T.StructField("near_edited", real), T.StructField("near_next", real)])
