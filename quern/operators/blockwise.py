"""Rankings by blocks: each task scores its documents against all queries and keeps the best of each query.

Scores are taken a NumPy tile at a time, in the order of operations of the Catalyst
expressions, so values agree bit for bit; what is shuffled is a task's best rows, and
a task holds no more than these, one batch of documents and one tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.common import top_k

#: Queries and documents of a tile.
QUERY_TILE, DOCUMENT_TILE = 64, 1024
#: Cells of a block of term weights.
WEIGHT_CELLS = 4 << 20

FOUND = "nth int, document_id string, score float"


class Best:
    """The best documents of each query: greatest key, then least id.

    A key of minus infinity stands for a null score, which comes last, and infinity for
    NaN, which comes first, as in Spark's order.
    """

    def __init__(self, queries: int, limit: int) -> None:
        self.limit = limit
        self.floor = np.full(queries, -np.inf, np.float32)
        self.query, self.key, self.name = np.empty(0, np.int64), np.empty(0, np.float32), np.empty(0, object)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def offer(self, first: int, keys: np.ndarray, names: np.ndarray, places: np.ndarray, present: np.ndarray | None = None) -> None:
        """Keys of queries from ``first`` on (rows) for documents ``names``; ``places`` are the ids' places in order."""
        mask = keys >= self.floor[first : first + len(keys), None]
        if present is not None:
            mask &= present
        crowded = np.flatnonzero(np.count_nonzero(mask, axis=1) > self.limit)
        if len(crowded):
            some = np.where(mask[crowded], keys[crowded], -np.inf)
            least = np.partition(some, some.shape[1] - self.limit, axis=1)[:, some.shape[1] - self.limit]
            mask[crowded] &= some >= least[:, None]
            self.floor[first + crowded] = least
            for row, bound in zip(crowded, least):
                own = np.flatnonzero(mask[row])
                if len(own) > self.limit:
                    # of those that tie at the end the least ids stay
                    ties = own[keys[row, own] == bound]
                    mask[row, ties[np.argsort(places[ties])[self.limit - (len(own) - len(ties)) :]]] = False
        row, at = np.nonzero(mask)
        if len(row):
            self.pending.append((row + first, keys[row, at], names[at]))

    def settle(self) -> None:
        """Cut to the limit again after a batch."""
        if not self.pending:
            return
        query = np.concatenate([self.query, *(p[0] for p in self.pending)])
        key = np.concatenate([self.key, *(p[1] for p in self.pending)])
        name = np.concatenate([self.name, *(p[2] for p in self.pending)])
        self.pending = []
        order = np.lexsort((encoded(name), -key, query))
        query, key, name = query[order], key[order], name[order]
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        full = place == self.limit - 1
        self.floor[query[full]] = key[full]
        kept = place < self.limit
        self.query, self.key, self.name = query[kept], key[kept], name[kept]

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.settle()
        score = np.where(np.isposinf(self.key), np.float32(np.nan), self.key)
        for at in range(0, len(score), 50_000):
            part = slice(at, at + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(self.query[part], pa.int32()), pa.array(self.name[part].tolist(), pa.string()), pa.array(score[part], pa.float32(), mask=np.isneginf(self.key[part]))], ["nth", "document_id", "score"])


def encoded(names: np.ndarray) -> np.ndarray:
    """Ids as bytes, whose order is that of Spark; null first."""
    return np.array([b"" if n is None else n.encode() for n in names], dtype="S") if len(names) else np.empty(0, "S1")


def places_of(names: np.ndarray) -> np.ndarray:
    places = np.empty(len(names), np.int64)
    places[np.argsort(encoded(names), kind="stable")] = np.arange(len(names))
    return places


def ranked(found: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """(query_id, rank, document_id, score) of tasks' best rows; ``ids`` is (nth, query_id)."""
    named = found.join(F.broadcast(ids), "nth")
    return top_k(named, ["query_id"], "score", "document_id", limit).select("query_id", "rank", "document_id", "score")


def numbered(queries: DataFrame, *columns: str) -> tuple[pa.Table, DataFrame]:
    """A block of queries at the driver, and (nth, query_id) of its rows."""
    held = queries.select("query_id", *columns).toArrow()
    spark = queries.sparkSession
    ids = spark.createDataFrame([(i, q) for i, q in enumerate(held.column("query_id").to_pylist())], f"nth int, query_id {queries.schema['query_id'].dataType.simpleString()}")
    return held, ids


# -- vectors


def matrix(column: pa.Array, kind: type = np.float32) -> np.ndarray:
    """A list column without null lists as rows; null elements are NaN.  All must have one length."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and sizes.min() != sizes.max():
        raise ValueError(f"vectors of {sizes.min()} and {sizes.max()} dimensions")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
    return flat.reshape(len(sizes), -1) if len(sizes) else np.empty((0, 0), kind)


def has_null(column: pa.Array) -> np.ndarray:
    """Whether a list holds a null element."""
    flat = column.flatten()
    if not flat.null_count:
        return np.zeros(len(column), bool)
    owner = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy(zero_copy_only=False))
    out = np.zeros(len(column), bool)
    out[owner[flat.is_null().to_numpy(zero_copy_only=False)]] = True
    return out


def squares(rows: np.ndarray) -> np.ndarray:
    """Sums of squares from left to right, each step rounded to the rows' type."""
    out = np.zeros(len(rows), rows.dtype)
    for at in range(rows.shape[1]):
        out += rows[:, at] * rows[:, at]
    return out


def dots(queries: np.ndarray, columns: np.ndarray, out: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """Products of all pairs, summed from left to right; ``columns`` has a row for each dimension."""
    out.fill(0)
    for at in range(queries.shape[1]):
        np.multiply(queries[:, at, None], columns[at], out=spare)
        np.add(out, spare, out=out)
    return out


def tiles(queries: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first query, first row, dot products) by tiles; a tile's array is used again."""
    if queries.shape[1] != rows.shape[1]:
        raise ValueError(f"vectors of {queries.shape[1]} and {rows.shape[1]} dimensions")
    out, spare = (np.empty((QUERY_TILE, DOCUMENT_TILE), rows.dtype) for _ in range(2))
    for b in range(0, len(rows), DOCUMENT_TILE):
        columns = np.ascontiguousarray(rows[b : b + DOCUMENT_TILE].T)
        for a in range(0, len(queries), QUERY_TILE):
            q = queries[a : a + QUERY_TILE]
            yield a, b, dots(q, columns, out[: len(q), : columns.shape[1]], spare[: len(q), : columns.shape[1]])


def dense_best(held: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The ranking of (document_id, vector) by single-precision cosine for a block of (query_id, embedding)."""
    asked, ids = numbered(queries, "embedding")
    vectors = asked.column("embedding").combine_chunks()
    if vectors.null_count:
        raise ValueError("a query has no vector")
    shared = held.sparkSession.sparkContext.broadcast((matrix(vectors), has_null(vectors)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_null = shared.value
        best, length = Best(len(q), limit), np.sqrt(squares(q))
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            x, x_null = matrix(batch.column(1)), has_null(batch.column(1))
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            places, reach = places_of(names), np.sqrt(squares(x))
            for a, b, dot in tiles(q, x):
                la, lb = length[a : a + dot.shape[0], None], reach[b : b + dot.shape[1]]
                with np.errstate(all="ignore"):
                    key = dot / (la * lb)
                key[np.isnan(key)] = np.inf
                key[q_null[a : a + dot.shape[0]]] = -np.inf
                key[:, x_null[b : b + dot.shape[1]]] = -np.inf
                key[(la == 0) | (lb == 0)] = 0
                best.offer(a, key, names[b : b + dot.shape[1]], places[b : b + dot.shape[1]])
            best.settle()
        yield from best.rows()

    return ranked(held.mapInArrow(run, FOUND), ids, limit)


def cosines(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, document_id, cosine) in double precision of all documents with a block of queries."""
    asked, ids = numbered(queries, "embedding")
    shared = docs.sparkSession.sparkContext.broadcast(matrix(asked.column("embedding").combine_chunks(), np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        length = np.sqrt(squares(q))
        for batch in batches:
            if not batch.num_rows or not len(q):
                continue
            # some megabytes of cosines at a time
            step = max(1, (1 << 20) // len(q))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = matrix(part.column(1), np.float64)
                reach, out = np.sqrt(squares(x)), np.empty((len(x), len(q)))
                for a, b, dot in tiles(q, x):
                    norms = length[a : a + dot.shape[0], None] * reach[b : b + dot.shape[1]]
                    with np.errstate(all="ignore"):
                        out[b : b + dot.shape[1], a : a + dot.shape[0]] = np.where(norms == 0, 0.0, dot / norms).T
                offsets = pa.array(np.arange(len(x) + 1) * len(q), pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))], ["document_id", "cosines"])

    held = docs.where("embedding IS NOT NULL").select("document_id", F.col("embedding").cast("array<float>"))
    rows = held.mapInArrow(run, "document_id string, cosines array<double>").select("document_id", F.posexplode("cosines").alias("nth", "cosine"))
    return rows.join(F.broadcast(ids), "nth").select("query_id", "document_id", "cosine")


# -- terms


def bm25_best(profiles: DataFrame, asked: list[tuple[object, list[str]]], kind: str, frequency: dict[str, int], n: int, mean: float, limit: int) -> DataFrame:
    """The BM25 ranking of (document_id, token_count, terms, frequencies) for a block of queries (id, distinct terms)."""
    spark = profiles.sparkSession
    words = sorted(frequency)
    number = {w: i for i, w in enumerate(words)}
    lists = [np.array(sorted(number[t] for t in terms if t in number), np.int64) for _, terms in asked]
    df = np.array([frequency[w] for w in words], np.float64)
    shared = spark.sparkContext.broadcast((words, lists, np.log(1 + (n - df + 0.5) / (df + 0.5))))
    ids = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(asked)], f"nth int, query_id {kind}")
    k1, b = 1.2, 0.75

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lists, idf = shared.value
        known = pa.array(words, pa.string())
        best = Best(len(lists), limit)
        step = max(16, min(DOCUMENT_TILE, WEIGHT_CELLS // max(1, len(words))))
        weights = np.zeros((len(words), step))
        for batch in batches:
            if not batch.num_rows or not words:
                continue
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            places = places_of(names)
            length = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            at = pc.index_in(batch.column(2).flatten(), value_set=known)
            tf = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(2)).fill_null(0).to_numpy(zero_copy_only=False))
            hit = at.is_valid().to_numpy(zero_copy_only=False)
            term, tf, owner = at.drop_null().to_numpy(zero_copy_only=False), tf[hit].astype(np.float64), owner[hit]
            part = idf[term] * (tf * (k1 + 1) / (tf + k1 * ((1 - b) + b * length[owner] / mean)))
            for first in range(0, batch.num_rows, step):
                low, high = np.searchsorted(owner, (first, first + step))
                cells = term[low:high], owner[low:high] - first
                weights[cells] = part[low:high]
                size = min(step, batch.num_rows - first)
                for a in range(0, len(lists), QUERY_TILE):
                    key = np.stack([weights[own, :size].sum(axis=0) if len(own) else np.zeros(size) for own in lists[a : a + QUERY_TILE]]).astype(np.float32)
                    best.offer(a, key, names[first : first + size], places[first : first + size], key > 0)
                weights[cells] = 0
            best.settle()
        yield from best.rows()

    return ranked(profiles.select("document_id", "token_count", "terms", "frequencies").mapInArrow(run, FOUND), ids, limit)


# -- hashes


def hash_best(ids_of_docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """The ranking of (document_id) by FNV-1a over query text, byte 255 and id, for a block of (query_id, text)."""
    asked, ids = numbered(queries, "text")
    prime = np.uint64(0x100000001B3)
    states = []
    for text in asked.column("text").to_pylist():
        h = 0xCBF29CE484222325
        for byte in b"" if text is None else text.encode() + b"\xff":
            h = ((h ^ byte) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
        states.append(h)
    # a null text or id gives no bytes
    shared = ids_of_docs.sparkSession.sparkContext.broadcast(np.array(states, np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        best = Best(len(start), limit)
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            raw, places = [b"" if n is None else n.encode() for n in names], places_of(names)
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                for b in range(0, len(own), DOCUMENT_TILE):
                    at = own[b : b + DOCUMENT_TILE]
                    digits = np.frombuffer(b"".join(raw[i] for i in at), np.uint8).reshape(len(at), size).astype(np.uint64)
                    for a in range(0, len(start), QUERY_TILE):
                        h = np.repeat(start[a : a + QUERY_TILE, None], len(at), axis=1)
                        for place in range(size):
                            h ^= digits[:, place]
                            h *= prime
                        key = ((h >> np.uint64(41)) / np.float64(1 << 23)).astype(np.float32)
                        best.offer(a, key, names[at], places[at])
            best.settle()
        yield from best.rows()

    return ranked(ids_of_docs.select("document_id").mapInArrow(run, FOUND), ids, limit)


def in_blocks(queries: DataFrame, most: int, each: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``each`` over blocks of at most ``most`` queries by a hash of query_id, put together."""
    n = queries.count()
    if n <= most:
        return each(queries)
    if queries.groupBy("query_id").count().where(F.col("count") > most).limit(1).count():
        raise ValueError(f"more than {most} rows of one query")
    blocks = -(-n // most)
    number = lambda: F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    while queries.groupBy(number().alias("b")).count().agg(F.max("count")).first()[0] > most:
        blocks += 1 + blocks // 4
    out = None
    for i in range(blocks):
        part = each(queries.where(number() == i))
        if queries.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            # one block's broadcast at a time
            part = part.checkpoint()
        out = part if out is None else out.union(part)
    return out
