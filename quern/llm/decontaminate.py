"""Benchmark decontamination by winnowing.

Words are runs of ``[0-9a-z]`` and non-ASCII characters after lower-casing A-Z.  A
benchmark item's *windows* are its runs of ``WINDOW`` words; an item with fewer
words, but not none, is one window.  Both sides keep, in each span of
``WINDOW - K + 1`` consecutive k-gram hashes, the least one; a shared run of
``WINDOW`` words therefore shares at least one kept k-gram.  Training fingerprints
are joined to the benchmark's, and each hit is extended: the document windows that
contain it are looked up among the benchmark's windows and compared word for word.
Items too short for that guarantee are searched at their own length, all positions.

Scale: documents are scanned once and never shuffled.  The benchmark is broadcast
in blocks of at most ``block_bytes`` of text, measured beforehand; a benchmark
above that bound is processed in several blocks, each against all documents, and
their hits are united.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import byte_texts, documents, field, slices

WINDOW = 10
K = 5
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 8 << 20

_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words(data: bytes | None) -> list[bytes]:
    return (data or b"").translate(_WORDS).split()


def grams(ids: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n word ids."""
    count = len(ids) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for i in range(n):
        out = (out + ids[i : i + count].astype(np.uint64)) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def run_hashes(rows: np.ndarray) -> np.ndarray:
    """The same hash for each row of a matrix of word ids."""
    out = np.zeros(len(rows), np.uint64)
    for i in range(rows.shape[1]):
        out = (out + rows[:, i].astype(np.uint64)) * _MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


def winnow(hashes: np.ndarray, span: int) -> np.ndarray:
    """Positions that hold the least hash of some ``span`` consecutive ones."""
    n = len(hashes)
    if n < span:
        return np.arange(n)
    least = hashes[: n - span + 1].copy()
    for i in range(1, span):
        np.minimum(least, hashes[i : n - span + 1 + i], out=least)
    # the least of all windows over a position is compared with what stands there
    most = np.zeros(n, np.uint64)
    for i in range(span):
        np.maximum(most[i : i + len(least)], least, out=most[i : i + len(least)])
    return np.flatnonzero(most == hashes)


class Block:
    """Search structures of some benchmark items, sent to every task."""

    def __init__(self, items: list[tuple[str, bytes | None]], window: int = WINDOW, k: int = K) -> None:
        self.window, self.k, self.span = window, k, window - k + 1
        self.vocabulary: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        tokens = [np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)], np.int64) for _, text in items]
        self.ids = np.concatenate([*tokens, np.zeros(window, np.int64)])
        offsets = np.cumsum([0, *map(len, tokens)])
        prints = [np.zeros(0, np.uint64)]
        starts: dict[int, list[np.ndarray]] = defaultdict(list)
        owners: dict[int, list[np.ndarray]] = defaultdict(list)
        for i, ids in enumerate(tokens):
            n = min(window, len(ids))
            if not n:
                continue
            if n == window:
                h = grams(ids, k)
                prints.append(h[winnow(h, self.span)])
            starts[n].append(offsets[i] + np.arange(len(ids) - n + 1))
            owners[n].append(np.full(len(ids) - n + 1, i))
        self.prints = np.unique(np.concatenate(prints))
        #: by window length: sorted distinct hashes, a place of each in ids, and the items of each (bounds, numbers)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in starts:
            at, owner = np.concatenate(starts[n]), np.concatenate(owners[n])
            rows = self.ids[at[:, None] + np.arange(n)]
            hashes, first, group = np.unique(run_hashes(rows), return_index=True, return_inverse=True)
            if not (rows == rows[first[group]]).all():
                raise ValueError("two different benchmark windows have one 64-bit hash; choose another multiplier")
            pairs = np.unique(np.stack([group, owner], axis=1), axis=0)
            self.by_length[n] = (hashes, at[first], np.searchsorted(pairs[:, 0], np.arange(len(hashes) + 1)), pairs[:, 1])

    def items_of(self, n: int, row: int) -> list[int]:
        _, _, bounds, numbers = self.by_length[n]
        return numbers[bounds[row] : bounds[row + 1]].tolist()

    def _lookup(self, ids: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts among ``at`` where a window of n words stands, and that window's number."""
        hashes, place, _, _ = self.by_length[n]
        at = at[(at >= 0) & (at + n <= len(ids))]
        rows = ids[at[:, None] + np.arange(n)]
        wanted = run_hashes(rows)
        row = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        same = (hashes[row] == wanted) & (self.ids[place[row][:, None] + np.arange(n)] == rows).all(axis=1)
        return at[same], row[same]

    def search(self, texts: list[bytes | None]) -> list[tuple[int, np.ndarray, list[int]]]:
        """For each text: its number of words, the numbers of its hit words, the items found."""
        seen = self.vocabulary.get
        tokens = [words(t) for t in texts]
        counts = np.array([len(t) for t in tokens], np.int64)
        # one array for all texts; 0 stands for other words and for the end of a text
        ends = np.cumsum(counts + 1)
        ids = np.fromiter((seen(w, 0) for t in tokens for w in (*t, b"")), np.int64, int(ends[-1]) if len(ends) else 0)
        starts, rows, lengths = [], [], []
        for n in self.by_length:
            if n == self.window:
                h = grams(ids, self.k)
                if not len(h) or not len(self.prints):
                    continue
                hit = winnow(h, self.span)
                where = np.searchsorted(self.prints, h[hit])
                where[where == len(self.prints)] = 0
                hit = hit[self.prints[where] == h[hit]]
                near = np.unique((hit[:, None] - np.arange(self.window - self.k + 1)).reshape(-1))
            else:
                near = np.flatnonzero(ids[: max(0, len(ids) - n + 1)])
            s, r = self._lookup(ids, near, n)
            starts.append(s)
            rows.append(r)
            lengths.append(np.full(len(s), n))
        out: list[tuple[int, np.ndarray, list[int]]] = [(int(c), np.zeros(0, np.int64), []) for c in counts]
        if not starts:
            return out
        s, r, n = np.concatenate(starts), np.concatenate(rows), np.concatenate(lengths)
        owner = np.searchsorted(ends, s, "right")
        for d in np.unique(owner):
            mine = owner == d
            base = ends[d] - counts[d] - 1
            delta = np.zeros(counts[d] + 1, np.int64)
            np.add.at(delta, s[mine] - base, 1)
            np.add.at(delta, s[mine] - base + n[mine], -1)
            names: set[int] = set()
            for row, length in set(zip(r[mine].tolist(), n[mine].tolist())):
                names.update(self.items_of(length, row))
            out[d] = (int(counts[d]), np.flatnonzero(np.cumsum(delta[:-1]) > 0), sorted(names))
        return out


def blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The benchmark in parts of at most about ``block_bytes`` of text each."""
    items = documents(benchmark, id_col, text_col).dropDuplicates()
    total = items.agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0
    n = -(-total // block_bytes)
    if n <= 1:
        return [items]
    return [items.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(2 * n)) == b) for b in range(2 * n)]


def _ranges(hit: np.ndarray) -> list[dict[str, int]]:
    if not len(hit):
        return []
    cut = np.flatnonzero(np.diff(hit) > 1)
    return [{"start": int(a), "end": int(b) + 1} for a, b in zip(hit[np.r_[0, cut + 1]], hit[np.r_[cut, len(hit) - 1]])]


_RANGE = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _scan(src: DataFrame, part: DataFrame, window: int, k: int) -> DataFrame:
    block = Block([(str(r.doc_id), r.text.encode() if r.text is not None else None) for r in part.orderBy("doc_id", "text").collect() if r.doc_id is not None], window, k)
    sent = src.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_texts(batch.column(1))
            for a, b in slices([len(t or b"") for t in texts]):
                found = sent.value.search(texts[a:b])
                names = [[sent.value.names[i] for i in items] for _, _, items in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a),
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array([_ranges(hit) for _, hit, _ in found], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        pa.array(names, pa.list_(pa.string())),
                    ],
                    ["doc_id", "n_words", "hits", "items"],
                )

    schema = T.StructType([field(src, "doc_id"), T.StructField("n_words", T.LongType()), T.StructField("hits", _RANGE), T.StructField("items", T.ArrayType(T.StringType()))])
    return src.mapInArrow(run, schema)


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, hits, items) for each row of ``docs``.

    ``hits`` are disjoint ranges of word numbers, in order; ``items`` the ids, as
    strings in string order, of benchmark items with a window in the text.  Null and
    empty texts have no words; items without words or without id match nothing; items
    that occur twice count once.  Rows with the same doc_id stay separate unless the
    benchmark needs several blocks, where rows equal in doc_id and text are one
    row's worth of evidence repeated for each.  An empty benchmark hits nothing.
    """
    src = documents(docs, id_col, text_col)
    parts = blocks(benchmark, item_col, item_text_col, block_bytes)
    if len(parts) == 1:
        return _scan(src, parts[0], window, k).withColumn("items", F.array_sort(F.array_distinct("items")))
    keyed = src.select(F.struct("doc_id", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n")).alias("doc_id"), "text")
    merged: DataFrame | None = None
    for part in parts:
        one = _scan(keyed, part, window, k)
        merged = one if merged is None else merged.unionByName(one)
    spread = merged.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("__n"), F.array_sort(F.flatten(F.collect_list("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    union = F.aggregate(
        "hits",
        F.array().cast(_RANGE),
        lambda acc, r: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] >= r["start"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["start"].alias("start"), F.greatest(F.try_element_at(acc, F.lit(-1))["end"], r["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(r))),
    )
    # equal rows came in once for each block
    spread = spread.withColumn("hits", union).withColumn("__copy", F.explode(F.sequence(F.lit(1), (F.col("__n") / len(parts)).cast("int"))))
    return spread.select(F.col("doc_id.doc_id").alias("doc_id"), "n_words", "hits", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, in which no benchmark window occurs.

    Nothing is shuffled: each block of the benchmark filters what the last one left.
    A null or empty text has no word and stays; repeated rows stay or go together.
    Items without an id count like others, items without a word never occur; an empty
    benchmark removes nothing, an empty table gives an empty table.
    """
    for part in blocks(benchmark, item_col, item_text_col, block_bytes):
        block = Block([(str(r.doc_id), r.text.encode() if r.text is not None else None) for r in part.collect()], window, k)
        sent = docs.sparkSession.sparkContext.broadcast(block)
        at = docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch], sent=sent, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = byte_texts(batch.column(at))
                for a, b in slices([len(t or b"") for t in texts]):
                    clean = [not len(hit) for _, hit, _ in sent.value.search(texts[a:b])]
                    yield batch.slice(a, b - a).filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def items_digest(names: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
