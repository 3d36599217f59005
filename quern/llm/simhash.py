"""SimHash near-duplicate groups by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments A and B of 23 bits and C of 18.  The
perfect binary Golay code (23, 12, 7) covers all 23-bit words with balls of radius
3 about its 4,096 codewords.  A word's *index list* holds the index of every
codeword to which the word or one of its 23 neighbours decodes: one index if the
word lies within 2 bits of its codeword, six if it lies at 3.  Words that differ in
at most 2 bits share a neighbour, hence an index.

Pigeonhole over the segments, for at most 2 differing bits in all: either C is
equal and A differs in at most 2 bits (key: C, an index of A), or C differs and
then one of A and B is equal and the other differs in at most 1 (keys: A with an
index of B, B with an index of A).  Rows that share a key are joined and verified
on the whole fingerprint.

Scale: equal fingerprints are folded first (partial aggregation), so a group of
copies is one row however many copies it has.  A key bucket of more than
``HOT_BUCKET`` distinct fingerprints isn't joined; its members go to a second index
whose key is every word within 1 bit of the fingerprint.  Such a bucket holds at
most 65 distinct fingerprints, and fingerprints at 2 bits or fewer share one, so no
pair is lost and no bucket is unbounded.  Components are found by contraction over
the distinct fingerprints that have a link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh64_intdigest

from quern.llm.common import byte_texts, discard, documents, field, fresh, hex64, hot_keys, materialize, partitions, salted_join

SEED = 42
SHINGLE = 3
#: Distinct fingerprints in one Golay bucket beyond which the radius-1 index takes over.
HOT_BUCKET = 256
GENERATOR = 0xC75
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_LANES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray) -> int:
    """The word whose bits are set in over half of the 64-bit hashes."""
    n = len(hashes)
    if n == 0:
        return 0
    pad = -n % 255
    block = np.concatenate([hashes, np.zeros(pad, np.uint64)]).reshape(-1, 255) if pad else hashes.reshape(-1, 255)
    out = 0
    for j in range(8):
        # eight byte lanes per word hold counts up to 255 without a carry
        lanes = ((block >> np.uint64(j)) & _LANES).sum(axis=1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for lane in range(8):
            if 2 * int(counts[lane]) > n:
                out |= 1 << (8 * lane + j)
    return out


def fingerprint(data: bytes | None) -> int:
    """SimHash of UTF-8 text: 3-word shingles with repeats, XXH64 with seed 42; no words: 0."""
    words = (data or b"").translate(LOWER).split()
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED) if words else 0
    shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    return majority(np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - SHINGLE + 1))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) for every row; ``fp`` is the fingerprint as a signed long."""
    src = documents(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(map(fingerprint, byte_texts(batch.column(1))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return src.mapInArrow(run, T.StructType([field(src, "doc_id"), T.StructField("fp", T.LongType())]))


class Golay:
    """Index lists of 23-bit words, by syndrome."""

    def __init__(self) -> None:
        rows = []
        for word in range(256):
            for shift in (0, 8, 16):
                rows.append(self._remainder(word << shift))
        self.parts = np.array(rows, np.int64).reshape(256, 3)
        self.patterns = np.zeros((2048, 6), np.int64)
        weights = np.zeros(2048, np.int64)
        fours: dict[int, list[int]] = {}
        for weight in range(5):
            for bits in combinations(range(23), weight):
                word = sum(1 << b for b in bits)
                s = int(self.syndrome(np.array([word]))[0])
                if weight < 4:
                    self.patterns[s] = word
                    weights[s] = weight
                else:
                    fours.setdefault(s, []).append(word)
        self.sizes = np.where(weights == 3, 6, 1)
        for s in np.flatnonzero(weights == 3):
            self.patterns[s, 1:] = fours[int(s)]

    @staticmethod
    def _remainder(word: int) -> int:
        for bit in range(23, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.parts[words & 255, 0] ^ self.parts[words >> 8 & 255, 1] ^ self.parts[words >> 16 & 255, 2]

    def index_lists(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and codeword indices, one pair for each entry of each word's list."""
        s = self.syndrome(words)
        rows = np.repeat(np.arange(len(words)), self.sizes[s])
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(self.sizes[s]) - self.sizes[s], self.sizes[s])
        return rows, (words[rows] ^ self.patterns[s[rows], nth]) >> 11


_golay: list[Golay] = []


def golay() -> Golay:
    if not _golay:
        _golay.append(Golay())
    return _golay[0]


def golay_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and bucket keys of unsigned 64-bit fingerprints."""
    mask = np.uint64((1 << 23) - 1)
    a, b, c = ((fps & mask).astype(np.int64), (fps >> np.uint64(23) & mask).astype(np.int64), (fps >> np.uint64(46)).astype(np.int64))
    rows, keys = [], []
    for kind, (exact, coded) in enumerate(((c, a), (a, b), (b, a))):
        r, index = golay().index_lists(coded)
        rows.append(r)
        keys.append(kind << 40 | exact[r] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def ball_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys: the fingerprint and its 64 neighbours."""
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    return np.repeat(np.arange(len(fps)), 65), (fps[:, None] ^ flips[None, :]).reshape(-1).view(np.int64)


def _keyed(distinct: DataFrame, ball: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for i in range(0, len(every), 4096):
                fps = every[i : i + 4096]
                rows, keys = (ball_keys if ball else golay_keys)(fps.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps[rows])], ["key", "fp"])

    return distinct.select("fp").mapInArrow(run, "key long, fp long")


def _verified(keyed: DataFrame, max_distance: int) -> DataFrame:
    a, b = keyed.alias("a"), keyed.alias("b")
    on = (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")) & (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_distance)
    return a.join(b, on).select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))


def links(distinct: DataFrame, max_distance: int = 2, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """Every pair (u, v), u < v, of distinct fingerprints within ``max_distance`` bits, once."""
    if not 0 <= max_distance <= 2:
        raise ValueError("the index lists guarantee distances up to 2")
    spark = distinct.sparkSession
    n = max(partitions(spark), spark.sparkContext.defaultParallelism)
    keyed = _keyed(distinct.repartition(n, "fp"), ball=False)
    sizes = materialize(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "golay-sizes")
    hot = hot_keys(sizes, ["key"], "size", sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).head()[0])
    shared = materialize(salted_join(keyed, sizes, ["key"], F.xxhash64("fp"), "inner", hot=hot, measured=True), "golay-keys")
    found = _verified(shared.where(F.col("size") <= hot_bucket).select("key", "fp"), max_distance)
    hot = shared.where(F.col("size") > hot_bucket).select("fp").distinct()
    found = found.unionByName(_verified(_keyed(hot.repartition(n, "fp"), ball=True), max_distance))
    out = materialize(found.distinct(), "simhash-links")
    discard(shared)
    discard(sizes)
    return out


def components(edges: DataFrame, jumps: int = 3) -> DataFrame:
    """(node, root) for every node of the edges (u, v); root is the component's least node.

    Each round sends a node to its least neighbour, follows such steps ``jumps``
    times by doubling, and renames the edges' ends; a node that heads a long chain
    is never gathered into one task, as renaming joins are salted.
    """
    spark = edges.sparkSession
    mapping: DataFrame | None = None
    own = False
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("root"))
        for _ in range(jumps):
            nxt = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            step = salted_join(step, nxt, ["root"], F.xxhash64("node"), "inner").select("node", F.col("further").alias("root"))
        step = materialize(step, "cc-step")
        if mapping is None:
            merged = step
        else:
            nxt = step.select(F.col("node").alias("root"), F.col("root").alias("further"))
            merged = salted_join(mapping, nxt, ["root"], F.xxhash64("node"), "left").select("node", F.coalesce("further", "root").alias("root"))
            merged = materialize(merged, "cc-map")
        ends = edges
        for c in ("u", "v"):
            names = step.select(F.col("node").alias(c), F.col("root").alias("__to"))
            ends = salted_join(ends, names, [c], F.xxhash64("u", "v"), "inner").drop(c).withColumnRenamed("__to", c)
        ends = ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).where("u < v").distinct()
        ends = materialize(ends, "cc-edges")
        for table in (step, mapping) if mapping is not None else ():
            discard(table)
        if own:
            discard(edges)
        mapping, edges, own = merged, ends, True
        if edges.isEmpty():
            discard(edges)
            return mapping


def _classes(docs: DataFrame, id_col: str, text_col: str, max_distance: int = 2, hot_bucket: int = HOT_BUCKET) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Rows (doc_id, fp), their distinct fingerprints (fp, n, n_near, root, component_id), and which of these are hot."""
    rows = materialize(fingerprints(docs, id_col, text_col), "simhash")
    classes = materialize(rows.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")), "simhash-classes")
    hot = hot_keys(classes, ["fp"], "n", classes.agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0])
    edges = links(classes, max_distance, hot_bucket)
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    others = both.join(classes.select(F.col("fp").alias("v"), "n"), "v").groupBy(F.col("u").alias("fp")).agg(F.sum("n").alias("others"))
    roots = components(edges)
    named = classes.join(others, "fp", "left").join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    joined = materialize(named, "simhash-roots")
    for table in (classes, edges, roots):
        discard(table)
    leasts = joined.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    wide = hot_keys(leasts, ["root"], "members", joined.count())
    named = salted_join(joined, leasts.drop("members"), ["root"], F.xxhash64("fp"), "inner", hot=wide, measured=True)
    n_near = (F.col("n") - 1 + F.coalesce("others", F.lit(0))).cast("long").alias("n_near")
    named = materialize(named.select("fp", "n", n_near, "root", "component_id"), "simhash-named")
    discard(joined)
    return rows, named, hot


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = 2, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """(doc_id, fingerprint, n_near, component_id), one row for each input row.

    Null and empty texts have no words and fingerprint zero, and link to one another
    like any other.  Repeated rows count one another.  component_id is the least
    non-null doc_id that can be reached over links, itself included; null only if
    no row reached has a doc_id.  An empty table gives an empty table.  Columns
    other than the two named are ignored.
    """
    rows, named, hot = _classes(docs, id_col, text_col, max_distance, hot_bucket)
    out = salted_join(rows, named, ["fp"], F.xxhash64("doc_id"), "inner", hot=hot, measured=True)
    return out.select("doc_id", hex64("fp").alias("fingerprint"), "n_near", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that represent their group, with all their columns.

    Of each group one row of the least doc_id stays: if rows of that group share it,
    one of the least fingerprint, and of rows with equal ids and fingerprints one.
    Rows with one id but in different groups are decided apart.  A row without
    doc_id can't be named by a decision and stays.  An empty table gives an empty one.

    Scale: decisions are made on ids and fingerprints; the rows themselves are moved
    once, for the join with those that stay.  Only rows whose id occurs repeatedly are
    fingerprinted again, to tell them apart.
    """
    rows, named, hot = _classes(docs, id_col, text_col)
    own = salted_join(rows, named.select("fp", "root", "component_id"), ["fp"], F.xxhash64("doc_id"), "inner", hot=hot, measured=True)
    own = own.where(F.col("doc_id") == F.col("component_id"))
    key, mark = fresh(docs, "__kept"), fresh(docs, "__fingerprint")
    firsts = materialize(own.groupBy("root").agg(F.min("doc_id").alias(key), F.min("fp").alias(f"{mark}_kept")).drop("root"), "near-kept")
    often = materialize(rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"), "near-repeated")
    discard(rows)
    discard(named)
    unnamed = docs.where(docs[id_col].isNull())
    if often.isEmpty():
        discard(often)
        return docs.join(firsts, docs[id_col] == F.col(key), "left_semi").unionByName(unnamed)
    repeated = F.col(key) == F.col("doc_id")
    clear = docs.join(firsts.join(often, repeated, "left_anti"), docs[id_col] == F.col(key), "left_semi")
    unclear = firsts.join(often, repeated, "left_semi")
    some = _with_fingerprint(docs.join(unclear, docs[id_col] == F.col(key), "left_semi"), text_col, mark)
    some = some.join(unclear, (some[id_col] == F.col(key)) & (some[mark] == F.col(f"{mark}_kept")), "left_semi")
    return clear.unionByName(some.dropDuplicates([id_col, mark]).drop(mark)).unionByName(unnamed)


def _with_fingerprint(docs: DataFrame, text_col: str, name: str) -> DataFrame:
    """``docs`` with its fingerprint as one more column."""
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter(map(fingerprint, byte_texts(batch.column(at))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], schema.names)

    return docs.mapInArrow(run, schema)
