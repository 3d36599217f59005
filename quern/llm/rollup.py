"""Token counts kept as delta-maintained rollups.

A batch of events (insert, delete, revise) is folded to signed changes of documents
and tokens by source, language and tokenizer version, and committed under the
batch's name.  Totals are the sums of the committed changes, so they never need the
documents again.  A commit writes its changes aside and publishes them by one
rename that fails if the name is taken: a batch that is replayed, or run twice at
once after a lost driver, counts once.  Compaction folds committed changes into a
snapshot that names the batches it holds; the folders of those that the snapshot before
it held already are removed, so that a reader which began before is not disturbed.

Scale: events are added up where they are read (map-side sums), so a source with a
third of all rows is one row for each task; what is stored and shuffled is bounded
by the number of distinct keys, not by documents.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import byte_texts, materialize
from quern.llm.packing import encoder

KEYS = ("source", "lang", "tokenizer")
SCHEMA = "source string, lang string, tokenizer string, n_docs long, n_tokens long"
_DIGIT = re.compile(rb"[0-9]")
_WITH_DIGIT = re.compile(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+")


class TokenRollup:
    """Totals by source, lang and tokenizer in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # -- files

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        p, fs = self._fs(f"{self.path}/{kind}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _publish(self, staged: str, final: str) -> bool:
        """Rename, unless the name is taken."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        source, fs = self._fs(staged)
        target, _ = self._fs(final)
        fs.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(source), fs.makeQualified(target), gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception:
            if not fs.exists(target):
                raise
            fs.delete(source, True)
            return False
        return True

    # -- commits

    def committed(self) -> set[str]:
        """Names of all batches that count."""
        return {unquote(n) for n in self._names("batches")} | self._held(self._names("snapshots")[-1:])

    def _held(self, snapshots: list[str]) -> set[str]:
        paths = [f"{self.path}/snapshots/{n}/held" for n in snapshots]
        return {r.batch for r in self.spark.read.parquet(*paths).collect()} if paths else set()

    def commit(self, batch: str, events: DataFrame, times: str | None = None) -> bool:
        """Apply a batch once; False if it was committed before.

        Events have op (insert, delete or revise), source, lang, tokenizer, n_tokens
        and, for revise, old_tokens.  An event counts once, or as often as its column
        ``times`` says.  Null keys are groups of their own, null counts are 0, an
        unknown or null op fails the whole batch, an empty batch commits.
        """
        if batch in self.committed():
            return False
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        signed(events, times).write.parquet(staged)
        return self._publish(staged, f"{self.path}/batches/{quote(batch, safe='')}")

    def compact(self) -> None:
        """Fold what is committed into a snapshot; readers then need no batch that it names."""
        names, before = self.committed(), self._names("snapshots")
        staged = f"{self.path}/staging/{uuid.uuid4().hex}"
        self._sums(names).write.parquet(f"{staged}/totals")
        self.spark.createDataFrame([(n,) for n in sorted(names)], "batch string").write.parquet(f"{staged}/held")
        number = int(before[-1]) + 1 if before else 0
        if self._publish(staged, f"{self.path}/snapshots/{number:012d}"):
            for n in self._held(before[-1:]):
                self._remove(f"batches/{quote(n, safe='')}")
            for n in before[:-1]:
                self._remove(f"snapshots/{n}")

    def _remove(self, name: str) -> None:
        p, fs = self._fs(f"{self.path}/{name}")
        fs.delete(p, True)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens); keys without documents and tokens left out."""
        return self._sums(self.committed()).where("n_docs <> 0 OR n_tokens <> 0")

    def _sums(self, names: set[str]) -> DataFrame:
        """The sums of the batches ``names``, which include all that the last snapshot holds."""
        last = self._names("snapshots")[-1:]
        paths = [f"{self.path}/snapshots/{n}/totals" for n in last]
        paths += [f"{self.path}/batches/{quote(n, safe='')}" for n in sorted(names - self._held(last))]
        every = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        return every.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def signed(events: DataFrame, times: str | None = None) -> DataFrame:
    """Signed changes of documents and tokens by key; an event counts ``times`` times (null: none)."""
    often = F.coalesce(F.col(times).cast("long"), F.lit(0)) if times else F.lit(1).cast("long")
    op, n = F.col("op"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0))
    old = F.coalesce(F.col("old_tokens").cast("long"), F.lit(0)) if "old_tokens" in events.columns else F.lit(0)
    unknown = F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(op, F.lit("null")))).cast("long")
    docs = F.when(op == "insert", 1).when(op == "delete", -1).when(op == "revise", 0).otherwise(unknown)
    tokens = F.when(op == "insert", n).when(op == "delete", -n).otherwise(n - old)
    keys = [F.col(k).cast("string").alias(k) for k in KEYS]
    return events.select(*keys, (docs.cast("long") * often).alias("n_docs"), (tokens * often).alias("n_tokens")).groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def copies(docs: DataFrame, key: str, id_col: str = "doc_id") -> DataFrame:
    """``docs`` folded by all columns but ``id_col``: rows, and how many of them aren't the first of their ``key``.

    Columns ``n`` and ``n_copies`` are added and ``id_col`` goes.  Of the rows with one
    key (null is a key) the first by id stays, those without an id last, and among
    equal ids the first by the other columns; repeated rows are copies of each other.

    Scale: rows are folded where they are read, so a key with a third of all rows is
    one row a task and combination; the join that tells the first is unique on both
    sides.
    """
    rest = [c for c in docs.columns if c != id_col]
    place = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))
    groups = materialize(docs.groupBy(*rest).agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("__place")), "copies")
    own = F.struct("__place", *(F.struct(F.col(c).isNull().alias("none"), F.col(c).alias("value")).alias(c) for c in rest if c != key))
    groups = groups.withColumn("__own", own)
    firsts = groups.groupBy(key).agg(F.min("__own").alias("__first")).withColumnRenamed(key, "__key")
    same = (F.xxhash64(key, "__own") == F.xxhash64("__key", "__first")) & F.col(key).eqNullSafe(F.col("__key")) & (F.col("__own") == F.col("__first"))
    n_copies = F.col("n") - F.when(F.col("__first").isNotNull(), 1).otherwise(0)
    return groups.join(firsts, same, "left").select(*rest, "n", n_copies.alias("n_copies"))


def scrubbed(data: bytes) -> bytes:
    """The text without the words between ASCII white space that hold a digit."""
    return _WITH_DIGIT.sub(b"", data)


def count_tokens(docs: DataFrame, text_col: str = "text", tokenizer: str | None = None) -> DataFrame:
    """``docs`` with its text column replaced by counts: words, words_kept and, with a tokenizer, bpe, bpe_kept.

    ``kept`` counts what is left of the scrubbed text, which is the text itself if it
    has no digit.  Null and empty texts count 0.
    """
    at = docs.columns.index(text_col)
    names = ["words", "words_kept", *(["bpe", "bpe_kept"] if tokenizer else [])]
    schema = T.StructType([f for f in docs.schema if f.name != text_col] + [T.StructField(n, T.LongType()) for n in names])

    def counted(data: bytes, encode) -> tuple[int, ...]:
        one = (len(data.split()), *([len(encode(data.decode())) // 4] if encode else []))
        rest = one
        if _DIGIT.search(data):
            left = scrubbed(data)
            rest = (len(left.split()), *([len(encode(left.decode())) // 4] if encode else []))
        return tuple(n for pair in zip(one, rest) for n in pair)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer) if tokenizer else None
        none = (0,) * len(names)
        for batch in batches:
            rows = [counted(t, encode) if t else none for t in byte_texts(batch.column(at))]
            own = [batch.column(i) for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array([r[i] for r in rows], pa.int64()) for i in range(len(names)))], schema.names)

    return docs.mapInArrow(run, schema)
