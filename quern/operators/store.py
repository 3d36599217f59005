"""An index on a shared file system: immutable segments, generations and one pointer.

A segment holds the documents that one build or update brought, their terms, the ids of
older documents that it replaced or deleted, and signed changes of the terms' document
frequencies.  A generation is a list of segments, published by renaming a small pointer
file; readers resolve the pointer once, so a failed or lost writer leaves what was
published as it was.

Scale: an update analyzes and writes what is new, and reads of the rest only ids and the
terms' ids; a document is live if no later segment names it dead.  After
``MOST_SEGMENTS`` updates the live rows are copied into one segment, without a new
analysis.  Terms lie in runs that are sorted by term, each of some documents: a scan
for a few terms reads a few pages of each.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.errors import CorpusError, EmptyCorpus, SearchError
from quern.functions import vectors
from quern.manifest import Manifest
from quern.operators import indexing, retrieval
from quern.operators.common import broadcast_if_small, nonblank, require
from quern.operators.incremental import cache_hits, duplicate_ids, generations_to_remove
from quern.providers import Embedder, embed

INT8 = "int8_per_vector_scale_offset"
#: Segments beyond which an update merges them.
MOST_SEGMENTS = 8
#: Distinct query terms that are pushed down to the scan of the terms.
PUSHED_TERMS = 256
#: Ids of dead documents up to which these are broadcast, so that texts and terms aren't shuffled.
BROADCAST_IDS = 1_000_000

DOCUMENTS = "document_id string, path string, language string, content string, embedding array<float>"


class Index:
    """Documents, weighted terms and statistics by generation, under ``path``."""

    def __init__(self, spark: SparkSession, path: str, manifest: Manifest | None = None, retention: int = 2) -> None:
        self.spark, self.path, self.retention = spark, path.rstrip("/"), retention
        self.manifest = manifest or Manifest()
        self.manifest.validate()
        if (active := self.active()) is not None:
            Manifest.from_json(self._read(f"{active}/manifest.json")).validate_runtime(self.manifest)

    # -- files

    def _hadoop(self, name: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> str | None:
        p, fs = self._hadoop(name)
        if not fs.exists(p):
            return None
        return "\n".join(r.value for r in self.spark.read.text(f"{self.path}/{name}").collect())

    def _write(self, name: str, text: str) -> None:
        """Write aside, then rename over."""
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        aside, fs = self._hadoop(f"{name}.{time.time_ns()}.tmp")
        target, _ = self._hadoop(name)
        fs.mkdirs(target.getParent())
        out = fs.create(aside, True)
        out.write(text.encode())
        out.hsync() if hasattr(out, "hsync") else out.hflush()
        out.close()
        kind = jvm.org.apache.hadoop.fs.Options.Rename
        how = gateway.new_array(kind, 1)
        how[0] = kind.OVERWRITE
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(fs.makeQualified(aside), fs.makeQualified(target), how)

    def generations(self) -> list[str]:
        p, fs = self._hadoop("")
        return sorted(n for s in (fs.listStatus(p) if fs.exists(p) else []) if (n := s.getPath().getName()).startswith("gen-"))

    def active(self) -> str | None:
        """The published generation."""
        text = self._read("CURRENT")
        return text.strip() if text else None

    # -- reading

    def segments(self) -> list[str]:
        """The published generation's segments, oldest first."""
        if (active := self.active()) is None:
            raise SearchError("the index has no published generation")
        return json.loads(self._read(f"{active}/segments.json"))

    def _live(self, name: str) -> DataFrame:
        """All rows of a table whose document no later segment names dead."""
        segments = self.segments()
        rows, dead = None, None
        for nth, segment in enumerate(segments):
            one = self.spark.read.parquet(f"{self.path}/{segment}/{name}")
            if len(segments) == 1:
                return one
            one = one.withColumn("__segment", F.lit(nth))
            rows = one if rows is None else rows.unionByName(one)
            if nth:
                gone = self.spark.read.parquet(f"{self.path}/{segment}/dead").select("document_id", F.lit(nth).alias("__dead"))
                dead = gone if dead is None else dead.unionByName(gone)
        # a document may have died several times: the last counts
        last = broadcast_if_small(dead.groupBy(F.col("document_id").alias("__id")).agg(F.max("__dead").alias("__dead")), BROADCAST_IDS)
        return rows.join(last, (F.col("document_id") == F.col("__id")) & (F.col("__segment") < F.col("__dead")), "left_anti").drop("__segment")

    def documents(self) -> DataFrame:
        return self._live("documents")

    def terms(self) -> DataFrame:
        return self._live("terms")

    def term_stats(self) -> DataFrame:
        """(term, document_frequency): the sums of the segments' changes."""
        changes = self.spark.read.parquet(*[f"{self.path}/{s}/term_stats" for s in self.segments()])
        return changes.groupBy("term").agg(F.sum("document_frequency").alias("document_frequency")).where("document_frequency <> 0")

    def document_count(self) -> int:
        return self.documents().count()

    def fetch(self, ids: list[str]) -> DataFrame:
        """Documents in the order of ``ids``; unknown ones are left out."""
        return retrieval.ordered_fetch(self.documents(), ids)

    def search(self, queries: DataFrame, top: int = 10, candidates: int = 50, query_vectors: DataFrame | None = None) -> DataFrame:
        """Hybrid search with the stored statistics; a few query terms are pushed down to the scans."""
        terms, stats = self.terms(), self.term_stats()
        asked = [r.term for r in retrieval.query_terms(queries).select("term").distinct().take(PUSHED_TERMS + 1)]
        if len(asked) <= PUSHED_TERMS:
            terms, stats = terms.where(F.col("term").isin(asked)), stats.where(F.col("term").isin(asked))
        # only the int8 form replaces the stored vectors; a binary one is a store's own affair
        return retrieval.search(self.documents(), terms, queries, top, candidates, query_vectors, self.manifest.quantization == INT8, stats)

    # -- writing

    def _remove(self, name: str) -> None:
        p, fs = self._hadoop(name)
        fs.delete(p, True)

    def _checked(self, docs: DataFrame, where: str) -> DataFrame:
        """``docs`` written aside, validated."""
        docs = docs.select(*[F.col(c.split()[0]).cast(c.split(" ", 1)[1]) for c in DOCUMENTS.split(", ")])
        docs = require(docs, F.col("document_id").isNotNull() & nonblank("content"), F.concat(F.lit("blank document "), F.coalesce("document_id", F.lit("null"))))
        if self.manifest.model_id != "none":
            short = F.size("embedding") == self.manifest.mrl_dim
            docs = require(docs, F.col("embedding").isNull() | (short & vectors.is_finite(F.col("embedding"))), F.concat(F.lit("bad vector of "), F.col("document_id")))
        # soon read twice and removed
        indexing.profiled(docs).write.option("compression", "zstd").parquet(f"{where}/staged")
        staged = self.spark.read.parquet(f"{where}/staged")
        if twice := duplicate_ids(staged).take(1):
            raise CorpusError(f"duplicate document {twice[0][0]}")
        return staged

    def _segment(self, docs: DataFrame, dead: DataFrame | None) -> str:
        """Write a segment of new documents; ``dead`` are ids, live or not, that it replaces or deletes."""
        name = f"seg-{time.time_ns()}"
        where = f"{self.path}/{name}"
        staged = self._checked(docs, where)
        if dead is None and staged.isEmpty():
            self._remove(name)
            raise EmptyCorpus("the corpus is empty")
        indexing.weighted_terms(staged).write.parquet(f"{where}/terms")
        terms = self.spark.read.parquet(f"{where}/terms")
        stats = indexing.term_stats(terms)
        if dead is not None:
            gone = dead.select("document_id").unionByName(staged.select("document_id")).distinct()
            live = self.documents().select("document_id").join(gone, "document_id", "left_semi")
            live.write.parquet(f"{where}/dead")
            gone = broadcast_if_small(self.spark.read.parquet(f"{where}/dead"), BROADCAST_IDS)
            lost = indexing.term_stats(self.terms().join(gone, "document_id", "left_semi"))
            stats = stats.unionByName(lost.withColumn("document_frequency", -F.col("document_frequency")))
            stats = stats.groupBy("term").agg(F.sum("document_frequency").alias("document_frequency")).where("document_frequency <> 0")
        stats.write.parquet(f"{where}/term_stats")
        out = staged.drop("terms", "frequencies")
        if self.manifest.quantization == INT8:
            out = indexing.quantize(out)
        out.write.option("compression", "zstd").parquet(f"{where}/documents")
        self._remove(f"{name}/staged")
        return name

    def _publish(self, segments: list[str]) -> str:
        seconds, nanos = divmod(time.time_ns(), 1_000_000_000)
        name = f"gen-{seconds}-{nanos:09d}"
        self._write(f"{name}/manifest.json", self.manifest.to_json())
        self._write(f"{name}/segments.json", json.dumps(segments))
        try:
            self._write("CURRENT", name)
        except Exception:
            # the rename may have happened all the same: only a positive answer counts
            if self.active() != name:
                raise
        for old in generations_to_remove(self.generations(), name, self.retention):
            self._remove(old)
        named = {s for g in self.generations() for s in json.loads(self._read(f"{g}/segments.json") or "[]")}
        p, fs = self._hadoop("")
        for found in (s.getPath().getName() for s in fs.listStatus(p)):
            # a segment older than the published ones that no generation names is left from a build that failed
            if found.startswith("seg-") and found not in named and found < min(segments):
                self._remove(found)
        return name

    def replace(self, docs: DataFrame) -> str:
        """Publish a corpus anew; on an error what was published stays."""
        return self._publish([self._segment(docs, None)])

    def update(self, new: DataFrame, stale: DataFrame) -> str:
        """Publish the active documents without ``stale`` and the ids of ``new``, and with ``new``."""
        names = [c.split()[0] for c in DOCUMENTS.split(", ")]
        segments = [*self.segments(), self._segment(new.select(*names), stale)]
        published = self._publish(segments)
        return self.merge() if len(segments) > MOST_SEGMENTS else published

    def merge(self) -> str:
        """Publish the live rows as one segment; nothing is analyzed again."""
        name = f"seg-{time.time_ns()}"
        where = f"{self.path}/{name}"
        self.terms().write.parquet(f"{where}/terms")
        self.term_stats().write.parquet(f"{where}/term_stats")
        self.documents().write.parquet(f"{where}/documents")
        return self._publish([name])

    def upsert(self, docs: DataFrame) -> str:
        return self.update(docs, docs.select("document_id").limit(0))

    def delete(self, ids: DataFrame) -> str:
        """Publish the active documents without ``ids``; unknown ones are ignored."""
        return self.update(self.spark.createDataFrame([], DOCUMENTS), ids)

    # -- embeddings

    def embedded(self, docs: DataFrame, embedder: Embedder) -> DataFrame:
        """``docs`` with vectors: those that the index's cache holds, by id and content, and new ones, which it then holds too."""
        empty = self.spark.createDataFrame([], "cache_key string, embedding array<float>")
        p, fs = self._hadoop("cache")
        cache = self.spark.read.parquet(f"{self.path}/cache") if fs.exists(p) else empty
        looked = cache_hits(docs.drop("embedding"), cache, embedder.dimensions)
        aside = f"cache-{time.time_ns()}"
        missing = embed(looked.where("embedding IS NULL").drop("embedding"), embedder)
        missing.select("cache_key", "embedding").dropDuplicates(["cache_key"]).write.parquet(f"{self.path}/{aside}")
        new = self.spark.read.parquet(f"{self.path}/{aside}")
        new.write.mode("append").parquet(f"{self.path}/cache")
        self._remove(aside)
        held = self.spark.read.parquet(f"{self.path}/cache").dropDuplicates(["cache_key"])
        return cache_hits(docs.drop("embedding"), held, embedder.dimensions).drop("cache_key")

    # -- checkpoints of a source

    def checkpoint(self) -> dict | None:
        """What the last finished run left: root, fingerprint, manifest hash, and where its files are listed."""
        text = self._read("CHECKPOINT")
        return json.loads(text) if text else None

    def compatible(self, root: str) -> bool:
        """Whether a checkpoint allows an incremental run."""
        c = self.checkpoint()
        return bool(c) and self.active() is not None and c == c | {"version": 2, "root": root, "fingerprint": self.manifest.fingerprint(), "manifest_hash": self.manifest.digest()}

    def begin(self) -> None:
        """Forget the checkpoint before anything is changed, so that a crash leads to a full run."""
        p, fs = self._hadoop("CHECKPOINT")
        fs.delete(p, False)

    def finish(self, root: str, files: DataFrame) -> None:
        """Keep (path, content_hash, document_ids) after publishing."""
        name = f"files-{time.time_ns()}"
        files.select("path", "content_hash", "document_ids").write.parquet(f"{self.path}/{name}")
        self._write("CHECKPOINT", json.dumps({"version": 2, "root": root, "fingerprint": self.manifest.fingerprint(), "manifest_hash": self.manifest.digest(), "files": name}))

    def known_files(self) -> DataFrame:
        """(path, content_hash, document_ids) of the checkpoint; empty without one."""
        c = self.checkpoint()
        if not c:
            return self.spark.createDataFrame([], "path string, content_hash string, document_ids array<string>")
        return self.spark.read.parquet(f"{self.path}/{c['files']}")
