"""Incremental ingest: each micro-batch of changed files becomes one published generation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.errors import EmptyCorpus
from quern.operators import chunking, incremental
from quern.operators.common import broadcast_if_small, nonblank
from quern.operators.store import Index

FILE_SCHEMA = "path string, content string, language string"


def documents_of(files: DataFrame, config: chunking.Config = chunking.Config()) -> DataFrame:
    """Index documents (one for each nonblank chunk) of (path, content, language)."""
    docs = files.select(F.col("path").alias("document_id"), "language", "content")
    chunks = chunking.chunk(docs, config=config).where(nonblank("text"))
    return chunks.select(F.col("chunk_id").alias("document_id"), F.col("document_id").alias("path"), "language", F.col("text").alias("content"), F.lit(None).cast("array<float>").alias("embedding"))


def latest(files: DataFrame) -> DataFrame:
    """A row of (path, content, language) for each path: of several the greatest content, of equal ones the greatest language.

    Only the rows of paths that recur are shuffled.
    """
    rows = files.select("path", "content", "language")
    again = incremental.duplicate_ids(rows.withColumnRenamed("path", "__path"), "__path").select("__path")
    if again.isEmpty():
        return rows
    again, same = broadcast_if_small(again), F.col("path").eqNullSafe(F.col("__path"))
    # null is the least content
    some = rows.join(again, same, "left_semi").groupBy("path").agg(F.max(F.struct("content", "language")).alias("row"))
    return rows.join(again, same, "left_anti").unionByName(some.select("path", "row.content", "row.language"))


def apply_batch(index: Index, files: DataFrame) -> str | None:
    """Replace the chunks of the files of a batch; a null content removes its file.

    Of a path that occurs twice in a batch the greatest content counts, so a replayed
    batch gives the same documents.
    """
    new = documents_of(latest(files).where("content IS NOT NULL"))
    if index.active() is None:
        try:
            return index.replace(new)
        except EmptyCorpus:
            return None
    stale = index.documents().join(files.select("path"), "path", "left_semi").select("document_id")
    return index.update(new, stale)


def ingest(spark: SparkSession, source: str, index: Index, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Follow a folder of JSON files of (path, content, language) into an index."""
    stream = spark.readStream.schema(FILE_SCHEMA).json(source)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, _: apply_batch(index, df))
    return (writer.trigger(availableNow=True) if once else writer).start()


def delta_of(index: Index, files: DataFrame, root: str) -> DataFrame:
    """The plan of an incremental run over a whole source, against the checkpoint if that is compatible."""
    known = index.known_files() if index.compatible(root) else index.known_files().limit(0)
    return incremental.plan_delta(files, known)
