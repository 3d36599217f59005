"""Retrieval metrics over all queries at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.errors import CorpusError
from quern.operators.common import nonblank

#: Greatest difference in nDCG@10 that two backends may show.
PARITY = 0.02


def per_query(ranked: DataFrame, judgments: DataFrame, cutoff: int = 10, recall_at: int = 50) -> DataFrame:
    """(query_id, ndcg, recall, reciprocal_rank) for each judged query.

    ``ranked`` is (query_id, rank, document_id), ``judgments`` (query_id, document_id,
    grade).  Gain is 2**grade - 1, discount log2(rank + 1).  A query without results
    has zeros, as has one without positive grade.
    """
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("grade").desc(), F.col("document_id")))
    ideal = judgments.withColumn("__i", ideal_rank).groupBy("query_id").agg(
        F.sum(F.when(F.col("__i") <= cutoff, gain / F.log2(F.col("__i") + 1)).otherwise(0.0)).alias("ideal"),
        F.sum((F.col("grade") > 0).cast("long")).alias("positive"),
    )
    joined = ranked.select("query_id", "document_id", "rank").join(judgments, ["query_id", "document_id"])
    got = joined.groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= cutoff, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"),
        F.sum(((F.col("rank") <= recall_at) & (F.col("grade") > 0)).cast("long")).alias("hits"),
        F.min(F.when(F.col("grade") > 0, F.col("rank"))).alias("first"),
    )
    out = ideal.join(got, "query_id", "left")
    return out.select(
        "query_id",
        F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"),
        F.when(F.col("positive") > 0, F.coalesce("hits", F.lit(0)) / F.col("positive")).otherwise(0.0).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def passages_in(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(query_id, document_id, grade) of (document_id, content) for a block of (query_id, passage).

    Grade 3 where the content holds the passage, 1 where it holds but its first four
    words between blanks; a row for each item of each document.  One scan.
    """
    # by a head's first word: the whole head, and its item
    heads: dict[str, list[tuple[list[str], int, str, str]]] = {}
    for nth, r in enumerate(items.collect()):
        words = r.passage.split(" ")[:4]
        heads.setdefault(words[0], []).append((words, nth, r.query_id, r.passage))
    shared = docs.sparkSession.sparkContext.broadcast(heads)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = shared.value
        for batch in batches:
            rows = []
            for document_id, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                if (content := content.as_py()) is None:
                    continue
                words, seen = content.split(" "), set()
                for at, word in enumerate(words):
                    for head, nth, query_id, passage in heads.get(word, ()):
                        if nth not in seen and words[at : at + len(head)] == head:
                            seen.add(nth)
                            rows.append((query_id, document_id, 3 if passage in content else 1))
            columns = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.int32()))], ["query_id", "document_id", "grade"])

    return docs.select("document_id", "content").mapInArrow(run, "query_id string, document_id string, grade int")


def macro(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over queries, in all or by group: ndcg, recall, mrr, queries."""
    return metrics.groupBy(*by).agg(F.avg("ndcg").alias("ndcg"), F.avg("recall").alias("recall"), F.avg("reciprocal_rank").alias("mrr"), F.count(F.lit(1)).alias("queries"))


def repository_of(judgments: DataFrame) -> DataFrame:
    """(query_id, repository): the part of graded ids before ``:``; a query of several is an error."""
    one = judgments.groupBy("query_id").agg(F.collect_set(F.substring_index("document_id", ":", 1)).alias("r"))
    return one.select("query_id", F.when(F.size("r") == 1, F.col("r")[0]).otherwise(F.raise_error(F.concat(F.lit("several repositories in query "), F.col("query_id").cast("string")))).alias("repository"))


def nearest_rank(df: DataFrame, value: str, percent: int, *by: str) -> DataFrame:
    """(by…, value): the sample at place ceil(n * percent / 100) in order."""
    if not 0 < percent <= 100:
        raise ValueError("percent must lie between 1 and 100")
    # percentile_disc is that very sample, and aggregates without a sort of the group
    return df.groupBy(*by).agg(F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})").alias(value))


def unknown_judgments(judgments: DataFrame, docs: DataFrame) -> DataFrame:
    """Graded ids that the corpus lacks."""
    return judgments.select("document_id").distinct().join(docs.select("document_id"), "document_id", "left_anti")


def validate_judgments(queries: DataFrame, judgments: DataFrame, docs: DataFrame, least: int = 30) -> None:
    """Fail for fewer than ``least`` queries, blank or repeated ones, ones without positive grade, and unknown ids."""
    if queries.count() < least:
        raise CorpusError(f"an evaluation needs {least} queries or more")
    if not queries.where(~nonblank("text")).isEmpty():
        raise CorpusError("a query is blank")
    if not queries.groupBy("text").count().where("count > 1").isEmpty():
        raise CorpusError("a query is repeated")
    positive = judgments.where("grade > 0").select("query_id").distinct()
    if not queries.join(positive, "query_id", "left_anti").isEmpty():
        raise CorpusError("a query has no positive grade")
    if not unknown_judgments(judgments, docs).isEmpty():
        raise CorpusError("a graded document is unknown")


def parity(a: float, b: float, bound: float = PARITY) -> bool:
    """Whether two values are finite and differ by no more than the bound."""
    return math.isfinite(a) and math.isfinite(b) and abs(a - b) <= bound + 2.220446049250313e-16


def parity_delta(a: DataFrame, b: DataFrame) -> DataFrame:
    """(ndcg_delta, passes) of two one-row results of ``macro``."""
    joined = a.select(F.col("ndcg").alias("__a")).crossJoin(b.select(F.col("ndcg").alias("__b")))
    delta = F.abs(F.col("__a") - F.col("__b"))
    return joined.select(delta.alias("ndcg_delta"), (F.coalesce(delta, F.lit(float("nan"))) <= PARITY + 2.220446049250313e-16).alias("passes"))


def parity_by(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """(by, ndcg_delta) of two results of ``macro`` by group; null where one of them lacks the group."""
    joined = a.select(by, F.col("ndcg").alias("__a")).join(b.select(by, F.col("ndcg").alias("__b")), by, "full_outer")
    return joined.select(by, F.abs(F.col("__a") - F.col("__b")).alias("ndcg_delta"))
