"""Rankings by blocks against plain loops, with ties and odd vectors."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import identity, vectors
from quern.operators import blockwise, retrieval
from quern.operators.common import top_k


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def pairs(docs, queries, score, limit):
    """The ranking from all pairs, as expressions give them."""
    scored = docs.crossJoin(queries).select("query_id", "document_id", score.alias("score"))
    return {tuple(map(str, r)) for r in top_k(scored, ["query_id"], "score", "document_id", limit).select("query_id", "rank", "document_id", "score").collect()}


def test_dense_ranks_as_all_pairs_do_without_making_them(spark, monkeypatch):
    monkeypatch.setattr(blockwise, "DOCUMENT_TILE", 16)
    r = random.Random(1)
    held = [(str(i), [float(r.randint(-2, 2)) for _ in range(3)]) for i in range(150)] + [("null", [1.0, None, 2.0]), ("nan", [1.0, float("nan"), 2.0]), ("none", None)]
    docs = spark.createDataFrame(held, "document_id string, embedding array<float>").repartition(3)
    queries = docs.where("document_id IN ('3', '7', '20', '21', 'null')").select(F.col("document_id").alias("query_id"), F.col("embedding").alias("q"))
    for limit in (1, 7, 200):
        got = retrieval.dense(docs, queries.withColumnRenamed("q", "embedding"), limit)
        assert {tuple(map(str, x)) for x in got.collect()} == pairs(docs.where("embedding IS NOT NULL"), queries, vectors.cosine(F.col("q"), F.col("embedding")), limit)
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_cosines_of_all_pairs(spark):
    r = np.random.default_rng(2)
    docs = spark.createDataFrame([(str(i), r.normal(size=5).tolist()) for i in range(40)] + [("zero", [0.0] * 5)], "document_id string, embedding array<float>")
    queries = docs.limit(9).select(F.col("document_id").alias("query_id"), "embedding")
    got = retrieval.cosine_all(docs, queries)
    want = docs.crossJoin(queries.withColumnRenamed("embedding", "q")).select("query_id", "document_id", vectors.cosine_double(F.col("q"), F.col("embedding")).alias("cosine"))
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()}
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)


def test_vectors_of_other_lengths_are_an_error(spark):
    docs = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "document_id string, embedding array<float>")
    for held in (docs, docs.limit(1)):
        with pytest.raises(Exception, match="dimensions"):
            retrieval.dense(held, spark.createDataFrame([("q", [1.0, 2.0, 3.0])], "query_id string, embedding array<float>"), 1).collect()


def test_hash_rank_equals_the_expression(spark, monkeypatch):
    monkeypatch.setattr(blockwise, "DOCUMENT_TILE", 16)
    docs = spark.createDataFrame([(str(i),) for i in range(120)] + [("",), ("ä7",), (None,)], "document_id string")
    queries = spark.createDataFrame([("1", "one"), ("2", ""), ("3", "drei ü"), ("4", None)], "query_id string, text string")
    for limit in (5, 200):
        got = retrieval.hash_rank(queries, docs, limit, 200)
        assert {tuple(map(str, x)) for x in got.collect()} == pairs(docs, queries, identity.stable_score(F.col("text"), F.col("document_id")), limit)
    assert "NestedLoop" not in plan(got)


CORPUS = [("1", "s/1", "Alpha beta beta runningFast"), ("2", "s/2", "beta über Straße gamma"), ("10", "t/10", None), ("3", "t/3", ""), ("4", "t/4", "alpha alpha the walked walked")]


def test_profiles_hold_what_the_terms_rows_hold_and_shuffle_nothing(spark):
    from quern.functions import text
    from quern.operators import indexing

    docs = spark.createDataFrame(CORPUS, "document_id string, path string, content string")
    rows = None
    for name, weight in zip(("content", "path", "document_id"), indexing.WEIGHTS):
        one = text.analyze(docs, F.col(name), "document_id").withColumn("w", F.lit(weight))
        rows = one if rows is None else rows.unionByName(one)
    want = {tuple(r) for r in rows.groupBy("document_id", "term").agg(F.sum("w")).collect()}
    held = indexing.profiles(docs)
    assert "Exchange" not in plan(held)
    assert {(r.document_id, t, n) for r in held.collect() for t, n in zip(r.terms, r.frequencies)} == want
    assert {r.document_id: r.token_count for r in held.collect()} == {r.document_id: sum(n for d, _, n in want if d == r.document_id) for r in held.collect()}
    # an id of two rows is one document with the terms of both
    twice = indexing.profiles(docs.unionByName(docs.where("document_id = '1'")))
    got = {r.document_id: r for r in twice.collect()}
    assert twice.count() == 5 and dict(zip(got["1"].terms, got["1"].frequencies)) == {t: 2 * n for d, t, n in want if d == "1"}
    assert got["1"].token_count == 2 * sum(got["1"].frequencies)


def test_bm25_over_profiles_shuffles_no_postings(spark):
    from quern.operators import indexing

    docs = spark.createDataFrame(CORPUS, "document_id string, path string, content string")
    queries = spark.createDataFrame([("a", "alpha beta"), ("b", "walked nowhere"), ("c", "the")], "query_id string, text string")
    terms = indexing.weighted_terms(docs)
    want = retrieval.bm25(indexing.with_token_count(docs, terms), terms, queries, 3)
    got = retrieval.bm25_profiles(indexing.profiles(docs), queries, 3)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()} and got.where("query_id = 'a'").count() == 3
    assert "SortMergeJoin" not in plan(got) and "hashpartitioning(document_id" not in plan(got)


def test_passages_are_graded_in_one_scan(spark):
    from quern.operators import evaluation

    docs = spark.createDataFrame([("1", "x one two three four five y"), ("2", "one two three four six"), ("3", "zone two three four five"), ("4", "short"), ("5", None)], "document_id string, content string")
    items = spark.createDataFrame([("p", "one two three four five"), ("q", "short"), ("r", "one two three four five")], "query_id string, passage string")
    got = evaluation.passages_in(docs, items)
    assert "Exchange" not in plan(got) and "Join" not in plan(got)
    assert {tuple(r) for r in got.collect()} == {("p", "1", 3), ("r", "1", 3), ("p", "2", 1), ("r", "2", 1), ("q", "4", 3)}


def test_runs_of_postings_are_bounded_and_sorted(spark, monkeypatch):
    from quern.operators import indexing

    held = [("1", ["b", "d"], [1, 2]), ("2", [], []), ("3", ["a", "b", "c", "e"], [3, 4, 5, 6]), ("4", ["a"], [7]), ("5", ["a", "c"], [8, 9])]
    rows = spark.createDataFrame(held, "document_id string, terms array<string>, frequencies array<long>").coalesce(1)
    monkeypatch.setattr(indexing, "RUN_TERMS", 3)
    got = [tuple(r) for r in indexing.postings(rows).collect()]
    assert got == [("1", "b", 1), ("1", "d", 2), ("3", "a", 3), ("3", "b", 4), ("3", "c", 5), ("3", "e", 6), ("4", "a", 7), ("5", "a", 8), ("5", "c", 9)]
    # tokens beyond those that are kept are analyzed again
    monkeypatch.setattr("quern.functions.text.Analyzer.KEPT", 4)
    docs = spark.createDataFrame(CORPUS, "document_id string, path string, content string")
    assert indexing.profiles(docs).count() == 5
