import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation, incremental, indexing, requests, retrieval
from quern.errors import CorpusError, IndexFailure
from quern.providers import HashEmbedder, scorer

RANKED = "query_id string, rank int, document_id string, score float"


def ranked(spark, *rows):
    return spark.createDataFrame([("q", i + 1, d, s) for i, (d, s) in enumerate(rows)], RANKED)


def ids(df):
    return [r.document_id for r in df.orderBy("query_id", "rank").collect()]


def test_fusion_prefers_what_both_have(spark):
    out = retrieval.rrf(ranked(spark, ("lexical", 4.0), ("both", 3.0)), ranked(spark, ("dense", 0.9), ("both", 0.8)), 10).orderBy("rank").collect()
    assert out[0].document_id == "both" and (out[0].lexical, round(out[0].dense, 3)) == (3.0, 0.8)
    assert [r.document_id for r in out[1:]] == ["dense", "lexical"]


def test_a_single_list_passes_as_it_is(spark):
    only = ranked(spark, ("b", 1.0), ("a", 1.0), ("c", 0.5))
    out = retrieval.rrf(only, only.limit(0), 2).orderBy("rank").collect()
    assert [(r.document_id, r.score, r.dense) for r in out] == [("b", 1.0, None), ("a", 1.0, None)]
    # settled for each query by itself
    two = only.unionByName(spark.createDataFrame([("p", 1, "x", 9.0)], RANKED))
    out = retrieval.rrf(two, ranked(spark, ("a", 0.5)), 5)
    assert {r.query_id: round(r.score, 3) for r in out.where("rank = 1").collect()} == {"p": 9.0, "q": 0.033}


def rerank(spark, score, found=("a", "b", "c"), held=("a", "b", "c")):
    cands = ranked(spark, *[(d, 1.0) for d in found]).withColumns({"lexical": F.col("score"), "dense": F.lit(None).cast("float")})
    passages = spark.createDataFrame([(d, d) for d in held], "document_id string, content string")
    return retrieval.rerank(cands, passages, score, spark.createDataFrame([("q", "text")], "query_id string, text string"), 5)


def scores(table):
    return lambda q, p: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), p).cast("float")


def test_rerank_orders_and_keeps_signals(spark):
    out = rerank(spark, scores({"a": -2.0, "b": 5.0, "c": 1.0})).orderBy("rank").collect()
    assert [(r.document_id, r.late, r.lexical) for r in out] == [("b", 5.0, 1.0), ("c", 1.0, 1.0), ("a", -2.0, 1.0)]
    assert ids(rerank(spark, scores({"z": 1.0, "m": 1.0, "a": 1.0}), ("z", "m", "a"), ("z", "m", "a"))) == ["a", "m", "z"]


def test_rerank_fails_closed(spark):
    with pytest.raises(Exception, match="no passage"):
        rerank(spark, scores({"a": 1.0, "b": 1.0, "c": 1.0}), held=("a", "b")).collect()
    with pytest.raises(Exception, match="finite"):
        rerank(spark, lambda q, p: F.lit(float("nan"))).collect()

    class Short:
        def rerank(self, query, passages):
            return [1.0]

    with pytest.raises(Exception, match="scores for"):
        rerank(spark, scorer(Short())).collect()


def test_collapse(spark):
    mapping = spark.createDataFrame([("a#0", "a"), ("a#1", "a"), ("b#0", "b")], "document_id string, parent_id string")
    assert ids(retrieval.collapse(ranked(spark, ("a#0", 3.0), ("a#1", 2.0), ("b#0", 1.0)), mapping)) == ["a", "b"]
    with pytest.raises(Exception, match="no parent"):
        retrieval.collapse(ranked(spark, ("x", 1.0)), mapping).collect()


def test_bm25_finds_the_right_document(spark):
    docs = spark.createDataFrame([("manifest", "src/m", "manifest validation fails closed"), ("chunker", "src/c", "splits source text"), ("gateway", "src/g", "remote calls")], "document_id string, path string, content string")
    terms = indexing.weighted_terms(docs)
    held = indexing.with_token_count(docs, terms)
    queries = spark.createDataFrame([("q", "manifest validation"), ("stop", "the of and")], "query_id string, text string")
    out = retrieval.bm25(held, terms, queries, 5).collect()
    assert out[0].document_id == "manifest" and {r.query_id for r in out} == {"q"}
    embedder = HashEmbedder()
    vectors = spark.createDataFrame([(d.document_id, embedder.embed_query(d.content).tolist()) for d in docs.collect()], "document_id string, embedding array<float>")
    asked = spark.createDataFrame([("q", embedder.embed_query("manifest validation").tolist())], "query_id string, embedding array<float>")
    best = retrieval.search(held.join(vectors, "document_id"), terms, queries, 2, 5, asked).where("query_id = 'q' AND rank = 1").head()
    assert best.document_id == "manifest" and best.lexical is not None and best.dense is not None
    with pytest.raises(ValueError):
        retrieval.search(held, terms, queries, 51, 50)


def test_hash_rank_is_stable_and_counts_ids_once(spark):
    docs = spark.createDataFrame([("second",), ("first",), ("first",)], "document_id string")
    q = spark.createDataFrame([("q", "text")], "query_id string, text string")
    a, b = (ids(retrieval.hash_rank(q, docs, 2, 50)) for _ in range(2))
    assert a == b and sorted(a) == ["first", "second"]


def test_parse_results(spark):
    lines = spark.createDataFrame([("[17] src/a directory/file.rs",), ("[0] x",), ("noise",), ("[20] src/a directory/file.rs",)], "line string")
    assert [(r.position, r.document_id) for r in retrieval.parse_results(lines).collect()] == [(17, "src/a directory/file.rs")]


def test_fetch_and_enrich(spark):
    docs = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, x int")
    assert [r.document_id for r in retrieval.ordered_fetch(docs, ["b", "none", "a"]).orderBy("position").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="no document"):
        retrieval.enrich(ranked(spark, ("c", 1.0)), docs).collect()


# -- evaluation


def test_perfect_ranking_scores_one(spark):
    grades = spark.createDataFrame([("q", "best", 3), ("q", "okay", 1), ("none", "best", 1)], "query_id string, document_id string, grade int")
    m = {r.query_id: r for r in evaluation.per_query(ranked(spark, ("best", 2.0), ("okay", 1.0)), grades).collect()}
    assert (m["q"].ndcg, m["q"].recall, m["q"].reciprocal_rank) == (1, 1, 1)
    assert (m["none"].ndcg, m["none"].recall, m["none"].reciprocal_rank) == (0, 0, 0)
    whole = evaluation.macro(spark.createDataFrame(list(m.values()))).head()
    assert whole.ndcg == 0.5 and whole.queries == 2


def test_nearest_rank(spark):
    df = spark.createDataFrame([(x,) for x in (40, 10, 30, 20)], "ms int")
    assert [evaluation.nearest_rank(df, "ms", p).head().ms for p in (50, 95, 1, 100)] == [20, 40, 10, 40]
    with pytest.raises(ValueError):
        evaluation.nearest_rank(df, "ms", 0)


def test_parity():
    assert evaluation.parity(0.50, 0.48) and not evaluation.parity(0.50, 0.479) and not evaluation.parity(0.5, float("nan"))


def test_judgments_are_validated(spark):
    docs = spark.createDataFrame([("d",)], "document_id string")

    def check(queries, grades, least=1):
        evaluation.validate_judgments(spark.createDataFrame(queries, "query_id string, text string"), spark.createDataFrame(grades, "query_id string, document_id string, grade int"), docs, least)

    check([("q", "t")], [("q", "d", 1)])
    for queries, grades, least in [([("q", "t")], [("q", "d", 1)], 2), ([("q", " ")], [("q", "d", 1)], 1), ([("q", "t"), ("p", "t")], [("q", "d", 1), ("p", "d", 1)], 1), ([("q", "t")], [("q", "d", 0)], 1), ([("q", "t")], [("q", "x", 1)], 1)]:
        with pytest.raises(CorpusError):
            check(queries, grades, least)


def test_one_repository_per_query(spark):
    schema = "query_id string, document_id string, grade int"
    one = spark.createDataFrame([("q", "k8s:a/b", 1), ("q", "k8s:c", 1)], schema)
    assert evaluation.repository_of(one).head().repository == "k8s"
    with pytest.raises(Exception, match="several repositories"):
        evaluation.repository_of(one.unionByName(spark.createDataFrame([("q", "x:a", 1)], schema))).collect()


# -- increments, requests


def test_delta(spark):
    now = spark.createDataFrame([("same", "1", None), ("changed", "2", None), ("new", "3", None), ("big", "4", "oversized"), ("skip", "5", "binary")], "path string, content_hash string, skip_reason string")
    old = spark.createDataFrame([("same", "1", ["s"]), ("changed", "0", ["c1", "c2"]), ("gone", "9", ["g"]), ("big", "4", ["b"])], "path string, content_hash string, document_ids array<string>")
    delta = incremental.plan_delta(now, old)
    assert {r.path: r.status for r in delta.collect()} == {"same": "unchanged", "changed": "changed", "new": "new", "big": "filtered", "skip": "skipped", "gone": "removed"}
    assert sorted(r.document_id for r in incremental.stale_ids(delta).collect()) == ["b", "c1", "c2", "g"]


def test_corrupt_cache_is_an_error(spark):
    docs = spark.createDataFrame([("a", "x")], "document_id string, content string")
    key = incremental.cache_hits(docs, spark.createDataFrame([], "cache_key string, embedding array<float>"), 8).head()
    assert key.embedding is None
    cache = spark.createDataFrame([(key.cache_key, [1.0] * 7)], "cache_key string, embedding array<float>")
    with pytest.raises(Exception, match="corrupt cache"):
        incremental.cache_hits(docs, cache, 8).collect()
    new = spark.createDataFrame([(key.cache_key, [2.0] * 7), ("n", [1.0]), ("n", [1.0])], "cache_key string, embedding array<float>")
    assert [r.cache_key for r in incremental.cache_conflicts(cache, new).collect()] == [key.cache_key]
    assert [r.cache_key for r in incremental.cache_append(cache, new).collect()] == ["n"]


def test_generations_to_remove():
    names = ["gen-300-3", "gen-200-2", "gen-100-1", "other"]
    assert incremental.generations_to_remove(names, "gen-300-3", 3) == ["gen-100-1"]
    assert incremental.generations_to_remove(names, "gen-300-3", 2) == ["gen-200-2", "gen-100-1"]
    assert incremental.generations_to_remove(names, None, 2) == []
    with pytest.raises(ValueError):
        incremental.generations_to_remove(names, "gen-300-3", 1)


def test_requests_and_retries():
    assert requests.pack_texts([5, 5, 20, 1, 1, 1], 2, 10) == [0, 0, 1, 2, 2, 3]
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise IndexFailure("remote", "busy", "try again", retry=0.5)
        return "done"

    assert requests.Retry(sleep=waits.append, clock=lambda: 0.0, seed=1).run(flaky) == "done" and len(waits) == 2
    with pytest.raises(IndexFailure):
        requests.Retry(sleep=waits.append).run(lambda: (_ for _ in ()).throw(IndexFailure("remote", "bad", "no", retry="never")))
    with pytest.raises(ValueError):
        requests.Retry(attempts=11)


def test_dense_takes_more_queries_than_one_block(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", [float(i % 7), float(i % 5), 1.0]) for i in range(40)], "document_id string, embedding array<float>")
    queries = spark.createDataFrame([(f"q{i}", [float(i % 3), 1.0, float(i)]) for i in range(23)], "query_id string, embedding array<float>")
    whole = sorted(retrieval.dense(docs, queries, 4).collect())
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 5)
    assert sorted(retrieval.dense(docs, queries, 4).collect()) == whole and len(whole) == 23 * 4
