"""Ranked retrieval for many queries at once: BM25, dense, fusion, rerank, collapse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text, vectors
from quern.operators import blockwise
from quern.operators.common import broadcast_if_small, require, top_k
from quern.operators.indexing import corpus_stats, term_stats

RRF_K = 60
MAX_RANK = 65_535


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): each query's distinct terms; a query of stop words has none."""
    return text.analyze(queries, F.col("text"), "query_id").distinct()


#: Distinct terms of queries that are kept by workers, so that others aren't stored.
MOST_TERMS = 1_000_000


def asked_terms(queries: DataFrame) -> frozenset[str] | None:
    """The distinct terms of all queries; None if there are too many of them to send about."""
    found = query_terms(queries).select("term").distinct().limit(MOST_TERMS + 1).toArrow().column("term")
    return frozenset(found.to_pylist()) if len(found) <= MOST_TERMS else None


def bm25(docs: DataFrame, terms: DataFrame, queries: DataFrame, limit: int, stats: DataFrame | None = None) -> DataFrame:
    """(query_id, rank, document_id, score) by BM25 with k1 = 1.2 and b = 0.75.

    ``docs`` has document_id and token_count.  A query counts as a set of terms.
    The sum is taken in double and rounded to float before the order is settled;
    ties go to the least document_id.  Postings are cut to the queries' terms and put
    together by document before anything is scored.  ``stats`` (term,
    document_frequency) are taken if they are stored, else counted from the postings.
    """
    wanted = query_terms(queries)
    mine = broadcast_if_small(wanted.select("term").distinct())
    held = terms.join(mine, "term").groupBy("document_id").agg(F.collect_list("term").alias("terms"), F.collect_list("term_frequency").alias("frequencies"))
    held = docs.select("document_id", "token_count").join(held, "document_id")
    stats = term_stats(terms.join(mine, "term")) if stats is None else stats.join(mine, "term")
    return _bm25(held, wanted, stats, corpus_stats(docs), limit)


def bm25_profiles(profiles: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """``bm25`` over stored (document_id, token_count, terms, frequencies): no posting is shuffled."""
    wanted = query_terms(queries)
    mine = broadcast_if_small(wanted.select("term").distinct())
    stats = term_stats(profiles.select(F.explode("terms").alias("term")).join(mine, "term"))
    return _bm25(profiles, wanted, stats, corpus_stats(profiles), limit)


def _bm25(held: DataFrame, wanted: DataFrame, stats: DataFrame, whole: DataFrame, limit: int) -> DataFrame:
    """Rows of (document_id, token_count, terms, frequencies) scored by blocks of queries."""
    kind, size = wanted.schema["query_id"].dataType.simpleString(), whole.first()
    frequency = stats.select("term", "document_frequency")

    def block(part: DataFrame) -> DataFrame:
        asked = [(r.query_id, r.terms) for r in part.collect()]
        words = part.select(F.explode("terms").alias("term")).distinct()
        df = {r.term: r.document_frequency for r in frequency.join(F.broadcast(words), "term").collect()}
        return blockwise.bm25_best(held, asked, kind, df, size.n, size.avgdl, limit)

    by_query = wanted.groupBy("query_id").agg(F.collect_list("term").alias("terms"))
    return blockwise.in_blocks(by_query, QUERY_BLOCK, block)


def dense(docs: DataFrame, queries: DataFrame, limit: int, quantized: bool = False) -> DataFrame:
    """(query_id, rank, document_id, score) by exact cosine over all stored vectors.

    ``queries`` (query_id, embedding) are broadcast, in blocks of at most
    ``QUERY_BLOCK`` by a hash of query_id, each against all vectors.  With ``quantized`` the documents' emb_i8,
    emb_scale and emb_offset are decoded, else ``embedding`` is read.  Documents
    without a vector are skipped, a wrong length is an error.  Each task keeps only
    its best rows before they are shuffled.
    """
    if quantized:
        held = docs.where("emb_i8 IS NOT NULL").select("document_id", vectors.int8_decode(F.col("emb_i8"), F.col("emb_scale"), F.col("emb_offset")).alias("__d"))
    else:
        held = docs.where("embedding IS NOT NULL").select("document_id", F.col("embedding").cast("array<float>").alias("__d"))
    asked = queries.select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))
    return blockwise.in_blocks(asked, QUERY_BLOCK, lambda block: blockwise.dense_best(held, block, limit))


def cosine_all(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, document_id, cosine) of all documents with all queries, in double precision."""
    asked = queries.select("query_id", F.col("embedding").cast("array<float>").alias("embedding"))
    return blockwise.in_blocks(asked, QUERY_BLOCK, lambda block: blockwise.cosines(docs, block))


#: Query vectors that one broadcast holds.
QUERY_BLOCK = 10_000


def rrf(lexical: DataFrame, dense_: DataFrame, limit: int, k: int = RRF_K) -> DataFrame:
    """Reciprocal-rank fusion of two rankings: (query_id, rank, document_id, score, lexical, dense).

    Whether a query has but one list is settled for each query: then that list passes
    with its own scores and order.
    """

    def share(rank: Column) -> Column:
        # least() passes over nulls, so an absent rank is told apart first
        position = F.least(rank - 1, F.lit(MAX_RANK)).cast("double")
        return F.when(rank.isNull(), F.lit(0.0)).otherwise(F.lit(1.0) / (F.lit(float(k)) + position + 1)).cast("float")

    lex = lexical.select("query_id", "document_id", F.col("rank").alias("__lr"), F.col("score").cast("float").alias("lexical"))
    den = dense_.select("query_id", "document_id", F.col("rank").alias("__dr"), F.col("score").cast("float").alias("dense"))
    both = lex.join(den, ["query_id", "document_id"], "full_outer")
    query = Window.partitionBy("query_id")
    both = both.withColumn("__nl", F.count("__lr").over(query)).withColumn("__nd", F.count("__dr").over(query))
    alone = (F.col("__nl") == 0) | (F.col("__nd") == 0)
    fused = (share(F.col("__lr")) + share(F.col("__dr"))).cast("float")
    score = F.when(alone, F.coalesce("lexical", "dense")).otherwise(fused)
    # a single list keeps its order: its rank decides where its score can't
    order = F.when(alone, F.coalesce("__lr", "__dr")).otherwise(F.lit(0))
    w = query.orderBy(F.col("__order").asc(), F.col("score").desc(), F.col("document_id").asc())
    ranked = both.withColumn("score", score).withColumn("__order", order).withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= limit).select("query_id", "rank", "document_id", "score", "lexical", "dense")


def search(docs: DataFrame, terms: DataFrame, queries: DataFrame, top: int = 10, candidates: int = 50, vectors_of: DataFrame | None = None, quantized: bool = False, stats: DataFrame | None = None) -> DataFrame:
    """Hybrid search: BM25 and, if query vectors are given, dense candidates, fused."""
    if not 0 < top <= candidates:
        raise ValueError("top must lie between 1 and the number of candidates")
    lexical = bm25(docs, terms, queries, candidates, stats)
    if vectors_of is None:
        empty = lexical.limit(0)
        return rrf(lexical, empty, top)
    return rrf(lexical, dense(docs, vectors_of, candidates, quantized), top)


#: Most results and candidates that a search service gives.
MOST_TOP, MOST_CANDIDATES = 50, 1_000


def check_request(query: str, top: int, candidates: int) -> None:
    """A service's bounds: a query that isn't blank, 1 to 50 results out of 1 to 1000 candidates, no fewer than results."""
    if not query.strip():
        raise ValueError("the query is blank")
    if not 1 <= top <= MOST_TOP:
        raise ValueError(f"top must lie between 1 and {MOST_TOP}")
    if not top <= candidates <= MOST_CANDIDATES:
        raise ValueError(f"candidates must lie between top and {MOST_CANDIDATES}")


def enrich(ranked: DataFrame, docs: DataFrame) -> DataFrame:
    """Candidates with their documents' columns; a missing document is an error."""
    held = docs.withColumn("__held", F.lit(True))
    joined = ranked.join(held, "document_id", "left")
    return require(joined, F.col("__held").isNotNull(), F.concat(F.lit("no document "), F.col("document_id"))).drop("__held")


def ordered_fetch(docs: DataFrame, ids: list[str]) -> DataFrame:
    """The documents of ``ids`` in that order as position; missing ones are left out."""
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(i, d) for i, d in enumerate(ids)], "position int, document_id string")
    return F.broadcast(wanted).join(docs, "document_id") if len(ids) <= 100_000 else wanted.join(docs, "document_id")


def rerank(candidates: DataFrame, passages: DataFrame, scorer: Callable[[Column, Column], Column], queries: DataFrame, top: int) -> DataFrame:
    """Replace scores by the scorer's and order anew: (query_id, rank, document_id, score, lexical, dense, late).

    ``scorer`` maps the columns of query text and passage to a float column, an Arrow
    UDF for instance; it sees only the candidates.  A missing passage and a score
    that isn't finite are errors.
    """
    joined = candidates.join(passages.select("document_id", F.col("content").alias("__passage")), "document_id", "left")
    joined = joined.join(broadcast_if_small(queries.select("query_id", F.col("text").alias("__query"))), "query_id")
    joined = require(joined, F.col("__passage").isNotNull(), F.concat(F.lit("no passage for "), F.col("document_id")))
    scored = joined.withColumn("late", scorer(F.col("__query"), F.col("__passage")).cast("float"))
    finite = F.col("late").isNotNull() & ~F.isnan("late") & (F.abs("late") < F.lit(float("inf")))
    scored = require(scored, finite, F.concat(F.lit("score isn't finite for "), F.col("document_id"))).withColumn("score", F.col("late"))
    return top_k(scored.drop("rank"), ["query_id"], "score", "document_id", top).select("query_id", "rank", "document_id", "score", "lexical", "dense", "late")


def shared_terms(query: Column, passage: Column) -> Column:
    """A scorer without a model: how many distinct lower-case words both have."""

    def words(c: Column) -> Column:
        return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))

    return F.size(F.array_intersect(words(query), words(passage))).cast("float")


def collapse(ranked: DataFrame, mapping: DataFrame) -> DataFrame:
    """The best-ranked chunk of each parent, ranked anew: (query_id, rank, document_id, score).

    ``mapping`` is (document_id, parent_id); a candidate that it lacks is an error.
    """
    joined = ranked.join(mapping.select("document_id", "parent_id"), "document_id", "left")
    joined = require(joined, F.col("parent_id").isNotNull(), F.concat(F.lit("no parent of "), F.col("document_id")))
    firsts = joined.groupBy("query_id", "parent_id").agg(F.min("rank").alias("__first"), F.min_by("score", "rank").alias("score"))
    w = Window.partitionBy("query_id").orderBy("__first")
    return firsts.select("query_id", F.row_number().over(w).alias("rank"), F.col("parent_id").alias("document_id"), "score")


def hash_rank(queries: DataFrame, docs: DataFrame, top: int, limit: int) -> DataFrame:
    """A ranking without relevance, stable from run to run: a hash of query and id.  Ids count once."""
    ids = docs.select("document_id").distinct()
    asked = queries.select("query_id", "text")
    return blockwise.in_blocks(asked, QUERY_BLOCK, lambda block: blockwise.hash_best(ids, block, min(top, limit)))


def parse_results(lines: DataFrame, column: str = "line") -> DataFrame:
    """(position, document_id, score) of ``[rank] path`` lines, first of each path; other lines are left out."""
    number = F.try_to_number(F.regexp_extract(column, r"^\[(\d{1,9})\] (.+)$", 1), F.lit("999999999")).cast("int")
    parsed = lines.select(number.alias("position"), F.regexp_extract(column, r"^\[(\d{1,9})\] (.+)$", 2).alias("document_id")).where("position > 0")
    first = parsed.groupBy("document_id").agg(F.min("position").alias("position"))
    return first.select("position", "document_id", (1.0 / F.col("position")).alias("score"))
