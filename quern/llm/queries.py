"""Queries of the corpus operators and, where SQL can express them, their DuckDB text."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, htmltext, langid, ordermh, packing, pii, rollup, secrets, sharding, simhash
from quern.llm.common import discard, materialize, shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint, links and component of every row; null and empty texts have fingerprint zero."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row against its edited text and the next document; a null text is an empty one."""
    return ordermh.compare_with_next(_table(spark, sf_dir, "documents"))


def _maintained(docs: DataFrame, tokenizers: tuple[str, ...]) -> DataFrame:
    """Totals after all documents came in, copies of a text went, and words with digits were scrubbed.

    Every row counts as a document; of the rows with one text (null is a text of its
    own) the one of the least doc_id stays, those without one last, and of repeated
    rows one.  Copies are folded before they are counted as events.  Deletes and
    revisions are replayed, which must change nothing.
    """
    spark = docs.sparkSession
    h = F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b""))
    docs = docs.select("doc_id", F.col("source").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string"), h.alias("h"))
    with_bpe = "byte_bpe_50k" in tokenizers
    names = [("words", "words", "words_kept")] + [("byte_bpe_50k", "bpe", "bpe_kept")] * with_bpe
    counts = rollup.copies(rollup.count_tokens(docs, "text", packing.byte_bpe_path() if with_bpe else None), "h")
    counts = materialize(counts.drop("h"), "token-counts")
    each = F.explode(F.array(*[F.struct(F.lit(f"{n}-v1").alias("tokenizer"), F.col(a).alias("before"), F.col(b).alias("after")) for n, a, b in names])).alias("t")
    every = counts.select("n", "n_copies", "source", "lang", each).select("n", "n_copies", "source", "lang", "t.*")
    totals = rollup.TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}")

    def events(op: str, times: Column, tokens: str, *more: Column) -> DataFrame:
        return every.select(F.lit(op).alias("op"), "source", "lang", "tokenizer", F.col(tokens).alias("n_tokens"), times.alias("times"), *more)

    n, n_copies = F.col("n"), F.col("n_copies")
    batches = {
        "insert": events("insert", n, "before"),
        "copies": events("delete", n_copies, "before"),
        "scrub": events("revise", n - n_copies, "after", F.col("before").alias("old_tokens")),
    }
    for name in ("insert", "copies", "copies", "scrub", "insert", "scrub"):
        totals.commit(name, batches[name], times="times")
    discard(counts)
    return totals.totals()


def op3_delta_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, lang and tokenizer; nulls are keys of their own, repeated rows are copies."""
    return _maintained(_table(spark, sf_dir, "documents"), ("words", "byte_bpe_50k"))


def word_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3 with the one tokenizer that SQL can express."""
    return _maintained(_table(spark, sf_dir, "documents"), ("words",))


def op4_kneser_ney_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every row; null texts and texts without a letter are ``und``; a null id is not held out, and not learned from."""
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out("doc_id") & F.col("doc_id").isNotNull()))
    return langid.identify(docs, model).withColumn("held_out", langid.held_out("doc_id"))


def _digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Counts and digest of the base kinds, and all spans, from (doc_id, spans)."""
    base = found.withColumn("__base", F.filter("spans", lambda s: s["kind"].isin(*kinds)))

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [of(k) for k in kinds]
    return base.select("doc_id", *counts, F.sha2(pii.joined("__base"), 256).alias("base_sha256"), pii.joined("spans").alias("spans"))


def op5_anchor_expansion_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every row; a null text is an empty one."""
    return _digest(pii.scan(_table(spark, sf_dir, "documents")), pii.BASE)


def pii_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op5 SQL can express: the base kinds' counts and digest."""
    return op5_anchor_expansion_pii(spark, sf_dir).drop("spans")


def op6_karmarkar_karp_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; null and empty texts are one group."""
    placed = sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op7_bounded_space_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every row; a null text is an empty one and gives the end id alone."""
    return packing.pack(_table(spark, sf_dir, "documents"), packing.byte_bpe_path(), keep_ids=False).drop("ids")


def op8_layout_aware_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible text of every page; a null page has a null text."""
    return htmltext.extract(_table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))


def op9_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every row; a null text has no words."""
    found = decontaminate.hits(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda acc, r: acc + r["end"] - r["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


def op10_randomness_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every row; a null text is an empty one."""
    return _digest(secrets.scan(_table(spark, sf_dir, "documents")), secrets.BASE)


def secret_base_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of op10 SQL can express: the base kinds' counts and digest."""
    return op10_randomness_secret_scan(spark, sf_dir).drop("spans")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_order_minhash": op2_order_minhash,
    "op3_delta_token_rollups": op3_delta_token_rollups,
    "word_rollups": word_rollups,
    "op4_kneser_ney_language_id": op4_kneser_ney_language_id,
    "op5_anchor_expansion_pii": op5_anchor_expansion_pii,
    "pii_base_spans": pii_base_spans,
    "op6_karmarkar_karp_sharding": op6_karmarkar_karp_sharding,
    "op7_bounded_space_packing": op7_bounded_space_packing,
    "op8_layout_aware_html": op8_layout_aware_html,
    "op9_winnowing_decontamination": op9_winnowing_decontamination,
    "op10_randomness_secret_scan": op10_randomness_secret_scan,
    "secret_base_spans": secret_base_spans,
}

_WORDS_SQL = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_DIGITS_SQL = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN_SQL = f"list_sum(list_transform(string_split(reverse({_DIGITS_SQL}), ''), lambda x, i: CASE WHEN i % 2 = 1 THEN CAST(x AS INT) WHEN CAST(x AS INT) > 4 THEN 2 * CAST(x AS INT) - 9 ELSE 2 * CAST(x AS INT) END)) % 10 = 0"
_ASSIGN_SQL = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, and which matches m count.
_PII_SQL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: NOT coalesce(try_cast(x AS HUGEINT) <= 255, false))) = 0"),
    ("card", r"[0-9]([\x20-]?[0-9])+", f"length({_DIGITS_SQL}) BETWEEN 16 AND 19 AND {_LUHN_SQL}"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS_SQL}) BETWEEN 8 AND 15"),
)
_SECRETS_SQL = (
    ("assign", _ASSIGN_SQL, f"length(regexp_extract(m, '{_ASSIGN_SQL}', 2)) >= 6"),
    ("access", "AKIA[A-Z0-9]+", "length(m) >= 20"),
    ("hex", "[0-9a-f]+", "length(m) >= 24"),
)


def _spans_sql(kinds: tuple[tuple[str, str, str], ...], order: str) -> str:
    """Counts and digest of leftmost matches; a match starts after all that was split off and matched before."""
    found = " UNION ALL ".join(
        f"SELECT r, {k} AS k, '{name}' AS kind, i, m, p, {keep} AS kept FROM (SELECT r, unnest(ms) AS m, unnest(ps[:len(ms)]) AS p, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT r, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS ps FROM d) WHERE len(ms) > 0)"
        for k, (name, pattern, keep) in enumerate(kinds)
    )
    counts = ", ".join(f"CAST(count(*) FILTER (kind = '{name}') AS BIGINT) AS n_{name}" for name, _, _ in kinds)
    names = ", ".join(f"coalesce(n_{name}, 0) AS n_{name}" for name, _, _ in kinds)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
f AS ({found}),
s AS (SELECT r, k, kind, kept, sum(length(p)) OVER w + sum(length(m)) OVER w - length(m) AS a, length(m) AS n FROM f WINDOW w AS (PARTITION BY r, k ORDER BY i)),
g AS (SELECT r, {counts}, string_agg(kind || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY {order}) AS digest FROM s WHERE kept GROUP BY r)
SELECT doc_id, {names}, sha256(coalesce(digest, '')) AS base_sha256 FROM d LEFT JOIN g USING (r)
"""


ORACLE_SQL: dict[str, str] = {
    "pii_base_spans": _spans_sql(_PII_SQL, "k, a"),
    "secret_base_spans": _spans_sql(_SECRETS_SQL, "a, k"),
    "word_rollups": r"""
SELECT source, lang, 'words-v1' AS tokenizer, count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_tokens
FROM (
  SELECT source, lang, row_number() OVER (PARTITION BY text ORDER BY doc_id, source, lang) AS nth,
    len(list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda w: NOT regexp_matches(w, '[0-9]'))) AS n
  FROM documents
)
WHERE nth = 1
GROUP BY source, lang
""",
    "op9_winnowing_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS_SQL.format("text")}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS_SQL.format("text")} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)
),
dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
),
h AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
p AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (r) LEFT JOIN t USING (r)
""",
}
