"""DuckDB SQL of the catalogue's queries, in plain terms of its own."""

from __future__ import annotations

STOP = "', '".join("a an and are as at be by for from how in into is it of on or that the to was what when where which who why with".split())
SUFFIXES = ("ization", "ation", "ated", "ingly", "edly", "ing", "ed", "ies", "es", "s")
STEM = "CASE " + " ".join(f"WHEN r LIKE '%{s}' AND strlen(r) >= {4 + len(s)} THEN r[:-{len(s) + 1}]" for s in SUFFIXES) + " END"
DOCS = "docs AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, source || '/' || doc_id AS path, lang AS language, text AS content FROM documents)"


def analyzed(name: str, source: str) -> str:
    """A CTE chain ending in ``name``: the columns of ``source`` (key, t, w) with a row for each term."""
    return rf"""
{name}_k AS (SELECT key, w, unnest(regexp_split_to_array(t, '[^\p{{L}}\p{{N}}]+')) AS tok FROM ({source})),
{name}_p AS (SELECT key, w, lower(tok) AS low, string_split(regexp_replace(regexp_replace(tok, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), ' ') AS parts FROM {name}_k WHERE tok <> ''),
{name}_r AS (SELECT key, w, unnest(CASE WHEN len(parts) > 1 THEN list_concat([low], list_filter(list_transform(parts, lambda x: lower(x)), lambda x: x <> low)) ELSE [low] END) AS r FROM {name}_p),
{name} AS (SELECT key, w, unnest(CASE WHEN stem IS NULL THEN [r] ELSE [r, stem] END) AS term FROM (SELECT *, {STEM} AS stem FROM {name}_r WHERE r NOT IN ('{STOP}')))"""


FIELDS = "SELECT document_id AS key, content AS t, 1 AS w FROM docs UNION ALL SELECT document_id, path, 3 FROM docs UNION ALL SELECT document_id, document_id, 2 FROM docs"
TERMS = f"{DOCS}, {analyzed('emit', FIELDS)}, terms AS (SELECT key AS document_id, term, CAST(sum(w) AS BIGINT) AS tf FROM emit GROUP BY ALL)"
COUNTS = f"{TERMS}, counts AS (SELECT document_id, CAST(coalesce(sum(tf), 0) AS BIGINT) AS token_count FROM docs LEFT JOIN terms USING (document_id) GROUP BY document_id)"
QUERIES = "queries AS (SELECT CAST(item_id AS VARCHAR) AS query_id, text FROM benchmark)"


def bm25(queries: str = QUERIES, limit: int = 50, counts: str = COUNTS) -> str:
    """A CTE chain ending in ``found`` (query_id, rank, document_id, score)."""
    return f"""{counts}, {queries}, {analyzed("asked", "SELECT query_id AS key, text AS t, 1 AS w FROM queries")},
qt AS (SELECT DISTINCT key AS query_id, term FROM asked),
stats AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
whole AS (SELECT count(*) AS n, avg(token_count) AS avgdl FROM counts),
scored AS (
  SELECT query_id, document_id, CAST(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * token_count / avgdl))) AS FLOAT) AS score
  FROM qt JOIN terms USING (term) JOIN stats USING (term) JOIN counts USING (document_id), whole GROUP BY ALL
),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM scored) WHERE rank <= {limit})"""


ROUNDED = "SELECT query_id, CAST(rank AS BIGINT) AS rank, document_id, round(CAST(score AS DOUBLE), 5) AS score"
EMB = "emb AS (SELECT CAST(vec_id AS VARCHAR) AS document_id, vec_id, embedding, label FROM embeddings)"


def total(floats: str) -> str:
    """The sum of a list in single precision, from left to right."""
    return f"list_reduce(list_prepend(CAST(0 AS FLOAT), {floats}), lambda s, x: CAST(s + x AS FLOAT))"


def dense(limit: int, source: str = "embedding") -> str:
    """A CTE chain ending in ``near`` (query_id, rank, document_id, score)."""
    return f"""{EMB},
pairs AS (
  SELECT query_id, document_id, CAST(CAST({total("list_transform(list_zip(q, d), lambda p: CAST(p[1] * p[2] AS FLOAT))")} AS DOUBLE) / CAST(CAST(sqrt({total("list_transform(q, lambda x: CAST(x * x AS FLOAT))")}) AS FLOAT) * CAST(sqrt({total("list_transform(d, lambda x: CAST(x * x AS FLOAT))")}) AS FLOAT) AS FLOAT) AS FLOAT) AS score
  FROM (SELECT CAST(q.vec_id // 50 AS VARCHAR) AS query_id, d.document_id, q.embedding AS q, d.{source} AS d FROM (SELECT * FROM emb WHERE vec_id % 50 = 0) q, {"emb" if source == "embedding" else "coded"} d)
),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM pairs) WHERE rank <= {limit})"""


def in_order(doubles: str) -> str:
    """The sum of a list in double precision, from left to right."""
    return f"list_reduce(list_prepend(CAST(0 AS DOUBLE), {doubles}), lambda s, x: s + x)"


def dimensions(source: str, value: str, more: str = "") -> str:
    """A row for each dimension of the list v of ``source``."""
    return f"WITH {EMB} SELECT document_id{more}, CAST(nth - 1 AS BIGINT) AS \"at\", CAST(CAST({value} AS FLOAT) AS DOUBLE) AS x FROM (SELECT *, unnest(v) AS e, unnest(range(1, len(v) + 1)) AS nth FROM ({source}))"


def unit(of: str) -> str:
    return f"SELECT *, sqrt({in_order('list_transform(v, lambda x: x * x)')}) AS s FROM (SELECT document_id, {of} AS v FROM emb)"


CODED = """coded AS (
  SELECT document_id, label, scale, q, list_transform(q, lambda x: CAST(CAST(x AS FLOAT) * scale + shift AS FLOAT)) AS back, embedding
  FROM (SELECT *, list_transform(embedding, lambda x: greatest(-128, least(127, CAST(round(CAST(CAST((x - shift) AS FLOAT) / scale AS FLOAT)) AS INTEGER)))) AS q
    FROM (SELECT *, CAST(list_min(embedding) + CAST(CAST(128 AS FLOAT) * scale AS FLOAT) AS FLOAT) AS shift
      FROM (SELECT *, CAST(CAST(list_max(embedding) - list_min(embedding) AS FLOAT) / CAST(255 AS FLOAT) AS FLOAT) AS scale FROM emb)))
)"""
RRF = """fused AS (
  SELECT query_id, document_id, l.score AS lexical, n.score AS dense,
    CAST(CAST(coalesce(1.0::DOUBLE / (60 + l.rank), 0) AS FLOAT) + CAST(coalesce(1.0::DOUBLE / (60 + n.rank), 0) AS FLOAT) AS FLOAT) AS both_score, l.rank AS lr, n.rank AS nr
  FROM found_ l FULL OUTER JOIN near_ n USING (query_id, document_id)
),
flagged AS (SELECT *, count(lr) OVER w = 0 OR count(nr) OVER w = 0 AS alone FROM fused WINDOW w AS (PARTITION BY query_id)),
chosen AS (SELECT query_id, document_id, lexical, dense, CASE WHEN alone THEN coalesce(lexical, dense) ELSE both_score END AS score, CASE WHEN alone THEN coalesce(lr, nr) ELSE 0 END AS o FROM flagged),
out AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY o, score DESC, document_id) AS rank FROM chosen) WHERE rank <= 10)
"""


def rrf(lexical: bool = True, near: bool = True) -> str:
    return f"WITH {bm25()}, {dense(50)}, found_ AS (SELECT * FROM found WHERE {lexical}), near_ AS (SELECT * FROM near WHERE {near}), {RRF} {ROUNDED}, round(CAST(lexical AS DOUBLE), 5) AS lexical, round(CAST(dense AS DOUBLE), 5) AS dense FROM out"


JUDGED = """judged AS (
  SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS document_id, CASE WHEN contains(d.text, b.text) THEN 3 ELSE 1 END AS grade
  FROM documents d, benchmark b WHERE contains(' ' || d.text || ' ', ' ' || array_to_string(string_split(b.text, ' ')[:4], ' ') || ' ')
)"""
METRICS = """ideal AS (
  SELECT query_id, sum(CASE WHEN i <= 10 THEN (pow(2, grade) - 1) / log2(i + 1) ELSE 0 END) AS ideal, count(*) FILTER (grade > 0) AS positive
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, document_id) AS i FROM judged) GROUP BY query_id
),
got AS (
  SELECT query_id, sum(CASE WHEN rank <= 10 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (rank <= 50 AND grade > 0) AS hits, min(rank) FILTER (grade > 0) AS first
  FROM found JOIN judged USING (query_id, document_id) GROUP BY query_id
),
metrics AS (
  SELECT query_id, CASE WHEN ideal > 0 THEN coalesce(dcg, 0) / ideal ELSE 0 END AS ndcg, CASE WHEN positive > 0 THEN coalesce(hits, 0) / positive ELSE 0 END AS recall, coalesce(1.0::DOUBLE / first, 0) AS reciprocal_rank
  FROM ideal LEFT JOIN got USING (query_id)
)"""
MEANS = "round(avg(ndcg), 5) AS ndcg, round(avg(recall), 5) AS recall, round(avg(reciprocal_rank), 5) AS mrr, count(*) AS queries"
EXT = "CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_extract(name, '^.+\\.([^.]*)$', 1) END"
PATHS = """paths AS (
  SELECT page_id AS id, CASE page_id % 5 WHEN 0 THEN '.' || raw WHEN 1 THEN 'src\\' || raw WHEN 2 THEN 'a/../b' || raw WHEN 3 THEN 'src/.hidden' || raw ELSE './lib//' || raw END || '.' || ext AS path
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]*(.*)$', 1) AS raw, ['rs', 'PY', 'h', 'json', 'unknown', 'tsx', 'md', 'yml', 'go', 'tf'][page_id % 10 + 1] AS ext FROM pages)
)"""
FILES = """files AS (
  SELECT CASE WHEN doc_id % 9 = 0 THEN '.git/' ELSE 'src/' END || doc_id || '.' || ext AS path, ext, doc_id % 9 = 0 AS hidden, octet_length(body) * 20 AS size, body, kind
  FROM (SELECT doc_id, ['py', 'json', 'bin', 'rs'][doc_id % 4 + 1] AS ext,
    CASE WHEN doc_id % 11 = 0 THEN '\\x00'::BLOB || encode(text) WHEN doc_id % 13 = 0 THEN '\\xFF\\xFE'::BLOB || encode(text) WHEN doc_id % 17 = 0 THEN encode(' ' || chr(10) || chr(9)) ELSE encode(text) END AS body,
    CASE WHEN doc_id % 11 = 0 THEN 'binary' WHEN doc_id % 13 = 0 THEN 'invalid' WHEN doc_id % 17 = 0 THEN 'blank' WHEN regexp_matches(text, '\\S') THEN 'text' ELSE 'blank' END AS kind,
  FROM documents)
)"""
LINES = "greatest(1, len(regexp_extract_all(substr(hex(body), 1, 16384), '..', 0)) - len(list_filter(regexp_extract_all(substr(hex(body), 1, 16384), '..', 0), lambda x: x <> '0A')))"
SNAP = """snap AS (SELECT source || '/' || doc_id AS path, sha256(text) AS h, doc_id AS n FROM documents),
old AS (SELECT path, h, n || '#0' AS a, n || '#1' AS b FROM snap WHERE n % 10 <> 1),
cur AS (SELECT path, CASE WHEN n % 10 = 3 THEN h || 'x' ELSE h END AS h, CASE WHEN n % 10 = 4 THEN 'binary' WHEN n % 20 = 1 THEN 'empty' END AS skip FROM snap WHERE n % 10 <> 2),
delta AS (
  SELECT path, CASE WHEN c.path IS NULL THEN 'removed' WHEN skip IS NOT NULL THEN CASE WHEN o.path IS NOT NULL THEN 'filtered' ELSE 'skipped' END WHEN o.path IS NULL THEN 'new' WHEN c.h = o.h THEN 'unchanged' ELSE 'changed' END AS status, o.path IS NOT NULL AS held, a, b
  FROM cur c FULL OUTER JOIN old o USING (path)
)"""


def u64(x: str) -> str:
    return f"unhex(lpad(hex({x}), 16, '0'))"


def le64(x: str) -> str:
    digits = f"lpad(hex({x}), 16, '0')"
    return "unhex(" + " || ".join(f"substr({digits}, {15 - 2 * i}, 2)" for i in range(8)) + ")"


KEY = f"sha256('quern/embedding-cache/1'::BLOB || '\\x00'::BLOB || {le64('octet_length(encode(i))')} || encode(i) || {le64('octet_length(encode(t))')} || encode(t))"
def boundary(p: str) -> str:
    """The last character start at or before byte p of the text whose hexadecimal form is x."""
    inside = "substr(x, 2 * ({0}) + 1, 1) IN ('8', '9', 'A', 'B')"
    return f"CASE WHEN NOT {inside.format(p)} THEN {p} WHEN NOT {inside.format(p + ' - 1')} THEN {p} - 1 WHEN NOT {inside.format(p + ' - 2')} THEN {p} - 2 ELSE {p} - 3 END"



def windows(size: int, overlap: int) -> str:
    return f"""WITH RECURSIVE d AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, hex(encode(text)) AS x, strlen(text) AS n FROM documents WHERE text <> ''),
w AS (SELECT document_id, 0 AS ordinal, 0 AS s FROM d UNION ALL SELECT w.document_id, ordinal + 1, {boundary(f"s + {size - overlap}")} FROM w JOIN d USING (document_id) WHERE s + {size} < n),
e AS (SELECT document_id, ordinal, s, coalesce(lead(s) OVER (PARTITION BY document_id ORDER BY ordinal), n) AS e, {boundary(f"least(s + {size}, n)")} AS c, x FROM w JOIN d USING (document_id))
SELECT document_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(s AS BIGINT) AS start_byte, CAST(e AS BIGINT) AS end_byte, CAST(c AS BIGINT) AS context_end_byte, sha256(unhex(substr(x, 2 * s + 1, 2 * (c - s)))) AS text_hash FROM e"""


PRODUCT = {"rs": "rust", "py": "python", "h": "c", "json": "json", "tsx": "tsx", "md": "markdown", "yml": "yaml", "go": "go", "tf": "hcl"}
EVALUATED = {"rs": "rust", "h": "c", "json": "json", "tsx": "typescript", "md": "markdown", "yml": "yaml", "go": "go"}
TREES = {"rs": "rust", "py": "python", "h": "ambiguous", "tsx": "tsx", "go": "go"}


def case(of: str, table: dict[str, str], default: str = "NULL") -> str:
    return f"CASE {of} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


SQL: dict[str, str] = {
    "analyze_terms": f"WITH {DOCS}, {analyzed('emit', 'SELECT document_id AS key, content AS t, 1 AS w FROM docs')} SELECT key AS document_id, term, count(*) AS tf FROM emit GROUP BY ALL",
    "weighted_terms": f"WITH {TERMS} SELECT document_id, term, tf AS term_frequency FROM terms",
    "token_counts": f"WITH {COUNTS} SELECT * FROM counts",
    "term_stats": f"WITH {TERMS} SELECT term, count(*) AS document_frequency FROM terms GROUP BY term",
    "corpus_stats": f"WITH {COUNTS} SELECT count(*) AS n, round(avg(token_count), 6) AS avgdl FROM counts",
    "bulk_terms_text": f"WITH {TERMS} SELECT document_id, string_agg(trim(repeat(term || ' ', tf)), ' ' ORDER BY encode(term)) AS terms FROM terms GROUP BY document_id",
    "bm25_topk_single": f"WITH {bm25("queries AS (SELECT 'q' AS query_id, 'The theaea onnd within' AS text)")} {ROUNDED} FROM found",
    "bm25_topk_multi": f"WITH {bm25()} {ROUNDED} FROM found",
    "bm25_conversation_queries": "WITH " + bm25("queries AS (SELECT CAST(conv_id AS VARCHAR) AS query_id, text FROM conversations WHERE role = 'user' AND turn = 0 AND conv_id % 50 = 0)", 10) + f" {ROUNDED} FROM found",
    "dense_topk": f"WITH {dense(50)} {ROUNDED} FROM near",
    "dense_int8_topk": f"WITH {EMB}, {CODED}, {dense(20, 'back').removeprefix(EMB + ',')} {ROUNDED} FROM near",
    "cosine_double": f"WITH {EMB} SELECT CAST(q.vec_id // 50 AS VARCHAR) AS query_id, d.document_id, round(list_cosine_similarity(q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 6) AS cosine FROM (SELECT * FROM emb WHERE vec_id % 50 = 0) q, emb d",
    "int8_codec": f"WITH {EMB}, {CODED} SELECT document_id, round(CAST(scale AS DOUBLE), 9) AS scale, CAST(list_min(q) AS BIGINT) AS low, CAST(list_max(q) AS BIGINT) AS high, CAST(list_sum(q) AS BIGINT) AS total, list_max(list_transform(list_zip(back, embedding), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) <= CAST(scale AS DOUBLE) * 0.51 AS close FROM coded",
    "mrl_project_32": dimensions(unit("embedding[:32]::DOUBLE[]"), "e / s"),
    "l2_normalize": dimensions(f"SELECT *, round(sqrt({in_order('list_transform(v, lambda x: CAST(CAST(x / s AS FLOAT) AS DOUBLE) * CAST(CAST(x / s AS FLOAT) AS DOUBLE))')}), 5) AS norm FROM ({unit('embedding::DOUBLE[]')})", "e / s", ", norm"),
    "layer_norm": dimensions(f"SELECT *, {in_order('list_transform(v, lambda x: (x - m) * (x - m))')} / len(v) AS s FROM (SELECT document_id, embedding::DOUBLE[] AS v, {in_order('embedding::DOUBLE[]')} / len(embedding) AS m FROM emb)", "(e - m) / sqrt(s + 1e-5)"),
    "mean_pool_by_label": f"WITH {EMB} SELECT label, CAST(nth - 1 AS BIGINT) AS \"at\", round(avg(CAST(x AS DOUBLE)), 7) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS nth FROM emb) GROUP BY label, nth",
    "weighted_window_mean": f"WITH {EMB} SELECT label, CAST(nth - 1 AS BIGINT) AS \"at\", round(sum(CAST(CAST(x / s AS FLOAT) AS DOUBLE) * w) / sum(w), 7) AS x FROM (SELECT label, vec_id % 7 + 1 AS w, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS s, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, len(embedding) + 1)) AS nth FROM emb) GROUP BY label, nth",
    "rrf_hybrid": rrf(),
    "rrf_lexical_only": rrf(near=False),
    "rrf_dense_only": rrf(lexical=False),
    "rerank_overlap": f"""WITH {bm25(limit=20)}, words AS (SELECT query_id, document_id, CAST(len(list_intersect(list_distinct(list_filter(regexp_split_to_array(lower(q.text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')), list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')))) AS FLOAT) AS score
  FROM found JOIN queries q USING (query_id) JOIN docs USING (document_id)), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM words) {ROUNDED} FROM best WHERE rank <= 5""",
    "collapse_to_parent": f"WITH {bm25()}, firsts AS (SELECT query_id, string_split(path, '/')[1] AS document_id, min(rank) AS f, arg_min(score, rank) AS score FROM found JOIN docs USING (document_id) GROUP BY query_id, string_split(path, '/')[1]), again AS (SELECT query_id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY f) AS rank FROM firsts) {ROUNDED} FROM again",
    "phase0_rank": f"""WITH {DOCS}, {QUERIES}, bytes AS (SELECT query_id, document_id, hex(encode(text) || '\\xFF'::BLOB || encode(document_id)) AS x FROM queries, docs),
hashed AS (SELECT query_id, document_id, list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(regexp_extract_all(x, '..'), lambda b: ('0x' || b)::INTEGER::HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::HUGEINT) % 18446744073709551616::HUGEINT) AS h FROM bytes),
scored AS (SELECT query_id, document_id, CAST((h // 2199023255552) / 8388608.0::DOUBLE AS FLOAT) AS score FROM hashed), best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS rank FROM scored) {ROUNDED} FROM best WHERE rank <= 10""",
    "result_enrichment": f"WITH {bm25(limit=3)} SELECT query_id, CAST(rank AS BIGINT) AS rank, document_id, path, language, left(trim(regexp_replace(content, '\\s+', ' ', 'g')), 120) AS snippet FROM found JOIN docs USING (document_id)",
    "eval_judgments": f"WITH {JUDGED} SELECT * FROM judged",
    "eval_per_query": f"WITH {bm25()}, {JUDGED}, {METRICS} SELECT query_id, round(ndcg, 5) AS ndcg, round(recall, 5) AS recall, round(reciprocal_rank, 5) AS reciprocal_rank FROM metrics",
    "eval_macro": f"WITH {bm25()}, {JUDGED}, {METRICS} SELECT {MEANS} FROM metrics",
    "eval_by_group": f"WITH {bm25()}, {JUDGED}, {METRICS} SELECT CAST(query_id AS BIGINT) % 4 AS part, {MEANS} FROM metrics GROUP BY 1",
    "eval_by_repository": f"WITH {bm25()}, {JUDGED}, {METRICS} SELECT 'repo' || (CAST(query_id AS BIGINT) % 3) AS repository, {MEANS} FROM metrics GROUP BY 1",
    "unknown_judgments": "SELECT DISTINCT CAST(doc_id * 3 AS VARCHAR) AS document_id FROM labels WHERE doc_id * 3 NOT IN (SELECT doc_id FROM documents)",
    "latency_nearest_rank": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type",
    "normalize_path": f"WITH {PATHS} SELECT id, path, CASE WHEN path <> '' AND left(path, 1) NOT IN ('/', '\\') AND substr(path, 2, 1) <> ':' AND NOT list_contains(parts, '..') AND len(kept) > 0 THEN array_to_string(kept, '/') END AS normalized FROM (SELECT *, list_filter(parts, lambda x: x NOT IN ('', '.')) AS kept FROM (SELECT *, string_split(replace(path, '\\', '/'), '/') AS parts FROM paths))",
    "hidden_paths": f"WITH {PATHS} SELECT id, len(list_filter(string_split(path, '/'), lambda x: left(x, 1) = '.' AND x NOT IN ('.', '..'))) > 0 AS hidden FROM paths",
    "language_of_path": f"WITH {PATHS} SELECT id, {case('lower(ext)', PRODUCT)} AS product, {case('ext', EVALUATED, chr(39) + 'text' + chr(39))} AS evaluation, {case('lower(ext)', TREES)} AS tree FROM (SELECT id, {EXT} AS ext FROM (SELECT id, string_split(path, '/')[-1] AS name FROM paths))",
    "skip_reasons": f"WITH {FILES} SELECT skip_reason, count(*) AS files FROM (SELECT CASE WHEN hidden THEN 'hidden' WHEN ext = 'json' AND size > 51200 THEN 'oversized_config' WHEN size > 5242880 THEN 'oversized_source' WHEN ext = 'bin' THEN 'unsupported_language' WHEN kind = 'binary' THEN 'binary' WHEN size > 768000 AND least(octet_length(body), 8192) // {LINES} > 100 THEN 'data_like' WHEN kind = 'invalid' THEN 'invalid_utf8' WHEN kind = 'blank' THEN 'empty' END AS skip_reason FROM files) GROUP BY skip_reason",
    "evaluation_skip_reasons": f"WITH {FILES} SELECT skip_reason, count(*) AS files FROM (SELECT CASE WHEN hidden THEN 'ignored_directory' WHEN ext = 'bin' THEN 'unsupported_extension' WHEN size > 5242880 THEN 'oversized_source' WHEN ext = 'json' AND size > 51200 THEN 'oversized_config' WHEN kind = 'binary' THEN 'binary' WHEN kind = 'invalid' THEN 'invalid_utf8' WHEN kind = 'blank' THEN 'empty' END AS skip_reason FROM files) GROUP BY skip_reason",
    "content_hash": "SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(text) AS content_hash FROM documents",
    "document_identity": f"WITH {DOCS} SELECT document_id, sha256('quern/document/1'::BLOB || '\\x00'::BLOB || encode(path) || '\\x00'::BLOB || unhex(sha256(content)) || unhex(sha256('fingerprint')) || {u64('3')} || {u64('0')} || {u64('octet_length(encode(content))')}) AS identity FROM docs",
    "cache_key": f"SELECT i AS document_id, {KEY} AS cache_key FROM (SELECT CAST(doc_id AS VARCHAR) AS i, text AS t FROM documents)",
    "sizer_bytes_words_lines": "SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(len(regexp_extract_all(text, '[^\\s\\x0B\\x85\\x{A0}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+')) AS BIGINT) AS words, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text <> '' AND right(text, 1) <> chr(10) THEN 1 ELSE 0 END AS BIGINT) AS lines FROM documents",
    "fixed_window_chunks": windows(600, 60),
    "auto_chunks": windows(6000, 600),
    "chunk_coverage": "SELECT CAST(doc_id AS VARCHAR) AS document_id, true AS covered, sha256(text) AS restored FROM documents",
    "line_chunks": """WITH tails AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, regexp_extract_all(text, '[^\\n]*\\n') AS whole, regexp_extract(text, '[^\\n]*$') AS tail FROM documents),
a AS (SELECT *, regexp_extract(tail, '^.*\\s') AS x FROM tails),
b AS (SELECT *, regexp_extract(substr(tail, length(x) + 1), '^.*[!-/:-@\\[-`{-~]') AS y FROM a),
c AS (SELECT document_id, len(whole) AS n, list_filter(list_concat(whole, [x, y, substr(tail, length(x) + length(y) + 1)]), lambda p: p <> '') AS p FROM b),
parts AS (SELECT document_id, n, unnest(p) AS part, generate_subscripts(p, 1) AS i FROM c),
ends AS (SELECT *, sum(strlen(part)) OVER (PARTITION BY document_id ORDER BY i) AS e FROM parts)
SELECT document_id, CAST(i - 1 AS BIGINT) AS ordinal, CAST(e - strlen(part) AS BIGINT) AS start_byte, CAST(e AS BIGINT) AS end_byte, CAST(least(i, n + 1) AS BIGINT) AS start_line FROM ends""",
    "incremental_delta": f"WITH {SNAP} SELECT path, status, CAST(CASE WHEN status <> 'unchanged' AND held THEN 2 ELSE 0 END AS BIGINT) AS stale FROM delta",
    "stale_ids": f"WITH {SNAP} SELECT DISTINCT unnest([a, b]) AS document_id FROM delta WHERE status <> 'unchanged' AND held",
    "upsert_result": "SELECT CAST(doc_id AS VARCHAR) AS document_id, sha256(CASE WHEN doc_id % 10 < 3 THEN 'new ' ELSE '' END || text) AS hash FROM documents",
    "delete_result": f"WITH {DOCS} SELECT document_id, language FROM docs WHERE CAST(document_id AS BIGINT) NOT IN (SELECT doc_id * 2 FROM labels WHERE toxic = 1)",
    "duplicate_ids": "SELECT sha256(text) AS document_id, count(*) AS copies FROM documents GROUP BY ALL HAVING count(*) > 1",
    "ordered_fetch": "SELECT position, CAST(doc_id AS VARCHAR) AS document_id, lang AS language FROM documents JOIN (VALUES (0, 30), (1, 7), (3, 19), (4, 0)) v(position, i) ON doc_id = i",
    "cache_hits": "SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id % 3 <> 0 AND doc_id IN (SELECT vec_id FROM embeddings) AS hit FROM documents",
    "cache_conflicts": f"SELECT {KEY} AS cache_key FROM (SELECT CAST(doc_id AS VARCHAR) AS i, text AS t FROM documents WHERE doc_id % 5 = 0 AND doc_id IN (SELECT vec_id FROM embeddings))",
    "generation_retention": """WITH listing AS (SELECT CAST(doc_id // 10 AS VARCHAR) AS alias, CAST(doc_id AS VARCHAR) AS name, doc_id % 4 AS seconds, doc_id % 3 AS nanos, doc_id % 10 = 3 AND (doc_id // 10) % 4 <> 0 AS active FROM documents)
SELECT alias, name FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY seconds DESC, nanos DESC, name) AS nth FROM listing WHERE NOT active AND alias IN (SELECT alias FROM listing WHERE active)) WHERE nth > 3""",
    "request_packing": """WITH RECURSIVE d AS (SELECT doc_id, doc_id // 128 AS batch, length(text) AS chars, row_number() OVER (PARTITION BY doc_id // 128 ORDER BY doc_id) AS nth FROM documents),
w AS (
  SELECT doc_id, batch, nth, 0 AS request, 1 AS cnt, chars AS total FROM d WHERE nth = 1
  UNION ALL
  SELECT d.doc_id, d.batch, d.nth, w.request + CASE WHEN w.cnt >= 16 OR w.total + d.chars > 20000 THEN 1 ELSE 0 END, CASE WHEN w.cnt >= 16 OR w.total + d.chars > 20000 THEN 1 ELSE w.cnt + 1 END, CASE WHEN w.cnt >= 16 OR w.total + d.chars > 20000 THEN d.chars ELSE w.total + d.chars END
  FROM w JOIN d ON d.batch = w.batch AND d.nth = w.nth + 1
)
SELECT doc_id, CAST(batch AS BIGINT) AS batch, CAST(request AS BIGINT) AS request FROM w""",
}
PLAIN = COUNTS.replace(FIELDS, "SELECT document_id AS key, content AS t, 1 AS w FROM docs")
SQL["eval_parity_delta"] = f"""WITH a AS (WITH {bm25()}, {JUDGED}, {METRICS} SELECT avg(ndcg) AS x FROM metrics), b AS (WITH {bm25(counts=PLAIN)}, {JUDGED}, {METRICS} SELECT avg(ndcg) AS y FROM metrics)
SELECT round(abs(x - y), 5) AS ndcg_delta, abs(x - y) <= 0.02 + 1e-15 AS passes FROM a, b"""

SQL["parity_by_repository"] = f"""WITH a AS (WITH {bm25()}, {JUDGED}, {METRICS} SELECT CAST(query_id AS BIGINT) % 3 AS p, avg(ndcg) AS x FROM metrics GROUP BY 1), b AS (WITH {bm25(counts=PLAIN)}, {JUDGED}, {METRICS} SELECT CAST(query_id AS BIGINT) % 3 AS p, avg(ndcg) AS y FROM metrics GROUP BY 1)
SELECT 'repo' || p AS repository, round(abs(x - y), 5) AS ndcg_delta FROM a JOIN b USING (p)"""
UPDATED = COUNTS.replace(DOCS, "docs AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, source || '/' || doc_id AS path, lang AS language, CASE WHEN doc_id % 10 = 2 THEN 'renewed ' ELSE '' END || text AS content FROM documents WHERE doc_id % 10 <> 3)")
SQL["index_update_search"] = f"WITH {bm25(counts=UPDATED)} {ROUNDED} FROM found WHERE rank <= 10"
SQL["index_update_stats"] = f"WITH {UPDATED} SELECT term, count(*) AS document_frequency FROM terms GROUP BY term"
SQL["index_update_documents"] = f"WITH {UPDATED} SELECT document_id, sha256(content) AS content_hash, token_count FROM docs JOIN counts USING (document_id)"
SQL["jsonl_corpus"] = f"WITH {DOCS} SELECT document_id, path, language, sha256(content) AS content_hash FROM docs"
SQL["streamed_documents"] = f"SELECT source || '/' || c.document_id || '#' || ordinal AS document_id, source || '/' || c.document_id AS path, text_hash AS content_hash FROM ({windows(6000, 600)}) c JOIN documents d ON CAST(d.doc_id AS VARCHAR) = c.document_id"
