"""Command line: chunk, index, search and evaluate."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import snippet
from quern.manifest import Manifest
from quern.operators import chunking, eligibility, evaluation, retrieval
from quern.operators.incremental import stale_ids
from quern.operators.store import Index
from quern.sources import corpora
from quern.streaming.ingest import delta_of, documents_of


def session() -> SparkSession:
    return SparkSession.builder.appName("quern").config("spark.ui.enabled", "false").getOrCreate()


def index_corpus(spark: SparkSession, corpus: str, path: str) -> dict:
    docs = corpora.corpus(spark, corpus).withColumn("embedding", F.lit(None).cast("array<float>"))
    name = Index(spark, path, Manifest()).replace(docs)
    return {"generation": name, "documents": Index(spark, path).document_count()}


def index_folder(spark: SparkSession, root: str, path: str) -> dict:
    """Index a folder's files, only changed ones if the last run's checkpoint fits."""
    index = Index(spark, path, Manifest())
    files = corpora.eligible(corpora.workspace_files(spark, root))
    delta = delta_of(index, files, root).cache()
    changed = files.join(delta.where("status IN ('new', 'changed')").select("path"), "path", "left_semi")
    new = documents_of(changed.select("path", F.col("content").cast("string").alias("content"), "language"))
    counts = {r.status: r["count"] for r in delta.groupBy("status").count().collect()}
    incremental = index.compatible(root)
    stale = stale_ids(delta)
    index.begin()
    name = index.update(new, stale) if incremental else index.replace(new)
    ids = index.documents().groupBy("path").agg(F.collect_list("document_id").alias("document_ids"))
    now = delta.where("status IN ('new', 'changed', 'unchanged')").select("path", "content_hash").join(ids, "path", "left")
    # taken files of which no chunk holds anything
    if empty := now.where("document_ids IS NULL").count():
        counts["empty_chunks"] = empty
    index.finish(root, now.withColumn("document_ids", F.coalesce("document_ids", F.array().cast("array<string>"))))
    delta.unpersist()
    return {"generation": name, "mode": "incremental" if incremental else "full", "files": counts, "documents": index.document_count()}


def search(spark: SparkSession, path: str, query: str, top: int, candidates: int) -> list[dict]:
    retrieval.check_request(query, top, candidates)
    index = Index(spark, path)
    ranked = index.search(spark.createDataFrame([("q", query)], "query_id string, text string"), top, candidates)
    hits = retrieval.enrich(ranked, index.documents()).orderBy("rank")
    return [r.asDict() for r in hits.select("rank", "document_id", "score", "lexical", "dense", "path", "language", snippet(F.col("content")).alias("snippet")).collect()]


def evaluate(spark: SparkSession, path: str, judgments: list[str], least: int) -> dict:
    index = Index(spark, path)
    queries, grades = corpora.judgments(spark, judgments)
    docs: DataFrame = index.documents()
    evaluation.validate_judgments(queries, grades, docs, least)
    ranked = index.search(queries, 50, 50)
    return evaluation.macro(evaluation.per_query(ranked, grades)).head().asDict()


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quern")
    sub = parser.add_subparsers(dest="command", required=True)
    c = sub.add_parser("chunk", help="chunk one file, or standard input with -")
    c.add_argument("file")
    c.add_argument("--language")
    c.add_argument("--max-size", type=int, default=chunking.MAX_WORDS)
    c.add_argument("--sizer", choices=sorted(chunking.SIZERS), default="words")
    i = sub.add_parser("index", help="index a JSONL corpus or a folder")
    i.add_argument("source")
    i.add_argument("index")
    s = sub.add_parser("search")
    s.add_argument("index")
    s.add_argument("query")
    s.add_argument("--top-k", type=int, default=10)
    s.add_argument("--candidates", type=int, default=50)
    e = sub.add_parser("evaluate")
    e.add_argument("index")
    e.add_argument("judgments", nargs="+")
    e.add_argument("--least", type=int, default=30)
    a = parser.parse_args(args)
    if a.command == "chunk":
        if a.file == "-" and not a.language:
            parser.error("standard input needs --language")
        text = sys.stdin.read() if a.file == "-" else Path(a.file).read_text(encoding="utf-8")
        language, method = eligibility.resolve_language(a.file, a.language)
        out = chunking.split(text, language, chunking.Config(max_size=a.max_size, sizer=a.sizer))
        data = text.encode()
        print(json.dumps({"language": language, "method": method, "strategy": out.strategy, "diagnostics": out.notes, "chunks": [{"start": p.start, "end": p.end, "size": n, "kinds": p.kinds, "text": data[p.start : p.end].decode()} for p, n in zip(out.pieces, out.sizes)]}, ensure_ascii=False))
        return 0
    spark = session()
    if a.command == "index":
        result: object = index_corpus(spark, a.source, a.index) if Path(a.source).is_file() else index_folder(spark, str(Path(a.source).resolve()), a.index)
    elif a.command == "search":
        result = search(spark, a.index, a.query, a.top_k, a.candidates)
    else:
        result = evaluate(spark, a.index, a.judgments, a.least)
    print(json.dumps(result, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
