"""Corpora, judgments and repositories as DataFrames."""

from __future__ import annotations

import json
import os
import re
import subprocess
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.errors import CorpusError
from quern.functions import identity
from quern.operators import eligibility
from quern.operators.common import nonblank
from quern.operators.incremental import duplicate_ids

CORPUS = "doc_id string, path string, language string, text string"
JUDGMENTS = "query string, graded_doc_ids map<string,int>"


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """One object a line; blank lines are skipped, a malformed one is an error."""
    lines = spark.read.text(path).where(nonblank("value"))
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def corpus(spark: SparkSession, path: str | list[str], unique: bool = True) -> DataFrame:
    """(document_id, path, language, content), paths normalized.

    An empty corpus, an empty or repeated id and a bad path are errors.
    """
    rows = read_jsonl(spark, path, CORPUS)
    out = rows.select(F.col("doc_id").alias("document_id"), identity.normalize_path(F.col("path")).alias("path"), "language", F.col("text").alias("content"))
    bad = (F.coalesce("document_id", F.lit("")) == "") | F.col("document_id").contains("\0") | F.col("path").isNull()
    if out.isEmpty():
        raise CorpusError("the corpus is empty")
    if broken := out.where(bad).take(1):
        raise CorpusError(f"bad id or path: {broken[0].document_id!r}")
    if unique and (twice := duplicate_ids(out).take(1)):
        raise CorpusError(f"duplicate document {twice[0].document_id}")
    return out


def judgments(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(query_id, text) and (query_id, document_id, grade); a query's id is its text's hash."""
    rows = read_jsonl(spark, path, JUDGMENTS).withColumn("query_id", F.sha2("query", 256))
    queries = rows.select("query_id", F.col("query").alias("text"))
    return queries, rows.select("query_id", F.explode("graded_doc_ids").alias("document_id", "grade"))


def judgment_files(folder: str, corpus_file: str = "corpus.jsonl") -> list[str]:
    """All JSONL files of a folder but the corpus, in order."""
    return sorted(str(p) for p in Path(folder).glob("*.jsonl") if p.name != corpus_file)


def repositories(path: str) -> list[dict[str, str]]:
    """The repositories of a manifest with schema version 1."""
    data = json.loads(Path(path).read_text(encoding="utf-8"))
    if data.get("schema_version") != 1:
        raise CorpusError("unknown schema version of a repository list")
    seen: dict[str, set[str]] = {"id": set(), "directory": set()}
    for r in data["repositories"]:
        if not {"id", "url", "revision", "directory"} <= set(r):
            raise CorpusError("a repository needs id, url, revision and directory")
        if not re.fullmatch(r"[A-Za-z0-9._-]+", r["id"]) or not str(r["url"]).strip():
            raise CorpusError(f"bad repository {r['id']!r}")
        if not re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", r["revision"]):
            raise CorpusError(f"the revision of {r['id']} isn't a whole hash")
        if Path(r["directory"]).is_absolute() or ".." in Path(r["directory"]).parts or not r["directory"]:
            raise CorpusError(f"the directory of {r['id']} leads elsewhere")
        for name, values in seen.items():
            if r[name] in values:
                raise CorpusError(f"{name} {r[name]} is repeated")
            values.add(r[name])
    return data["repositories"]


FILES = "path string, size long, kind string, content binary"


@F.pandas_udf(T.BinaryType())
def _content(places: pd.Series) -> pd.Series:
    return places.map(lambda p: Path(p).read_bytes())


def _walked(root: str) -> tuple[list[str], list[str]]:
    """Relative paths below a local folder of symbolic links, which aren't followed, and of files that Spark's listing passes over."""
    links, passed = [], []
    for where, folders, names in os.walk(root):
        for name in (*folders, *names):
            path = os.path.join(where, name)
            relative = os.path.relpath(path, root)
            if os.path.islink(path):
                links.append(relative)
            elif name in names and any(p[0] in "._" for p in relative.split(os.sep)):
                passed.append(relative)
    return sorted(links), sorted(passed)


def _listed(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, kind, content) of all files under a folder.

    Listing and reading are Spark's, but for what has a part beginning with ``.`` or
    ``_``, which its listing passes over: of a local folder such files are added.  A
    symbolic link, or what one leads to, has kind ``symlink``; only local folders can
    hold such.
    """
    base = root.rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    # the place has a scheme, but no escapes
    place = F.regexp_replace("path", r"^[a-z0-9]+:(//)?", "")
    relative = F.substring(place, len(base) + 1, 1 << 20)
    out = found.select(relative.alias("path"), F.col("length").alias("size"), F.lit("file").alias("kind"), "content")
    if "://" in root:
        return out
    links, passed = _walked(root)
    if passed:
        rows = spark.createDataFrame([(p, os.path.getsize(f"{base}{p}")) for p in passed], "path string, size long")
        out = out.unionByName(rows.select("path", "size", F.lit("file").alias("kind"), _content(F.concat(F.lit(base), "path")).alias("content")))
    if links:
        held = F.broadcast(spark.createDataFrame([(x,) for x in links], "link string"))
        linked = out.select("path").distinct().join(held, (F.col("path") == F.col("link")) | F.startswith("path", F.concat("link", F.lit("/")))).select("path").distinct()
        out = out.join(linked.withColumn("__linked", F.lit(True)), "path", "left").withColumn("kind", F.when(F.col("__linked"), "symlink").otherwise(F.col("kind"))).drop("__linked")
    return out.select("path", "size", "kind", "content")


def files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, kind, content) of all files under a folder that no hidden part leads to.

    A plan that doesn't use the content never reads it, so filters on path and size come
    first.
    """
    return _listed(spark, root).where(~identity.has_hidden_component(F.col("path")))


def workspace_files(spark: SparkSession, root: str) -> DataFrame:
    """``files``; in the root of a git repository only what git tracks or doesn't ignore."""
    found = files(spark, root)
    if git_root(root) != Path(root).resolve():
        return found
    return found.join(git_paths(spark, root), "path", "left_semi").select("path", "size", "kind", "content")


def git_root(folder: str) -> Path | None:
    """The root of the git working tree that holds a folder; None outside one, or where git is missing."""
    try:
        said = subprocess.run(["git", "-C", folder, "rev-parse", "--show-toplevel"], capture_output=True, text=True)
    except FileNotFoundError:
        return None
    return Path(said.stdout.strip()).resolve() if said.returncode == 0 and said.stdout.strip() else None


def workspace(folder: str = ".") -> tuple[Path, bool, Path]:
    """What a command run in ``folder`` works on: the root, whether git keeps it, and its default index."""
    found = git_root(folder)
    root = found or Path(folder).resolve()
    return root, found is not None, root / ".quern" / "index"


def git_paths(spark: SparkSession, root: str) -> DataFrame:
    """(path) of what git tracks or doesn't ignore; the folder must be the repository's root."""
    if git_root(root) != Path(root).resolve():
        raise CorpusError(f"{root} isn't the root of a git repository")
    listed = subprocess.run(["git", "-C", root, "ls-files", "-z", "--cached", "--others", "--exclude-standard"], capture_output=True)
    if listed.returncode:
        raise CorpusError(listed.stderr.decode(errors="replace"))
    names = sorted({p.decode(errors="replace") for p in listed.stdout.split(b"\0") if p})
    return spark.createDataFrame([(n,) for n in names], "path string")


def evaluation_files(spark: SparkSession, root: str, repository: str) -> DataFrame:
    """(repository, path, size, content, skip_reason, language) of an evaluation's checkout.

    Unlike ``files`` it takes hidden files, but no link and nothing below a folder that
    evaluations ignore; what has another suffix is left out without a reason.
    """
    found = _listed(spark, root).where("kind = 'file'")
    reason = eligibility.evaluation_skip_reason(F.col("path"), F.col("size"), F.col("content"))
    out = found.select(F.lit(repository).alias("repository"), "path", "size", "content", reason.alias("skip_reason"), eligibility.evaluation_language(F.col("path")).alias("language"))
    return out.where(F.coalesce("skip_reason", F.lit("")).isin("ignored_directory", "unsupported_extension") == F.lit(False))


def eligible(files_: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """``files_`` with skip_reason, content_hash and language; ``previous`` is (path, content_hash) of the last run."""
    old = None
    if previous is not None:
        files_ = files_.join(previous.select("path", F.col("content_hash").alias("__old")), "path", "left")
        old = F.col("__old")
    reason = eligibility.skip_reason(F.col("path"), F.col("size"), F.col("content"), F.col("kind"), old)
    out = files_.withColumn("skip_reason", reason).withColumn("content_hash", identity.content_hash(F.col("content")))
    return out.withColumn("language", eligibility.product_language(F.col("path"))).drop("__old")
