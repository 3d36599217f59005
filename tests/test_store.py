import json
import subprocess

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern import cli, errors
from quern.manifest import Manifest, validate_parity
from quern.operators import eligibility
from quern.operators.store import DOCUMENTS, Index
from quern.providers import HashEmbedder, StaticEmbedder, embed
from quern.sources import artifacts, corpora
from quern.streaming import ingest


def docs(spark, *rows):
    return spark.createDataFrame([(i, f"src/{i}", "text", t, e) for i, t, e in rows], DOCUMENTS)


def found(index, spark, text):
    return [r.document_id for r in index.search(spark.createDataFrame([("q", text)], "query_id string, text string"), 5).orderBy("rank").collect()]


def test_cycle(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    with pytest.raises(errors.SearchError):
        index.documents()
    index.replace(docs(spark, ("a", "alpha beta", None), ("b", "beta gamma", None)))
    assert index.document_count() == 2 and found(index, spark, "alpha") == ["a"]
    index.upsert(docs(spark, ("a", "delta", None)))
    assert found(index, spark, "alpha") == [] and found(index, spark, "delta") == ["a"]
    gone = spark.createDataFrame([("a",), ("unknown",)], "document_id string")
    index.delete(gone)
    index.delete(gone)
    assert [r.document_id for r in index.fetch(["b", "a"]).collect()] == ["b"]
    assert {r.term: r.document_frequency for r in index.term_stats().collect()}["gamma"] == 1
    assert len(index.generations()) <= 2 and index.active() in index.generations()
    assert Index(spark, str(tmp_path / "i")).document_count() == 1


def test_a_failed_build_leaves_what_was(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.replace(docs(spark, ("a", "alpha", None)))
    before = index.active()
    for bad in (docs(spark, ("x", "  ", None)), docs(spark, ("x", "one", None), ("x", "two", None)), docs(spark)):
        with pytest.raises(Exception, match="blank|duplicate|empty"):
            index.replace(bad)
    assert index.active() == before and found(index, spark, "alpha") == ["a"]


def test_vectors_are_checked_and_quantized(spark, tmp_path):
    m = Manifest(model_id="m", embedding_profile="p", embed_dim=2, mrl_dim=2, quantization="int8_per_vector_scale_offset")
    index = Index(spark, str(tmp_path / "i"), m)
    index.replace(docs(spark, ("a", "alpha", [1.0, 0.0]), ("b", "beta", [0.0, 1.0]), ("c", "none", None)))
    q, v = spark.createDataFrame([("q", "zzz")], "query_id string, text string"), spark.createDataFrame([("q", [0.1, 1.0])], "query_id string, embedding array<float>")
    assert [r.document_id for r in index.search(q, 5, 5, v).orderBy("rank").collect()] == ["b", "a"]
    for bad in ([1.0], [float("nan"), 1.0]):
        with pytest.raises(Exception, match="bad vector"):
            index.upsert(docs(spark, ("d", "delta", bad)))
    with pytest.raises(errors.ReindexRequired) as failure:
        Index(spark, str(tmp_path / "i"), Manifest())
    assert [f for f, _, _ in failure.value.mismatches] == ["model_id", "embedding_profile", "embed_dim", "mrl_dim", "quantization"]


CHANGES = {"model_id": "x", "model_revision": "x", "embedding_profile": "x", "embed_dim": 9, "mrl_dim": 4, "quantization": "binary_backend", "tokenizer_hash": "x", "chunker_version": "x", "fde_params": {"kind": "x"}, "schema_version": 2}


@pytest.mark.parametrize("field", sorted(CHANGES))
def test_each_field_alone_is_one_mismatch(field):
    from dataclasses import replace

    base = Manifest(embed_dim=8, mrl_dim=8)
    with pytest.raises(errors.ReindexRequired) as failure:
        base.validate_runtime(replace(base, **{field: CHANGES[field]}))
    assert [f for f, _, _ in failure.value.mismatches] == [field]
    same_ids = base.fingerprint() == replace(base, **{field: CHANGES[field]}).fingerprint()
    assert same_ids == (field in ("mrl_dim", "quantization")) and base.digest() != replace(base, **{field: CHANGES[field]}).digest()
    assert Manifest.from_json(base.to_json()) == base


def test_manifests_and_parity():
    for bad in ({"model_id": " "}, {"mrl_dim": 0}, {"mrl_dim": 2}, {"schema_version": 0}, {"quantization": "x"}):
        with pytest.raises(errors.InvalidConfig):
            Manifest(**bad).validate()
    m = {"model_id": "m", "embedding_profile": "p"}
    validate_parity(Manifest(), Manifest())
    validate_parity(Manifest(**m, embed_dim=4, mrl_dim=4), Manifest(**m, embed_dim=4, mrl_dim=4, quantization="binary_backend"))
    validate_parity(Manifest(**m, embed_dim=768, mrl_dim=256, quantization="int8_per_vector_scale_offset"), Manifest(**m, embed_dim=768, mrl_dim=768, quantization="binary_backend"))
    for a, b in [(Manifest(), Manifest(model_revision="x")), (Manifest(**m, embed_dim=4, mrl_dim=4), Manifest(**m, embed_dim=4, mrl_dim=2, quantization="binary_backend"))]:
        with pytest.raises(errors.InvalidConfig):
            validate_parity(a, b)


def test_corpus_source(spark, tmp_path):
    path = tmp_path / "corpus.jsonl"
    row = {"doc_id": "a", "path": "./src//x.py", "language": "python", "text": "t"}
    path.write_text(json.dumps(row) + "\n\n" + json.dumps(row | {"doc_id": "b"}) + "\n")
    assert {(r.document_id, r.path) for r in corpora.corpus(spark, str(path)).collect()} == {("a", "src/x.py"), ("b", "src/x.py")}
    for bad in ([row, row], [row | {"doc_id": ""}], [row | {"path": "../x"}], []):
        path.write_text("\n".join(map(json.dumps, bad)))
        with pytest.raises(errors.CorpusError):
            corpora.corpus(spark, str(path))
    path.write_text("{broken")
    with pytest.raises(Exception):
        corpora.corpus(spark, str(path))
    (tmp_path / "q.jsonl").write_text(json.dumps({"query": "x", "graded_doc_ids": {"a": 3, "b": 0}}))
    assert corpora.judgment_files(str(tmp_path)) == [str(tmp_path / "q.jsonl")]
    queries, grades = corpora.judgments(spark, [str(tmp_path / "q.jsonl")])
    assert queries.count() == 1 and {(r.document_id, r.grade) for r in grades.collect()} == {("a", 3), ("b", 0)}
    (tmp_path / "r.json").write_text(json.dumps({"schema_version": 1, "repositories": [{"id": "i", "url": "u", "revision": "a" * 40, "directory": "d"}]}))
    assert corpora.repositories(str(tmp_path / "r.json"))[0]["id"] == "i"
    one = {"id": "i", "url": "u", "revision": "a" * 40, "directory": "d"}
    for bad in ([one, one], [one | {"revision": "main"}], [one | {"directory": "../x"}], [one | {"id": "a b"}], [{"id": "i"}]):
        (tmp_path / "r.json").write_text(json.dumps({"schema_version": 1, "repositories": bad}))
        with pytest.raises(errors.CorpusError):
            corpora.repositories(str(tmp_path / "r.json"))
    (tmp_path / "r.json").write_text(json.dumps({"schema_version": 2, "repositories": []}))
    with pytest.raises(errors.CorpusError):
        corpora.repositories(str(tmp_path / "r.json"))


def repository(root):
    (root / "src").mkdir(parents=True)
    (root / ".hidden").mkdir()
    (root / "src/main.rs").write_text("fn main() { run(); }\n")
    (root / "src/é x.py").write_text("def f():\n    return 1\n")
    (root / "unknown.bin").write_text("x")
    (root / ".hidden/secret.rs").write_text("fn x() {}")
    (root / "nul.py").write_bytes(b"a\0b")
    (root / "big.json").write_text("1" * (50 * 1024 + 1))
    (root / "bad.go").write_bytes(b"\xff\xfe")
    (root / "blank.md").write_text(" \n\t\n")
    (root / "data.sql").write_text("x" * (751 * 1024))


def test_files_and_their_reasons(spark, tmp_path):
    root = tmp_path / "repo"
    repository(root)
    files = corpora.eligible(corpora.files(spark, str(root)))
    got = {r.path: r.skip_reason for r in files.select("path", "skip_reason").collect()}
    assert got == {"src/main.rs": None, "src/é x.py": None, "unknown.bin": "unsupported_language", "nul.py": "binary", "big.json": "oversized_config", "bad.go": "invalid_utf8", "blank.md": "empty", "data.sql": "data_like"}
    known = files.where("path = 'src/main.rs'").select("path", "content_hash")
    again = corpora.eligible(corpora.files(spark, str(root)), known)
    assert again.where("skip_reason = 'reused'").count() == 1
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    names = {r.path for r in corpora.git_paths(spark, str(root)).collect()}
    assert "src/main.rs" in names and ".hidden/secret.rs" in names
    with pytest.raises(errors.CorpusError):
        corpora.git_paths(spark, str(root / "src"))


def test_languages():
    assert eligibility.resolve_language("a/b.RS") == ("rust", "extension")
    assert eligibility.resolve_language("x", "Golang") == ("go", "explicit")
    assert eligibility.resolve_language("x.unknown") == ("generic", "generic_fallback")
    assert eligibility.resolve_language("x", "txt") == ("generic", "explicit")
    with pytest.raises(errors.AmbiguousLanguage):
        eligibility.resolve_language("x.h")
    with pytest.raises(errors.UnsupportedLanguage):
        eligibility.resolve_language("x.unknown", fallback=False)
    assert len(eligibility.GRAMMARS) == 13 and len(set(eligibility.PRODUCT_EXTENSIONS.values())) == 32


def test_streamed_batches(spark, tmp_path):
    source, index = tmp_path / "in", Index(spark, str(tmp_path / "i"))
    source.mkdir()

    def put(name, *rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("path", "content", "language"), r))) for r in rows))
        ingest.ingest(spark, str(source), index, str(tmp_path / "cp")).awaitTermination()

    put("1.json", ("a.py", "def alpha():\n    return 1\n", "python"), ("b.md", "beta words", "markdown"))
    assert found(index, spark, "alpha") == ["a.py#0"]
    put("2.json", ("a.py", "def delta():\n    return 1\n", "python"), ("b.md", None, "markdown"))
    assert found(index, spark, "alpha beta") == [] and found(index, spark, "delta") == ["a.py#0"]
    before = sorted(r.document_id for r in index.documents().collect())
    ingest.apply_batch(index, spark.createDataFrame([("a.py", "def delta():\n    return 1\n", "python")], ingest.FILE_SCHEMA))
    assert sorted(r.document_id for r in index.documents().collect()) == before


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    root = tmp_path / "repo"
    repository(root)

    def run(*args):
        assert cli.main(list(args)) == 0
        return json.loads(capsys.readouterr().out.strip().splitlines()[-1])

    first = run("index", str(root), str(tmp_path / "i"))
    assert first["mode"] == "full" and first["documents"] == 2 and first["files"]["new"] == 2
    (root / "src/main.rs").write_text("fn main() { renamed(); }\n")
    second = run("index", str(root), str(tmp_path / "i"))
    assert second["mode"] == "incremental" and second["files"]["unchanged"] == 1 and second["files"]["changed"] == 1 and second["documents"] == 2
    (root / "src/main.rs").unlink()
    third = run("index", str(root), str(tmp_path / "i"))
    assert third["files"] == {"removed": 1, "unchanged": 1, "skipped": 6} and third["documents"] == 1
    assert run("search", str(tmp_path / "i"), "return f")[0]["path"] == "src/é x.py"
    (tmp_path / "q.jsonl").write_text(json.dumps({"query": "return", "graded_doc_ids": {"src/é x.py#0": 3}}))
    assert run("evaluate", str(tmp_path / "i"), str(tmp_path / "q.jsonl"), "--least", "1")["mrr"] == 1.0
    chunks = run("chunk", str(root / "src/é x.py"), "--max-size", "2")
    assert chunks["language"] == "python" and "".join(c["text"] for c in chunks["chunks"]) == "def f():\n    return 1\n"
    with pytest.raises(ValueError):
        cli.main(["search", str(tmp_path / "i"), "  "])


def test_embedders(spark, tmp_path):
    df = spark.createDataFrame([("a", "x y"), ("b", None), ("c", "longer text here")], "document_id string, content string")
    out = {r.document_id: r.embedding for r in embed(df, HashEmbedder(), batch=1).collect()}
    assert out["b"] is None and sum(out["a"]) == 2 and sum(out["c"]) == 3
    table = np.array([[1, 0], [0, 1], [9, 9]], np.float16)
    static = StaticEmbedder(table, lambda t: [ord(c) - 97 for c in t], unknown=2)
    assert np.allclose(static.embed_query("abc"), [0.5**0.5] * 2)
    with pytest.raises(errors.NonFinite):
        static.embed_query("c")
    head = json.dumps({"t": {"dtype": "F16", "shape": [3, 2], "data_offsets": [0, 12]}}).encode()
    (tmp_path / "m").write_bytes(len(head).to_bytes(8, "little") + head + table.tobytes())
    assert (artifacts.tensors(artifacts.verified(str(tmp_path / "m")))["t"] == table).all()
    with pytest.raises(errors.InvalidValue):
        artifacts.verified(str(tmp_path / "m"), length=3)


def test_updates_give_what_a_new_build_gives(spark, tmp_path, monkeypatch):
    from quern.operators import store

    monkeypatch.setattr(store, "MOST_SEGMENTS", 3)
    index, held = Index(spark, str(tmp_path / "i")), {}
    steps = [
        ({"a": "alpha beta", "b": "beta gamma", "c": "gamma delta"}, []),
        ({"a": "alpha new", "d": "delta delta"}, ["b"]),
        ({"b": "beta again"}, ["nowhere", "d"]),
        ({"b": "beta thrice", "d": "delta back"}, ["a"]),
        ({}, ["c"]),
    ]
    analyzed = []
    from quern.operators import indexing

    terms_of = indexing.weighted_terms
    monkeypatch.setattr(indexing, "weighted_terms", lambda d, *w: (analyzed.append(d.count()), terms_of(d, *w))[1])
    for n, (new, stale) in enumerate(steps):
        rows = docs(spark, *[(i, t, None) for i, t in new.items()]) if new else spark.createDataFrame([], DOCUMENTS)
        if n == 0:
            index.replace(rows)
        else:
            index.update(rows, spark.createDataFrame([(i,) for i in stale], "document_id string"))
        held = {i: t for i, t in held.items() if i not in stale} | new
        assert {r.document_id: r.content for r in index.documents().collect()} == held
        whole = Index(spark, str(tmp_path / f"whole{n}"))
        monkeypatch.setattr(indexing, "weighted_terms", terms_of)
        whole.replace(docs(spark, *[(i, t, None) for i, t in held.items()]))
        monkeypatch.setattr(indexing, "weighted_terms", lambda d, *w: (analyzed.append(d.count()), terms_of(d, *w))[1])
        for name in ("term_stats", "terms"):
            assert sorted(map(tuple, getattr(index, name)().select("term", *(["document_frequency"] if name == "term_stats" else ["document_id", "term_frequency"])).collect())) == sorted(map(tuple, getattr(whole, name)().select("term", *(["document_frequency"] if name == "term_stats" else ["document_id", "term_frequency"])).collect()))
        asked = spark.createDataFrame([("q", "beta delta"), ("r", "gamma alpha")], "query_id string, text string")
        assert sorted(map(tuple, index.search(asked).collect())) == sorted(map(tuple, whole.search(asked).collect()))
    # only what was new was analyzed, and segments were merged
    assert analyzed == [3, 2, 1, 2, 0]
    assert len(index.segments()) <= 3 and len(index.generations()) <= 2


def test_any_white_space_is_blank(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    for blank in ("\n\t", "\u00a0\u2003", ""):
        with pytest.raises(Exception, match="blank"):
            index.replace(docs(spark, ("x", blank, None)))
    files = spark.createDataFrame([("a", "\n\t \u2003", "text"), ("b", "x", "text")], ingest.FILE_SCHEMA)
    assert [r.path for r in ingest.documents_of(files).collect()] == ["b"]
    queries = spark.createDataFrame([(str(i), "\u2003" if i == 3 else f"q{i}") for i in range(30)], "query_id string, text string")
    from quern.operators import evaluation

    with pytest.raises(errors.CorpusError, match="blank"):
        evaluation.validate_judgments(queries, spark.createDataFrame([], "query_id string, document_id string, grade int"), queries)


def test_a_binary_index_searches_its_stored_vectors(spark, tmp_path):
    m = Manifest(model_id="m", embedding_profile="p", embed_dim=2, mrl_dim=2, quantization="binary_backend")
    index = Index(spark, str(tmp_path / "i"), m)
    index.replace(docs(spark, ("a", "alpha", [1.0, 0.0]), ("b", "beta", [0.0, 1.0])))
    q, v = spark.createDataFrame([("q", "zzz")], "query_id string, text string"), spark.createDataFrame([("q", [0.1, 1.0])], "query_id string, embedding array<float>")
    assert [r.document_id for r in index.search(q, 5, 5, v).orderBy("rank").collect()] == ["b", "a"]


def test_the_embedding_cache_serves_what_it_holds(spark, tmp_path):
    index = Index(spark, str(tmp_path / "x"))
    rows = docs(spark, ("a", "alpha", None), ("b", "beta", None))
    first = {r.document_id: r.embedding for r in index.embedded(rows, HashEmbedder(4)).collect()}
    more = docs(spark, ("a", "alpha", None), ("b", "changed", None), ("c", "new", None))
    second = {r.document_id: r.embedding for r in index.embedded(more, HashEmbedder(4)).collect()}
    assert second["a"] == first["a"] and all(v is not None for v in second.values())
    # what the cache held wasn't embedded, and so not appended, again
    assert spark.read.parquet(str(tmp_path / "x" / "cache")).count() == 4


@pytest.mark.parametrize("query,top,candidates", [(" ", 5, 10), ("x", 0, 10), ("x", 51, 100), ("x", 10, 9), ("x", 10, 1001)])
def test_requests_are_bounded(query, top, candidates):
    from quern.operators import retrieval

    with pytest.raises(ValueError):
        retrieval.check_request(query, top, candidates)
    retrieval.check_request("x", 50, 1000)


def test_workspace_links_and_evaluation_files(spark, tmp_path):
    root = tmp_path / "repo"
    repository(root)
    (root / "a+b 100%20.py").write_text("x = 1\n")
    (root / "link.py").symlink_to(root / "src/main.rs")
    (root / "linked").symlink_to(root / "src")
    (root / "src/__init__.py").write_text("y = 2\n")
    (root / "vendor").mkdir()
    (root / "vendor/v.rs").write_text("fn v() {}")
    kinds = {r.path: r.kind for r in corpora.files(spark, str(root)).select("path", "kind").collect()}
    assert kinds["src/__init__.py"] == kinds["a+b 100%20.py"] == kinds["src/main.rs"] == "file" and kinds["link.py"] == "symlink"
    assert all(k == "symlink" for p, k in kinds.items() if p.startswith("linked/"))
    assert {r.path for r in corpora.workspace_files(spark, str(root)).select("path").collect()} == set(kinds)
    assert corpora.workspace(str(root))[1] is False and corpora.workspace(str(root))[0] == root.resolve()
    assert [bytes(r.content) for r in corpora.files(spark, str(root)).where("path = 'src/__init__.py'").collect()] == [b"y = 2\n"]
    taken = {r.path: r.skip_reason for r in corpora.evaluation_files(spark, str(root), "r").collect()}
    assert taken[".hidden/secret.rs"] is None and not any(p.startswith(("vendor", "link")) or p.endswith(".bin") for p in taken)
    assert taken["big.json"] == "oversized_config" and taken["bad.go"] == "invalid_utf8"
    subprocess.run(["git", "init", "-q", str(root)], check=True)
    (root / ".gitignore").write_text("*.go\n")
    names = {r.path for r in corpora.workspace_files(spark, str(root)).select("path").collect()}
    assert "src/main.rs" in names and "bad.go" not in names
    assert corpora.workspace(str(root / "src"))[:2] == (root.resolve(), True)


def test_windowed_embedding():
    from quern.providers import WindowedEmbedder, windows

    assert windows(0) == [] and windows(256) == [(0, 256)] and windows(500) == [(0, 256), (224, 480), (448, 500)]
    seen = []

    def model(batch):
        seen.append([len(x) for x in batch])
        return np.array([[len(x), sum(x)] for x in batch], np.float32)

    e = WindowedEmbedder(lambda t: [ord(c) for c in t], model, 2, size=4, overlap=1, batch=2)
    texts = ["abcdefgh", "a", "abc"]
    got = e.embed_batch(texts)
    for t, v in zip(texts, got):
        want = sum(np.array([b - a, sum(map(ord, t[a:b]))], float) * (b - a) for a, b in windows(len(t), 4, 1))
        assert np.allclose(v, want / np.linalg.norm(want))
    assert [n for b in seen for n in b] == sorted(n for b in seen for n in b)
    with pytest.raises(errors.EmptyValue):
        e.embed_query("")


def test_watchdog(spark):
    from quern.progress import Watchdog
    from quern.protocols import Cancellation

    looks = []
    with Watchdog(spark, 60, observer=lambda *seen: looks.append(seen), every=0.05):
        assert spark.range(1000).count() == 1000
    slow = F.udf(lambda x: __import__("time").sleep(30) or x, "long")
    for dog in (Watchdog(spark, 2, every=0.2), Watchdog(spark, 60, cancellation=(stop := Cancellation()), every=0.2)):
        if dog.cancellation:
            stop.cancel()
        with pytest.raises(errors.Stalled):
            with dog:
                spark.range(2).select(slow("id")).collect()
    assert spark.range(5).count() == 5


def test_checked_retriever(spark, tmp_path):
    from quern.protocols import Checked, IndexStore

    index = Index(spark, str(tmp_path / "i"))
    assert isinstance(index, IndexStore)
    with pytest.raises(errors.ReindexRequired):
        Checked(index, Manifest(schema_version=2))
    checked = Checked(index, Manifest())
    for top, candidates in ((0, 10), (51, 100), (10, 5), (10, 1001)):
        with pytest.raises(ValueError):
            checked.search(None, top, candidates)


def test_a_segment_shuffles_no_terms_and_lies_in_runs(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    index.replace(docs(spark, ("a", "gamma alpha", None), ("b", "beta alpha", None)).coalesce(1))
    segment = tmp_path / "i" / index.segments()[0]
    assert sorted(p.name for p in segment.iterdir()) == ["documents", "term_stats", "terms"]
    for f in (segment / "terms").glob("*.parquet"):
        terms = [r.term for r in spark.read.parquet(str(f)).collect()]
        assert terms == sorted(terms)
    index.update(docs(spark, ("a", "delta", None)), spark.createDataFrame([], "document_id string"))
    assert "SortMergeJoin" not in index.terms()._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.term for r in index.terms().where("document_id = 'a' AND term <> 'a'").collect())[0] == "delta"


def test_a_batch_is_evaluated_once_and_only_recurring_paths_are_shuffled(spark, tmp_path):
    rows = [("a.md", "one", "markdown"), ("b.md", "two", "markdown"), (None, "three", None)]
    files = spark.createDataFrame(rows, ingest.FILE_SCHEMA)
    assert "Exchange" not in ingest.latest(files)._jdf.queryExecution().executedPlan().toString()
    more = [("a.md", "zwei", "text"), ("a.md", None, "zz"), (None, "four", "x"), ("b.md", "two", None), ("c.md", None, "text"), ("c.md", "", None)]
    got = ingest.latest(files.unionByName(spark.createDataFrame(more, ingest.FILE_SCHEMA)))
    assert {tuple(r) for r in got.collect()} == {("a.md", "zwei", "text"), ("b.md", "two", "markdown"), (None, "three", None), ("c.md", "", None)} and got.count() == 4
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    index = Index(spark, str(tmp_path / "i"))
    index.replace(docs(spark, ("a", "alpha", None), ("b", "beta", None)).mapInArrow(counted, DOCUMENTS))
    assert seen.value == 2
    # a first batch of blank files publishes nothing and leaves nothing
    blank = Index(spark, str(tmp_path / "blank"))
    assert ingest.apply_batch(blank, spark.createDataFrame([("a.md", " ", "markdown")], ingest.FILE_SCHEMA)) is None
    assert blank.active() is None and not list((tmp_path / "blank").glob("seg-*"))
