import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern import errors
from quern.operators import chunking
from quern.operators.chunking import Config, fixed_windows, split

CODE = {
    "python": "import os\n\n\n@wraps\ndef f(a):\n    '''é'''\n    return [x for x in a]\n\n\nclass C:\n    def g(self):\n        return 1\n\n    def h(self):\n        return f'{self}'\n" * 4,
    "go": 'package p\n\nfunc A() string { return "}" }\n\n// }\nfunc B(x int) {\n\tif x > 0 {\n\t\tB(x - 1)\n\t}\n}\n' * 4,
    "rust": "use a::b;\nfn f<'a>(x: &'a str) -> u8 { match x { \"{\" => 1, _ => 2 } }\nstruct S { a: u8 }\n" * 4,
    "javascript": "const f = (x) => { return `}${x}`; };\nfunction g() { for (let i = 0; i < 3; i++) { f(i); } }\n" * 4,
    "ruby": "module M\n  def f(x)\n    if x\n      1\n    end\n  end\nend\n" * 4,
    "bash": "f() {\n  if true; then\n    echo 1\n  fi\n}\nfor i in 1 2; do\n  f\ndone\n" * 4,
}


def covers(text, out, config):
    data = text.encode()
    assert b"".join(data[p.start : p.end] for p in out.pieces) == data
    size = chunking.SIZERS[config.sizer]
    for p, n in zip(out.pieces, out.sizes):
        assert n == size(data[p.start : p.end].decode())
        if config.strict:
            assert n <= config.max_size and (config.max_bytes is None or p.end - p.start <= config.max_bytes)


@pytest.mark.parametrize("language", sorted(CODE))
@pytest.mark.parametrize("config", [Config(max_size=12), Config(max_size=40, max_bytes=120), Config(max_size=3, sizer="lines"), Config(max_size=30, sizer="bytes", max_bytes=None), Config(max_size=10**6)])
def test_trees_cover_exactly(language, config):
    out = split(CODE[language], language, config)
    covers(CODE[language], out, config)
    assert out.strategy == ("ast" if language == "python" else "generic")
    assert "generic_fallback" not in out.notes
    if config.max_size >= 10**6:
        assert len(out.pieces) == 1


def test_structure_decides_boundaries():
    text = "def a():\n    return 1\n\n\ndef b():\n    return 2\n"
    out = split(text, "python", Config(max_size=5))
    assert [text[p.start : p.end] for p in out.pieces] == ["def a():\n    return 1\n\n\n", "def b():\n    return 2\n"]
    assert [p.kinds for p in out.pieces] == [["FunctionDef"], ["FunctionDef"]]
    text = "func A() { x() }\nfunc B() { y() }\n"
    assert [text[p.start : p.end] for p in split(text, "go", Config(max_size=6)).pieces] == ["func A() { x() }\n", "func B() { y() }\n"]


def test_broken_code_falls_back_or_fails():
    assert "generic_fallback" in split("def (:\n x", "python").notes
    assert "generic_fallback" in split("func {", "go").notes
    with pytest.raises(errors.ParseHasErrors):
        split("def (:", "python", Config(policy="require_ast"))
    with pytest.raises(errors.UnsupportedLanguage):
        split("x", "cobol", Config(policy="require_ast"))
    with pytest.raises(errors.UnsupportedFeature):
        split("x", "python", Config(overlap=1))
    with pytest.raises(errors.InputTooLarge):
        split("x" * 11, "text", Config(max_input=10))
    with pytest.raises(errors.ChunkConfigError):
        Config(max_size=0)


def test_leaves_are_kept_or_cut():
    text = "x = '" + "word " * 50 + "'\n"
    assert "degraded_split" in split(text, "python", Config(max_size=10)).notes
    kept = split(text, "python", Config(max_size=10, strict=False))
    assert "oversized_atomic_node" in kept.notes and max(kept.sizes) > 10
    assert "hard_chunk_byte_cap" in split(text, "python", Config(max_size=10, max_bytes=60, strict=False)).notes


def test_generic_respects_the_byte_cap():
    out = split("a" * 60_000, "text", Config(max_size=10, max_bytes=25_000))
    assert len(out.pieces) >= 3 and all(p.end - p.start <= 25_000 for p in out.pieces)
    covers("a" * 60_000, out, Config(max_size=10, max_bytes=25_000))


def test_a_sizer_need_not_grow(monkeypatch):
    monkeypatch.setitem(chunking.SIZERS, "odd", lambda t: 2 if len(t) == 4 else 1)
    out = split("abc\nxxxxx", "text", Config(max_size=1, sizer="odd"))
    assert [(p.start, p.end) for p in out.pieces] == [(0, 9)]


def test_one_character_that_does_not_fit():
    with pytest.raises(errors.UnsplittableUnit):
        split("é" * 3, "text", Config(max_size=1, sizer="bytes"))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n.é🙂{}()'\"", max_size=80), st.integers(4, 30), st.sampled_from(["python", "go", "ruby", "bash", "text", "javascript"]))
def test_any_text_is_covered(text, size, language):
    config = Config(max_size=size, sizer="bytes", max_bytes=None)
    covers(text, split(text, language, config), config)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abc🙂é", max_size=80), st.integers(5, 20))
def test_windows_cover(text, window):
    data = text.encode()
    cuts = fixed_windows(data, window, 1)
    assert b"".join(data[s:e] for s, e, _ in cuts) == data
    for s, e, c in cuts:
        assert c - s <= window and c >= e
        data[s:c].decode()


def test_windows_overlap():
    data = "🙂abcdef🙂ghijkl🙂".encode()
    cuts = fixed_windows(data, 12, 4)
    assert len(cuts) > 1 and all(a[2] > b[0] for a, b in zip(cuts, cuts[1:]))
    assert fixed_windows(b"", 12, 4) == []
    with pytest.raises(errors.ChunkConfigError):
        fixed_windows(b"x", 4, 4)


def test_dataframe_chunks_and_their_coverage(spark):
    rows = [("py", "python", CODE["python"]), ("txt", "text", "é line\n" * 2000), ("none", "text", None), ("empty", "text", "")]
    docs = spark.createDataFrame(rows, "document_id string, language string, content string")
    chunks = chunking.chunk(docs, config=Config(max_size=20))
    got = chunks.orderBy("document_id", "ordinal").collect()
    assert {r.document_id for r in got} == {"py", "txt"} and {r.strategy for r in got if r.document_id == "py"} == {"ast"}
    assert got[0].start_line == 1 and got[0].chunk_id == "py#0"
    second = next(r for r in got if r.document_id == "txt" and r.ordinal == 1)
    head = rows[1][2].encode()[: second.start_byte]
    assert (second.start_line, second.start_column) == (head.count(b"\n") + 1, len(head) - head.rfind(b"\n") - 1)
    assert {r.document_id: r.covered for r in chunking.coverage(chunks, docs).collect()} == {"py": True, "txt": True, "none": True, "empty": True}
    broken = chunks.where("NOT (document_id = 'py' AND ordinal = 1)")
    assert {r.document_id: r.covered for r in chunking.coverage(broken, docs).collect()}["py"] is False
    assert chunking.chunk(docs.limit(0)).count() == 0
    with pytest.raises(errors.ChunkConfigError):
        chunking.chunk(docs, "magic")


def test_deep_code():
    text = "f(" * 300 + "1" + ")" * 300
    covers(text, split(text, "python", Config(max_size=50, sizer="bytes")), Config(max_size=50, sizer="bytes"))
    text = "{" * 2000 + "x;" + "}" * 2000
    covers(text, split(text, "c", Config(max_size=50, sizer="bytes")), Config(max_size=50, sizer="bytes"))


def test_queries_take_texts_over_the_default_limit(spark, tmp_path):
    from quern.plans import catalogue

    rows = [(1, "word " * 1_100_000, "en", "s", 5_500_000)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert [r.covered for r in catalogue.chunk_coverage(spark, str(tmp_path)).collect()] == [True]
    assert catalogue.line_chunks(spark, str(tmp_path)).count() == 1


BROKEN = [
    ("python", "import os\n\n@dec\ndef f(x):\n    return x\n\ndef g(:\n    pass\n\nif a:\n    b\nelse:\n    c\n", 1, 0),
    ("rust", "fn main() { a(); \n fn b() { c(); }\n", 0, 1),
    ("go", "func a() { b() } }\nfunc c() {}\n", 1, 0),
    ("ruby", "def a\n  b\nend\nend\n", 1, 0),
    ("bash", "if x\n then y\n", 0, 1),
    ("python", "\n\n(((\n", 1, 0),
]


@pytest.mark.parametrize("language,text,bad,missing", BROKEN)
def test_broken_texts_are_recovered(language, text, bad, missing):
    for size in (1, 4, 100):
        out = chunking.split(text, language, chunking.Config(max_size=size, policy="recover"))
        assert f"recovered_parse:errors={bad},missing={missing}" in out.notes
        assert "".join(text[p.start : p.end] for p in out.pieces) == text
    with pytest.raises(errors.ParseHasErrors):
        chunking.split(text, language, chunking.Config(policy="require_ast"))


def test_sizers_can_be_given():
    text = "some words of a text. " * 50
    out = chunking.split(text, "generic", chunking.Config(max_size=30, sizer=lambda t: len(t.encode()) // 2))
    assert all(n <= 30 for n in out.sizes) and "".join(text[p.start : p.end] for p in out.pieces) == text


def test_bpe_sizer(spark, tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    byte_level = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate(sorted(pre_tokenizers.ByteLevel.alphabet()))}, merges=[]))
    byte_level.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    byte_level.save(str(tmp_path / "t.json"))
    sizer = chunking.BpeSizer(str(tmp_path / "t.json"))
    config = chunking.Config(max_size=12, sizer=sizer)
    assert sizer.profile in config.profile() and sizer("é a") == 4
    docs = spark.createDataFrame([("d", "x", "é some text of words")], "document_id string, language string, content string")
    rows = chunking.chunk(docs, "lexical", config).orderBy("ordinal").collect()
    assert "".join(r.text for r in rows) == "é some text of words" and all(r.measured_size == len(r.text.encode()) <= 12 for r in rows)


def test_long_texts_are_split_in_linear_time():
    import time

    text = "word é " * 400_000
    start = time.time()
    out = chunking.split(text, "generic", chunking.Config(max_bytes=None, max_input=1 << 40))
    assert time.time() - start < 30 and sum(out.sizes) == 800_000


BITS = ["x = 1 \\\n", "def f(a):\n    return a\n", "@d\n", "if x:\n    y\n", "else:\n    z\n", "s = '''a\n", "'''\n", "y = (1,\n", "2)\n", "# c\n", "\n", "class C:\n  def g(self):\n    return 'é'\n\n  x = 2\n", "a; b = 3\n", "\\\n", "  ind\n", "\x0cf()\n", "# coding: latin-1\n", "print(1)\r\n", "é\n"]


def flat(node):
    return (node.kind, node.start, node.end, tuple(map(flat, node.children)))


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(BITS), min_size=1, max_size=6))
def test_a_tree_of_parts_is_the_tree_of_the_whole(bits):
    data = "".join(bits).encode()
    if (found := chunking.python_parts(data)) is not None:
        assert flat(found) == flat(chunking.python_tree(data))


def test_equal_parts_are_parsed_once(monkeypatch):
    parsed = []
    monkeypatch.setattr(chunking, "_parts", {})
    monkeypatch.setattr(chunking.ast, "parse", lambda *a: parsed.append(a))
    monkeypatch.setattr(chunking, "compile", lambda *a: parsed.append(a) or compile(*a), raising=False)
    text = "def f(x):\n    return 'a' + x\n\n" * 500
    out = split(text, "python", Config(max_size=20))
    assert len(parsed) == 1 and len(out.pieces) == 167 and out.strategy == "ast"
    covers(text, out, Config(max_size=20))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab é\u3000\x1c\x85\n🙂\xa0", min_size=1, max_size=40))
def test_words_of_ranges_are_those_of_split(text):
    source = chunking._Source(text.encode(), chunking.word_sizer)
    bounds = [len(text[:i].encode()) for i in range(len(text) + 1)]
    size = source.between(bounds)
    for i in range(len(bounds)):
        for j in range(i, len(bounds)):
            assert size(i, j) == source.size(bounds[i], bounds[j]) == len(text[i:j].split())


def test_chunks_with_some_columns_alone(spark):
    docs = spark.createDataFrame([("py", "python", CODE["python"]), ("no", "text", None)], "document_id string, language string, content string")
    some = ("ordinal", "end_byte", "node_kinds")
    for method in ("tree", "lexical", "fixed"):
        want = chunking.chunk(docs, method, Config(max_size=20)).select(*some).orderBy("ordinal").collect()
        assert chunking.chunk(docs, method, Config(max_size=20), columns=some).orderBy("ordinal").collect() == want
