import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from quern.functions import identity, text
from quern.operators import indexing


def terms_of(spark, value):
    df = spark.createDataFrame([(value,)], "t string")
    out = {}
    for r in text.analyze(df, F.col("t")).collect():
        out[r.term] = out.get(r.term, 0) + 1
    return out


def test_identifiers_split_and_keep_their_whole(spark):
    got = terms_of(spark, "HTTPServer http_server parseJSON2Value")
    assert {"httpserver", "http", "server", "parsejson2value", "json2", "value"} <= set(got)


def test_stop_words_go_and_stems_count(spark):
    got = terms_of(spark, "where is validation validated")
    assert "where" not in got and "is" not in got and got["valid"] == 2


@pytest.mark.parametrize(("word", "stem"), [("classes", "class"), ("bodies", "bodi"), ("studies", "stud"), ("running", "runn"), ("ated", None), ("organization", "organ"), ("station", None), ("as", None), ("ééés", "ééé"), ("és", None)])
def test_one_stem_of_four_bytes(spark, word, stem):
    assert spark.createDataFrame([(word,)], "t string").select(text.stem(F.col("t"))).head()[0] == stem


def test_no_text_no_terms(spark):
    assert terms_of(spark, "") == terms_of(spark, None) == terms_of(spark, " -- the ") == {}


def test_weights(spark):
    docs = spark.createDataFrame([("valid", "src/alpha", "alpha beta")], "document_id string, path string, content string")
    got = {r.term: r.term_frequency for r in indexing.weighted_terms(docs).collect()}
    assert got == {"alpha": 4, "beta": 1, "src": 3, "valid": 2}


def test_sizers(spark):
    df = spark.createDataFrame([("世界",), ("one\ntwo\n",), ("one\u2003two",), ("",), ("x",)], "t string")
    c = F.col("t")
    got = [tuple(r) for r in df.select(text.byte_size(c), text.word_size(c), text.line_size(c)).collect()]
    assert got == [(6, 1, 1), (8, 2, 2), (9, 2, 1), (0, 0, 0), (1, 1, 1)]


@pytest.mark.parametrize(
    ("path", "want"),
    [("src\\parser\\mod.rs", "src/parser/mod.rs"), ("./src//lib.rs", "src/lib.rs"), ("../secret", None), ("/etc/passwd", None), ("C:\\secret", None), ("./", None), ("", None), ("a\0b", None), ("a/../b", None), ("a..b", "a..b"), (None, None)],
)
def test_normalize_path(spark, path, want):
    assert spark.createDataFrame([(path,)], "p string").select(identity.normalize_path(F.col("p"))).head()[0] == want


def test_ids_are_those_of_the_bytes(spark):
    row = ("a/b.py", "é text", 3, 70_000, 5)
    df = spark.createDataFrame([row], "p string, t string, o long, s long, e long")
    h, f = hashlib.sha256(row[1].encode()).hexdigest(), hashlib.sha256(b"f").hexdigest()
    got = df.select(identity.document_id(F.col("p"), F.lit(h), F.lit(f), F.col("o"), F.col("s"), F.col("e")), identity.cache_key(F.col("p"), F.col("t"))).head()
    data = identity.DOCUMENT_DOMAIN.encode() + b"\0" + b"a/b.py\0" + bytes.fromhex(h) + bytes.fromhex(f) + struct.pack(">QQQ", 3, 70_000, 5)
    assert got[0] == hashlib.sha256(data).hexdigest()
    p, t = b"a/b.py", row[1].encode()
    data = identity.CACHE_DOMAIN.encode() + b"\0" + struct.pack("<Q", len(p)) + p + struct.pack("<Q", len(t)) + t
    assert got[1] == hashlib.sha256(data).hexdigest()


def test_stable_score_is_fnv(spark):
    for q, d in [("query", "doc"), ("", ""), ("é世界", "x" * 200)]:
        h = 0xCBF29CE484222325
        for b in q.encode() + b"\xff" + d.encode():
            h = (h ^ b) * 0x100000001B3 % 2**64
        got = spark.createDataFrame([(q, d)], "q string, d string").select(identity.stable_score(F.col("q"), F.col("d"))).head()[0]
        assert got == (h >> 41) / 2**23


def test_the_analyzer_of_workers_gives_what_the_expressions_give(spark):
    import random

    from quern.functions import text

    r = random.Random(3)
    alphabet = "aBcDéÉßẞσςΣİıǅ中ⅣⅷⓐⒶ٣²𝐀𝐚𐐀𐐨\U0001F600 _-/.0z\u0301\u0345ᾳ"
    rows = ["".join(r.choice(alphabet) for _ in range(r.randint(1, 12))) for _ in range(1500)]
    rows += ["".join(chr(c) for c in (r.randint(1, 0xD7FF), r.randint(0xE000, 0x1FFFF), r.randint(65, 122), r.randint(0xA0, 0x24FF))) for _ in range(3000)]
    rows += [w + s for w in ("ab", "éa", "中a", "abc", "ééx", "𝐚", "organ", "XMLParser", "the") for s in (*text.SUFFIXES, "izations", "edlys", "")] + ["", "The OF andWhere", "HTTPServerIsRunning x1Y2"]
    found = spark.createDataFrame([(x,) for x in rows], "t string").select("t", text.terms_of(text.F.col("t")).alias("terms")).collect()
    own = text.analyzer(*text.alphabet(spark))
    for row in found:
        assert [t for token in own.tokens(row.t) for t in own.terms(token)] == row.terms, row.t


def test_counts_alone_are_those_of_profiles(spark):
    from quern.operators import indexing

    docs = spark.createDataFrame([("1", "s/1", "Alpha beta betaGamma"), ("2", "s/2", None), ("3", "", ""), ("1", "s/9", "more words"), (None, "p", "x")], "document_id string, path string, content string")
    for weights in (indexing.WEIGHTS, (1, 0, 0)):
        want = {(r.document_id, r.token_count) for r in indexing.profiles(docs, weights).collect()}
        assert {tuple(r) for r in indexing.profiles(docs, weights, lists=False).collect()} == want


def test_profiles_of_several_weights_and_of_some_terms(spark):
    from quern.operators import indexing

    docs = spark.createDataFrame([("1", "s/1", "Alpha beta betaGamma"), ("2", "s/2", None), ("3", "", ""), ("1", "s/9", "more beta")], "document_id string, path string, content string")
    whole, only = [(1, 3, 2), (1, 0, 0)], frozenset({"beta", "1", "none"})
    for rows in (docs, docs.where("path <> 's/9'")):
        got = {(r.variant, r.document_id): (r.token_count, dict(zip(r.terms, r.frequencies))) for r in indexing.profiles(rows, *whole, only=only).collect()}
        for i, weights in enumerate(whole):
            for r in indexing.profiles(rows, weights).collect():
                assert got.pop((i, r.document_id)) == (r.token_count, {t: n for t, n in zip(r.terms, r.frequencies) if t in only})
        assert not got
