import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quern.llm import packing, queries, rollup
from tests.llm.oracle import assert_agrees

EVENTS = "op string, source string, lang string, tokenizer string, n_tokens long, old_tokens long"


def apply(totals, events):
    for op, source, lang, tok, n, old in events:
        key, n, old = (source, lang, tok), n or 0, old or 0
        docs, tokens = totals.get(key, (0, 0))
        totals[key] = {"insert": (docs + 1, tokens + n), "delete": (docs - 1, tokens - n), "revise": (docs, tokens + n - old)}[op]


def rows(store):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in store.totals().collect()}


def test_batches_against_brute_force(spark, tmp_path):
    rng = random.Random(0)
    store, want = rollup.TokenRollup(spark, str(tmp_path / "r")), {}
    assert rows(store) == {}
    for i in range(6):
        events = [(rng.choice(["insert", "insert", "delete", "revise"]), rng.choice(["hot", "hot", "a", None]), rng.choice(["en", None]), rng.choice(["v1", "v2"]), rng.choice([None, 0, 5, 17]), rng.choice([None, 3])) for _ in range(40)]
        df = spark.createDataFrame([(*e, "x") for e in events], EVENTS + ", n_docs string")
        assert store.commit(f"b/{i} ü", df)
        apply(want, events)
        assert not store.commit(f"b/{i} ü", df)
        if i in (2, 4):
            store.compact()
            assert not store.commit(f"b/{i} ü", df)
        assert rows(store) == {k: v for k, v in want.items() if v != (0, 0)}
    # the second compaction removed what the first held
    assert len(store._names("batches")) == 3 and len(store._names("snapshots")) == 2
    assert store.committed() == {f"b/{i} ü" for i in range(6)}


def test_failed_and_empty_batches(spark, tmp_path):
    store = rollup.TokenRollup(spark, str(tmp_path / "r"))
    for op in ("upsert", None):
        with pytest.raises(Exception, match="unknown op"):
            store.commit("bad", spark.createDataFrame([(op, "s", "en", "v1", 1, 1)], EVENTS))
    assert store.committed() == set()
    empty = spark.createDataFrame([], EVENTS)
    assert store.commit("empty", empty) and not store.commit("empty", empty) and rows(store) == {}
    ok = spark.createDataFrame([("insert", "s", "en", "v1", 4)], "op string, source string, lang string, tokenizer string, n_tokens long")
    assert store.commit("bad", ok) and rows(store) == {("s", "en", "v1"): (1, 4)}


def test_a_taken_name_is_not_published_again(spark, tmp_path):
    store = rollup.TokenRollup(spark, str(tmp_path / "r"))
    for want in (True, False):
        staged = str(tmp_path / "r" / "staging" / str(want))
        spark.createDataFrame([("s", "en", "v1", 1, 4)], rollup.SCHEMA).write.parquet(staged)
        assert store._publish(staged, f"{store.path}/batches/one") is want
    assert rows(store) == {("s", "en", "v1"): (1, 4)}


def test_counts(spark):
    texts = [None, "", "a b2  c\td\x0be", "é 世界\xa0x 12", " lead", "2", "x1y z"]
    df = spark.createDataFrame([(i, t, "w") for i, t in enumerate(texts)], "doc_id long, text string, other string")
    got = rollup.count_tokens(df, tokenizer=packing.byte_bpe_path())
    assert got.columns == ["doc_id", "other", "words", "words_kept", "bpe", "bpe_kept"]
    encode = packing.encoder(packing.byte_bpe_path())
    for r, t in zip(got.orderBy("doc_id").collect(), texts):
        w = [x for x in re.split("[\x20\x09-\x0d]+", t or "") if x]
        left = re.sub("[^\x20\x09-\x0d0-9]*[0-9][^\x20\x09-\x0d]*", "", t or "")
        assert (r.words, r.words_kept) == (len(w), sum(not re.search("[0-9]", x) for x in w))
        assert (r.bpe, r.bpe_kept) == (len(encode(t or "")) // 4, len(encode(left)) // 4)


def test_query_matches_brute_force(spark):
    path = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{path}/documents.parquet").orderBy("doc_id").collect()
    encode, seen, want = packing.encoder(packing.byte_bpe_path()), set(), Counter()
    for r in docs:
        if r.text in seen:
            continue
        seen.add(r.text)
        scrubbed = re.sub("[^\x20\x09-\x0d0-9]*[0-9][^\x20\x09-\x0d]*", "", r.text)
        for tok, n in (("words-v1", len(re.findall("[^\x20\x09-\x0d]+", scrubbed))), ("byte_bpe_50k-v1", len(encode(scrubbed)) // 4)):
            want[r.source, r.lang, tok, "docs"] += 1
            want[r.source, r.lang, tok, "tokens"] += n
    got = Counter()
    for r in queries.QUERIES["op3_delta_token_rollups"](spark, path).collect():
        got[r.source, r.lang, r.tokenizer, "docs"] += r.n_docs
        got[r.source, r.lang, r.tokenizer, "tokens"] += r.n_tokens
    assert got == want


def test_query_agrees_with_sql(spark):
    path = "/root/testdata/sf0.01"
    assert_agrees(queries.QUERIES["word_rollups"](spark, path), queries.ORACLE_SQL["word_rollups"], path)


def test_repeated_rows_and_null_ids(spark):
    hot = [(100 + i, "hot text 1", "web", "en") for i in range(300)]
    rows = [(1, "a b", "web", "en"), (1, "a b", "web", "en"), (None, "c 2 d", "web", "en"), (None, "c 2 d", "web", "en"), (7, "a b", "web", "de")]
    rows += [(3, None, None, "en"), (None, None, "web", None), (4, "", "web", None), (4, "", "a", None), (9, "a b", None, None), (5, "x", "web", "en")]
    for some in (rows[:5], rows, rows + hot, []):
        docs = spark.createDataFrame([(*r, "n", "h") for r in some], "doc_id long, text string, source string, lang string, n string, h string").repartition(3)
        seen, want = set(), Counter()
        for i, text, source, lang in sorted(some, key=lambda r: (r[0] is None, r[0] or 0, r[2] is None, r[2] or "", r[3] is None, r[3] or "")):
            if text not in seen:
                seen.add(text)
                want[source, lang, "docs"] += 1
                want[source, lang, "tokens"] += sum(not re.search("[0-9]", w) for w in (text or "").split())
        got = Counter()
        for r in queries._maintained(docs, ("words",)).collect():
            assert r.tokenizer == "words-v1"
            got[r.source, r.lang, "docs"], got[r.source, r.lang, "tokens"] = r.n_docs, r.n_tokens
        assert got == want


def test_a_batch_that_comes_while_compacting_counts_once(spark, tmp_path, monkeypatch):
    store = rollup.TokenRollup(spark, str(tmp_path / "r"))
    one = spark.createDataFrame([("insert", "s", "en", "v1", 4, 0)], EVENTS)
    store.commit("first", one)
    sums = store._sums
    monkeypatch.setattr(store, "_sums", lambda names: (store.commit("second", one), sums(names))[1])
    store.compact()
    monkeypatch.undo()
    assert rows(store) == {("s", "en", "v1"): (2, 8)}
