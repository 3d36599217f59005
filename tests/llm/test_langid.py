import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import langid, queries


def normal(text):
    return "\x01\x01\x01" + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())).lstrip(" ")


class Brute:
    """Interpolated Kneser-Ney by dictionaries, straight from the definition."""

    def __init__(self, texts, vocabulary):
        self.v = vocabulary
        self.c = {4: Counter()}
        for t in texts:
            s = normal(t)
            for i in range(3, len(s)):
                self.c[4][s[i - 3 : i + 1]] += 1
        for n in (3, 2, 1):
            self.c[n] = Counter(g[1:] for g in self.c[n + 1])
        self.d, self.total, self.types = {}, defaultdict(Counter), defaultdict(Counter)
        for n, c in self.c.items():
            ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.d[n] = min(0.9, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5
            for g, v in c.items():
                self.total[n][g[:-1]] += v
                self.types[n][g[:-1]] += 1

    def p(self, g):
        n = len(g)
        if n == 0:
            return 1 / self.v
        ctx, total = g[:-1], self.total[n][g[:-1]]
        if not total:
            return self.p(g[1:])
        return max(self.c[n][g] - self.d[n], 0) / total + self.d[n] * self.types[n][ctx] / total * self.p(g[1:])

    def h(self, text):
        s = normal(text)
        return -sum(math.log(self.p(s[i - 3 : i + 1])) for i in range(3, len(s))) / max(1, len(s) - 3)


TRAIN = {"aa": ["The cat, the HAT and the mat.", "that is the thing", "é über the"], "bb": ["le chat et le chien", "la maison est là", "ça va"], "cc": ["Привет мир", "мир и 世界 x\x01y"]}


def fitted():
    counts = {}
    for lang, texts in TRAIN.items():
        counts[lang] = np.unique(langid.symbols(texts)[0], return_counts=True)
    return langid.Model.fit(counts)


def test_entropies_match_the_definition():
    model = fitted()
    alphabet = {c for texts in TRAIN.values() for t in texts for c in normal(t)[3:]}
    brute = [Brute([t.replace("\x01", " ") for t in TRAIN[name]], len(alphabet) + 1) for name in model.languages]
    texts = ["the chat", "xyz qqq", "", None, "42 !!", "мир the 世", "   lead", "a", "🙂𝒜b", "the  cat\n the", "é" * 500]
    h, sizes, letters = model.entropies(texts)
    for i, t in enumerate(texts):
        s = normal(t)
        assert sizes[i] == len(s) - 3 and letters[i] == sum(c.isalpha() for c in t or "")
        if len(s) > 3 and "𝒜" not in (t or ""):
            assert h[i] == pytest.approx([b.h(t) for b in brute], rel=1e-4)
    alone = model.entropies([texts[5]])[0][0]
    assert alone == pytest.approx(h[5])


def test_hash_array():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 5000).astype(np.uint64))
    table = langid.HashArray(keys, keys[:, None] % 1000)
    at = table.find(keys)
    assert (at >= 0).all() and (table.rows[at, 0] == keys % 1000).all()
    assert (table.find(keys + np.uint64(1)) < 0).sum() == len(keys) - np.isin(keys + np.uint64(1), keys).sum()


def test_edges(spark):
    rows = [(i, t, lang) for lang, texts in TRAIN.items() for i, t in enumerate(texts * 30)] + [(900, None, "aa"), (901, "the", None), (902, "", "bb"), (903, "123", "aa"), (None, "the hat", "aa"), (901, "the", None), (904, "the cat " * 20_000, "aa")]
    df = spark.createDataFrame([(*r, 1.0, True) for r in rows], "doc_id long, text string, lang string, score double, rejected boolean")
    model = langid.train(df)
    out = langid.identify(df, model).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    by = {r.doc_id: r for r in out if (r.doc_id or 0) >= 900}
    assert by[900].lang_pred == by[902].lang_pred == by[903].lang_pred == "und" and by[900].rejected and by[900].score == 0
    assert by[901].lang_pred == "aa" == by[904].lang_pred and not by[904].rejected
    assert all(0 <= r.score <= 1 for r in out)
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == sum(not r.rejected for r in out)
    empty = langid.train(df.where(F.lit(False)))
    assert {r.lang_pred for r in langid.identify(df, empty).collect()} == {"und"}
    assert langid.identify(df.where(F.lit(False)), model).count() == 0


def test_model_size_is_bounded(spark):
    df = spark.createDataFrame([(t, lang) for lang, texts in TRAIN.items() for t in texts], "text string, lang string")
    model = langid.train(df, max_grams=5)
    assert 0 < len(model.grams[4].hashes) <= 3 * 60


def test_all_grams_are_kept_however_many_languages(spark):
    # 120 languages, for which 582 4-grams each used to be left; most of these occur once
    rng = random.Random(0)
    texts = {f"l{i:03}": " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(200)) for i in range(120)}
    model = langid.train(spark.createDataFrame([(t, lang) for lang, t in texts.items()], "text string, lang string"))
    every = np.unique(langid.symbols(list(texts.values()))[0])
    assert len(model.grams[4].hashes) == len(every) and len(model.grams[4].values) == sum(len(np.unique(langid.symbols([t])[0])) for t in texts.values())
    brute = Brute([texts["l007"]], 28)
    assert model.entropies(["abc " + texts["l007"][:300]])[0][0][7] == pytest.approx(brute.h("abc " + texts["l007"][:300]), rel=1e-4)
    assert model.predict([t[-80:] for t in texts.values()])[0] == list(texts)


def test_a_dirty_label_column_is_no_error(spark, monkeypatch):
    # more labels than a model used to take, most of one short text
    monkeypatch.setattr(langid, "FETCHED", 400)
    rows = [(t, lang) for lang, texts in TRAIN.items() for t in texts] + [(f"zz{chr(0x4E00 + i)}", f"?{i}") for i in range(700)]
    df = spark.createDataFrame(rows, "text string, lang string")
    model = langid.train(df)
    assert model.languages == sorted({lang for _, lang in rows}) and len(model.median) == len(model.languages)
    assert model.predict(["the cat", "le chat", f"zz{chr(0x4E00 + 77)}"])[0] == ["aa", "bb", "?77"]
    sizes = {"a": 5, "b": 9, "c": 1, "d": 2}
    assert list(langid._blocks(sizes, 6)) == [["a"], ["b"], ["c", "d"]]


def test_discounts_are_those_of_all_counts():
    counts = {lang: np.unique(langid.symbols(texts)[0], return_counts=True) for lang, texts in TRAIN.items()}
    whole, cut = langid.Model.fit(counts), langid.Model.fit(counts, 5)
    assert len(cut.grams[4].hashes) < len(whole.grams[4].hashes)
    for n in (1, 2, 3):
        assert (cut.grams[n].values == whole.grams[n].values).all() and (cut.weights[n + 1].values == whole.weights[n + 1].values).all()


def test_scoring_in_steps_changes_nothing(monkeypatch):
    model = fitted()
    texts = ["the chat", "", "мир the 世", None, "é" * 500, "42", "la maison est là " * 20]
    whole = model.entropies(texts)[0]
    monkeypatch.setattr(langid, "CELLS", 3 * 7)
    assert np.allclose(model.entropies(texts)[0], whole)


def test_calibration_takes_all_rows(spark):
    # 30,000 rows of one language, which a sample used to thin, and ten of another
    rng = random.Random(0)
    common = [" ".join(rng.choice(["the", "cat", "hat", "mat", "and", "that"]) for _ in range(12)) for _ in range(30_000)]
    rare = ["ça va là " * (1 + i) + "chien maison est"[i:] for i in range(10)]
    rows = [(t, "aa") for t in common] + [(t, "bb") for t in rare]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(4))
    h, sizes, _ = model.entropies([t for t, _ in rows])
    best, low = h.argmin(axis=1), h.min(axis=1)
    for i, name in enumerate(model.languages):
        own = np.sort(low[best == i])
        assert len(own) >= 10
        assert own[int(0.49 * len(own)) - 1] <= model.median[name] <= own[int(0.51 * len(own))]
        excess = np.sort(((low - model.median[name]) * np.sqrt(sizes))[best == i])
        assert excess[int(0.9985 * len(own)) - 1] <= model.bound[name] <= excess[min(len(own) - 1, int(0.9995 * len(own)))]


def test_a_language_never_predicted_rejects_too(spark):
    rows = [("the cat and the hat and the mat", "aa")] * 20 + [("the cat and the hat and the mat", "bb")] * 20
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert set(model.median) == set(model.bound) == {"aa", "bb"}


def test_held_out_accuracy_and_rejection(spark):
    path = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    out = queries.QUERIES["op4_kneser_ney_language_id"](spark, path).collect()
    assert len(out) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    test = [r for r in out if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in test) > 0.97 * len(test)
    assert sum(r.rejected for r in out) < 0.01 * len(out)
    rng = random.Random(0)
    junk = spark.createDataFrame([(i, " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(7)) for _ in range(40))) for i in range(50)], "doc_id long, text string")
    table = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.train(table.where(~langid.held_out("doc_id")))
    assert sum(r.rejected for r in langid.identify(junk, model).collect()) == 50
