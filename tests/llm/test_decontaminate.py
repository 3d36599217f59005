import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, queries
from tests.llm.oracle import assert_agrees

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def toks(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    w = toks(text)
    hit, names = set(), set()
    for name, t in items:
        v = toks(t)
        n = min(10, len(v))
        for p in range(len(v) - n + 1) if n else ():
            for q in range(len(w) - n + 1):
                if w[q : q + n] == v[p : p + n]:
                    hit.update(range(q, q + n))
                    names.add(str(name))
    return len(w), len(hit), sorted(names)


def cases():
    rng = random.Random(4)
    vocab = ["the", "of", "É", "naïve", "a1", "b", "zz"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([0, 1, 3, 9, 10, 11, 25, 40, 12])]
    items += [(20, None), (21, "!!"), (7, items[7][1]), (22, "the " * 30), (30, "Unique-Words: q w e r t y u i o p l")]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 2, 30, 200])))) for i in range(40)]
    docs += [(50, None), (51, ""), (51, ""), (52, "x " * 50 + items[7][1].upper().replace("É", "É") + " tail"), (53, items[6][1] + " " + items[6][1]), (54, "the, " * 500), (None, items[7][1]), (55, "q w e r t y u i o"), (56, "Q.W.E.R.T.Y.U.I.O.P")]
    return docs, items


@pytest.mark.parametrize("block_bytes", [1 << 20, 700])
def test_matches_brute_force(spark, block_bytes):
    docs, items = cases()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert (len(decontaminate.blocks(b, "item_id", "text", block_bytes)) > 1) == (block_bytes == 700)
    got = sorted(((r.doc_id, r.n_words, sum(h.end - h.start for h in r.hits), r["items"]) for r in decontaminate.hits(d, b, block_bytes=block_bytes).collect()), key=repr)
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=repr)
    assert got == want
    kept = decontaminate.decontaminate(d, b, block_bytes=block_bytes)
    assert kept.columns == d.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted((i for i, t in docs if not brute(t, items)[1]), key=repr)
    assert decontaminate.hits(d.where(F.lit(False)), b).count() == 0
    assert {len(r.hits) for r in decontaminate.hits(d, b.where(F.lit(False))).collect()} == {0}


def test_winnowing_keeps_one_print_per_span():
    h = np.random.default_rng(0).integers(0, 50, 500).astype(np.uint64)
    kept = set(decontaminate.winnow(h, 6).tolist())
    for i in range(len(h) - 5):
        assert any(j in kept for j in range(i, i + 6))
        low = h[i : i + 6].min()
        assert all(i + j in kept for j in range(6) if h[i + j] == low)


def test_query_agrees_with_sql(spark):
    for d in ("sf0.001", "sf0.01"):
        path = f"/root/testdata/{d}"
        assert_agrees(queries.QUERIES["op9_winnowing_decontamination"](spark, path), queries.ORACLE_SQL["op9_winnowing_decontamination"], path)


def test_digest():
    assert decontaminate.items_digest(["9", "10"]) == hashlib.sha256(b"10,9").hexdigest()
