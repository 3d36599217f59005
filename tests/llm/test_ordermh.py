import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import ordermh, queries


M64, ODD = (1 << 64) - 1, 0x9E3779B97F4A7C15


def mix(x):
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & M64
    x = (x ^ x >> 29) * ODD & M64
    return x ^ x >> 32


def gram_hash(gram, k):
    """A k-mer's hash from the halves of its code points' hashes; a shorter text's from its bytes."""
    if len(gram) < k:
        return mix(int.from_bytes(hashlib.blake2b(gram.encode(), digest_size=8).digest(), "little"))
    level = [mix(ord(c) + 1) for c in gram]
    while len(level) > 1:
        level = [(x := (a * ODD + b) & M64) ^ x >> 31 for a, b in zip(level[::2], level[1::2])]
    return mix(level[0])


def brute_sketch(text, k=16, l=2, sketches=64):
    """Order MinHash from its definition in whole numbers, a k-mer at a time."""
    if not text:
        return [0] * sketches
    grams = [text[i : i + k] for i in range(len(text) - k + 1)] or [text]
    h = [gram_hash(g, k) for g in grams]
    base = []
    for i, x in enumerate(h):
        nth = grams[:i].count(grams[i])
        base.append((mix(x + nth * 0xC2B2AE3D27D4EB4F & M64) if nth else x) >> 32)
    multipliers = np.random.Generator(np.random.PCG64(20_190_101)).integers(0, 1 << 31, sketches, np.uint32).tolist()
    out = []
    for m in multipliers:
        order = sorted(range(len(base)), key=lambda i: (base[i] * (2 * m + 1) & 0xFFFFFFFF, i))[:l]
        entry = 0
        for i in sorted(order):
            entry = mix(entry * ODD + h[i] & M64)
        out.append(entry >> 48)
    return out


def defined_likeness(a, b, k=16, l=2, sketches=400):
    """Share of equal selections, each by a keyed cryptographic hash of (k-mer, occurrence number)."""

    def selections(text):
        seen, elements = {}, []
        for i in range(len(text) - k + 1):
            g = text[i : i + k]
            seen[g] = seen.get(g, 0) + 1
            elements.append((g, seen[g]))
        for s in range(sketches):
            key = s.to_bytes(4, "big")
            ranked = sorted(range(len(elements)), key=lambda i: hashlib.blake2b(repr(elements[i]).encode(), key=key, digest_size=8).digest())
            yield tuple(elements[i][0] for i in sorted(ranked[:l]))

    return sum(x == y for x, y in zip(selections(a), selections(b))) / sketches


def test_likeness_is_that_of_the_definition():
    rng = random.Random(4)
    own, defined = [], []
    for i in range(12):
        a = "".join(rng.choice("abcdefgh ") for _ in range(120))
        cut = rng.randrange(10, 110)
        b = [a[:cut] + a[cut + 3 :], a + a[:cut], a[cut:] + a[:cut], a[:cut] + a[:40] + a[cut:]][i % 4]
        own.append(np.mean([x == y for x, y in zip(brute_sketch(a, sketches=400), brute_sketch(b, sketches=400))]))
        assert (ordermh.sketch(a, sketches=400) == brute_sketch(a, sketches=400)).all()
        defined.append(defined_likeness(a, b))
        assert abs(own[-1] - defined[-1]) < 0.15
    assert abs(np.mean(own) - np.mean(defined)) < 0.04


def test_a_first_occurrence_is_the_same_element_when_its_kmer_recurs():
    s = "".join(chr(0x100 + i) for i in range(36))
    t = s + "###" + s
    assert set(ordermh.numbered(ordermh.kmers(s)).tolist()) <= set(ordermh.numbered(ordermh.kmers(t)).tolist())
    # a line repeated at the end of a text changes little
    rng = random.Random(5)
    lines = ["".join(rng.choice("abcdefghijk ") for _ in range(60)) for _ in range(40)]
    text = "\n".join(lines)
    assert ordermh.likeness(ordermh.sketch(text), ordermh.sketch(text + "\n" + lines[3])) > 0.75


@pytest.mark.parametrize("text", ["", "a", "short", "x" * 16, "x" * 40, "the cat sat on the mat. " * 6, "é世界🙂 " * 12, "abcdefghijklmnopqrstuvwxyz" * 3])
def test_sketch_matches_definition(text):
    assert ordermh.sketch(text).tolist() == brute_sketch(text)


def test_blocks_do_not_matter(monkeypatch):
    text = "".join(random.Random(0).choice("abc def") for _ in range(3000))
    want = ordermh.sketch(text)
    monkeypatch.setattr(ordermh, "STEP", 7000)
    assert (ordermh.sketch(text) == want).all()


def test_likeness_falls_with_edits_and_moves():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    text = " ".join(words)
    own = ordermh.sketch(text)
    likes = []
    for n in (0, 10, 60, 200):
        changed = list(words)
        for i in rng.sample(range(400), n):
            changed[i] = "zz" + changed[i][::-1]
        likes.append(ordermh.likeness(own, ordermh.sketch(" ".join(changed))))
    assert likes[0] == 1 and likes == sorted(likes, reverse=True) and likes[-1] < 0.2
    # the same words in another order share k-mers, but not their order
    moved = " ".join(words[200:] + words[:200])
    assert ordermh.likeness(own, ordermh.sketch(moved)) < 0.75


def brute_compare(rows):
    order = sorted(rows, key=lambda r: -r[0])
    out = []
    for i, (doc_id, text) in enumerate(order):
        nxt = order[(i + 1) % len(order)][1] or ""
        text = text or ""
        n = len(text) // 3
        changed = text[: len(text) - n] + nxt[:n]
        a, b, c = (ordermh.sketch(t) for t in (text, changed, nxt))
        out.append((doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), ordermh.as_hex(a), ordermh.as_hex(b), float((a == b).mean()), float((a == c).mean())))
    return sorted(out)


@pytest.mark.parametrize("n_ranges", [1, 3, 50])
def test_edges(spark, n_ranges):
    rng = random.Random(2)
    rows = [(rng.randrange(10**6), "".join(rng.choice("ab cé") for _ in range(rng.choice([0, 1, 5, 300])))) for _ in range(60)]
    rows = list(dict(rows).items()) + [(-5, None), (2 * 10**6, "same text here " * 9), (2 * 10**6 + 1, "same text here " * 9)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(4)
    assert sorted(map(tuple, ordermh.compare_with_next(df, n_ranges=n_ranges).collect())) == brute_compare(rows)


def test_null_and_repeated_ids_and_few_rows(spark):
    schema = "doc_id long, text string"
    one = ordermh.compare_with_next(spark.createDataFrame([(7, "abc def ghi")], schema)).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(7, 1.0)]
    assert ordermh.compare_with_next(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "x y z"), (1, "x y z"), (None, "null id"), (3, "w"), (None, None), (1, "other")]
    for n in (1, 2, 5):
        got = ordermh.compare_with_next(spark.createDataFrame(rows, schema), n_ranges=n).collect()
        assert sorted((r.doc_id is None, r.doc_id, r.n_chars) for r in got if r.doc_id is not None) == [(False, 1, 5), (False, 1, 5), (False, 1, 5), (False, 3, 1)]
        assert sum(r.doc_id is None for r in got) == 2
    prints = ordermh.fingerprint(spark.createDataFrame([(1, None), (2, ""), (3, "a b")], schema)).collect()
    assert len({r.fingerprint for r in prints}) == 2 and all(len(r.fingerprint) == 256 for r in prints)


def test_query_matches_brute_force(spark):
    path = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    assert sorted(map(tuple, queries.QUERIES["op2_order_minhash"](spark, path).collect())) == brute_compare(rows)
