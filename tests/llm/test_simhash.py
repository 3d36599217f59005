import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quern.llm import simhash


def brute_fp(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, fps):
    n = len(rows)
    near = defaultdict(set)
    for i in range(n):
        for j in range(n):
            if i != j and (fps[i] ^ fps[j]).bit_count() <= 2:
                near[i].add(j)
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], f"{fps[i]:016x}", len(near[i]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b C", "é È x\x0by\x1fz w", "a " * 3000, "x y z " * 100 + "q"])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fp(text)


def test_index_lists_share_an_entry_within_two_bits():
    g, rng = simhash.golay(), np.random.default_rng(1)
    assert sorted(set(g.sizes.tolist())) == [1, 6]
    words = rng.integers(0, 1 << 23, 3000)
    for flips in range(3):
        others = words.copy()
        for i in range(len(others)):
            for b in rng.choice(23, flips, replace=False):
                others[i] ^= 1 << int(b)
        lists = []
        for w in (words, others):
            got = defaultdict(set)
            for r, k in zip(*g.index_lists(w)):
                got[int(r)].add(int(k))
            lists.append(got)
        assert all(lists[0][i] & lists[1][i] for i in range(len(words)))


def test_links_match_brute_force_with_hot_buckets(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = set(base)
    for b in base[:10]:
        for _ in range(60):
            x = b
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = [(f - (1 << 64) if f >> 63 else f,) for f in sorted(fps)]
    df = spark.createDataFrame(signed, "fp long")
    want = {(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 2}
    for hot in (1, 8, 256):
        got = [(r.u, r.v) for r in simhash.links(df, 2, hot).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_of_a_long_chain(spark):
    order = list(range(100, 160))
    random.Random(5).shuffle(order)
    edges = [(min(a, b), max(a, b)) for a, b in zip(order, order[1:])] + [(1, 2), (2, 3), (7, 9)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{n: 100 for n in order}, 1: 1, 2: 1, 3: 1, 7: 7, 9: 7}


def test_edge_cases_match_brute_force(spark):
    rng = random.Random(2)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(4000))
    rows = [(5, "alpha beta gamma delta"), (3, "Alpha  beta gamma\tdelta"), (9, None), (8, ""), (2, "  "), (5, "alpha beta gamma delta"), (None, "lonely text here now"), (11, long), (12, long + " tail"), (13, "x"), (None, None)]
    df = spark.createDataFrame([(*r, "n", 1) for r in rows], "doc_id long, text string, fingerprint string, n_near int")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    assert got == brute(rows, [brute_fp(t) for _, t in rows])
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id for r in kept.collect() if r.doc_id is not None)) == sorted({c for d, _, _, c in brute(rows, [brute_fp(t) for _, t in rows]) if d is not None and c is not None and d == c})
    assert simhash.near_duplicates(df.where(F.lit(False))).count() == 0


def test_whole_small_table_matches_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str) == brute(rows, [brute_fp(t) for _, t in rows])


def test_rows_with_one_id_and_different_texts(spark):
    """Of each group one row stays, also where an id occurs in several groups, or twice in one."""
    words = [f"w{i}" for i in range(400)]
    base, other = " ".join(words), " ".join(reversed(words))
    near = next(t for i in range(400) if 0 < (brute_fp(t := " ".join(words[:i] + ["zz"] + words[i + 1 :])) ^ brute_fp(base)).bit_count() <= 2)
    rows = [(5, base), (5, near), (5, near), (9, base), (5, other), (7, other), (8, "alone here it is"), (3, None), (4, ""), (None, base)]
    for some in (rows, rows * 3, rows[6:]):
        df = spark.createDataFrame([(*r, 1, 2, "x") for r in some], "doc_id long, text string, fp int, __kept int, __FINGERPRINT string").repartition(5)
        kept = simhash.keep_one(df)
        assert kept.columns == df.columns
        got = [(r.doc_id, r.text) for r in kept.collect()]
        assert sum(i is None for i, _ in got) == sum(i is None for i, _ in some)
        named = sorted((i, t or "") for i, t in got if i is not None)
        first = min((base, near), key=lambda t: brute_fp(t) - (brute_fp(t) >> 63 << 64))
        want = [(3, ""), (8, "alone here it is")] + ([(5, first), (5, other)] if some != rows[6:] else [])
        assert named == sorted(want)
