import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import queries, secrets

ASSIGN = re.compile(r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")


def brute(text):
    """The base kinds, by the plain patterns over the whole text."""
    text = text or ""
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m.group()) >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text) if len(m.group()) >= 24]
    return sorted(out, key=lambda s: (s[1], secrets.BASE.index(s[0])))


def base(text):
    return [s[:3] for s in secrets.find(None if text is None else text.encode()) if s[0] in secrets.BASE]


CASES = [
    None, "", "password=abc", "password=abcdef", "é Token : 'a.b-c+d/e=f'", "api_key=\"x12345\" apikey=y1234567", "API_KEY==abcdef", "secret secret: longvalue1", "tokentoken=abcdefg",
    "AKIA" + "A" * 15, "AKIA" + "A" * 16, "xAKIAAKIA" + "Z9" * 9, "0" * 23, "0" * 24, "世界 " + "deadbeef" * 3 + "g", "password=" + "a" * 30, "password:\tabcdefg", "passwd=token=abcdef", "ToKeN=abcdefK",
]


@pytest.mark.parametrize("text", CASES)
def test_base_equals_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=1000, deadline=None)
@given(st.lists(st.sampled_from(["token", "secret", "api", "_", "key", "=", ":", " ", "'", '"', "AKIA", "ABCDEFGH12", "deadbeef", "0123abcd", "x", "é", "\n", "passwd"]), max_size=14).map("".join))
def test_base_equals_the_patterns_on_noise(text):
    assert base(text) == brute(text)


def test_battery_is_uniform_for_random_strings_and_near_zero_for_others():
    rng = np.random.default_rng(0)
    for size in (16, 36, 64):
        for n in (24, 40, 100):
            ps = np.array([secrets.battery(rng.integers(0, size, n), size) for _ in range(2000)])
            assert abs((ps < 0.5).mean() - 0.5) < 0.1 and (ps < 0.01).mean() < 0.03
    for word in (b"the-quick-brown-fox-jumps-2024", b"aaaaaaaaaaaaaaaaaaaaaaaaa1", b"0123456789012345678901234567890123456789", b"internationalization12"):
        assert secrets.judge(word)[1] < 0.01


def test_parts_of_runs_are_judged():
    token, other = "9aF3kQ7LmZ2xW8bTnR5vYc1D", "Kd83_mZq-0PxV7tRw2LbYs9cNf"
    letters = "qWzXkPvTjRmLbNyHsGfD"
    cases = [
        (f"AWS_ACCESS_ID={token}", [token]),
        (f"?sig={token}==", [token + "=="]),
        (f"https://host.org/a+b/{other}/x", [other]),
        (f"sk-live-x/{token}+{token}-old", [f"x/{token}+{token}"]),
        (f"é {letters} é", [letters]),
        (f"client={token}=password=abcdefgh", [token]),
        (f"api_key = '{other}' then", [other]),
        ("commit deadbeef0123456789ab4c5d6e7f80917263", ["deadbeef0123456789ab4c5d6e7f80917263"]),
        ("=" * 30 + " " + "a+b-c/" * 10, []),
    ]
    for text, want in cases:
        got = [text[a:b] for kind, a, b, *_ in secrets.find(text.encode()) if kind == "random"]
        assert got == want, text
    assert secrets.judge(letters.encode())[0] == "letters52:20"
    rng = random.Random(1)
    keys = [key(rng) for _ in range(40)]
    ps = [[s[4] for s in secrets.find(f"NAME={k}".encode())] for k in keys]
    assert ps == [[secrets.judge(k.encode())[1]] for k in keys]


def test_letters_alone_are_uniform_and_words_are_not():
    rng = random.Random(2)
    for alphabet in (string.ascii_lowercase, string.ascii_letters):
        ps = np.array([secrets.judge("".join(rng.choice(alphabet) for _ in range(24)).encode())[1] for _ in range(3000)])
        assert abs((ps < 0.5).mean() - 0.5) < 0.1 and (ps < 0.05).mean() < 0.08
    for word in (b"keitstlichschenverpf", b"donaudampfschifffahrtsgesellschaft", b"anticonstitutionnellement"):
        assert secrets.judge(word)[1] < 0.05


def test_threshold_controls_false_discoveries():
    flat = [10] * 200
    assert secrets.choose({"s": flat}) == {"s": 0.01}
    piled = [10_000] * 20 + [10] * 180
    assert secrets.choose({"s": piled})["s"] >= 0.1
    assert secrets.choose({"s": [50] * 100 + [0] * 100}) == {}


def test_sparse_strata_have_a_fixed_level():
    low = [10_000, *[0] * 199]
    alone = list(low)
    alone[60] = 1
    assert secrets.choose({"s": alone, "t": low}) == {"s": secrets.LEVEL, "t": secrets.LEVEL}
    full = list(low)
    full[60] = secrets.SPARSE
    assert secrets.choose({"s": full}) == {}


def test_copies_count_once(spark):
    rng = random.Random(3)
    every = [key(rng) for _ in range(200)]
    copied = next(k for k in every if 0.25 < secrets.judge(k.encode())[1] < 0.35)
    rows = [(i, f"see {k} there") for i, k in enumerate(every)]
    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = once.union(spark.createDataFrame([(1000 + i, f"see {copied}") for i in range(2000)], once.schema))
    limits = secrets.thresholds(secrets.candidates(once))
    assert limits == secrets.thresholds(secrets.candidates(often)) == {"base62:32": 0.01}
    found = secrets.scan(often).where(F.size("spans") == 0).count()
    assert found == 0
    rare = "0123456789ABCDEF" + "".join(rng.choice("0123456789ABCDEF") for _ in range(40))
    while not 0.1 < secrets.judge(rare.encode())[1] < 0.5:
        rare = "".join(rng.choice("0123456789ABCDEF") for _ in range(56))
    assert [len(r.spans) for r in secrets.scan(spark.createDataFrame([(1, f"id {rare}")], once.schema)).collect()] == [1]


def key(rng, n=40, alphabet=string.ascii_letters + string.digits):
    while True:
        out = "".join(rng.choice(alphabet) for _ in range(n))
        if (seen := secrets.judge(out.encode())) and seen[1] > 0.02:
            return out


def test_edges(spark):
    rng = random.Random(0)
    keys = [key(rng) for _ in range(60)]
    rows = [(i, f"é some words {k} more words") for i, k in enumerate(keys)]
    rows += [(100, None), (101, ""), (102, "password=hunter2hunter2"), (102, "password=hunter2hunter2"), (None, "AKIA" + "A1" * 10), (103, "plain-words-with-hyphens-and-2-digits"), (104, "w " * 100_000 + "token: abcdefgh")]
    df = spark.createDataFrame([(*r, 5, "k") for r in rows], "doc_id long, text string, n_chars int, kind string")
    out = {r.doc_id: r.spans for r in secrets.scan(df).collect()}
    assert len(out) == 60 + 6
    found = sum(len(out[i]) == 1 and rows[i][1][out[i][0].start : out[i][0].end] == k for i, k in enumerate(keys))
    assert found >= 57
    assert out[100] == out[101] == out[103] == [] and [s.kind for s in out[104]] == ["assign"]
    clean = secrets.redact(df, length_col="n_chars")
    assert clean.columns == df.columns
    texts = {r.doc_id: (r.text, r.n_chars) for r in clean.collect()}
    assert texts[102] == ("[SECRET]", 8) and texts[100] == (None, None) and texts[103][0] == rows[-2][1]
    assert secrets.scan(df.where(F.lit(False))).count() == 0


ALPHABETS = {
    "hex": string.digits + "abcdef", "HEX": string.digits + "ABCDEF", "lower26": string.ascii_lowercase, "upper26": string.ascii_uppercase,
    "base32": string.ascii_uppercase + "234567", "lower36": string.digits + string.ascii_lowercase, "upper36": string.digits + string.ascii_uppercase,
    "letters52": string.ascii_uppercase + string.ascii_lowercase, "base62": string.digits + string.ascii_uppercase + string.ascii_lowercase,
    "letters54": string.ascii_uppercase + string.ascii_lowercase + "+/", "letters54url": string.ascii_uppercase + string.ascii_lowercase + "-_",
    "base64": string.digits + string.ascii_uppercase + string.ascii_lowercase + "+/", "base64url": string.digits + string.ascii_uppercase + string.ascii_lowercase + "-_",
}


def tail(z):
    return 0.5 * math.erfc(z / math.sqrt(2))


def brute_p(body, alphabet):
    """The tests by their formulas, a symbol at a time."""
    n, size = len(body), len(alphabet)
    x = [alphabet.index(c) for c in body]
    chi = sum((body.count(c) - n / size) ** 2 / (n / size) for c in alphabet)
    mean, var = size - 1, 2 * (size - 1) * (n - 1) / n
    c, df = var / (2 * mean), 2 * mean**2 / var
    ps = [tail(((chi / c / df) ** (1 / 3) - 1 + 2 / (9 * df)) / (2 / (9 * df)) ** 0.5)]
    side = [v >= size / 2 for v in x]
    a = sum(side)
    runs, expected = 1 + sum(s != t for s, t in zip(side, side[1:])), 1 + 2 * a * (n - a) / n
    var = (expected - 1) * (expected - 2) / (n - 1)
    ps.append(2 * tail(abs(runs - expected) / var**0.5) if 0 < a < n and var > 0 else 0)
    m = sum(x) / n
    power = sum((v - m) ** 2 for v in x)
    ps.append(2 * tail(abs(sum((v - m) * (w - m) for v, w in zip(x, x[1:])) / power + 1 / n) * n**0.5) if power else 0)
    if not set(alphabet) & set(string.digits):
        w = [math.log(secrets._PROSE[ord(c.lower()) - 97] if c.isalpha() else 100 / 26) for c in alphabet]
        mu = sum(w) / size
        sd = (sum((v - mu) ** 2 for v in w) / size) ** 0.5
        ps.append(tail(sum((w[v] - mu) / sd for v in x) / n**0.5))
    half = -sum(math.log(max(p, 1e-300)) for p in ps)
    return math.exp(-half) * sum(half**i / math.factorial(i) for i in range(len(ps)))


def brute_candidates(text):
    """(start, end, stratum, p, string) of every candidate."""
    out = []

    def look(a, b):
        body = text[a:b].strip("=")
        if len(body) < 20:
            return b - a < 20
        for name, alphabet in ALPHABETS.items():
            if set(body) <= set(alphabet):
                out.append((a, b, f"{name}:{max(x for x in (20, 32, 48, 80) if x <= len(body))}", brute_p(body, alphabet), body))
                return True
        return False

    for run in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        for part in re.finditer(r"[^=]+(=+$)?", run.group()):
            a, b = run.start() + part.start(), run.start() + part.end()
            if b - a >= 20 and not look(a, b):
                for x, y in sorted({(a + m.start(), a + m.end()) for cut in ("[^/]+", "[^_-]+") for m in re.finditer(cut, text[a:b])}):
                    look(x, y)
    return out


def brute_limits(every, fdr=0.05):
    """Each stratum's threshold, each distinct string once, by counting at every grid point."""
    seen = {(s, body): p for found in every for _, _, s, p, body in found}
    out = {}
    for stratum in {s for s, _ in seen}:
        ps = [min(199, int(p * 200)) for (s, _), p in seen.items() if s == stratum]
        if sum(p >= 2 for p in ps) < 50:
            out[stratum] = 0.05
            continue
        random_ones = 2 * sum(p >= 100 for p in ps)
        for i in range(2, 101):
            kept = sum(p >= i for p in ps)
            if random_ones and kept - random_ones * (1 - i / 200) <= fdr * kept:
                out[stratum] = i / 200
                break
    return out


def check(rows, docs):
    """Rows of the query against the brute-force version of base kinds and added spans."""
    every = {i: brute_candidates(t) for i, t in docs.items()}
    limits = brute_limits(every.values())
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[0] == k for s in want) for k in secrets.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(":".join(map(str, s)) for s in want).encode()).hexdigest()
        added = [("random", a, b) for a, b, s, p, _ in every[r.doc_id] if p >= limits.get(s, 2)]
        both = sorted(want + added, key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert r.spans == ",".join(":".join(map(str, s)) for s in both)
    return every, limits


def test_query_matches_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_randomness_secret_scan"](spark, path).collect()
    check(rows, docs)
    assert sum(r.n_assign for r in rows) > 0 and sum(r.n_hex for r in rows) > 0 and any("random" in r.spans for r in rows)


def test_planted_keys_of_each_encoding_are_found(spark, tmp_path):
    """Recall of at least 0.9 in every encoding over a whole table, and false discoveries within the level."""
    rng = random.Random(6)
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = {r.doc_id: r.text for r in table.collect()}
    forms = ["X_ID={}", "token: '{}'", "https://host.example/get?sig={}", "see {} there", '"{}"']
    planted = {}
    for n, i in enumerate(sorted(docs)[:960]):
        name = ("hex", "HEX", "base32", "lower36", "upper36", "base62", "base64", "base64url")[n % 8]
        value = "".join(rng.choice(ALPHABETS[name]) for _ in range(rng.randrange(28, 64)))
        words = docs[i].split(" ")
        words.insert(rng.randrange(len(words) + 1), forms[n // 8 % 5].format(value))
        docs[i], planted[i] = " ".join(words), (name, value)
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = queries.QUERIES["op10_randomness_secret_scan"](spark, str(tmp_path)).collect()
    every, _ = check(rows, docs)
    hit, total, false, found = Counter(), Counter(planted[i][0] for i in planted), set(), set()
    real = {v for _, v in planted.values()} | {s for i in docs for s in re.findall("[0-9a-f]{32,}|[0-9A-F]{32,}", docs[i])}
    for r in rows:
        mine = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random")]
        texts = [docs[r.doc_id][a:b] for a, b in mine]
        if r.doc_id in planted:
            name, value = planted[r.doc_id]
            hit[name] += any(value in t for t in texts)
        found |= {t.strip("=") for t in texts}
    false = {t for t in found if not any(v in t or t in v for v in real)}
    assert all(hit[k] >= 0.9 * total[k] for k in total), hit
    assert len(false) <= 0.05 * len(found), false


def test_base_spans_agree_with_sql(spark):
    from tests.llm.oracle import assert_agrees

    path = "/root/testdata/sf0.01"
    assert_agrees(queries.QUERIES["secret_base_spans"](spark, path), queries.ORACLE_SQL["secret_base_spans"], path)
