import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.llm import pii, queries

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub(r"[^0-9]", "", s)


def brute(text):
    """The base kinds, by the plain patterns over the whole text."""
    text = text or ""
    ok = {
        "email": (EMAIL, lambda m: True),
        "ip": (IP, lambda m: all(int(p) <= 255 for p in m.group().split("."))),
        "card": (CARD, lambda m: 16 <= len(digits(m.group())) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits(m.group())))) % 10 == 0),
        "phone": (PHONE, lambda m: 8 <= len(digits(m.group())) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (pattern, good) in ok.items() for m in pattern.finditer(text) if good(m)]


def base(text):
    return [s for s in pii.find(text) if s[0] in pii.BASE]


CASES = [
    None, "", "a@b", "a@b.c", "a@b.com@c.org", "é.x@ex-ample.co.uk, y@@z.com x@.com", "1.2.3.4.5", "1.2.3", "256.1.1.1 01.2.3.255", "999.1.2.3.4.5.6.7",
    "4111 1111 1111 1111", "12 4111 1111 1111 1111", "4111-1111-1111-1111 5500", "4111  1111 1111 1111", "+1 (988) 555-2485 or +33.1 23 45 67 89", "+12", "+1 2 3+4 5 6 7 8 9 0 1", "++1234567890", "1" * 5000, "@" * 500, "+" * 500 + "1" * 20,
    "x@" + "a." * 1000 + "b", "1." * 1000, "世界 test@mail.example.com 10.0.0.1",
]


@pytest.mark.parametrize("text", CASES)
def test_base_equals_the_patterns(text):
    assert base(text) == brute(text)


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a@.+-( )0123459%é", max_size=60))
def test_base_equals_the_patterns_on_noise(text):
    assert base(text) == brute(text)


@pytest.mark.parametrize(
    ("text", "kind", "value"),
    [
        ("see ftp://bob:s3cret@host.org/x", "userinfo", "bob:s3cret"),
        ("IBAN: DE89 3704 0044 0532 0130 00.", "iban", "DE89 3704 0044 0532 0130 00"),
        ("my account number: 12345678 ok", "account", "12345678"),
        ("SSN 123-45-6789", "ssn", "123-45-6789"),
    ],
)
def test_added_spans(text, kind, value):
    assert [text[a:b] for k, a, b in pii.find(text) if k == kind] == [value]


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFFXXX", "DE89 3704 0044 0532 0130 00"),
        ("IBAN DE89370400440532013000 BIC COBADEFFXXX", "DE89370400440532013000"),
        ("IBAN: GB82 WEST 1234 5698 7654 32 12345678 AND MORE WORDS", "GB82 WEST 1234 5698 7654 32"),
        ("iban NO93 8601 1117 947 OSLO", "NO93 8601 1117 947"),
        ("IBAN LC55 HEMM 0001 0001 0012 0012 0002 3015 BIC X", "LC55 HEMM 0001 0001 0012 0012 0002 3015"),
    ],
)
def test_iban_ends_before_what_follows(text, value):
    assert [text[a:b] for k, a, b in pii.find(text) if k == "iban"] == [value]


@pytest.mark.parametrize("text", ["https://host.org/a", "IBAN: DE88 3704 0044 0532 0130 00", "on account of 3 things", "SSN 000-45-6789", "accounts 12345", "lessn 123-45-6789", "MIT License, version 2.0, January 2004"])
def test_clean_texts_have_no_spans(text):
    assert pii.find(text) == []


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "mail a@b.com"), (3, "mail a@b.com"), (None, "10.0.0.1"), (5, "x " * 100_000 + "a@b.com")]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, spans string")
    got = sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in pii.scan(df).collect()), key=repr)
    assert got == sorted(((i, brute(t)) for i, t in rows), key=repr)
    clean = pii.redact(df)
    assert clean.columns == df.columns
    assert sorted((r.text or "")[-12:] for r in clean.collect()) == sorted(["", "", "mail [EMAIL]", "mail [EMAIL]", "[IP]", " x x [EMAIL]"])
    assert pii.scan(df.where(F.lit(False))).count() == 0


def test_masks_overlapping_spans_once():
    assert pii.masked("abcdef", [("ip", 1, 3), ("email", 1, 4), ("card", 3, 5)]) == "a[EMAIL]f"


def test_query_matches_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{path}/documents.parquet").collect()}
    rows = queries.QUERIES["op5_anchor_expansion_pii"](spark, path).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in pii.BASE]
        said = ",".join(":".join(map(str, s)) for s in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.spans == ",".join(":".join(map(str, s)) for s in pii.find(docs[r.doc_id]))
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 20


def test_base_spans_agree_with_sql(spark):
    from tests.llm.oracle import assert_agrees

    path = "/root/testdata/sf0.01"
    assert_agrees(queries.QUERIES["pii_base_spans"](spark, path), queries.ORACLE_SQL["pii_base_spans"], path)
