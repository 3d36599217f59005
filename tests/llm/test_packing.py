import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import packing, queries

PATH = packing.byte_bpe_path()


def exact():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=20), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", "  ", " a", "\n"])), max_size=8).map("".join))
def test_fast_ids_are_those_of_tokenizers(text):
    assert np.frombuffer(packing.encoder(PATH)(text), "<u4").tolist() == exact()(text)


@pytest.mark.parametrize("text", ["", "<|endoftext|> a", "a<|endoftext|>b", " <|endoftext|>  <|endoftext|><|endoftext|>\n\n x", "<|endoftext", "<|<|endoftext|>|>", "  two  spaces \n\n x", "I'll it's IT'S", "世界 🙂 é ²³ ٣", "a\x1cb\x85c d", "x" * 5000, " " * 3000])
def test_fast_ids_on_edges(text):
    assert np.frombuffer(packing.encoder(PATH)(text), "<u4").tolist() == exact()(text)


def assert_packed(pieces, docs, capacity=1024):
    """Exact round trip: every id lies in one piece, in order; offsets are gapless."""
    encode = exact()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    want = defaultdict(list)
    for i, text in docs:
        want[i].append(np.array([*encode(text or ""), 0], "<u4").tobytes())
    assert set(by_doc) == set(want)
    for i, texts in want.items():
        if len(texts) > 1:
            assert sum(p.length for p in by_doc[i]) == sum(len(t) // 4 for t in texts)
            continue
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(texts[0]) // 4
            assert p.ids_crc32 == zlib.crc32(texts[0][4 * at : 4 * (at + p.length)])
            if getattr(p, "ids", None) is not None:
                assert bytes(p.ids) == texts[0][4 * at : 4 * (at + p.length)]
            at += p.length
        assert at == len(texts[0]) // 4
    fills = []
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        fills.append(at)
    return fills


def test_edges(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["alpha", "é", "x1", "the"]) for _ in range(rng.choice([0, 3, 400, 3000])))) for i in range(60)]
    docs += [(103, "two <|endoftext|> documents<|endoftext|>"), (100, None), (101, ""), (102, "same"), (102, "same"), (None, "no id")]
    df = spark.createDataFrame([(*r, 7) for r in docs], "doc_id long, text string, offset int").repartition(3)
    out = packing.pack(df, PATH, windows=4)
    fills = assert_packed(out.collect(), docs)
    assert sum(f < 1024 for f in fills) <= 1
    whole = packing.sequences(out).collect()
    assert sorted(len(r.ids) // 4 for r in whole) == sorted(fills)
    assert packing.pack(df.where(F.lit(False)), PATH).count() == 0


@given(st.lists(st.integers(1, 40), max_size=60), st.integers(1, 5))
def test_packer_loses_nothing(sizes, windows):
    packer, seen = packing.Packer(16, windows), defaultdict(bytes)
    out = []
    for i, n in enumerate(sizes):
        out += packer.add(i, bytes(range(n)) * 4)
        assert len(packer.open) <= windows
    assert all(sum(p[2] for p in w) == 16 for w in out)
    for w in out + packer.rest():
        assert [p[3] for p in w] == list(np.cumsum([0, *[p[2] for p in w]])[:-1])
        for doc, start, n, _, ids in sorted(w, key=lambda p: p[1]):
            assert len(ids) == 4 * n
    packer = packing.Packer(16, windows)
    parts = [p for i, n in enumerate(sizes) for w in packer.add(i, bytes(range(n)) * 4) for p in w] + [p for w in packer.rest() for p in w]
    for doc, start, n, _, ids in sorted(parts, key=lambda p: (p[0], p[1])):
        assert len(seen[doc]) == 4 * start
        seen[doc] += ids
    assert [seen[i] for i in range(len(sizes))] == [bytes(range(n)) * 4 for n in sizes]


def test_query_is_an_exact_round_trip(spark):
    path = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{path}/documents.parquet").collect()]
    fills = assert_packed(queries.QUERIES["op7_bounded_space_packing"](spark, path).collect(), docs)
    assert sum(1024 - f for f in fills) < 1024
