from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from quern.llm import langid, packing, secrets
from tests.llm.test_decontaminate import brute as brute_hits
from tests.llm.test_packing import assert_packed
from tests.llm.test_simhash import brute as brute_groups
from tests.llm.test_simhash import brute_fp

PATH = "/root/testdata/sf0.001"


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    base = docs.where("lang = 'en' AND n_chars > 1000").orderBy("doc_id").first().text
    planted = [(9001, "password=hunter2hunter2 " + base[::-1], "en", "p", 0), (9002, base[500:] + " AKIA" + "Q7" * 9, "en", "p", 0)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    columns, before = docs.columns, {r.doc_id: r for r in docs.collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, PATH)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        rows = [(k, r.text) for k, r in before.items()]
        if name == "language_id":
            model = langid.train(spark.createDataFrame(list(before.values())).where(~langid.held_out("doc_id")))
            rejected = model.predict([t for _, t in rows])[3]
            want = {k for (k, _), r in zip(rows, rejected) if not r}
            assert len(want) > 0.97 * len(rows)
        elif name == "near_dedup":
            want = {g[0] for g in brute_groups(rows, [brute_fp(t) for _, t in rows]) if g[0] == g[3]}
            assert len(want) < len(rows)
        elif name == "benchmark_decontamination":
            want = {k for k, t in rows if not brute_hits(t, items)[1]}
            assert len(want) < len(rows)
        elif name == "secret_scan":
            want = set(before)
            assert any(r.text != before[r.doc_id].text for r in after)
            for r in after:
                assert r.n_chars == len(r.text) and not [s for s in secrets.find(r.text.encode()) if s[4] is None]
                if r.text != before[r.doc_id].text:
                    assert "[SECRET]" in r.text
        else:
            assert_packed(after, rows)
            continue
        assert Counter(r.doc_id for r in after) == Counter(want)
        before = {r.doc_id: r for r in after}


def test_run_gives_the_same(spark):
    out = corpus_pipeline.run(spark, PATH)
    assert set(out.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert out.count() > 0


def test_stages_take_nulls_empties_and_no_rows(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", None, 5), (4, "the cat sat on the mat " * 50, "en", "s", 1150), (4, "the cat sat on the mat " * 50, "en", "s", 1150), (6, "token=abcdefgh and the cat sat", "en", "s", 30)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, component_id string, score int"
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], schema)
    for d in (docs, docs.where(F.lit(False))):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, d, PATH)
            assert out.columns == d.columns
            assert out.count() <= d.count()
        assert packing.pack(d, packing.byte_bpe_path()).count() >= (d.count() > 0)
