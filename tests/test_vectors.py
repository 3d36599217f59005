import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.functions import vectors
from quern.operators import indexing



def frame(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r] if r is not None else None) for i, r in enumerate(rows)], "id long, embedding array<float>")


def test_round_trip_is_close_and_constant_is_exact(spark):
    q = indexing.quantize(frame(spark, [[-1, -0.5, 0, 0.5, 1], [0.25] * 8, None])).orderBy("id")
    back = [r[0] for r in q.select(vectors.int8_decode(F.col("emb_i8"), F.col("emb_scale"), F.col("emb_offset"))).collect()]
    assert max(abs(a - b) for a, b in zip(back[0], [-1, -0.5, 0, 0.5, 1])) <= 2 / 255
    assert back[1] == [0.25] * 8 and back[2] is None


def test_codec_equals_a_single_precision_loop(spark):
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(200, 16)).astype(np.float32)
    got = indexing.quantize(frame(spark, rows.tolist())).orderBy("id").collect()
    for r, v in zip(got, rows):
        lo, hi = v.min(), v.max()
        scale = np.float32((hi - lo) / np.float32(255))
        off = np.float32(lo + np.float32(128) * scale)
        x = ((v - off) / scale).astype(np.float32)
        q = np.clip(np.trunc(x + np.copysign(np.float32(0.5), x)), -128, 127).astype(int)
        assert (np.float32(r.emb_scale), np.float32(r.emb_offset)) == (scale, off)
        assert np.abs(np.array(r.emb_i8) - q).max() <= 0


def test_cosine_equals_a_single_precision_loop(spark):
    rng = np.random.default_rng(1)
    rows = rng.normal(size=(50, 24)).astype(np.float32)
    got = frame(spark, rows.tolist()).select(vectors.cosine(F.lit(rows[0].tolist()).cast("array<float>"), F.col("embedding"))).collect()
    for r, v in zip(got, rows):
        dot = a = b = np.float32(0)
        for x, y in zip(rows[0], v):
            dot, a, b = dot + x * y, a + x * x, b + y * y
        assert np.float32(r[0]) == np.float32(dot / (np.sqrt(a) * np.sqrt(b)))


def test_zero_vectors_and_wrong_lengths(spark):
    df = frame(spark, [[0, 0]])
    q = F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")
    assert df.select(vectors.cosine(q, F.col("embedding"))).head()[0] == 0
    with pytest.raises(Exception, match="dimensions"):
        df.select(vectors.cosine(F.slice(q, 1, 1), F.col("embedding"))).collect()
    with pytest.raises(Exception, match="normalized"):
        df.select(vectors.l2_normalize(F.col("embedding"))).collect()


def test_projection_and_norms(spark):
    df = frame(spark, [[1.0] * 768])
    got = df.select(vectors.l2_normalize(vectors.project(F.col("embedding"), 256)), vectors.layer_norm(F.array(F.lit(1.0), F.lit(3.0)).cast("array<float>")), F.size("embedding")).head()
    assert abs(np.linalg.norm(got[0]) - 1) < 1e-5 and len(got[0]) == 256 and got[2] == 768
    assert np.allclose(got[1], [-1, 1], atol=1e-4)


def test_finite(spark):
    df = frame(spark, [[1.0], [float("nan")], [float("inf")], []])
    assert [r[0] for r in df.select(vectors.is_finite(F.col("embedding"))).collect()] == [True, False, False, True]


def test_mean_pool_weights(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], 1), ("a", [0.0, 1.0], 3), ("b", None, 1)], "g string, embedding array<float>, w int")
    assert {r.g: list(r.embedding) for r in indexing.mean_pool(df, "g", weight="w").collect()} == {"a": [0.25, 0.75]}
