import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecatlas.functions import noise, scalars


def test_golden_hash_and_stream():
    assert (noise.hash32(), noise.hash32(0), noise.hash32(1, 2, 3)) == (2166136261, 84696351, 1456420779)
    assert (noise.hash32(123, 2, -3, 0), noise.hash32(123, 0, 0, 0), noise.hash32(-1, -1)) == (4049976253, 442514334, 913903779)
    assert noise.draws(42, 4).tolist() == [0.6011037519201636, 0.44829055899754167, 0.8524657934904099, 0.6697340414393693]
    assert noise.draws(0, 2).tolist() == [0.26642920868471265, 0.0003297457005828619]
    assert np.allclose(noise.normals(42, 3)[0], [-0.956162229384149, -0.2730261048826104, -1.8416271847835968], atol=1e-12)
    assert noise.draws(42, 2, after=2).tolist() == noise.draws(42, 4)[2:].tolist()


def test_golden_field():
    assert [noise.hash32(x + 100, y + 100) % 50 for x, y in ((0, 0), (1, 0), (1, 1))] == [47, 30, 49]
    assert [noise.hash32(x + 100, y + 100, 0, 0) % 100 for x, y in ((0, 0), (1, 0), (1, 1))] == [13, 4, 75]
    assert [noise.temperature(math.hypot(*c)) for c in ((0, 0), (12, 0))] == [0, 1]
    assert noise.temperature(math.hypot(-3, 8)) == pytest.approx(0.7463108076357602)
    assert noise.weights(noise.temperature(math.hypot(-3, 8))) == pytest.approx((0.06435820632242027, 0.3786619720836391, 0.5569798215939407))


@settings(max_examples=50)
@given(st.integers(0, 2**32 - 1), st.integers(1, 200))
def test_stream_is_random_access(seed, n):
    d = noise.draws(seed, n)
    assert ((0 <= d) & (d < 1)).all() and d[-1] == noise.draws(seed, 1, after=n - 1)[0]


@given(st.floats(-50, 50), st.floats(-50, 50))
def test_smoothstep_is_monotone(a, b):
    lo, hi = sorted((a, b))
    assert 0 <= noise.smoothstep(1.5, 12, lo) <= noise.smoothstep(1.5, 12, hi) <= 1


def test_columns_agree_with_numpy(spark):
    df = spark.range(50).select(F.col("id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("j"))
    for r in df.select("id", "j", scalars.stream_draw(F.col("id"), F.col("j") + 1).alias("u"), scalars.normal_draw(F.col("id"), F.col("j")).alias("g")).collect():
        assert r["u"] == noise.draws(r["id"], 1, after=r["j"])[0]
        assert r["g"] == pytest.approx(noise.normals(r["id"], r["j"] + 1)[0][-1], abs=1e-12)


def test_vector_columns(spark):
    row = spark.sql("select array(3D, 4D) a, array(0D, 0D) z, array(1D, 0D) x").select(
        scalars.unit(F.col("a")).alias("u"), scalars.unit(F.col("z")).alias("uz"), scalars.cosine(F.col("a"), F.col("x")).alias("c"), scalars.cosine(F.col("a"), F.col("z")).alias("none"),
        scalars.half_up(F.lit(-2.5), 0).alias("h"), scalars.plus(F.col("a"), F.col("x")).alias("p"),
    ).first()
    assert row["u"] == [0.6, 0.8] and row["uz"] == [0, 0] and row["c"] == pytest.approx(0.6) and row["none"] is None and row["h"] == -2 and row["p"] == [4, 4]


def test_perturbed_needs_equal_dimensions():
    with pytest.raises(ValueError):
        noise.perturbed([1.0, 0.0, 0.0], [[1.0, 0.0], [0.0, 1.0]], 1, 1, 5)
