import numpy as np
import pytest
from driftlens.functions import stochastic, vec
from driftlens.operators import core
from driftlens.sources import frames
from pyspark.sql import functions as F


def project(spark, rows):
    df = spark.createDataFrame([([float(v) for v in r],) for r in rows], "x array<double>")
    return np.array([r[0] for r in df.select(vec.simplex_project("x")).collect()])


def test_exact_projections(spark):
    """By hand: what stays above 0 loses the same amount, so that the sum is 1."""
    assert project(spark, [[7.25]]).tolist() == [[1.0]]
    assert np.allclose(project(spark, [[1.3, 1.1], [-3.0, 4.0], [2.0, 2.0]]), [[0.6, 0.4], [0, 1], [0.5, 0.5]])
    assert np.allclose(project(spark, [[0.9, 0.6, -0.2], [0.1, 0.1, 0.1], [3.0, 2.8, 2.7]]), [[0.65, 0.35, 0], [1 / 3, 1 / 3, 1 / 3], [0.5, 0.3, 0.2]])


@pytest.mark.parametrize("d", [1, 5, 10, 100])
def test_projections_are_feasible_idempotent_and_agree_with_numpy(spark, d):
    a = np.random.default_rng(d).normal(size=(20, d))
    p = project(spark, a)
    assert np.allclose(p.sum(1), 1, atol=1e-14 * d + 1e-14) and (p >= 0).all()
    assert np.allclose(project(spark, p), p, atol=1e-14)
    assert np.allclose(core.project_rows(a), p, atol=1e-14)


def test_a_vector_with_nan_is_projected_to_zeros_in_both_forms(spark):
    nan = float("nan")
    rows = [[nan, 2.0], [1.0, nan, 3.0], [nan], [0.2, 2.0]]
    want = [[0.0, 0.0], [0.0, 0.0, 0.0], [0.0], [0.0, 1.0]]
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, x array<double>")
    assert [r[0] for r in df.orderBy("k").select(vec.simplex_project("x")).collect()] == want
    assert [core.project_rows(np.array([r]))[0].tolist() for r in rows] == want
    assert core.project_rows(np.array([[nan, 2.0], [0.5, 0.5]])).tolist() == [[0, 0], [0.5, 0.5]]


def test_stochastic_matrices():
    state = np.random.RandomState(0)
    assert np.allclose(stochastic.left_stochastic((4, 3), state).sum(0), 1)
    assert np.allclose(stochastic.right_stochastic((4, 3), state).sum(1), 1)
    with pytest.raises(ValueError):
        stochastic.uniform_stochastic((2, 2), 2, state)


def test_random_weights_are_on_the_simplex_and_repeat(spark):
    df = spark.range(50).select(F.lit(0).alias("series_id"), F.col("id").alias("t"))
    a, b = (df.withColumn("gamma", stochastic.random_weights(3, 1, "series_id", "t")) for _ in range(2))
    assert frames.check_unit_sums(a) < 1e-9
    assert a.collect() == b.collect()


def test_checks(spark):
    good = spark.createDataFrame([(0, 0, [1.0, 2.0]), (0, 1, [3.0, 4.0])], "series_id long, t long, x array<double>")
    assert frames.check_vectors(good) == (2, 2)
    frames.check_order(good)
    for bad in ([(0, 0, [1.0]), (0, 1, [1.0, 2.0])], [(0, 0, [float("nan")])], [(0, 0, None)], []):
        with pytest.raises(ValueError):
            frames.check_vectors(spark.createDataFrame(bad, good.schema))
    with pytest.raises(ValueError):
        frames.check_order(good.union(good))
    with pytest.raises(ValueError):
        frames.check_unit_sums(good, "x")
    for wrong in ({"n": 0}, {"n": 1.5}, {"tolerance": -1}):
        with pytest.raises(ValueError):
            frames.check_positive(**wrong)


def test_lags_by_window_and_by_join_agree(spark):
    df = spark.createDataFrame([(s, t, [float(s * 10 + t)]) for s in range(3) for t in range(7)], "series_id long, t long, x array<double>")
    a, b = (frames.lagged(df, "x", [1, 3, -2], by).select("series_id", "t", "x_lag1", "x_lag3", "x_lag-2") for by in ("window", "join"))
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
