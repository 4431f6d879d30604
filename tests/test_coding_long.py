"""Codings and archetypes of one series that spans many chunks, against the fits of one task."""

import numpy as np
import pytest
from driftlens.operators import core, models
from driftlens.sources import frames

DDL = "series_id long, t long, x array<double>, gamma array<double>, c array<double>"


def frame(spark, x, gamma, c=None):
    c = gamma if c is None else c
    rows = [(0, 2 * t + t % 2, *([float(v) for v in a] for a in each)) for t, each in enumerate(zip(x, gamma, c))]
    return spark.createDataFrame(rows, DDL).repartition(3)


def series(n, d, k, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).cumsum(0) / 5
    return x, rng.dirichlet(np.ones(k), n), rng.normal(size=(k, d)), rng


def in_order(rows, name):
    return np.array([r[0] for r in rows.orderBy("t").select(name).collect()])


@pytest.mark.parametrize("lags,n", [([], 90), ([1, 3], 90), ([4], 101), ([2, 7], 96), ([3], 3)])
def test_coding(spark, monkeypatch, lags, n):
    monkeypatch.setattr(frames, "CHUNK", 19)
    x, gamma, states, rng = series(n, 2, 3, 1)
    mixture = core.random_mtd(3, lags, np.random.RandomState(2)) if lags else None
    want = core.fit_coding(x, 3, 0.2, lags, 1.5, gamma, states, mixture, max_iterations=6, tolerance=0, init="custom", memory=2, monotonic=False)
    start = {"states": states, **({"mixture": mixture} if lags else {})}
    got = models.ConvexCoding(3, 0.2, lags, 1.5, 0.0, 6, init="custom", start=start, memory=2, monotonic=False).fit_long(frame(spark, x, gamma))
    assert np.allclose(got.costs, want.trace.costs, rtol=1e-9)
    assert np.allclose(got.states, want.states) and np.allclose(in_order(got.rows, "gamma"), want.gamma)
    if lags:
        assert np.allclose(got.order_weights, want.order_weights) and np.allclose(got.transitions, want.transitions)


@pytest.mark.parametrize("update", [("weights",), ("states",), ("parameters",)])
def test_blocks_that_are_frozen(spark, monkeypatch, update):
    monkeypatch.setattr(frames, "CHUNK", 19)
    x, gamma, states, _ = series(60, 2, 2, 3)
    mixture = core.random_mtd(2, [2], np.random.RandomState(2))
    want = core.fit_coding(x, 2, 0.0, [2], 3.0, gamma, states, mixture, max_iterations=3, tolerance=0, init="custom", update=update)
    got = models.ConvexCoding(2, 0.0, [2], 3.0, 0.0, 3, init="custom", start={"states": states, "mixture": mixture}, update=update).fit_long(frame(spark, x, gamma))
    assert np.allclose(got.costs, want.trace.costs) and np.allclose(in_order(got.rows, "gamma"), want.gamma) and np.allclose(got.transitions, want.transitions)


@pytest.mark.parametrize("delta", [0.0, 0.4])
def test_archetypes(spark, monkeypatch, delta):
    monkeypatch.setattr(frames, "CHUNK", 16)
    x, gamma, _, rng = series(70, 3, 3, 4)
    c = rng.dirichlet(np.ones(70), 3)
    want = core.fit_archetypes(x, 3, delta, c, gamma, "custom", 0.0, 5)
    got = models.ArchetypalAnalysis(3, delta, "custom", 0.0, 5).fit_long(frame(spark, x, gamma, c.T))
    assert np.allclose(got.costs, want.trace.costs, rtol=1e-9)
    assert np.allclose(in_order(got.rows, "c").T, want.dictionary) and np.allclose(in_order(got.rows, "gamma"), want.weights)
    assert np.allclose(got.scales, want.scales) and np.allclose(got.states, want.states)


def test_starts_far_from_each_other(spark):
    """Both estimators begin at the picks that the table operator and the array form give."""
    x, gamma, _, _ = series(40, 2, 3, 5)
    df = frame(spark, x, gamma)
    picks = core.furthest_rows(x, 3, 0)
    assert np.allclose(models.ConvexCoding(3, init="furthest_sum", update=(), max_iterations=1).fit_long(df).states, x[picks])
    got = models.ArchetypalAnalysis(3, update=(), max_iterations=1).fit_long(df)
    assert (in_order(got.rows, "c").T == np.eye(40)[picks]).all() and np.allclose(got.states, x[picks])
    random = models.ArchetypalAnalysis(3, init="random", update=(), max_iterations=1).fit_long(df)
    assert np.allclose(in_order(random.rows, "c").sum(0), 1)
    with pytest.raises(ValueError, match="linear"):
        models.ArchetypalAnalysis(3, kernel="precomputed").fit_long(df)
