"""Bounded regimes of one series that spans many chunks, against the fit of one task."""

import numpy as np
import pytest
from driftlens.operators import core, models, paths, regimes_long
from driftlens.sources import frames

DDL = "series_id long, t long, x array<double>, u array<double>"


def frame(spark, x, u=None):
    u = np.zeros((len(x), 1)) if u is None else u
    df = spark.createDataFrame([(0, 3 * t + t % 2, [float(v) for v in a], [float(v) for v in b]) for t, (a, b) in enumerate(zip(x, u))], DDL)
    return df.repartition(5)


def regimes(n, seed, d=2, k=3, stay=9):
    rng = np.random.default_rng(seed)
    labels = rng.integers(0, k, n // stay + 1).repeat(stay)[:n]
    return rng.normal(size=(k, d))[labels] * 2 + rng.normal(size=(n, d))


@pytest.fixture
def chunks(monkeypatch):
    monkeypatch.setattr(frames, "CHUNK", 37)
    monkeypatch.setattr(regimes_long, "GROUP", 3)
    monkeypatch.setattr(paths, "SIDE", 8)


@pytest.mark.parametrize("n,k", [(1, 2), (9, 2), (300, 3), (512, 4)])
def test_a_path_is_the_cheapest_one(n, k, monkeypatch):
    monkeypatch.setattr(paths, "SIDE", 16)
    rng = np.random.default_rng(n)
    costs, toll = rng.random((n, k)), rng.random(k)
    want = core._cheapest_path(costs, toll)
    m, turns = paths.reduced(costs, toll, True)
    last = int(m[0].argmin())
    assert (paths.path(costs, toll, 0, last, True) == want).all()
    assert np.allclose(turns[0, last], core.total_variation(np.eye(k)[want]))
    assert np.isclose(m[0].min(), costs[np.arange(n), want].sum() + toll @ turns[0, last])


@pytest.mark.parametrize("bound", [None, 0.0, 6.0])
def test_weights_of_chunks_are_those_of_one_task(spark, chunks, bound):
    x, start = regimes(400, 1), np.array([[0.0, 0.0], [1.0, 2.0], [-1.0, 1.0]])
    want = core.fit_regimes(core.FixedStart(core.Centers(), start), x, None, 3, bound, 1e-9, 2)
    rows, centers, costs = models.BoundedRegimes(3, bound, tolerance=1e-9, max_iterations=2).fit_long(frame(spark, x), [start])
    got = np.array([r.gamma for r in rows.orderBy("t").collect()])
    assert rows.columns == ["series_id", "t", "x", "u", "gamma"]
    assert np.allclose(costs, want.trace.costs) and np.allclose(centers, want.parameters)
    assert np.allclose(got, want.gamma, atol=1e-6)
    if bound is not None:
        assert (core.total_variation(got) <= bound + 1e-9).all()


@pytest.mark.parametrize("bound", [None, 12.0])
def test_autoregressions(spark, chunks, bound, monkeypatch):
    rng = np.random.default_rng(5)
    n, u = 300, rng.normal(size=(300, 1))
    x = np.zeros((n, 2))
    for t in range(2, n):
        a = np.array([[0.7, 0.2], [0.0, 0.5]]) if t // 75 % 2 else np.array([[-0.6, 0.0], [0.3, 0.1]])
        x[t] = a @ x[t - 1] + 0.5 * u[t] * [1, -1] + 0.1 * rng.normal(size=2)
    family = core.Autoregressions([1, 2])
    first = np.vstack([(g := np.random.default_rng([3, c]).uniform(size=(min(37, 298 - 37 * c), 2))) / g.sum(1, keepdims=True) for c in range(9)])
    monkeypatch.setattr(core, "right_stochastic", lambda shape, rng: first)
    want = core.fit_regimes(family, x, u, 2, bound, 1e-9, 3, 3)
    rows, parameters, costs = models.BoundedRegimes(2, bound, "var", [1, 2], tolerance=1e-9, max_iterations=3, seed=3).fit_long(frame(spark, x, u))
    assert np.allclose(costs, want.trace.costs, rtol=1e-7)
    for a, b in zip(parameters, want.parameters):
        assert np.allclose(a.coefficients, b.coefficients, atol=1e-7) and np.allclose(a.sigma, b.sigma, atol=1e-8)
    assert np.allclose([r.gamma for r in rows.orderBy("t").collect()], want.gamma, atol=1e-6)


def test_restarts_share_passes(spark, chunks):
    x = regimes(100, 2)
    df = frame(spark, x)
    starts = [models.random_rows(df, 3, np.random.RandomState(s)) for s in range(2)]
    single = [models.BoundedRegimes(3, 4.0, max_iterations=1).fit_long(df, [s])[2][-1] for s in starts]
    passes = []
    original = regimes_long.Passes._map
    regimes_long.Passes._map = lambda self, *a: passes.append(1) or original(self, *a)
    try:
        best = models.BoundedRegimes(3, 4.0, restarts=2, max_iterations=1).fit_long(df)[2][-1]
    finally:
        regimes_long.Passes._map = original
    assert np.isclose(best, min(single))
    assert len(passes) < 150


def test_what_is_not_possible(spark):
    with pytest.raises(ValueError, match="too few"):
        models.BoundedRegimes(2, kind="var", memory=3).fit_long(frame(spark, np.ones((3, 1))))
    with pytest.raises(ValueError, match="centres or autoregressions"):
        models.BoundedRegimes(2, kind=core.FixedStart(core.Centers(), np.zeros((2, 1)))).fit_long(frame(spark, np.ones((3, 1))))
