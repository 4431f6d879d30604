"""Starts, frozen blocks, kernels, families of regimes, and weights of new rows."""

import numpy as np
import pytest
from driftlens.operators import core, models
from pyspark.sql import functions as F

DDL = "series_id long, t long, x array<double>"


def frame(spark, *series):
    return spark.createDataFrame([(k, t, [float(v) for v in row]) for k, x in enumerate(series) for t, row in enumerate(x)], DDL)


def arrays(df, column="gamma"):
    out = {}
    for r in df.orderBy("series_id", "t").collect():
        out.setdefault(r.series_id, []).append(r[column])
    return {k: np.array(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def two():
    rng = np.random.default_rng(4)
    corners = rng.normal(size=(3, 4)) * 3
    return [rng.dirichlet(np.full(3, 0.4), 60) @ corners + rng.normal(size=(60, 4)) * 0.05 for _ in range(2)]


def test_codings_of_new_rows_use_the_states_of_their_series(spark, two):
    fitted = models.ConvexCoding(3, 0.01, tolerance=1e-9).fit(frame(spark, *two))
    new = [two[0][:20], two[1][30:]]
    coded = fitted.transform(frame(spark, *new))
    got = arrays(coded)
    for k in (0, 1):
        s = fitted.matrix("states", k)
        want = core.fit_coding(new[k], 3, states=s, update=("weights",), tolerance=1e-12, max_iterations=5000).gamma
        assert np.allclose(got[k].sum(1), 1) and got[k].min() >= 0
        assert core.coding_loss(new[k], got[k], s) < core.coding_loss(new[k], want, s) + 1e-5
        assert np.allclose(arrays(fitted.inverse_transform(coded), "y")[k], got[k] @ s)
    assert fitted.transform(frame(spark, *new).where("false")).count() == 0
    assert fitted.transform(frame(spark, *new).withColumn("series_id", F.lit(77).cast("long"))).count() == 0


def test_joint_codings_hold_the_mixture(spark):
    rng = np.random.default_rng(1)
    x = rng.dirichlet(np.ones(3), 80)
    fitted = models.ConvexCoding(2, 0.0, [1, 2], 0.5).fit(frame(spark, x))
    got = arrays(fitted.transform(frame(spark, x[:40])))[0]
    s, w, t = fitted.matrix("states"), fitted.matrix("order_weights").ravel(), fitted.matrix("transitions")
    start = core.fit_coding(x[:40], 2, 0.0, [1, 2], 0.5, states=s, mixture=(w, t), update=(), max_iterations=1)
    total = lambda g: core.coding_loss(x[:40], g, s) + core.mtd_penalty(g, w, t, [1, 2], 0.5)
    assert total(got) < total(start.gamma)


def test_archetypes_of_new_rows(spark, two):
    fitted = models.ArchetypalAnalysis(3).fit(frame(spark, *two))
    got = arrays(fitted.transform(frame(spark, *two)))
    for k in (0, 1):
        z = fitted.matrix("states", k)
        mine, first = got[k], arrays(fitted.rows("gamma").withColumnRenamed("values", "gamma"))[k]
        assert ((two[k] - mine @ z) ** 2).sum() < ((two[k] - first @ z) ** 2).sum() * 1.05 + 1e-6


def test_a_linear_kernel_is_no_kernel(spark, two):
    x = two[0]
    plain = core.fit_archetypes(x, 3, 0.1, seed=3)
    kernel = core.fit_archetypes(x @ x.T, 3, 0.1, seed=3, kernel=True)
    assert np.allclose(plain.trace.costs[:40], kernel.trace.costs[:40], rtol=1e-6)
    by_function = models.ArchetypalAnalysis(3, kernel=lambda a: np.exp(-((a[:, None] - a[None]) ** 2).sum(2))).fit(frame(spark, x))
    costs = [r.cost for r in by_function.summary().orderBy("iteration").collect()]
    assert costs[-1] < costs[0]
    k = np.exp(-((x[:, None] - x[None]) ** 2).sum(2))
    given = models.ArchetypalAnalysis(3, kernel="precomputed").fit(frame(spark, k))
    assert [r.cost for r in given.summary().orderBy("iteration").collect()] == pytest.approx(costs)
    with pytest.raises(ValueError, match="no transform"):
        given.transform(frame(spark, k))
    with pytest.raises(ValueError, match="square"):
        core.fit_archetypes(x, 3, kernel=True)


def test_starts_and_frozen_blocks(spark, two):
    x = two[0]
    far = core.fit_coding(x, 3, init="furthest_sum", max_iterations=0, seed=5)
    assert all(any(np.array_equal(s, row) for row in x) for s in far.states)
    gamma, states = np.full((60, 3), 1 / 3), x[:3]
    own = models.ConvexCoding(3, init="custom", start={"states": states, "gamma": gamma}, update=("weights",), max_iterations=5).fit(frame(spark, x))
    assert np.allclose(own.matrix("states"), states)
    kept = models.ConvexCoding(3, init="custom", start={"states": states, "gamma": gamma}, update=("states",), max_iterations=5).fit(frame(spark, x))
    assert np.allclose(arrays(kept.rows("gamma").withColumnRenamed("values", "gamma"))[0], gamma)
    for wrong in ({"init": "nearest"}, {"init": "custom"}, {"update": ("colours",)}):
        with pytest.raises(ValueError):
            models.ConvexCoding(3, **wrong)
    with pytest.raises(ValueError, match="shape"):
        core.fit_coding(x, 3, states=states[:2])
    with pytest.raises(ValueError, match="simplex"):
        core.fit_coding(x, 3, gamma=gamma * 2)
    with pytest.raises(ValueError):
        models.ArchetypalAnalysis(3, init="furthest")
    c = np.eye(3, 60)
    held = models.ArchetypalAnalysis(3, init="custom", start={"dictionary": c, "weights": gamma}, update=("weights",)).fit(frame(spark, x))
    assert np.allclose(held.matrix("states"), x[:3])


def test_longer_memory_of_line_searches_ends_no_higher(two):
    one, five = (core.fit_coding(two[0], 3, 0.01, memory=m, monotonic=m == 1, tolerance=1e-9, max_iterations=3000) for m in (1, 5))
    assert five.trace.costs[-1] < one.trace.costs[-1] * 1.05 + 1e-6


def test_regimes_of_new_rows(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 0.1, (30, 2)), rng.normal(3, 0.1, (30, 2))])
    fitted = models.BoundedRegimes(2, 2.0, restarts=3).fit(frame(spark, x))
    got = arrays(fitted.transform(frame(spark, x[20:40])))[0]
    assert np.allclose(got[:10], got[0]) and np.allclose(got[10:], got[-1]) and abs(got[0] - got[-1]).max() > 0.99
    y = np.zeros(120)
    for t in range(1, 120):
        y[t] = (0.9 if t < 60 else -0.9) * y[t - 1] + rng.normal()
    var = models.BoundedRegimes(2, 4.0, "var", [1, 2], restarts=4).fit(frame(spark, y[:, None]))
    weights = arrays(var.transform(frame(spark, y[:, None])))[0]
    fitted_weights = arrays(var.rows("gamma").withColumnRenamed("values", "gamma"))[0]
    assert np.allclose(weights, fitted_weights, atol=1e-6)
    precision = var.matrix("precision")
    assert np.allclose(precision * var.matrix("sigma"), 1)


class Medians(core.Family):
    """A component is a point of absolute deviations: a family of a user's own."""

    def start(self, x, u, k, rng):
        return x[rng.choice(len(x), k, replace=False)]

    def distances(self, parameters, x, u):
        return np.abs(x[:, None] - parameters[None]).sum(2)

    def update(self, parameters, x, u, gamma):
        return np.stack([np.median(x[g > 0.5], 0) if (g > 0.5).any() else p for g, p in zip(gamma.T, parameters, strict=True)])

    def tables(self, parameters):
        return [("medians", parameters)]

    def restored(self, tables):
        return tables["medians"]


def test_a_family_of_ones_own(spark):
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(0, 0.1, (40, 1)), rng.normal(5, 0.1, (40, 1))])
    x[3] = 1e6
    fitted = models.BoundedRegimes(2, 4.0, Medians(), restarts=5).fit(frame(spark, x[4:]))
    assert sorted(np.round(fitted.matrix("medians").ravel())) == [0, 5]
    assert arrays(fitted.transform(frame(spark, x[:3])))[0].shape == (3, 2)


def test_centres_of_a_long_series(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.1, (50, 2)) for c in (0, 4, 9)])
    rows, centers, costs = models.BoundedRegimes(3, None, seed=2).fit_long(frame(spark, x))
    assert costs == sorted(costs, reverse=True) and rows.count() == 150
    labels = ((x[:, None] - centers[None]) ** 2).sum(2).argmin(1)
    assert np.allclose(arrays(rows)[0], np.eye(3)[labels])


def test_restarts_are_aligned_before_they_are_summarised(spark):
    class Fit:
        def __init__(self, *rows):
            self.regions = {k: core.unpack(np.array(r), 1, 1, 0, 0, True, False, None) for k, r in enumerate(rows)}

    table = models.summarise_restarts([Fit([[1.0], [0.5]], [[-1.0], [0.3]]), Fit([[-1.2], [0.1]], [[1.0], [0.7]])], spark)
    got = {(r.component, r.i): (round(r["mean"], 6), round(r["std"], 6)) for r in table.collect()}
    assert got == {(0, 0): (-1.1, 0.1), (0, 1): (0.2, 0.1), (1, 0): (1.0, 0.0), (1, 1): (0.6, 0.1)}


def test_weights_of_bounded_variation_do_not_stop_silently():
    with pytest.raises(RuntimeError, match="columns"):
        core.bounded_weights(np.random.default_rng(0).normal(size=(50, 3)), 5.0, max_columns=2)


def gaussian(x):
    return np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / 8)


def test_new_rows_on_archetypes_of_a_kernel(spark):
    rng = np.random.default_rng(6)
    x, new = rng.normal(size=(80, 2)) * 2, rng.normal(size=(30, 2)) * 2
    got, full = [], None
    for number in (12, 80):
        model = models.ArchetypalAnalysis(3, kernel=gaussian, landmarks=number, tolerance=1e-9).fit(frame(spark, x))
        got.append(arrays(model.transform(frame(spark, new)))[0])
        if full is None:  # by the products with all fitted samples
            c, products = np.array([r[0] for r in model.rows("dictionary").orderBy("t").select("values").collect()]).T, gaussian(np.vstack([new, x]))[:30, 30:]
            full = core.weights_by_products(products @ c.T, c @ gaussian(x) @ c.T, 1e-9, 1000)
    errors = [abs(g - full).max() for g in got]
    assert errors[1] < 1e-3 and errors[0] < 0.25 and errors[1] <= errors[0]
    with pytest.raises(ValueError, match="transform"):
        models.ArchetypalAnalysis(3, kernel="precomputed").fit(frame(spark, gaussian(x))).transform(frame(spark, new))


def test_rows_as_mixtures_of_samples(spark):
    x = np.random.default_rng(7).normal(size=(25, 3))
    model = models.ArchetypalAnalysis(3).fit(frame(spark, x))
    coded = model.rows("gamma").withColumnRenamed("values", "gamma")
    got = np.zeros((25, 25))
    for r in model.mixtures(coded).collect():
        got[r.t, r["sample"]] = r.value
    assert np.allclose(got.sum(1), 1)
    y = np.array([r.y for r in model.inverse_transform(coded).orderBy("t").collect()])
    assert np.allclose(got @ x, y)


def test_recursions_over_chunks(spark, monkeypatch):
    from driftlens.sources import frames, generators

    monkeypatch.setattr(frames, "CHUNK", 17)
    for made, step in ((generators.periodic_var, None), (generators.switching_var, None)):
        rows = made(spark, 100, 2, noise=0.5, seed=4, order=3).orderBy("t").collect()
        rng = np.random.default_rng(4)
        if made is generators.periodic_var:
            mu, a = rng.uniform(-1, 1, 2), generators._stable(rng, 3, 2)
            step = lambda t: (np.cos(2 * np.pi * t / 10) * mu, np.cos(2 * np.pi * t / 10) * a)
        else:
            mu, a = rng.uniform(-3, 3, (2, 2)), np.stack([generators._stable(rng, 3, 2) for _ in range(2)])
            step = lambda t: (mu[min(t * 4 // 100, 3) % 2], a[min(t * 4 // 100, 3) % 2])
        noise = np.vstack([np.random.default_rng([4, c]).standard_normal((min(17, 100 - 17 * c), 2)) for c in range(6)]) * np.sqrt(0.5)
        x = np.zeros((100, 2))
        for t in range(3, 100):
            constant, each = step(t)
            x[t] = constant + sum(each[k] @ x[t - 1 - k] for k in range(3)) + noise[t]
        assert [r.t for r in rows] == list(range(100)) and np.allclose([r.x for r in rows], x)
