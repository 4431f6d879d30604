"""Estimators over frames."""

import numpy as np
import pytest
from driftlens.functions import vec
from driftlens.operators import core, markov, models, moments, seeding
from driftlens.sources import frames, generators
from pyspark.sql import functions as F

DDL = "series_id long, t long, x array<double>"


def frame(spark, x, series=0):
    return spark.createDataFrame([(series, t, [float(v) for v in row]) for t, row in enumerate(x)], DDL)


def test_moments_and_projection_across_rows(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 3))
    df = frame(spark, x)
    assert np.allclose(moments.cross(df, "x", "x"), x.T @ x)
    out, _ = moments.simplex_columns(df, "x", ["t"])
    got = np.array([r.x for r in out.orderBy("t").collect()])
    assert np.allclose(got, core.project_columns(x))
    lagged = moments.lagged_moments(df, "x", [1, 3])
    want = core.moments_of(x, [1, 3])
    assert all(np.allclose(lagged[k], want[k]) for k in want)


def test_furthest_sum(spark):
    square = [[0.5, 0.5]] * 10
    for at, corner in zip((0, 4, 6, 9), ([0, 0], [1, 0], [0, 1], [1, 1]), strict=True):
        square[at] = corner
    df = frame(spark, square)
    assert sorted(i for i, _ in seeding.furthest_sum(df, 4, 1, extra_steps=8)) == [0, 4, 6, 9]
    assert seeding.furthest_sum(df, 0, 1) == []
    assert sorted(i for i, _ in seeding.furthest_sum(df, 10, 0, extra_steps=3)) == list(range(10))
    assert [i for i, _ in seeding.furthest_sum(df, 1, 3, exclude=[k for k in range(10) if k != 3])] == [3]
    for wrong in ({"k": 2, "start": 99}, {"k": 2, "start": 1, "exclude": [1]}, {"k": 11, "start": 1}):
        with pytest.raises(ValueError):
            seeding.furthest_sum(df, **wrong)


def test_coding_by_series_and_long(spark):
    rng = np.random.default_rng(1)
    x = rng.dirichlet(np.ones(3), 120) @ rng.normal(size=(3, 4))
    df = frame(spark, x).union(frame(spark, x[::-1], 1))
    fitted = models.ConvexCoding(3, max_iterations=300).fit(df)
    costs = [r.cost for r in fitted.summary().where("series_id = 1").orderBy("iteration").collect()]
    assert costs == sorted(costs, reverse=True) and costs[-1] < 0.05 * costs[0]
    states = fitted.matrix("states")
    assert states.shape == (3, 4)
    gamma = fitted.rows("gamma").where("series_id = 0").withColumnRenamed("values", "gamma")
    assert frames.check_unit_sums(gamma) < 1e-9
    coded = models.reconstruct(models.code(frame(spark, x), states), states)
    error = coded.agg(F.avg(vec.sqdist("x", "y"))).first()[0]
    assert error < 0.01
    long_costs = models.ConvexCoding(3, 0.1, max_iterations=4).fit_long(frame(spark, x)).costs
    assert all(b <= a + 1e-9 for a, b in zip(long_costs, long_costs[1:], strict=False))


def test_forecast_over_a_frame(spark):
    rng = np.random.default_rng(2)
    g, lags = rng.dirichlet(np.ones(2), 12), [1, 3]
    w, t = core.random_mtd(2, lags, np.random.RandomState(1))
    df = frame(spark, g).withColumnRenamed("x", "gamma")
    for by in ("window", "join", "chunk"):
        rows = models.forecast(df, w, t, lags, 2, by).orderBy("t").collect()
        assert [r.ahead is None for r in rows] == [True, True] + [False] * 10
        past = list(g[:6])
        for _ in range(2):
            past.append(sum(wi * ti @ past[-lag] for wi, ti, lag in zip(w, t, lags, strict=True)))
        assert np.allclose(rows[5].ahead, past[-1])


def test_archetypes_and_regimes_by_series(spark):
    corners = np.array([[0, 0], [1, 0], [0, 1.0]])
    x = np.random.default_rng(3).dirichlet(np.ones(3), 50) @ corners
    x[[5, 27, 32]] = corners
    fitted = models.ArchetypalAnalysis(3, tolerance=1e-9).fit(frame(spark, x))
    top = fitted.part("dictionary").groupBy("j").agg(F.max_by("t", "value").alias("t")).collect()
    assert sorted(r.t for r in top) == [5, 27, 32]
    df = generators.gaussian_regimes(spark, 150)
    fitted = models.BoundedRegimes(3, 2.0, restarts=4).fit(df)
    gamma = fitted.rows("gamma").orderBy("t").collect()
    assert len(gamma) == 150 and (core.total_variation(np.array([r["values"] for r in gamma])) <= 2 + 1e-6).all()
    with pytest.raises(ValueError):
        models.BoundedRegimes(2, 1.0, "var", [1, 2, 3])


def test_piecewise_autoregression(spark):
    df = generators.piecewise_affine(spark, 400)
    fitted = models.PiecewiseAutoregression(3, p=1, s=1, seed=2).fit(df)
    labelled, found = fitted.rows, fitted.regions
    again = fitted.transform(df)
    assert again.count() == labelled.count() and again.where('y IS NULL').isEmpty()
    both = again.join(labelled.select('t', labelled.region.alias('r')), 't')
    assert both.where('region <> r').isEmpty()
    assert labelled.count() == 399 and len(found) == 3
    u = generators.switching_var(spark, 60).count() + generators.periodic_var(spark, 60).count()
    assert u == 120


def test_kmeans_markov(spark):
    x = np.array([[0.0, 0.0], [5.0, 5.0]])[np.arange(40) % 2] + np.random.default_rng(4).normal(size=(40, 2)) * 0.1
    model = markov.KMeansMarkov(2).fit(frame(spark, x))
    assert np.allclose(model.transition, [[0, 1], [1, 0]])
    rows = model.predict(frame(spark, x), 3).orderBy("t").collect()
    assert all(r.probability[1 - r.label] == 1 for r in rows)
    assert all(abs(min(r.distance)) < 1 for r in rows)


def test_a_state_that_only_ends_has_unknown_transitions(spark):
    df = spark.createDataFrame([(0, 0, "a"), (0, 1, "a"), (0, 2, "b")], "series_id long, t long, label string")
    got = {(r.next_state, r.cur_state): r.p for r in markov.transitions(df).collect()}
    assert got == {("a", "a"): 0.5, ("b", "a"): 0.5, ("a", "b"): None, ("b", "b"): None}


def test_chunks_give_the_lags_of_windows(spark, monkeypatch):
    monkeypatch.setattr(frames, "CHUNK", 7)
    gaps = frame(spark, np.arange(30.0)[:, None], 2).withColumn("t", F.col("t") * F.col("t") * 1000)
    df = frame(spark, np.arange(50.0)[:, None]).unionByName(frame(spark, np.arange(9.0)[:, None], 1)).unionByName(gaps)
    nobody = df.where("series_id = 1").withColumn("series_id", F.lit(None).cast("long"))
    df = df.unionByName(nobody)
    for by, lags in [(by, lags) for by in ("chunk", "auto") for lags in ([1], [3, 1], [-2, 4], [-11], [9, 2])]:
        names = [f"x_lag{k}" for k in lags]
        want = frames.lagged(df, "x", lags, "window").orderBy("series_id", "t").collect()
        got = frames.lagged(df, "x", lags, by).orderBy("series_id", "t").select(df.columns + names).collect()
        assert got == want
    with pytest.raises(ValueError, match="window"):
        frames.lagged(df, "x", [1], "task")


def test_one_series_with_half_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(frames, "CHUNK", 16)
    events = spark.range(400).selectExpr("IF(id % 2 = 0, 7, id % 23) AS series_id", "id * id % 1009 AS t", "id", "substr('abcd', 1 + int(id * id % 4), 1) AS label")
    want = [tuple(r) for r in markov.transitions(events, order=("t", "id")).orderBy("next_state", "cur_state").collect()]
    monkeypatch.setattr(frames, "CHUNK", 1 << 20)
    assert want == [tuple(r) for r in markov.transitions(events, order=("t", "id")).orderBy("next_state", "cur_state").collect()]
    monkeypatch.setattr(markov, "STATES", 1)
    with pytest.raises(ValueError, match="states"):
        markov.transitions(events, order=("t", "id"))


def test_rows_are_numbered_without_a_single_task(spark, tmp_path):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS v").repartition(5)
    rows = frames.numbered(df, ["v"]).collect()
    assert sorted((r.v, r.t) for r in rows) == [(k, k) for k in range(1000)]
    assert frames.numbered(df.limit(0), ["v"]).count() == 0
    (tmp_path / "a.csv").write_text("# two columns\n3,30\n1,10\n2,20\n")
    got = frames.read_csv_series(spark, str(tmp_path / "a.csv"), "a double, b double", ["b"], ["a"]).orderBy("t").collect()
    assert [(r.series_id, r.t, r.x) for r in got] == [(0, 0, [10.0]), (0, 1, [20.0]), (0, 2, [30.0])]


def test_generators_of_higher_order(spark):
    for made in (generators.periodic_var(spark, 60, 2, order=3), generators.switching_var(spark, 60, 2, order=2)):
        assert made.count() == 60 and frames.check_vectors(made) == (60, 2)


def test_least_squares_of_an_ill_conditioned_design(spark, monkeypatch):
    """Two columns that differ by 1e-8: sums of products lose them, triangles don't."""
    monkeypatch.setattr(moments, "FACTORS", 2)
    rng = np.random.default_rng(9)
    z = rng.normal(size=(400, 1)) @ np.ones((1, 2)) + 1e-8 * rng.normal(size=(400, 2))
    y = z @ [3.0, -2.0] + 0.5
    table = np.column_stack([np.ones(400), z, y])
    df = frame(spark, table).repartition(11)
    triangle = moments.factor(df, "x")
    assert np.allclose(triangle.T @ triangle, table.T @ table)
    assert np.linalg.cond(table[:, :3]) > 1e8
    right = [0.5, 3.0, -2.0]
    assert np.allclose(core.from_factor(triangle, 1, 400, 0, 2, 0, True, True).coefficients.ravel(), right, atol=1e-6)
    assert not np.allclose(core.from_gram(table.T @ table, 1, 400, 0, 2, 0, True, True).coefficients.ravel(), right, atol=1e-2)
    assert moments.factor(df.limit(0), "x").shape == (0, 0)
    few = moments.factor(frame(spark, table[:2]), "x")
    assert few.shape == (4, 4) and np.allclose(few.T @ few, table[:2].T @ table[:2])


def test_regions_with_round_borders(spark):
    """A ring around a disc: random Fourier features part them, a linear classifier can't."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    rng = np.random.default_rng(1)
    z = rng.uniform(-2, 2, (600, 2)) * [1, 50]
    rows = frame(spark, z).withColumns({"predictors": array_to_vector("x"), "cluster": F.when(F.expr("x[0] * x[0] + x[1] * x[1] / 2500 < 1.8"), 0.0).otherwise(1.0)})
    train, new = rows.where("t % 3 > 0"), rows.where("t % 3 = 0")
    right = lambda model: model.transform(new).agg(F.avg((F.col("region") == F.col("cluster")).cast("double"))).first()[0]
    fourier = models.regions_by_features().fit(train)
    linear = LogisticRegression(family="multinomial", featuresCol="predictors", labelCol="cluster", predictionCol="region").fit(train)
    assert right(fourier) > 0.95 and right(linear) < 0.8
    x = np.array([[0.3, -0.2], [0.1, 0.4], [1.0, 0.0]])
    features = models.FourierFeatures("v", "f", 4000, 0.7, 3)
    made = features.transform(frame(spark, x).withColumn("v", array_to_vector("x"))).orderBy("t").collect()
    f = np.array([r.f.toArray()[:4000] for r in made])
    assert np.allclose(f @ f.T, np.exp(-((x[:, None] - x[None]) ** 2).sum(2) / (2 * 0.7**2)), atol=0.06)


class TrueRegions:
    """A clusterer that knows the regions: t tells them apart."""

    def fit(self, rows):
        return self

    def transform(self, rows):
        truth = generators.piecewise_affine(rows.sparkSession, 500, 1).select("t", F.col("region").alias("cluster"))
        return rows.join(truth, "t")


def test_regions_of_the_generator(spark):
    df = generators.piecewise_affine(spark, 500, 1)
    fitted = models.PiecewiseAutoregression(3, 1, 1, seed=2, clusterer=TrueRegions()).fit(df)
    found = fitted.rows.join(df.select("t", F.col("region").alias("true")), "t")
    assert found.agg(F.avg((F.col("region") == F.col("true")).cast("double"))).first()[0] > 0.95
    slopes = {r: a.a[0, 0, 0] for r, a in fitted.regions.items()}
    assert np.allclose([slopes[r] for r in range(3)], [0.6, -0.5, 0.3], atol=0.1)


def test_the_gap_of_coded_rows(spark):
    rng = np.random.default_rng(3)
    states, x = rng.normal(size=(4, 3)), rng.normal(size=(30, 3))
    best = ((x - core.fit_coding(x, 4, states=states, update=("weights",), tolerance=1e-13, max_iterations=5000).gamma @ states) ** 2).sum(1)
    for rounds in (3, 400):
        rows = models.code(frame(spark, x), states, rounds, "gap").orderBy("t").collect()
        error = ((x - np.array([r.gamma for r in rows]) @ states) ** 2).sum(1)
        gaps = np.array([r.gap for r in rows])
        assert (error - best <= gaps + 1e-6).all() and (gaps >= -1e-9).all()
    assert gaps.max() < 1e-3
