"""Numerics: descent, fixed points, gradients, known structure, published estimates."""

import numpy as np
import pytest
from driftlens.operators import core, spg
from driftlens.operators.models import autoregression
from driftlens.operators.tvlp import constraints


def simplex(rng, n, k):
    return core.project_rows(rng.normal(size=(n, k)))


def numeric(f, x, h=1e-5):
    out = np.zeros_like(x)
    for i in np.ndindex(*x.shape):
        e = np.zeros_like(x)
        e[i] = h
        out[i] = (f(x + e) - f(x - e)) / (2 * h)
    return out


def test_coding_loss_is_zero_for_exact_factors_and_they_are_a_fixed_point():
    rng = np.random.default_rng(0)
    g, s = simplex(rng, 40, 6), rng.normal(size=(6, 10))
    assert core.coding_loss(g @ s, g, s) < 1e-14
    got = core.fit_coding(g @ s, 6, gamma=g, states=s, max_iterations=3)
    assert np.allclose(got.gamma, g, atol=1e-12) and np.allclose(got.states, s, atol=1e-12)


@pytest.mark.parametrize(("n", "d", "k", "epsilon"), [(50, 13, 3, 0.0), (500, 27, 13, 4.3)])
@pytest.mark.parametrize("update", [("states",), ("weights",), ("states", "weights")])
def test_coding_converges_without_rising(n, d, k, epsilon, update):
    x = np.random.default_rng(0).normal(size=(n, d))
    got = core.fit_coding(x, k, epsilon, update=update, max_iterations=1000)
    assert got.trace.converged
    assert all(b <= a + 1e-9 for a, b in zip(got.trace.costs, got.trace.costs[1:], strict=False))
    assert np.allclose(got.gamma.sum(1), 1) and (got.gamma >= 0).all()


def test_gradients_are_the_numeric_ones():
    rng = np.random.default_rng(0)
    lags, g = [1, 2, 4], simplex(rng, 10, 3)
    w, t = core.random_mtd(3, lags, np.random.RandomState(0))
    assert np.allclose(core.mtd_penalty_gradient(g, w, t, lags, 3.2), numeric(lambda z: core.mtd_penalty(z, w, t, lags, 3.2), g), rtol=1e-4, atol=1e-7)
    s = rng.normal(size=(4, 3))
    assert np.allclose(core.pair_penalty_gradient(s, 1.7), numeric(lambda z: core.pair_penalty(z, 1.7), s), rtol=1e-4)
    pairs = sum(((s[i] - s[j]) ** 2).sum() for i in range(4) for j in range(i))
    assert core.pair_penalty(s, 1.7) == pytest.approx(1.7 * 2 / (4 * 3 * 3) * pairs)


def test_mixture_is_recovered_from_moments():
    rng = np.random.default_rng(1)
    lags = [1, 2]
    w, t = np.array([0.7, 0.3]), np.stack([core.project_columns(rng.normal(size=(3, 3))) for _ in range(2)])
    g = simplex(rng, 60, 3)
    g = core.mtd_predicted(g, w, t, lags)  # not exact, but close to a mixture
    moments = core.moments_of(g, lags)
    w2, t2, cost = core.fit_mixture(moments, lags, len(g), 3)
    assert cost <= core.mtd_penalty(g, w, t, lags) + 1e-8
    assert cost == pytest.approx(core.mtd_penalty(g, w2, t2, lags), abs=1e-10)
    assert np.allclose(t2.sum(1), 1) and np.isclose(w2.sum(), 1)


def test_forecast_is_the_recursion():
    rng = np.random.default_rng(2)
    lags, g = [1, 3], simplex(rng, 10, 2)
    w, t = core.random_mtd(2, lags, np.random.RandomState(1))
    past = list(g)
    for _ in range(3):
        past.append(sum(wi * ti @ past[-lag] for wi, ti, lag in zip(w, t, lags, strict=True)))
    blocks = core.forecast_blocks(w, t, lags, 3)
    assert np.allclose(sum(b @ g[-1 - j] for j, b in enumerate(blocks)), past[-1])


def test_joint_mixture_fit_does_not_rise():
    got = core.fit_coding(np.random.default_rng(0).normal(size=(200, 9)), 4, 1.3, [1, 3, 4], 6.4, max_iterations=200)
    assert all(b <= a + 1e-6 for a, b in zip(got.trace.costs, got.trace.costs[1:], strict=False))
    assert np.isclose(got.order_weights.sum(), 1)


@pytest.mark.parametrize(("corners", "n"), [(np.array([[0, 0], [1, 0], [0, 1.0]]), 50), (np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1.0]]), 123)])
def test_archetypes_are_the_hull(corners, n):
    rng = np.random.default_rng(0)
    k = len(corners)
    x = rng.dirichlet(np.ones(k), n) @ corners
    at = rng.choice(n, k, replace=False)
    x[at] = corners
    got = core.fit_archetypes(x, k, tolerance=1e-9)
    assert sorted(got.dictionary.argmax(1)) == sorted(at)
    assert all(b <= a + 1e-9 for a, b in zip(got.trace.costs, got.trace.costs[1:], strict=False))


def test_relaxed_archetypes_are_no_worse():
    x = np.random.default_rng(3).normal(size=(80, 5))
    strict, free = (core.fit_archetypes(x, 4, delta, max_iterations=200) for delta in (0.0, 0.3))
    assert free.trace.costs[-1] <= strict.trace.costs[-1] + 1e-6
    assert (abs(free.scales - 1) <= 0.3 + 1e-12).all()


#: West German investment, income and consumption by quarter, 1960 to 1978, and the estimates printed for them, from
#: H. Lütkepohl, New Introduction to Multiple Time Series Analysis (Springer, 2005).
QUARTERS = [
    (180, 451, 415),
    (179, 465, 421),
    (185, 485, 434),
    (192, 493, 448),
    (211, 509, 459),
    (202, 520, 458),
    (207, 521, 479),
    (214, 540, 487),
    (231, 548, 497),
    (229, 558, 510),
    (234, 574, 516),
    (237, 583, 525),
    (206, 591, 529),
    (250, 599, 538),
    (259, 610, 546),
    (263, 627, 555),
    (264, 642, 574),
    (280, 653, 574),
    (282, 660, 586),
    (292, 694, 602),
    (286, 709, 617),
    (302, 734, 639),
    (304, 751, 653),
    (307, 763, 668),
    (317, 766, 679),
    (314, 779, 686),
    (306, 808, 697),
    (304, 785, 688),
    (292, 794, 704),
    (275, 799, 699),
    (273, 799, 709),
    (301, 812, 715),
    (280, 837, 724),
    (289, 853, 746),
    (303, 876, 758),
    (322, 897, 779),
    (315, 922, 798),
    (339, 949, 816),
    (364, 979, 837),
    (371, 988, 858),
    (375, 1025, 881),
    (432, 1063, 905),
    (453, 1104, 934),
    (460, 1131, 968),
    (475, 1137, 983),
    (496, 1178, 1013),
    (494, 1211, 1034),
    (498, 1256, 1064),
    (526, 1290, 1101),
    (519, 1314, 1102),
    (516, 1346, 1145),
    (531, 1385, 1173),
    (573, 1416, 1216),
    (551, 1436, 1229),
    (538, 1462, 1242),
    (532, 1493, 1267),
    (558, 1516, 1295),
    (524, 1557, 1317),
    (525, 1613, 1355),
    (519, 1642, 1371),
    (526, 1690, 1402),
    (510, 1759, 1452),
    (519, 1756, 1485),
    (538, 1780, 1516),
    (549, 1807, 1549),
    (570, 1831, 1567),
    (559, 1873, 1588),
    (584, 1897, 1631),
    (611, 1910, 1650),
    (597, 1943, 1685),
    (603, 1976, 1722),
    (619, 2018, 1752),
    (635, 2040, 1774),
    (658, 2070, 1807),
    (675, 2121, 1831),
    (700, 2132, 1842),
]


def published():
    return np.diff(np.log(np.array(QUARTERS, float)), axis=0)


def check_published(got):
    assert np.allclose(got.mu, [-0.017, 0.016, 0.013], atol=1e-3)
    assert np.allclose(got.a[0], [[-0.320, 0.146, 0.961], [0.044, -0.153, 0.289], [-0.002, 0.225, -0.264]], atol=1e-3)
    assert np.allclose(got.a[1], [[-0.161, 0.115, 0.934], [0.050, 0.019, -0.010], [0.034, 0.355, -0.022]], atol=1e-3)
    assert np.allclose(got.sigma, 1e-4 * np.array([[21.30, 0.72, 1.23], [0.72, 1.37, 0.61], [1.23, 0.61, 0.89]]), atol=1e-5)


def test_published_estimates_of_a_var():
    check_published(core.fit_autoregression(published(), 2))


def test_published_estimates_over_a_frame(spark):
    y = published()
    df = spark.createDataFrame([(0, t, row.tolist()) for t, row in enumerate(y)], "series_id long, t long, x array<double>")
    check_published(autoregression(df, 2))


def test_autoregression_recovers_coefficients_with_inputs_and_weights():
    rng = np.random.default_rng(4)
    u, y = rng.normal(size=(400, 1)), np.zeros((400, 2))
    a, b0, mu = np.array([[0.4, 0.1], [-0.2, 0.3]]), np.array([[1.0], [-2.0]]), np.array([0.5, -0.1])
    for t in range(1, 400):
        y[t] = mu + a @ y[t - 1] + b0 @ u[t]
    got = core.fit_autoregression(y, 1, u, 0, weights=rng.random(399) + 0.1)
    assert np.allclose(got.a[0], a) and np.allclose(got.b0, b0) and np.allclose(got.mu, mu)
    with pytest.raises(ValueError):
        core.fit_autoregression(y, 1, u, 0, weights=np.ones(3))


def test_bounded_weights():
    d = np.random.default_rng(5).random((60, 3))
    free = core.bounded_weights(d, None)
    assert (free.argmax(1) == d.argmin(1)).all()
    costs = []
    for bound in (0, 1.5, 5, 20, 1000):
        w = core.bounded_weights(d, bound)
        assert np.allclose(w.sum(1), 1) and (w >= 0).all() and (core.total_variation(w) <= bound + 1e-6).all()
        costs.append((w * d).sum())
    assert costs[0] == pytest.approx(d.sum(0).min()) and costs[-1] == pytest.approx(d.min(1).sum())
    assert costs == sorted(costs, reverse=True)


def test_regimes_find_switches():
    rng = np.random.default_rng(6)
    truth = np.repeat([0, 1, 0], 40)
    x = np.array([[0.0, 3.0], [3.0, 0.0]])[truth] + rng.normal(size=(120, 2)) * 0.3
    got = core.fit_regimes(core.Centers(), x, None, 2, 3.0, seed=1)
    hard = got.gamma.argmax(1)
    assert max((hard == truth).mean(), (hard != truth).mean()) > 0.98
    y = np.zeros((300, 1))
    truth = np.repeat([0, 1, 0], 100)
    for t in range(1, 300):
        y[t] = [2.0, -2.0][truth[t]] + 0.3 * y[t - 1] + 0.2 * rng.normal()
    best = min((core.fit_regimes(core.Autoregressions([1, 1]), y, None, 2, 3.0, seed=s) for s in range(5)), key=lambda r: r.trace.costs[-1])
    hard = best.gamma.argmax(1)
    assert max((hard == truth).mean(), (hard != truth).mean()) > 0.95


def test_step_rules():
    assert spg.spectral_length(1, -1) == 1e3 and spg.spectral_length(1, 1e9) == 1e-3 and spg.spectral_length(2, 4) == 0.5
    assert spg.next_step(1.0, -1.0, 0.0, 1.0) == pytest.approx(0.25)
    step, value = spg.line_search(spg.parabola(1.0, -1.0, 0.5), -1.0, [1.0])
    assert step == 1.0 and value == 0.5
    with pytest.raises(ValueError):
        core.check_lags([0, 1])


def test_constraints_of_the_programme(spark):
    rows = constraints(spark, 3, 2).collect()
    a = np.zeros((3, 10))
    for r in rows:
        if r.kind == "eq":
            a[r.r, r.col] = r.coeff
    assert a[:, :6].tolist() == np.kron(np.eye(3), np.ones(2)).tolist()
    assert sum(r.kind == "bound" for r in rows) == 4 and sum(r.kind == "positive" for r in rows) == 10


# The published sizes, tolerances and numbers of iterations within which such fits are expected to end.


@pytest.mark.parametrize(("n", "d", "k", "epsilon", "update", "limit"), [(50, 13, 3, 0.0, "states", 100), (500, 27, 13, 4.3, "states", 100), (500, 10, 9, 0.0, "weights", 100), (500, 35, 4, 1.3, "weights", 100)])
def test_codings_end_within_their_budgets(n, d, k, epsilon, update, limit):
    rng = np.random.default_rng(0)
    x = rng.dirichlet(np.ones(k), n) @ rng.uniform(size=(k, d))
    got = core.fit_coding(x, k, epsilon, update=(update,), tolerance=1e-6, max_iterations=limit, seed=0)
    assert got.trace.converged and len(got.trace.costs) - 1 < limit


@pytest.mark.parametrize(("n", "d", "k", "lags", "epsilon", "update", "limit"), [
    (50, 13, 3, [6, 7], 0.0, "states", 100), (500, 27, 13, [1, 12], 0.0, "states", 100), (500, 10, 9, [1, 2], 0.0, "weights", 100), (500, 35, 4, [1, 2], 3.4, "weights", 100), (500, 35, 4, [1, 3, 4], 1.0, "parameters", 200),
])
def test_joint_codings_end_within_their_budgets(n, d, k, lags, epsilon, update, limit):
    rng = np.random.default_rng(0)
    x = rng.dirichlet(np.ones(k), n) @ rng.uniform(size=(k, d))
    got = core.fit_coding(x, k, 0.0, lags, epsilon, update=(update,), tolerance=1e-6, max_iterations=limit, seed=0)
    assert got.trace.converged and len(got.trace.costs) - 1 < limit


@pytest.mark.parametrize(("n", "d", "k", "delta", "update", "tolerance", "limit"), [
    (600, 20, 15, 0.0, ("dictionary",), 1e-6, 500), (320, 30, 11, 3.2, ("dictionary",), 1e-4, 1000), (600, 10, 3, 0.0, ("weights",), 1e-6, 100), (320, 30, 11, 0.3, ("weights",), 1e-4, 1000),
    (50, 2, 3, 0.0, ("dictionary", "weights"), 1e-6, 500),
])
def test_archetypes_end_within_their_budgets(n, d, k, delta, update, tolerance, limit):
    rng = np.random.default_rng(0)
    x = rng.uniform(size=(n, d))
    if len(update) == 2:  # a hull, whose corners are among the samples
        corners = np.vstack([np.zeros(d), np.eye(d)])
        x = rng.dirichlet(np.ones(k), n) @ corners
        x[rng.choice(n, k, replace=False)] = corners
    got = core.fit_archetypes(x, k, delta, init="furthest_sum" if len(update) == 2 else "random", update=update, tolerance=tolerance, max_iterations=limit, seed=0)
    assert got.trace.converged and len(got.trace.costs) - 1 < limit


def test_the_hull_of_four_corners_to_1e12():
    """500 iterations are expected; this takes 889 (README)."""
    rng = np.random.RandomState(0)
    s = core.right_stochastic((123, 4), rng)
    s[[8, 9, 56, 90]] = np.eye(4)
    x = s @ np.vstack([np.zeros(3), np.eye(3)])
    start = {"dictionary": core.right_stochastic((4, 123), rng), "weights": core.right_stochastic((123, 4), rng)}
    got = core.fit_archetypes(x, 4, init="custom", tolerance=1e-12, max_iterations=1000, **start)
    assert got.trace.converged and sorted(got.dictionary.argmax(1)) == [8, 9, 56, 90]
