"""Whole fits against their SQL on tables made so that an early end or a rough border shows."""

import datetime as dt

import duckdb
import numpy as np
import pandas as pd
import pytest

from driftlens.operators import core
from driftlens.plans import catalog, whole_fits  # noqa: F401


def differs(spark, folder, name, events):
    """The query's rows and those of its SQL, if they are not the same."""
    events.to_parquet(folder / "events.parquet", coerce_timestamps="us")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
    want = con.execute(catalog.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    a, b = sorted(tuple(r[c] for c in columns) for r in catalog.QUERIES[name](spark, str(folder)).collect()), sorted(want.fetchall())
    return (a, b) if a != b else None


@pytest.mark.parametrize("slope", [0.6, 0.0, -0.6])
def test_two_states_whose_shares_hardly_move(spark, tmp_path, slope):
    # clicks of a day among 1000 events; at slope -0.6 the regression leaves the simplex
    rng, clicks, at = np.random.default_rng(5), [], 0.0
    for _ in range(60):
        at = slope * at + rng.normal() * 4
        clicks.append(200 + round(at))
    day = np.repeat(np.arange(60), 1000)
    kind = np.concatenate([np.where(np.arange(1000) < c, "click", "view") for c in clicks])
    ts = pd.Series([dt.datetime(2024, 1, 1) + dt.timedelta(days=int(d)) for d in range(60)])[day].to_numpy()
    events = pd.DataFrame({"event_id": np.arange(60000), "ts": ts, "user_id": 1, "event_type": kind, "value": 1.0})
    assert differs(spark, tmp_path, "q_markov_mixture_two_states", events) is None


def test_the_mixture_is_solved_where_weights_hardly_move():
    rng = np.random.default_rng(3)
    g = core.project_rows(np.array([[0.2, 0.3, 0.5]]) + 1e-3 * rng.normal(size=(200, 3)))
    moments = core.moments_of(g, [1])
    w, t, cost = core.fit_mixture(moments, [1], 200, 3)
    assert w == pytest.approx([1.0]) and t.min() >= 0 and np.allclose(t.sum(1), 1)
    assert cost == pytest.approx(core.mtd_penalty(g, w, t, [1]), rel=1e-6)
    gradient = -2 * (moments[0, 1] - t[0] @ moments[1, 1]) / len(g)
    # in each column, states that are used have the least gradient
    used = np.where(t[0] > 1e-9, gradient, gradient.min(0))
    assert (used - gradient.min(0)).max() < 1e-10


def test_two_lags_reach_the_cost_of_a_long_descent():
    rng = np.random.default_rng(4)
    g = core.project_rows(np.array([[0.2, 0.3, 0.5]]) + 0.02 * rng.normal(size=(300, 3)))
    lags, moments = [1, 3], core.moments_of(g, [1, 3])
    w, t = core.random_mtd(3, lags, np.random.RandomState(1))
    block = core.Block()
    for _ in range(20_000):
        w, t, cost = core.fit_mtd_parameters(moments, lags, 300, w, t, block)
    assert core.fit_mixture(moments, lags, 300, 3)[2] <= cost + 1e-12


def test_regions_with_rare_rows_near_the_border(spark, tmp_path):
    # one value of a low user lies far above the others, as in large tables
    rng = np.random.default_rng(6)
    value, user = rng.exponential(50, 20000).round(2), rng.integers(0, 40, 20000)
    value[501], user[501] = 960.0, 2
    events = pd.DataFrame({"event_id": np.arange(20000), "ts": pd.Timestamp("2024-01-01"), "user_id": user, "event_type": "view", "value": value})
    assert differs(spark, tmp_path, "q_pw_fit_regions", events) is None
