"""Registry of the model queries and their SQL.

Each query applies an operator to whole tables. Where an operator needs weights
gamma or states, all engines take the same ones: gamma(t, i) is
1 + (t (i + 1)) mod 7, normalised over i; states are the vectors of the K
smallest ids. The Markov mixture has lags 1 and 3, order weights 0.6 and 0.4 and
transitions 1 + ((i + 1) (j + 2) lag) mod 5, normalised over i. Values are
rounded, since engines add floats in different orders.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import vec
from driftlens.operators import core, markov, models, moments, pairs, regimes_long, seeding, tvlp
from driftlens.sources import frames
from driftlens.sources.store import shared_dir, workers_know

K, LAGS, ORDER = 4, [1, 3], np.array([0.6, 0.4])
EPSILON_STATES, EPSILON_WEIGHTS = 0.5, 2.0
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, d: str) -> DataFrame:
            workers_know(spark)
            return f(spark, d)

        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = _expand(sql)
        return f

    return add


# --- common parts of the SQL --------------------------------------------------

_CTES = {
    "x": "x AS (SELECT CAST(vec_id AS BIGINT) AS t, unnest(range(len(embedding))) AS j, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)",
    "n": "n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT t) AS DOUBLE) AS rows, CAST(count(DISTINCT j) AS DOUBLE) AS d FROM x)",
    "g": f"g AS (SELECT t, i, r / sum(r) OVER (PARTITION BY t) AS g FROM (SELECT CAST(vec_id AS BIGINT) AS t, i, CAST(1 + (vec_id * (i + 1)) % 7 AS DOUBLE) AS r FROM embeddings, range({K}) k(i)))",
    "s": f"s AS (SELECT i, j, v AS s FROM x JOIN (SELECT vec_id AS t, row_number() OVER (ORDER BY vec_id) - 1 AS i FROM embeddings) USING (t) WHERE i < {K})",
    "gram": "gram AS (SELECT a.i AS i, b.i AS j, sum(a.s * b.s) AS v FROM s a JOIN s b ON a.j = b.j GROUP BY 1, 2)",
    "gtg": "gtg AS (SELECT a.i AS i, b.i AS j, sum(a.g * b.g) AS v FROM g a JOIN g b ON a.t = b.t GROUP BY 1, 2)",
    "gtx": "gtx AS (SELECT i, j, sum(g * v) AS v FROM g JOIN x USING (t) GROUP BY 1, 2)",
    "y": "y AS (SELECT t, j, sum(g * s) AS y FROM g JOIN s USING (i) GROUP BY 1, 2)",
    "loss": "loss AS (SELECT sum((v - y) * (v - y)) / any_value(n) AS loss FROM x JOIN y USING (t, j), n)",
    "penalty": f"penalty AS (SELECT {EPSILON_STATES} * 2.0 / ({K} * any_value(d) * ({K} - 1)) * ({K} * sum(CASE WHEN i = j THEN v ELSE 0 END) - sum(v)) AS penalty FROM gram, n)",
    "gradw": "gradw AS (SELECT gs.t, gs.i, 2 / n * (gs.v - xs.v) AS v FROM (SELECT g.t AS t, gram.i AS i, sum(g.g * gram.v) AS v FROM gram JOIN g ON gram.j = g.i GROUP BY 1, 2) gs JOIN (SELECT x.t AS t, s.i AS i, sum(x.v * s.s) AS v FROM x JOIN s ON x.j = s.j GROUP BY 1, 2) xs ON gs.t = xs.t AND gs.i = xs.i, n)",
    "day": "day AS (SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS c FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2)",
    "kind": "kind AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS i FROM (SELECT DISTINCT event_type FROM day))",
    "w": "w AS (SELECT CAST(datediff('day', (SELECT min(day) FROM day), d.day) AS BIGINT) AS t, i, coalesce(c, 0) / sum(coalesce(c, 0)) OVER (PARTITION BY d.day) AS g FROM (SELECT DISTINCT day FROM day) d CROSS JOIN kind LEFT JOIN day ON day.day = d.day AND day.event_type = kind.event_type)",
    "tr": f"tr AS (SELECT lag, i, j, r / sum(r) OVER (PARTITION BY lag, j) AS p, CASE lag WHEN {LAGS[0]} THEN {ORDER[0]} ELSE {ORDER[1]} END AS w FROM (SELECT lag, a.i AS i, b.i AS j, CAST(1 + ((a.i + 1) * (b.i + 2) * lag) % 5 AS DOUBLE) AS r FROM kind a, kind b, (VALUES ({LAGS[0]}), ({LAGS[1]})) l(lag)))",
    "z": f"z AS (SELECT t, i, g, CASE WHEN t < {max(LAGS)} THEN g ELSE (SELECT sum(tr.w * tr.p * past.g) FROM tr JOIN w past ON past.t = w.t - tr.lag AND past.i = tr.j WHERE tr.i = w.i) END AS z FROM w)",
    "m": f"m AS (SELECT a.lag AS a, b.lag AS b, p.i AS i, q.i AS j, sum(p.g * q.g) AS v FROM (VALUES (0), ({LAGS[0]}), ({LAGS[1]})) a(lag), (VALUES (0), ({LAGS[0]}), ({LAGS[1]})) b(lag), w p, w q WHERE p.t + a.lag = q.t + b.lag AND p.t + a.lag >= {max(LAGS)} AND p.t + a.lag <= (SELECT max(t) FROM w) GROUP BY ALL)",
    "rg": "rg AS (SELECT tr.lag, i, j, p, w, (SELECT sum((r.g - r.z) * past.g) FROM z r JOIN w past ON past.t = r.t - tr.lag WHERE r.i = tr.i AND past.i = tr.j AND r.t >= 3) AS v FROM tr)",
    "cw": f"cw AS (SELECT {EPSILON_WEIGHTS} / ((SELECT count(*) FROM kind) * ((SELECT count(DISTINCT t) FROM w) - {max(LAGS)})) AS c)",
    "last": "last AS (SELECT user_id, t, CAST(value AS DOUBLE) AS y, lag(CAST(value AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY t) AS y1, lag(CAST(value AS DOUBLE), 2) OVER (PARTITION BY user_id ORDER BY t) AS y2 FROM (SELECT user_id, event_id AS t, value FROM events))",
}
_NEEDS = {
    "n": "x", "s": "x", "gram": "s", "gtg": "g", "gtx": "g x", "y": "g s", "loss": "x y n", "penalty": "gram n", "gradw": "gram g x s n",
    "kind": "day", "w": "day kind", "tr": "kind", "z": "w tr", "m": "w", "rg": "z w tr", "cw": "w kind",
}


def _expand(sql: str) -> str:
    """Puts the common parts that the SQL names in its first line, {a b}, before it."""
    if not sql.startswith("{"):
        return sql
    names, _, body = sql[1:].partition("}")
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, "").split():
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    body = body.strip()
    joint = ", " if body.startswith("+") else " "
    return "WITH " + ", ".join(_CTES[n] for n in order) + joint + body.removeprefix("+")


# --- common parts of the DataFrames -------------------------------------------


def _gamma(t: str = "t", k: int = K) -> Column:
    return vec.normalised(F.array(*[(1 + (F.col(t) * (i + 1)) % 7).cast("double") for i in range(k)]))


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return frames.vectors(spark, d).withColumn("gamma", _gamma())


def _states(spark: SparkSession, d: str, k: int = K) -> np.ndarray:
    return np.array([r.x for r in frames.vectors(spark, d).orderBy("t").limit(k).collect()])


def _transitions(k: int) -> np.ndarray:
    i, j = np.indices((k, k))
    raw = np.stack([1.0 + ((i + 1) * (j + 2) * lag) % 5 for lag in LAGS])
    return raw / raw.sum(1, keepdims=True)


def _cells(df: DataFrame, column: str, name: str, *keys: str, decimals: int = 6, place: str = "j") -> DataFrame:
    """(keys, place, value) of a vector column."""
    out = df.select(*keys, F.posexplode(column).alias(place, name))
    return out.select(*keys, F.col(place).cast("long").alias(place), F.round(name, decimals).alias(name))


def _table(spark: SparkSession, matrix: np.ndarray, decimals: int = 6) -> DataFrame:
    rows = [(int(i), int(j), float(matrix[i, j])) for i, j in np.ndindex(*matrix.shape)]
    return spark.createDataFrame(rows, "i long, j long, v double").withColumn("v", F.round("v", decimals))


def _mixture(spark: SparkSession, d: str) -> tuple[DataFrame, np.ndarray]:
    days = frames.daily_shares(spark, d)
    return days, _transitions(len(days.first().gamma))


def _predicted(days: DataFrame, t: np.ndarray) -> DataFrame:
    """days with z: what the mixture predicts."""
    rows = frames.lagged(days, "gamma", LAGS)
    total = vec.scaled(vec.matvec(t[0], f"gamma_lag{LAGS[0]}"), ORDER[0])
    for w, m, lag in zip(ORDER[1:], t[1:], LAGS[1:], strict=True):
        total = vec.add(total, vec.scaled(vec.matvec(m, f"gamma_lag{lag}"), w))
    return rows.withColumn("z", F.when(F.col(f"gamma_lag{max(LAGS)}").isNotNull(), total).otherwise(F.col("gamma")))


def _users(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return events.select(F.col("user_id").alias("series_id"), F.col("event_id").alias("t"), F.array(F.col("value").cast("double")).alias("x"))


# --- simplex and stochastic matrices ------------------------------------------


@query("""{x} + p AS (SELECT t, j, v, sum(v) OVER o AS s, row_number() OVER o AS k FROM x WINDOW o AS (PARTITION BY t ORDER BY v DESC, j ROWS UNBOUNDED PRECEDING)),
h AS (SELECT t, max((s - 1) / k) AS theta FROM p GROUP BY t) SELECT t, j, round(greatest(v - theta, 0), 6) AS p FROM p JOIN h USING (t)""")
def q_simplex_rows(spark: SparkSession, d: str) -> DataFrame:
    return _cells(frames.vectors(spark, d).withColumn("p", vec.simplex_project("x")), "p", "p", "t")


@query("""{x} + p AS (SELECT t, j, v, sum(v) OVER o AS s, row_number() OVER o AS k FROM x WINDOW o AS (PARTITION BY j ORDER BY v DESC, t ROWS UNBOUNDED PRECEDING)),
h AS (SELECT j, max((s - 1) / k) AS theta FROM p GROUP BY j) SELECT t, j, round(greatest(v - theta, 0), 6) AS p FROM p JOIN h USING (j)""")
def q_simplex_cols(spark: SparkSession, d: str) -> DataFrame:
    return _cells(moments.simplex_columns(frames.vectors(spark, d), "x", ["t"])[0], "x", "p", "t")


@query("{g} SELECT t, i, round(g, 6) AS g FROM g")
def q_stochastic_rows(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_rows(spark, d), "gamma", "g", "t", place="i")


@query("{g} SELECT round(max(abs(s - 1)), 6) AS worst, count(*) AS rows FROM (SELECT t, sum(g) AS s FROM g GROUP BY t)")
def q_stochastic_check(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).agg(F.round(F.max(F.abs(vec.total("gamma") - 1)), 6).alias("worst"), F.count("*").alias("rows"))


# --- kernels and seeding ------------------------------------------------------

_PAIRS = "{{}} SELECT CAST(a.vec_id AS BIGINT) AS i, CAST(b.vec_id AS BIGINT) AS j, round({}, 5) AS {} FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) a, (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings) b"


@query(_PAIRS.format("list_dot_product(a.e, b.e)", "k").replace("{} ", ""))
def q_kernel_linear(spark: SparkSession, d: str) -> DataFrame:
    return pairs.all_pairs(frames.vectors(spark, d), pairs.products, "k", 5)


@query(_PAIRS.format("list_distance(a.e, b.e)", "d").replace("{} ", ""))
def q_dissimilarity(spark: SparkSession, d: str) -> DataFrame:
    return pairs.all_pairs(frames.vectors(spark, d), pairs.distances, "d", 5)


@query("""WITH e AS (SELECT CAST(vec_id AS BIGINT) AS t, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p0 AS (SELECT t, v FROM e ORDER BY t LIMIT 1),
p1 AS (SELECT e.t, e.v FROM e, p0 WHERE e.t <> p0.t ORDER BY list_distance(e.v, p0.v) DESC, e.t LIMIT 1),
p2 AS (SELECT e.t, e.v FROM e, p0, p1 WHERE e.t NOT IN (p0.t, p1.t) ORDER BY list_distance(e.v, p0.v) + list_distance(e.v, p1.v) DESC, e.t LIMIT 1),
p3 AS (SELECT e.t, e.v FROM e, p0, p1, p2 WHERE e.t NOT IN (p0.t, p1.t, p2.t) ORDER BY list_distance(e.v, p0.v) + list_distance(e.v, p1.v) + list_distance(e.v, p2.v) DESC, e.t LIMIT 1)
SELECT CAST(0 AS BIGINT) AS pick, t FROM p0 UNION ALL SELECT 1, t FROM p1 UNION ALL SELECT 2, t FROM p2 UNION ALL SELECT 3, t FROM p3""")
def q_furthest_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.vectors(spark, d)
    picked = seeding.furthest_sum(rows, 4, rows.agg(F.min("t")).first()[0])
    return spark.createDataFrame([(k, t) for k, (t, _) in enumerate(picked)], "pick long, t long")


# --- convex coding ------------------------------------------------------------


def _loss(rows: DataFrame, states: np.ndarray) -> Column:
    return F.sum(vec.sqdist("x", vec.weighted_rows("gamma", states))) / F.sum(F.size("x"))


@query("{loss} SELECT round(loss, 6) AS loss FROM loss")
def q_gpnh_loss(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).agg(F.round(_loss(None, _states(spark, d)), 6).alias("loss"))


@query("{penalty} SELECT round(penalty, 6) AS penalty FROM penalty")
def q_gpnh_penalty(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(core.pair_penalty(_states(spark, d), EPSILON_STATES),)], "penalty double").select(F.round("penalty", 6).alias("penalty"))


@query("{loss penalty} SELECT round(loss + penalty, 6) AS cost FROM loss, penalty")
def q_gpnh_cost(spark: SparkSession, d: str) -> DataFrame:
    states = _states(spark, d)
    return _rows(spark, d).agg(F.round(_loss(None, states) + core.pair_penalty(states, EPSILON_STATES), 6).alias("cost"))


@query(f"""{{gtx gtg s n}} SELECT i, j, round({4 * EPSILON_STATES} / (d * {K * (K - 1)}) * ({K} * s - sum(s) OVER (PARTITION BY j)) + 2 / n * (gs - gtx.v), 6) AS v
FROM s JOIN gtx USING (i, j) JOIN (SELECT gtg.i AS i, s.j AS j, sum(gtg.v * s.s) AS gs FROM gtg JOIN s ON gtg.j = s.i GROUP BY 1, 2) USING (i, j), n""")
def q_gpnh_grad_dict(spark: SparkSession, d: str) -> DataFrame:
    states = _states(spark, d)
    gtg, gtx, n = _products(_rows(spark, d))
    gradient = core.pair_penalty_gradient(states, EPSILON_STATES) + 2 / (n * states.shape[1]) * (gtg @ states - gtx)
    return _table(spark, gradient)


def _products(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums of gamma gamma', of gamma x' and the number of rows (weights sum to 1), in one pass."""
    both = moments.cross(rows.withColumn("all", F.concat("gamma", "x")), "gamma", "all")
    return both[:, : len(both)], both[:, len(both) :], float(both[:, : len(both)].sum())


def _weights_gradient(spark: SparkSession, d: str) -> DataFrame:
    rows, states = _rows(spark, d), _states(spark, d)
    n = rows.agg(F.sum(F.size("x"))).first()[0]
    return rows.withColumn("g", vec.scaled(vec.add(vec.matvec(states @ states.T, "gamma"), vec.matvec(states, "x"), -1.0), 2 / n))


@query("{gradw} SELECT t, i, round(v, 9) AS v FROM gradw")
def q_gpnh_grad_weights(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_weights_gradient(spark, d), "g", "v", "t", place="i", decimals=9)


@query("""{gradw} + u AS (SELECT g.t AS t, g.i AS i, g.g - 100 * gradw.v AS v FROM g JOIN gradw ON g.t = gradw.t AND g.i = gradw.i),
p AS (SELECT t, i, v, sum(v) OVER o AS s, row_number() OVER o AS k FROM u WINDOW o AS (PARTITION BY t ORDER BY v DESC, i ROWS UNBOUNDED PRECEDING)),
h AS (SELECT t, max((s - 1) / k) AS theta FROM p GROUP BY t) SELECT t, i, round(greatest(v - theta, 0), 6) AS g FROM p JOIN h USING (t)""")
def q_gpnh_weights_step(spark: SparkSession, d: str) -> DataFrame:
    """A projected step of length 100."""
    rows = _weights_gradient(spark, d)
    return _cells(rows.withColumn("gamma", vec.simplex_project(vec.add("gamma", "g", -100.0))), "gamma", "g", "t", place="i")


@query("{y} SELECT t, j, round(y, 6) AS y FROM y")
def q_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    return _cells(models.reconstruct(_rows(spark, d), _states(spark, d)), "y", "y", "t")


# --- Markov mixtures ----------------------------------------------------------


@query("{z} SELECT t, i, round(z, 6) AS z FROM z")
def q_mtd_predicted(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_predicted(*_mixture(spark, d)), "z", "z", "t", place="i")


@query("{z cw} SELECT round(sum((g - z) * (g - z)) * any_value(c), 6) AS penalty FROM z, cw")
def q_mtd_penalty(spark: SparkSession, d: str) -> DataFrame:
    days, t = _mixture(spark, d)
    k, m = t.shape[1], max(LAGS)
    return _predicted(days, t).agg(F.round(F.sum(vec.sqdist("gamma", "z")) * EPSILON_WEIGHTS / (k * (F.count("*") - m)), 6).alias("penalty"))


@query("""{z cw} SELECT r.t, r.i, round(2 * any_value(c) * ((any_value(r.g) - any_value(r.z)) - coalesce((SELECT sum(tr.w * tr.p * (a.g - a.z)) FROM tr JOIN z a ON a.t = r.t + tr.lag AND a.i = tr.i WHERE tr.j = r.i AND a.t >= 3), 0)), 6) AS v
FROM z r, cw GROUP BY r.t, r.i""")
def q_mtd_grad_weights(spark: SparkSession, d: str) -> DataFrame:
    days, t = _mixture(spark, d)
    n, k, m = days.count(), t.shape[1], max(LAGS)
    rows = _predicted(days, t).withColumn("r", vec.add("gamma", "z", -1.0))
    zero = vec.literal(np.zeros(k))
    # a residual matters to the weights lag rows before; residuals of the first rows are 0
    rows = frames.lagged(rows.select("series_id", "t", "r"), "r", [-lag for lag in LAGS])
    total = F.col("r")
    for w, matrix, lag in zip(ORDER, t, LAGS, strict=True):
        total = vec.add(total, vec.matvec(matrix.T, F.coalesce(f"r_lag{-lag}", zero)), -w)
    return _cells(rows.withColumn("g", vec.scaled(total, 2 * EPSILON_WEIGHTS / (k * (n - m)))), "g", "v", "t", place="i")


@query("{m} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, i, j, round(v, 6) AS v FROM m")
def q_mtd_lagged_moments(spark: SparkSession, d: str) -> DataFrame:
    got = moments.lagged_moments(frames.daily_shares(spark, d), "gamma", LAGS)
    rows = [(a, b, int(i), int(j), float(m[i, j])) for (a, b), m in got.items() for i, j in np.ndindex(*m.shape)]
    return spark.createDataFrame(rows, "a long, b long, i long, j long, v double").withColumn("v", F.round("v", 6))


def _residual_moments(spark: SparkSession, d: str) -> tuple[list[np.ndarray], np.ndarray, float]:
    days, t = _mixture(spark, d)
    got = moments.lagged_moments(days, "gamma", LAGS)
    k = t.shape[1]
    co = {0: np.eye(k), **{lag: -w * m for w, m, lag in zip(ORDER, t, LAGS, strict=True)}}
    return [sum(co[a] @ got[a, lag] for a in co) for lag in LAGS], t, EPSILON_WEIGHTS / (k * (days.count() - max(LAGS)))


@query("{rg cw} SELECT CAST(lag AS BIGINT) AS lag, round(-2 * any_value(c) * sum(p * v), 6) AS v FROM rg, cw GROUP BY lag")
def q_mtd_grad_order(spark: SparkSession, d: str) -> DataFrame:
    rg, t, c = _residual_moments(spark, d)
    return spark.createDataFrame([(lag, float(-2 * c * (m * r).sum())) for lag, m, r in zip(LAGS, t, rg, strict=True)], "lag long, v double").withColumn("v", F.round("v", 6))


@query("{rg cw} SELECT CAST(lag AS BIGINT) AS lag, i, j, round(-2 * c * w * v, 6) AS v FROM rg, cw")
def q_mtd_grad_transition(spark: SparkSession, d: str) -> DataFrame:
    rg, _, c = _residual_moments(spark, d)
    rows = [(lag, int(i), int(j), float(-2 * c * w * r[i, j])) for lag, w, r in zip(LAGS, ORDER, rg, strict=True) for i, j in np.ndindex(*r.shape)]
    return spark.createDataFrame(rows, "lag long, i long, j long, v double").withColumn("v", F.round("v", 6))


def _ahead(spark: SparkSession, d: str, horizon: int) -> DataFrame:
    days, t = _mixture(spark, d)
    rows = models.forecast(days, ORDER, t, LAGS, horizon, "chunk")
    return _cells(rows.where("ahead IS NOT NULL"), "ahead", "v", "t", place="i")


def _ahead_sql(horizon: int) -> str:
    """h0 is known; step h adds the forecast for h steps after each day, from those before and from the past."""
    steps = []
    for h in range(1, horizon + 1):
        part = " + ".join(f"(SELECT sum(tr.w * tr.p * q.g) FROM tr JOIN {f'h{h - lag} q ON q.t = b.t' if lag <= h else f'w q ON q.t = b.t - {lag - h}'} AND q.i = tr.j WHERE tr.lag = {lag} AND tr.i = b.i)" for lag in LAGS)
        steps.append(f"h{h} AS (SELECT t, i, {part} AS g FROM w b WHERE t >= {max(LAGS) - 1})")
    return "{w tr} + h0 AS (SELECT t, i, g FROM w), " + ", ".join(steps) + f" SELECT t, i, round(g, 6) AS v FROM h{horizon}"


@query(_ahead_sql(1))
def q_mtd_forecast_h1(spark: SparkSession, d: str) -> DataFrame:
    return _ahead(spark, d, 1)


@query(_ahead_sql(3))
def q_mtd_forecast_h3(spark: SparkSession, d: str) -> DataFrame:
    return _ahead(spark, d, 3)


# --- archetypes ---------------------------------------------------------------


@query("{y x} SELECT round(sum((v - y) * (v - y)), 4) AS cost FROM x JOIN y USING (t, j)")
def q_aa_cost(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).agg(F.round(F.sum(vec.sqdist("x", vec.weighted_rows("gamma", _states(spark, d)))), 4).alias("cost"))


@query("{gradw n} SELECT t, i, round(v * n, 5) AS v FROM gradw, n")
def q_aa_grad_s(spark: SparkSession, d: str) -> DataFrame:
    states = _states(spark, d)
    g = vec.scaled(vec.add(vec.matvec(states @ states.T, "gamma"), vec.matvec(states, "x"), -1.0), 2.0)
    return _cells(_rows(spark, d).withColumn("g", g), "g", "v", "t", place="i", decimals=5)


@query("""{gtg gtx s x} + b AS (SELECT gtx.i AS i, gtx.j AS j, 2 * (any_value(gs) - any_value(gtx.v)) AS b FROM gtx JOIN (SELECT gtg.i AS i, s.j AS j, sum(gtg.v * s.s) AS gs FROM gtg JOIN s ON gtg.j = s.i GROUP BY 1, 2) USING (i, j) GROUP BY 1, 2)
SELECT t, i, round(sum(b * v), 3) AS v FROM b JOIN x USING (j) GROUP BY t, i""")
def q_aa_grad_c(spark: SparkSession, d: str) -> DataFrame:
    rows, states = _rows(spark, d), _states(spark, d)
    gtg, gtx, _ = _products(rows)
    base = 2 * (gtg @ states - gtx)
    return _cells(rows.withColumn("g", vec.matvec(base, "x")), "g", "v", "t", place="i", decimals=3)


# --- k-means and regimes ------------------------------------------------------

_DIST = "dist AS (SELECT t, i, sum((v - s) * (v - s)) AS d FROM x JOIN s USING (j) GROUP BY t, i)"


@query("{x s} + " + _DIST + " SELECT t, i, round(sqrt(d), 6) AS d FROM dist")
def q_kmeans_distances(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.vectors(spark, d).withColumn("d", F.transform(vec.sqdists("x", _states(spark, d)), lambda v: F.sqrt(v)))
    return _cells(rows, "d", "d", "t", place="i")


@query("{x s} + " + _DIST + " SELECT t, arg_min(i, (d, i)) AS label FROM dist GROUP BY t")
def q_kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    return frames.vectors(spark, d).select("t", vec.argmin(vec.sqdists("x", _states(spark, d))).cast("long").alias("label"))


def _lloyd(rows: DataFrame, centers: np.ndarray) -> np.ndarray:
    """Means of the rows nearest to each centre: one aggregation."""
    labelled = rows.withColumn("hot", vec.one_hot(vec.argmin(vec.sqdists("x", centers)), len(centers))).withColumn("with_one", F.concat(F.col("x"), F.array(F.lit(1.0))))
    sums = moments.cross(labelled, "hot", "with_one")
    return np.where(sums[:, -1:] > 0, sums[:, :-1] / np.maximum(sums[:, -1:], 1), centers)


@query("{x s} + " + _DIST + """, l1 AS (SELECT t, arg_min(i, (d, i)) AS i FROM dist GROUP BY t), c1 AS (SELECT i, j, avg(v) AS s FROM x JOIN l1 USING (t) GROUP BY 1, 2),
d2 AS (SELECT t, i, sum((v - s) * (v - s)) AS d FROM x JOIN c1 USING (j) GROUP BY 1, 2), l2 AS (SELECT t, arg_min(i, (d, i)) AS i FROM d2 GROUP BY t)
SELECT i, j, round(avg(v), 6) AS v FROM x JOIN l2 USING (t) GROUP BY 1, 2""")
def q_lloyd_2steps(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.vectors(spark, d)
    return _table(spark, _lloyd(rows, _lloyd(rows, _states(spark, d))))


@query("""WITH s AS (SELECT event_type AS cur_state, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_state FROM events),
c AS (SELECT next_state, cur_state, count(*) AS n FROM s WHERE next_state IS NOT NULL GROUP BY 1, 2), k AS (SELECT DISTINCT event_type AS e FROM events WHERE event_type IS NOT NULL)
SELECT a.e AS next_state, b.e AS cur_state, CAST(coalesce(n, 0) AS BIGINT) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY b.e), 6) AS p
FROM k a CROSS JOIN k b LEFT JOIN c ON c.next_state = a.e AND c.cur_state = b.e""")
def q_markov_transition(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    return markov.transitions(events, "event_type", "user_id", ("ts", "event_id")).withColumn("p", F.round("p", 6))


@query("""WITH s AS (SELECT event_type AS c, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS e FROM events),
t AS (SELECT e, c, count(*) / sum(count(*)) OVER (PARTITION BY c) AS p FROM s WHERE e IS NOT NULL GROUP BY e, c),
t2 AS (SELECT a.e, b.c, sum(a.p * b.p) AS p FROM t a JOIN t b ON a.c = b.e GROUP BY 1, 2)
SELECT a.e AS next_state, b.c AS cur_state, round(sum(a.p * b.p), 6) AS p FROM t a JOIN t2 b ON a.c = b.e GROUP BY 1, 2""")
def q_markov_h3(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    states, t = markov.matrix(markov.transitions(events, "event_type", "user_id", ("ts", "event_id")))
    far = np.linalg.matrix_power(t, 3)
    rows = [(a, b, float(far[i, j])) for i, a in enumerate(states) for j, b in enumerate(states)]
    return spark.createDataFrame(rows, "next_state string, cur_state string, p double").withColumn("p", F.round("p", 6))


@query("{x s} + " + _DIST + " SELECT t, i, CASE WHEN i = arg_min(i, (d, i)) OVER (PARTITION BY t) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS g FROM dist")
def q_fembv_notv_step(spark: SparkSession, d: str) -> DataFrame:
    states = _states(spark, d)
    rows = frames.vectors(spark, d).withColumn("g", vec.one_hot(vec.argmin(vec.sqdists("x", states)), len(states)))
    return _cells(rows, "g", "g", "t", place="i")


@query("{w} SELECT i, round(sum(a), 6) AS tv FROM (SELECT i, abs(g - lag(g) OVER (PARTITION BY i ORDER BY t)) AS a FROM w) GROUP BY i")
def q_tv_norm(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.lagged(frames.daily_shares(spark, d), "gamma", [1])
    steps = rows.select(F.posexplode(F.zip_with("gamma", "gamma_lag1", lambda a, b: F.abs(a - b))).alias("i", "a"))
    return steps.groupBy(F.col("i").cast("long").alias("i")).agg(F.round(F.sum("a"), 6).alias("tv"))


@query("{x s g} + " + _DIST + " SELECT round(sum(g * d), 4) AS cost FROM dist JOIN g USING (t, i)")
def q_fembv_cost(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).agg(F.round(F.sum(vec.dot("gamma", vec.sqdists("x", _states(spark, d)))), 4).alias("cost"))


@query("{x g} SELECT i, j, round(sum(g * v) / sum(g), 6) AS v FROM g JOIN x USING (t) GROUP BY i, j")
def q_fembv_centroids(spark: SparkSession, d: str) -> DataFrame:
    gtg, gtx, _ = _products(_rows(spark, d))
    return _table(spark, core.centroids_of(gtx, gtg.sum(1, keepdims=True)))


@query("""WITH p(n, k, c) AS (VALUES (12, 3, 5.0)), v AS (SELECT t, i, t * k + i AS g, n * k + t * k + i AS e FROM p, range(12) a(t), range(3) b(i)),
rows AS (SELECT 'eq' AS kind, t AS r, g AS col, 1.0 AS coeff FROM v
 UNION ALL SELECT 'positive', g, g, -1.0 FROM v UNION ALL SELECT 'positive', e, e, -1.0 FROM v WHERE t < 11
 UNION ALL SELECT 'up', g, g + 3, 1.0 FROM v WHERE t < 11 UNION ALL SELECT 'up', g, g, -1.0 FROM v WHERE t < 11 UNION ALL SELECT 'up', g, e, -1.0 FROM v WHERE t < 11
 UNION ALL SELECT 'down', g, g + 3, -1.0 FROM v WHERE t < 11 UNION ALL SELECT 'down', g, g, 1.0 FROM v WHERE t < 11 UNION ALL SELECT 'down', g, e, -1.0 FROM v WHERE t < 11
 UNION ALL SELECT 'bound', i, e, 1.0 FROM v WHERE t < 11)
SELECT kind, CAST(r AS BIGINT) AS r, CAST(col AS BIGINT) AS col, CAST(coeff AS DOUBLE) AS coeff FROM rows""")
def q_lp_constraints(spark: SparkSession, d: str) -> DataFrame:
    """The linear programme of weights with bounded variation, 12 samples and 3 components, as coefficients."""
    return tvlp.constraints(spark, 12, 3)


# --- autoregression -----------------------------------------------------------


@query("{last} SELECT user_id AS series_id, t, 1.0::DOUBLE AS z0, round(y1, 6) AS z1, round(y2, 6) AS z2, round(y, 6) AS y FROM last WHERE y2 IS NOT NULL")
def q_lag_design_p2(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.lagged(_users(spark, d), "x", [1, 2]).where("x_lag2 IS NOT NULL")
    each = {n: F.round(F.get(c, F.lit(0)), 6) for n, c in (("z1", "x_lag1"), ("z2", "x_lag2"), ("y", "x"))}
    return rows.select("series_id", "t", F.lit(1.0).alias("z0"), *[c.alias(n) for n, c in each.items()])


_DAILY = "SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS y, CAST(count(*) AS DOUBLE) AS u FROM orders GROUP BY 1"


def _daily_orders(spark: SparkSession, d: str) -> DataFrame:
    days = spark.read.parquet(f"{d}/orders.parquet").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("y"), F.count("*").cast("double").alias("u"))
    return frames.numbered(days, ["day"]).select(F.lit(0).cast("long").alias("series_id"), (F.col("t") + 1).alias("t"), F.array("y").alias("x"), F.array("u").alias("u"))


@query(f"WITH q AS ({_DAILY}) SELECT CAST(t AS BIGINT) AS t, round(v, 6) AS v FROM (SELECT row_number() OVER (ORDER BY day) AS t, ln(y) - lag(ln(y)) OVER (ORDER BY day) AS v FROM q) WHERE v IS NOT NULL")
def q_logdiff(spark: SparkSession, d: str) -> DataFrame:
    return frames.log_difference(_daily_orders(spark, d), "chunk").select("t", F.round(F.get("x", F.lit(0)), 6).alias("v"))


@query("{last} SELECT user_id AS series_id, round(regr_slope(y, y1), 5) AS a, round(regr_intercept(y, y1), 5) AS mu FROM last WHERE y1 IS NOT NULL GROUP BY user_id")
def q_var1_user(spark: SparkSession, d: str) -> DataFrame:
    """A VAR(1) for each series, all in one aggregation: with one feature, least squares is a regression on the lag."""
    rows = frames.lagged(_users(spark, d), "x", [1]).where("x_lag1 IS NOT NULL").select("series_id", F.get("x", F.lit(0)).alias("y"), F.get("x_lag1", F.lit(0)).alias("z"))
    return rows.groupBy("series_id").agg(F.round(F.regr_slope("y", "z"), 5).alias("a"), F.round(F.regr_intercept("y", "z"), 5).alias("mu"))


@query("""{last} + q AS (SELECT *, CAST(1 + t % 5 AS DOUBLE) AS w FROM last WHERE y1 IS NOT NULL),
s AS (SELECT user_id, sum(w) AS w, sum(w * y1) AS z, sum(w * y) AS y, sum(w * y1 * y1) AS zz, sum(w * y1 * y) AS zy FROM q GROUP BY user_id)
SELECT user_id AS series_id, round((w * zy - z * y) / nullif(w * zz - z * z, 0), 5) AS a, round((y - (w * zy - z * y) / nullif(w * zz - z * z, 0) * z) / w, 5) AS mu FROM s""")
def q_wls_user(spark: SparkSession, d: str) -> DataFrame:
    """Weighted least squares with weights 1 + t mod 5."""
    rows = frames.lagged(_users(spark, d), "x", [1]).where("x_lag1 IS NOT NULL").select("series_id", F.get("x", F.lit(0)).alias("y"), F.get("x_lag1", F.lit(0)).alias("z"), (1 + F.col("t") % 5).cast("double").alias("w"))
    s = rows.groupBy("series_id").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("z")).alias("z"), F.sum(F.col("w") * F.col("y")).alias("y"), F.sum(F.expr("w * z * z")).alias("zz"), F.sum(F.expr("w * z * y")).alias("zy"))
    a = F.expr("(w * zy - z * y) / nullif(w * zz - z * z, 0)")
    return s.select("series_id", F.round(a, 5).alias("a"), F.round((F.col("y") - a * F.col("z")) / F.col("w"), 5).alias("mu"))


@query("""{last} + q AS (SELECT y, y1, regr_slope(y, y1) OVER () AS a, regr_intercept(y, y1) OVER () AS mu FROM last WHERE y1 IS NOT NULL)
SELECT round(any_value(mu), 4) AS mu, round(any_value(a), 5) AS a, round(sum((y - mu - a * y1) * (y - mu - a * y1)) / (count(*) - 2), 2) AS sigma FROM q""")
def q_var1_sigma(spark: SparkSession, d: str) -> DataFrame:
    got = models.autoregression(_users(spark, d), 1)
    return spark.createDataFrame([(round(float(got.mu[0]), 4), round(float(got.a[0, 0, 0]), 5), round(float(got.sigma[0, 0]), 2))], "mu double, a double, sigma double")


@query(f"""WITH q AS ({_DAILY}), l AS (SELECT y, lag(y) OVER (ORDER BY day) AS z, u FROM q), f AS (SELECT * FROM l WHERE z IS NOT NULL),
c AS (SELECT covar_samp(y, z) AS yz, covar_samp(y, u) AS yu, covar_samp(z, u) AS zu, var_samp(z) AS zz, var_samp(u) AS uu, avg(y) AS my, avg(z) AS mz, avg(u) AS mu FROM f),
r AS (SELECT *, (yz * uu - yu * zu) / (zz * uu - zu * zu) AS a, (yu * zz - yz * zu) / (zz * uu - zu * zu) AS b FROM c)
SELECT round(a, 5) AS a, round(b, 2) AS b0, round(my - a * mz - b * mu, 0) AS mu FROM r""")
def q_varx_exog(spark: SparkSession, d: str) -> DataFrame:
    """Daily order value on the day before and the day's count of orders."""
    got = models.autoregression(_daily_orders(spark, d), 1)
    return spark.createDataFrame([(round(float(got.a[0, 0, 0]), 5), round(float(got.b0[0, 0]), 2), float(np.round(got.mu[0])))], "a double, b0 double, mu double")


@query("""{last} SELECT CAST(y1 >= 50 AS BIGINT) AS region, count(*) AS n, round(regr_slope(y, y1), 5) AS a, round(regr_intercept(y, y1), 4) AS mu FROM last WHERE y1 IS NOT NULL GROUP BY 1""")
def q_pw_region_var(spark: SparkSession, d: str) -> DataFrame:
    """One VAR(1) for each region, where regions are sides of 50 of the predictor."""
    rows = frames.lagged(_users(spark, d), "x", [1]).where("x_lag1 IS NOT NULL").select(F.get("x", F.lit(0)).alias("y"), F.get("x_lag1", F.lit(0)).alias("z"))
    return rows.groupBy((F.col("z") >= 50).cast("long").alias("region")).agg(F.count("*").alias("n"), F.round(F.regr_slope("y", "z"), 5).alias("a"), F.round(F.regr_intercept("y", "z"), 4).alias("mu"))


# --- scans, checks, labels ----------------------------------------------------


@query("SELECT CAST(row_number() OVER (ORDER BY c_custkey) - 1 AS BIGINT) AS t, CAST(c_acctbal AS DOUBLE) AS v FROM customer WHERE c_acctbal > 0")
def q_csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a filter, written as CSV and read back as a series."""
    path = f"{shared_dir(spark)}/csv"
    spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select("c_custkey", F.col("c_acctbal").cast("double")).write.csv(path)
    return frames.read_csv_series(spark, path, "k long, v double", ["v"], ["k"]).select("t", F.get("x", F.lit(0)).alias("v"))


@query("SELECT count(*) AS n, CAST(max(len(embedding)) AS BIGINT) AS d FROM embeddings")
def q_shape_check(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([frames.check_vectors(frames.vectors(spark, d))], "n long, d long")


@query("{g} SELECT t, min(i) AS label FROM (SELECT t, i, g, max(g) OVER (PARTITION BY t) AS m FROM g) WHERE g = m GROUP BY t")
def q_hard_labels(spark: SparkSession, d: str) -> DataFrame:
    return _rows(spark, d).select("t", vec.argmax("gamma").cast("long").alias("label"))


@query("{tr} SELECT CAST(lag AS BIGINT) AS lag, j, round(sum(p), 6) AS total FROM tr GROUP BY lag, j")
def q_left_stochastic(spark: SparkSession, d: str) -> DataFrame:
    """Columns of the transition matrices sum to 1."""
    _, t = _mixture(spark, d)
    for m in t:
        core.check_start(m, m.shape, 0)
    rows = [(lag, j, float(v)) for lag, m in zip(LAGS, t, strict=True) for j, v in enumerate(m.sum(0))]
    return spark.createDataFrame(rows, "lag long, j long, total double").withColumn("total", F.round("total", 6))


# --- starts -------------------------------------------------------------------

_FURTHEST = """WITH e AS (SELECT CAST(vec_id AS BIGINT) AS t, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 10 <> 3),
p0 AS (SELECT t, v FROM e ORDER BY t LIMIT 1),
p1 AS (SELECT e.t, e.v FROM e, p0 WHERE e.t <> p0.t ORDER BY list_distance(e.v, p0.v) DESC, e.t LIMIT 1),
p2 AS (SELECT e.t, e.v FROM e, p0, p1 WHERE e.t NOT IN (p0.t, p1.t) ORDER BY list_distance(e.v, p0.v) + list_distance(e.v, p1.v) DESC, e.t LIMIT 1),
q0 AS (SELECT e.t, e.v FROM e, p1, p2 WHERE e.t NOT IN (p1.t, p2.t) ORDER BY list_distance(e.v, p1.v) + list_distance(e.v, p2.v) DESC, e.t LIMIT 1),
q1 AS (SELECT e.t, e.v FROM e, q0, p2 WHERE e.t NOT IN (q0.t, p2.t) ORDER BY list_distance(e.v, q0.v) + list_distance(e.v, p2.v) DESC, e.t LIMIT 1),
picks AS (SELECT CAST(0 AS BIGINT) AS i, t, v FROM q0 UNION ALL SELECT 1, t, v FROM q1 UNION ALL SELECT 2, t, v FROM p2)"""


def _picks(spark: SparkSession, d: str) -> list[tuple[int, list[float]]]:
    """Three picks with two extra steps; ids that end in 3 are excluded."""
    rows = frames.vectors(spark, d)
    first = rows.where("t % 10 <> 3").agg(F.min("t")).first()[0]
    return seeding.furthest_sum(rows, 3, first, F.col("t") % 10 == 3, extra_steps=2)


@query(_FURTHEST + " SELECT i AS pick, t FROM picks")
def q_furthest_sum_extra(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(k, t) for k, (t, _) in enumerate(_picks(spark, d))], "pick long, t long")


@query(_FURTHEST + " SELECT i, CAST(j AS BIGINT) AS j, round(v[j + 1], 6) AS v FROM picks, range(64) r(j) WHERE j < len(v)")
def q_furthest_states(spark: SparkSession, d: str) -> DataFrame:
    """States of a coding that starts at rows far from each other, by the estimator."""
    rows = frames.vectors(spark, d).where("t % 10 <> 3")
    return _table(spark, models.ConvexCoding(3, init="furthest_sum", update=(), max_iterations=1, extra_steps=2).fit_long(rows).states)


@query(_FURTHEST + " SELECT i, e.t, CASE WHEN e.t = picks.t THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS c FROM picks, (SELECT CAST(vec_id AS BIGINT) AS t FROM embeddings) e")
def q_furthest_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary of archetypes that starts at those rows, by the estimator: one entry of 1 in each component. Rows that take no part have entries of 0."""
    rows = frames.vectors(spark, d)
    coded = models.ArchetypalAnalysis(3, update=(), max_iterations=1, extra_steps=2).fit_long(rows.where("t % 10 <> 3")).rows.select("t", "c")
    none = F.array(*[F.lit(0.0)] * 3)
    return _cells(rows.select("t").join(coded, "t", "left").withColumn("c", F.coalesce("c", none)), "c", "c", "t", place="i")


# --- one iteration of a coding ------------------------------------------------

_STEP = "CASE WHEN slope + bend <= 1e-4 * slope THEN 1.0 WHEN -slope / (2 * bend) BETWEEN 0.1 AND 0.9 THEN -slope / (2 * bend) END"
_STATES_STEP = f"""{{gtx gtg gram s n}} + gd AS (SELECT s.i, s.j, s.s, {4 * EPSILON_STATES} / (d * {K * (K - 1)}) * ({K} * s.s - sum(s.s) OVER (PARTITION BY s.j)) + 2 / n * (gs - gtx.v) AS v
 FROM s JOIN gtx USING (i, j) JOIN (SELECT gtg.i AS i, s.j AS j, sum(gtg.v * s.s) AS gs FROM gtg JOIN s ON gtg.j = s.i GROUP BY 1, 2) USING (i, j), n),
dd AS (SELECT a.i AS i, b.i AS j, sum(a.v * b.v) AS v FROM gd a JOIN gd b ON a.j = b.j GROUP BY 1, 2),
sb AS (SELECT -(SELECT sum(v * v) FROM gd) AS slope, (SELECT sum(gtg.v * dd.v) FROM gtg JOIN dd USING (i, j)) / (SELECT n FROM n)
  + {EPSILON_STATES * 2} / ({K * (K - 1)} * (SELECT d FROM n)) * (SELECT {K} * sum(CASE WHEN i = j THEN v ELSE 0 END) - sum(v) FROM dd) AS bend),
s1 AS (SELECT i, j, s - v * (SELECT {_STEP} FROM sb) AS s FROM gd)"""
_WEIGHTS_STEP = f""", gram1 AS (SELECT a.i AS i, b.i AS j, sum(a.s * b.s) AS v FROM s1 a JOIN s1 b ON a.j = b.j GROUP BY 1, 2),
gw AS (SELECT gs.t, gs.i, gs.g, 2 / n * (gs.v - xs.v) AS v FROM (SELECT g.t AS t, gram1.i AS i, any_value(own.g) AS g, sum(g.g * gram1.v) AS v FROM gram1 JOIN g ON gram1.j = g.i JOIN g own ON own.t = g.t AND own.i = gram1.i GROUP BY 1, 2) gs
  JOIN (SELECT x.t AS t, s1.i AS i, sum(x.v * s1.s) AS v FROM x JOIN s1 ON x.j = s1.j GROUP BY 1, 2) xs ON gs.t = xs.t AND gs.i = xs.i, n),
pw AS (SELECT t, i, g - v AS u, sum(g - v) OVER o AS s, row_number() OVER o AS k FROM gw WINDOW o AS (PARTITION BY t ORDER BY g - v DESC, i ROWS UNBOUNDED PRECEDING)),
hw AS (SELECT t, max((s - 1) / k) AS theta FROM pw GROUP BY t),
dw AS (SELECT gw.t, gw.i, gw.g, gw.v, greatest(u - theta, 0) - gw.g AS d FROM gw JOIN pw ON pw.t = gw.t AND pw.i = gw.i JOIN hw ON hw.t = gw.t),
cw AS (SELECT a.i AS i, b.i AS j, sum(a.d * b.d) AS v FROM dw a JOIN dw b ON a.t = b.t GROUP BY 1, 2),
sw AS (SELECT (SELECT sum(v * d) FROM dw) AS slope, (SELECT sum(cw.v * gram1.v) FROM cw JOIN gram1 USING (i, j)) / (SELECT n FROM n) AS bend)"""


_TWO_STATES_STEPS = _STATES_STEP + f""", al AS (SELECT least(1e3, greatest(1e-3, CASE WHEN bend <= 0 THEN 1e3 ELSE -slope / (2 * bend) END)) AS alpha FROM sb),
gd1 AS (SELECT s1.i, s1.j, s1.s, {4 * EPSILON_STATES} / (d * {K * (K - 1)}) * ({K} * s1.s - sum(s1.s) OVER (PARTITION BY s1.j)) + 2 / n * (gs - gtx.v) AS v
 FROM s1 JOIN gtx USING (i, j) JOIN (SELECT gtg.i AS i, s1.j AS j, sum(gtg.v * s1.s) AS gs FROM gtg JOIN s1 ON gtg.j = s1.i GROUP BY 1, 2) USING (i, j), n),
dd1 AS (SELECT a.i AS i, b.i AS j, sum(a.v * b.v) * (SELECT alpha * alpha FROM al) AS v FROM gd1 a JOIN gd1 b ON a.j = b.j GROUP BY 1, 2),
sb1 AS (SELECT -(SELECT alpha FROM al) * (SELECT sum(v * v) FROM gd1) AS slope, (SELECT sum(gtg.v * dd1.v) FROM gtg JOIN dd1 USING (i, j)) / (SELECT n FROM n)
  + {EPSILON_STATES * 2} / ({K * (K - 1)} * (SELECT d FROM n)) * (SELECT {K} * sum(CASE WHEN i = j THEN v ELSE 0 END) - sum(v) FROM dd1) AS bend),
s2 AS (SELECT i, j, s - (SELECT alpha FROM al) * v * (SELECT {_STEP} FROM sb1) AS s FROM gd1)"""


def _one_iteration(spark: SparkSession, d: str) -> models.coding_long.LongCoding:
    """The coding after one step on states and one on weights, from the fixed start."""
    return models.ConvexCoding(K, EPSILON_STATES, init="custom", start={"states": _states(spark, d)}, max_iterations=1).fit_long(_rows(spark, d))


@query(_STATES_STEP + " SELECT i, j, round(s, 6) AS v FROM s1")
def q_gpnh_fit_1step_states(spark: SparkSession, d: str) -> DataFrame:
    return _table(spark, _one_iteration(spark, d).states)


@query(_TWO_STATES_STEPS + " SELECT i, j, round(s, 6) AS v FROM s2")
def q_gpnh_fit_2steps_states(spark: SparkSession, d: str) -> DataFrame:
    """States after two iterations with frozen weights: the second step has the spectral length that the first one sets."""
    fit = models.ConvexCoding(K, EPSILON_STATES, init="custom", start={"states": _states(spark, d)}, max_iterations=2, tolerance=0, update=("states",))
    return _table(spark, fit.fit_long(_rows(spark, d)).states)


@query(_STATES_STEP.replace("{gtx", "{gtx g x") + _WEIGHTS_STEP + f" SELECT t, i, round(g + d * (SELECT {_STEP} FROM sw), 6) AS g FROM dw")
def q_gpnh_fit_1step_weights(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_one_iteration(spark, d).rows, "gamma", "g", "t", place="i")


# --- fitted models on rows ----------------------------------------------------


@query("{x s} + " + _DIST + " SELECT t, i, CASE WHEN i = arg_min(i, (d, i)) OVER (PARTITION BY t) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS g FROM dist")
def q_regimes_transform(spark: SparkSession, d: str) -> DataFrame:
    """Regimes with fixed centres and no bound, on all rows."""
    centers = _states(spark, d)
    parts = [(0, "centers", 0, 0, int(i), int(j), float(centers[i, j])) for i, j in np.ndindex(*centers.shape)]
    fitted = models.BoundedRegimes(K).fitted(spark.createDataFrame(parts, models.PARTS))
    return _cells(fitted.transform(frames.vectors(spark, d)), "gamma", "g", "t", place="i")


@query("{y} SELECT t, j, round(y, 6) AS y FROM y")
def q_inverse_transform(spark: SparkSession, d: str) -> DataFrame:
    states = _states(spark, d)
    parts = [(0, "states", 0, 0, int(i), int(j), float(states[i, j])) for i, j in np.ndindex(*states.shape)]
    coded = _rows(spark, d).select("series_id", "t", "gamma")
    return _cells(models.Fitted(spark.createDataFrame(parts, models.PARTS)).inverse_transform(coded), "y", "y", "t")


@query("""{last} + f AS (SELECT regr_slope(y, y1) AS a, regr_intercept(y, y1) AS mu FROM last WHERE y1 IS NOT NULL)
SELECT user_id AS series_id, t, round(mu + a * y1, 4) AS y FROM last, f WHERE y1 IS NOT NULL""")
def q_pw_transform(spark: SparkSession, d: str) -> DataFrame:
    """What a piecewise model of one region gives for every row that has its lag."""
    rows = _users(spark, d)
    estimator = models.PiecewiseAutoregression(1)
    fitted = models.PiecewiseModel(estimator, None, None, rows, {0: models.autoregression(rows, 1)})
    return fitted.transform(rows).select("series_id", "t", F.round(F.get("y", F.lit(0)), 4).alias("y"))


@query("""{last} + r AS (SELECT user_id % 3 AS restart, y1 >= 50 AS side, regr_intercept(y, y1) AS mu, regr_slope(y, y1) AS a FROM last WHERE y1 IS NOT NULL GROUP BY 1, 2),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY restart ORDER BY mu, a) - 1 AS BIGINT) AS component FROM r),
v AS (SELECT component, CAST(0 AS BIGINT) AS i, mu AS value FROM o UNION ALL SELECT component, 1, a FROM o)
SELECT component, i, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, count(*) AS restarts FROM v GROUP BY component, i""")
def q_restart_summary(spark: SparkSession, d: str) -> DataFrame:
    """Regressions on both sides of 50 for each third of the users, aligned and summarised as restarts."""
    rows = frames.lagged(_users(spark, d), "x", [1]).where("x_lag1 IS NOT NULL").select("series_id", F.get("x", F.lit(0)).alias("y"), F.get("x_lag1", F.lit(0)).alias("z"))
    got = rows.groupBy((F.col("series_id") % 3).alias("restart"), (F.col("z") >= 50).alias("side")).agg(F.regr_intercept("y", "z").alias("mu"), F.regr_slope("y", "z").alias("a")).collect()
    fits = []
    for restart in sorted({r.restart for r in got}):
        regions = {int(r.side): core.unpack(np.array([[r.mu], [r.a]]), 1, 1, 0, 0, True, False, None) for r in got if r.restart == restart}
        fits.append(models.PiecewiseModel(models.PiecewiseAutoregression(2), None, None, rows, regions))
    out = models.summarise_restarts(fits, spark)
    return out.select(F.col("component").cast("long").alias("component"), F.col("i").cast("long").alias("i"), F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "restarts")


_WLS = """{last} + q AS (SELECT y, y1, CAST(1 + t % 5 AS DOUBLE) AS w FROM last WHERE y1 IS NOT NULL),
f AS (SELECT (sum(w) * sum(w * y1 * y) - sum(w * y1) * sum(w * y)) / (sum(w) * sum(w * y1 * y1) - sum(w * y1) * sum(w * y1)) AS a FROM q),
m AS (SELECT a, (sum(w * y) - a * sum(w * y1)) / sum(w) AS mu FROM q, f GROUP BY a),
e AS (SELECT sum(w * (y - mu - a * y1) * (y - mu - a * y1)) / (sum(w) - 1) AS sigma FROM q, m)"""


def _weighted(spark: SparkSession, d: str) -> core.Autoregression:
    return models.autoregression(_users(spark, d).withColumn("w", (1 + F.col("t") % 5).cast("double")), 1, weight="w")


@query(_WLS + " SELECT round(sigma, 3) AS sigma FROM e")
def q_wls_sigma(spark: SparkSession, d: str) -> DataFrame:
    """The weighted noise covariance of one autoregression over all users."""
    return spark.createDataFrame([(round(float(_weighted(spark, d).sigma[0, 0]), 3),)], "sigma double")


@query(_WLS + " SELECT round(1 / sigma, 8) AS precision FROM e")
def q_wls_precision(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(round(float(_weighted(spark, d).precision[0, 0]), 8),)], "precision double")


@query(f"""WITH q AS ({_DAILY}), l AS (SELECT row_number() OVER (ORDER BY day) AS t, y, lag(y) OVER (ORDER BY day) AS z, u FROM q), f AS (SELECT * FROM l WHERE z IS NOT NULL),
c AS (SELECT covar_samp(y, z) AS yz, covar_samp(y, u) AS yu, covar_samp(z, u) AS zu, var_samp(z) AS zz, var_samp(u) AS uu, avg(y) AS my, avg(z) AS mz, avg(u) AS mu, regr_slope(y, u) AS b1, regr_intercept(y, u) AS c1 FROM f),
r AS (SELECT *, (yz * uu - yu * zu) / (zz * uu - zu * zu) AS a, (yu * zz - yz * zu) / (zz * uu - zu * zu) AS b FROM c),
e AS (SELECT t, y - my - a * (z - mz) - b * (u - mu) AS e0, y - c1 - b1 * u AS e1 FROM f, r)
SELECT CAST(t AS BIGINT) AS t, CAST(0 AS BIGINT) AS i, round(sqrt(e0 * e0), 0) AS distance FROM e UNION ALL SELECT t, 1, round(sqrt(e1 * e1), 0) FROM e""")
def q_regime_memories(spark: SparkSession, d: str) -> DataFrame:
    """Residuals of two regimes, one with a memory of a day and one with none, both with the day's count as input, aligned on t."""

    rows = frames.lagged(_daily_orders(spark, d), "x", [1]).where("x_lag1 IS NOT NULL")
    family = regimes_long.LongAutoregressions([1, 0], 1, 1)
    passes = regimes_long.Passes(rows.select((F.col("t") - 2).alias("place"), F.concat(F.array(F.lit(1.0)), "x_lag1", "u", "x").alias("v")), family, 2, "v")
    both = family.update(None, passes.summed([None], lambda _, row, block: family.sums(block, np.ones((len(block), 2))))[0])
    found = _cells(passes.rows(lambda row, block: np.sqrt(family.costs(both, block)), "distance"), "distance", "distance", "place", decimals=0, place="i")
    return found.select((F.col("place") + 2).alias("t"), "i", "distance")


@query("{z} SELECT t, i, round(g - z, 6) AS e FROM z")
def q_crom_residual(spark: SparkSession, d: str) -> DataFrame:
    rows = _predicted(*_mixture(spark, d))
    return _cells(rows.withColumn("e", vec.add("gamma", "z", -1.0)), "e", "e", "t", place="i")


@query(f"WITH q AS ({_DAILY}), l AS (SELECT row_number() OVER (ORDER BY day) AS t, y, lag(y) OVER (ORDER BY day) AS z0, lag(u) OVER (ORDER BY day) AS z1 FROM q) SELECT CAST(t AS BIGINT) AS t, round(y, 2) AS y, round(z0, 2) AS z0, z1 FROM l WHERE z0 IS NOT NULL")
def q_pw_design(spark: SparkSession, d: str) -> DataFrame:
    """Predictors of the piecewise model: a lag of the value and one of the input."""
    rows = models.PiecewiseAutoregression(2, 1, 1).design(_daily_orders(spark, d))
    value = {"y": F.round(F.get("x", F.lit(0)), 2), "z0": F.round(F.get("z", F.lit(0)), 2), "z1": F.get("z", F.lit(1))}
    return rows.select("t", *[c.alias(n) for n, c in value.items()])


@query("{x s} + " + _DIST + """, l1 AS (SELECT t, arg_min(i, (d, i)) AS i FROM dist GROUP BY t), c1 AS (SELECT i, j, avg(v) AS s FROM x JOIN l1 USING (t) GROUP BY 1, 2),
d2 AS (SELECT t, i, sum((v - s) * (v - s)) AS d FROM x JOIN c1 USING (j) GROUP BY 1, 2) SELECT round(sum(d), 3) AS cost FROM (SELECT min(d) AS d FROM d2 GROUP BY t)""")
def q_fembv_2steps(spark: SparkSession, d: str) -> DataFrame:
    """The cost of regimes without a bound after two iterations from fixed centres, by the fit itself."""
    _, _, costs = models.BoundedRegimes(K, max_iterations=2).fit_long(frames.vectors(spark, d), [_states(spark, d)])
    return spark.createDataFrame([(round(costs[1], 3),)], "cost double")


# --- whole fits: no SQL, tests hold invariants --------------------------------


@query()
def q_gpnh_fit(spark: SparkSession, d: str) -> DataFrame:
    fitted = models.ConvexCoding(3, 0.1).fit(frames.vectors(spark, d))
    return fitted.summary()


@query()
def q_gpnh_fit_long(spark: SparkSession, d: str) -> DataFrame:
    rows = models.ConvexCoding(3, 0.1).fit_long(frames.vectors(spark, d)).rows
    return _cells(rows, "gamma", "g", "t", place="i")


@query()
def q_aa_fit(spark: SparkSession, d: str) -> DataFrame:
    return models.ArchetypalAnalysis(3).fit(frames.vectors(spark, d)).summary()


@query()
def q_mtd_fit(spark: SparkSession, d: str) -> DataFrame:
    days = frames.daily_shares(spark, d).withColumnRenamed("gamma", "x")
    return models.ConvexCoding(3, 0.1, LAGS, 1.0).fit(days).part("transitions")


@query()
def q_crom_fit(spark: SparkSession, d: str) -> DataFrame:
    """A convex coding of the days, a Markov mixture of its weights, and the forecast of the weights two days on."""
    days = frames.daily_shares(spark, d).withColumnRenamed("gamma", "x")
    coded = models.ConvexCoding(3, 0.1).fit(days).rows("gamma").withColumnRenamed("values", "gamma")
    w, t, _ = models.fit_markov_mixture(coded, LAGS)
    return _cells(models.forecast(coded, w, t, LAGS, 2, "chunk").where("ahead IS NOT NULL"), "ahead", "v", "t", place="i")


@query()
def q_fembv_kmeans_fit(spark: SparkSession, d: str) -> DataFrame:
    days = frames.daily_shares(spark, d).withColumnRenamed("gamma", "x")
    return models.BoundedRegimes(3, 4.0, restarts=3).fit(days).part("gamma")


@query()
def q_fembv_varx_fit(spark: SparkSession, d: str) -> DataFrame:
    return models.BoundedRegimes(2, 6.0, "var", 1).fit(_users(spark, d)).part("coefficients")


@query()
def q_pwvarx_fit(spark: SparkSession, d: str) -> DataFrame:
    found = models.PiecewiseAutoregression(3).fit(_users(spark, d)).regions
    return _table(spark, np.array([m.coefficients.ravel() for m in found.values()]))


@query()
def q_kmeans_markov_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = frames.vectors(spark, d)
    fitted = markov.KMeansMarkov(4).fit(rows)
    return _cells(fitted.predict(rows, 2), "probability", "p", "t", place="i")
