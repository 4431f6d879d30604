"""Queries of the tier for one long series, and their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.functions import vec
from driftlens.operators import models, regimes_long
from driftlens.plans.catalog import _FURTHEST, EPSILON_WEIGHTS, LAGS, ORDER, K, _cells, _daily_orders, _gamma, _rows, _transitions, query
from driftlens.sources import frames

#: The step of a line search along slope and bend: whole, to the minimum, or halved until the cost falls enough.
_STEP = "CASE WHEN slope + bend <= 1e-4 * slope THEN 1.0 WHEN -slope / (2 * bend) BETWEEN 0.1 AND 0.9 THEN -slope / (2 * bend) ELSE power(0.5, ceil(log2(1 / (-slope / bend * 0.9999)))) END"


# --- lags -----------------------------------------------------------------------


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """All lines in order of order and line as one series; t has gaps."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("t"))
    return lines.agg(F.sum("l_quantity").alias("q"), F.sum("l_discount").alias("v")).select(F.lit(0).cast("long").alias("series_id"), "t", F.array("q").alias("x"), F.array("v").alias("u"))


_LINES = "lines AS (SELECT l_orderkey * 8 + l_linenumber AS t, sum(l_quantity) AS q, sum(l_discount) AS v FROM lineitem GROUP BY 1)"


@query(f"WITH {_LINES} SELECT t, round(q - lag(q, 2) OVER (ORDER BY t), 6) AS back, round(lead(q) OVER (ORDER BY t) - q, 6) AS ahead FROM lines")
def q_lags_of_a_long_series(spark: SparkSession, d: str) -> DataFrame:
    """Changes against two rows before and to the next row, over chunk borders and gaps of t."""
    rows = frames.lagged(_lines(spark, d), "x", [2, -1])
    at = lambda c: F.get(c, F.lit(0))
    return rows.select("t", F.round(at("x") - at("x_lag2"), 6).alias("back"), F.round(at("x_lag-1") - at("x"), 6).alias("ahead"))


# --- regimes --------------------------------------------------------------------

_CENTERS, _TOLL = np.array([[10.0], [45.0], [80.0]]), np.array([900.0, 1500.0, 700.0])


def _event_passes(spark: SparkSession, d: str) -> regimes_long.Passes:
    events = spark.read.parquet(f"{d}/events.parquet").where("value IS NOT NULL").select("event_id", F.array("value").alias("x"))
    return regimes_long.Passes(frames.numbered(events, ["event_id"], "place").select("place", "x"), regimes_long.LongCenters(), len(_CENTERS))


def _forward(k: int, cost: str, toll: np.ndarray) -> str:
    """The accumulator of list_reduce over [costs]: [cost of the cheapest path to each label, then its turns by label, label by label]."""

    def option(a: int, b: int) -> str:
        turns = [f"x[{k + a * k + c + 1}]" + (" + 1" if a != b and c in (a, b) else "") for c in range(k)]
        return f"[x[{a + 1}] + {0.0 if a == b else toll[a] + toll[b]} + {cost}[{b + 1}], {a}.0, {', '.join(turns)}]"

    best = [f"list_sort([{', '.join(option(a, b) for a in range(k))}])[1]" for b in range(k)]
    return ", ".join([f"{b}[1]" for b in best] + [f"{b}[{c + 3}]" for b in best for c in range(k)])


@query(f"""WITH e AS (SELECT list([(value - 10) * (value - 10), (value - 45) * (value - 45), (value - 80) * (value - 80)] || [0.0 FOR i IN range(9)] ORDER BY event_id) AS c FROM events WHERE value IS NOT NULL),
r AS (SELECT list_reduce(c, lambda x, y: [{_forward(3, 'y', _TOLL)}]) AS x FROM e),
b AS (SELECT list_sort([[x[i], i] FOR i IN [1, 2, 3]])[1] AS best, x FROM r)
SELECT CAST(i AS BIGINT) AS label, CAST(x[CAST(3 * best[2] + i + 1 AS BIGINT)] AS BIGINT) AS turns, round(best[1] - ({' + '.join(f'{t} * x[CAST(3 * best[2] + {c + 1} AS BIGINT)]' for c, t in enumerate(_TOLL))}), 3) AS cost FROM b, range(3) r(i)""")
def q_path_with_tolls(spark: SparkSession, d: str) -> DataFrame:
    """All events as one series: cost and turns of the cheapest path over three levels, where switches pay tolls."""
    cost, turns = _event_passes(spark, d).priced([(_CENTERS, _TOLL)])[0]
    return spark.createDataFrame([(i, int(n), round(cost, 3)) for i, n in enumerate(turns)], "label long, turns long, cost double")


#: Switches that are counted by the dynamic programme that the linear programme is held against, and the bound.
_SWITCHES, _BOUND = 40, 9.0


def _counting(s: int) -> str:
    """The accumulator of list_reduce over [c0, c1]: costs of the cheapest paths that end in label 0 with 0 to s switches, then of those that end in label 1."""
    a, b = (lambda k: f"x[{k + 1}]"), (lambda k: f"x[{s + k + 2}]")
    one = lambda own, other, c, k: f"{own(k)} + y[{c}]" if not k else f"least({own(k)}, {other(k - 1)}) + y[{c}]"
    return ", ".join([*(one(a, b, 1, k) for k in range(s + 1)), *(one(b, a, 2, k) for k in range(s + 1))])


@query(f"""WITH q AS (SELECT day, CAST((n - 3.0) * (n - 3.0) AS DOUBLE) AS c0, CAST((n - 9.0) * (n - 9.0) AS DOUBLE) AS c1, row_number() OVER (ORDER BY day) AS k FROM (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)),
e AS (SELECT list(CASE WHEN k = 1 THEN [c0] || [1e300 FOR i IN range({_SWITCHES})] || [c1] || [1e300 FOR i IN range({_SWITCHES})] ELSE [c0, c1] END ORDER BY day) AS c FROM q),
r AS (SELECT list_reduce(c, lambda x, y: [{_counting(_SWITCHES)}]) AS x FROM e),
h AS (SELECT CAST(s AS DOUBLE) AS s, least(x[s + 1], x[s + {_SWITCHES + 2}]) AS c FROM r, range({_SWITCHES + 1}) t(s))
SELECT round(least((SELECT min(c) FROM h WHERE s <= {_BOUND}), min(a.c + (b.c - a.c) * ({_BOUND} - a.s) / (b.s - a.s))), 4) AS cost FROM h a, h b WHERE a.s <= {_BOUND} AND b.s > {_BOUND}""")
def q_bounded_weights_cost(spark: SparkSession, d: str) -> DataFrame:
    """The least cost of weights of bounded variation, two fixed centres, by the linear programme over paths; in SQL by counting switches: a path within the bound, or a mixture of one within and one beyond."""
    rows = _daily_orders(spark, d).select("series_id", "t", F.col("u").alias("x"))
    fit = models.BoundedRegimes(2, _BOUND, max_iterations=1).fit_long(rows, [np.array([[3.0], [9.0]])])
    return spark.createDataFrame([(round(fit[2][0], 4),)], "cost double")


@query("""WITH RECURSIVE q AS (SELECT CAST(row_number() OVER (ORDER BY day) - 1 AS BIGINT) AS t, c0, c1 FROM (
 SELECT CAST(o_orderdate AS DATE) AS day, (count(*) - 3.0) * (count(*) - 3.0) AS c0, (count(*) - 9.0) * (count(*) - 9.0) AS c1 FROM orders GROUP BY 1)),
f AS (
 SELECT t, CAST(c0 AS DOUBLE) AS b0, CAST(c1 AS DOUBLE) AS b1, 0 AS f0, 1 AS f1 FROM q WHERE t = 0
 UNION ALL
 SELECT q.t, least(b0, b1 + 30) + c0, least(b0 + 30, b1) + c1, CASE WHEN b0 <= b1 + 30 THEN 0 ELSE 1 END, CASE WHEN b0 + 30 <= b1 THEN 0 ELSE 1 END FROM f JOIN q ON q.t = f.t + 1
), p AS (
 SELECT t, CASE WHEN b0 <= b1 THEN 0 ELSE 1 END AS label FROM f WHERE t = (SELECT max(t) FROM f)
 UNION ALL
 SELECT f.t - 1, CASE p.label WHEN 0 THEN f0 ELSE f1 END FROM p JOIN f ON f.t = p.t WHERE p.t > 0
) SELECT t, CAST(label AS BIGINT) AS label FROM p""")
def q_path_labels(spark: SparkSession, d: str) -> DataFrame:
    """The label of each day on the cheapest path over two levels of counts of orders."""
    rows = _daily_orders(spark, d).select((F.col("t") - 1).alias("place"), F.col("u").alias("x"))
    passes = regimes_long.Passes(rows, regimes_long.LongCenters(), 2)
    coded = regimes_long.coded(passes, np.array([[3.0], [9.0]]), [(np.array([10.0, 20.0]), 1.0)])
    return coded.select(F.col("place").alias("t"), vec.argmax("gamma").cast("long").alias("label"))


@query(f"""WITH {_LINES}, l AS (SELECT row_number() OVER (ORDER BY t) - 1 AS place, q AS y, v AS u, lag(q) OVER (ORDER BY t) AS z FROM lines),
g AS (SELECT y, u, z, i, CASE i WHEN 0 THEN (1 + place % 5) / 7.0 ELSE 1 - (1 + place % 5) / 7.0 END AS w FROM l, range(2) r(i) WHERE z IS NOT NULL),
m AS (SELECT i, sum(w) AS w, sum(w * y) / sum(w) AS my, sum(w * u) / sum(w) AS mu, sum(w * z) / sum(w) AS mz FROM g GROUP BY i),
c AS (SELECT i, any_value(m.w) AS w, any_value(my) AS my, any_value(mu) AS mu, any_value(mz) AS mz, sum(g.w * (y - my) * (z - mz)) AS yz, sum(g.w * (y - my) * (u - mu)) AS yu, sum(g.w * (z - mz) * (u - mu)) AS zu,
 sum(g.w * (z - mz) * (z - mz)) AS zz, sum(g.w * (u - mu) * (u - mu)) AS uu, sum(g.w * (y - my) * (y - my)) AS yy FROM g JOIN m USING (i) GROUP BY i),
b AS (SELECT *, (yz * uu - yu * zu) / (zz * uu - zu * zu) AS a, (yu * zz - yz * zu) / (zz * uu - zu * zu) AS b FROM c)
SELECT i, round(my - a * mz - b * mu, 5) AS mu, round(a, 6) AS a, round(b, 4) AS b0, round((yy - a * yz - b * yu) / (w - 1), 4) AS sigma FROM b""")
def q_regime_regressions(spark: SparkSession, d: str) -> DataFrame:
    """Both regimes' autoregressions with an input, for given weights, out of one pass over one long series."""
    rows = frames.numbered(frames.lagged(_lines(spark, d), "x", [1]), ["t"], "place").where("x_lag1 IS NOT NULL")
    family = regimes_long.LongAutoregressions([1, 1], 1, 1)
    g = F.expr("(1 + place % 5) / 7D")
    wide = rows.select((F.col("place") - 1).alias("place"), F.concat(F.array(F.lit(1.0)), "x_lag1", "u", "x", F.array(g, 1 - g)).alias("v"))
    passes = regimes_long.Passes(wide, family, 2, "v")
    found = family.update(None, passes.summed([None], lambda _, row, block: family.sums(block[:, :-2], block[:, -2:]))[0])
    out = [(i, *(round(float(v), n) for v, n in ((a.mu[0], 5), (a.a[0, 0, 0], 6), (a.b0[0, 0], 4), (a.sigma[0, 0], 4)))) for i, a in enumerate(found)]
    return spark.createDataFrame(out, "i long, mu double, a double, b0 double, sigma double")


# --- one iteration of a coding with a mixture -------------------------------------

_DAYS = f"""{{w}} + n AS (SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT t) AS DOUBLE) AS rows FROM w), d AS (SELECT DISTINCT t FROM w),
g AS (SELECT t, i, r / sum(r) OVER (PARTITION BY t) AS g FROM (SELECT t, i, CAST(1 + (t * (i + 1)) % 7 AS DOUBLE) AS r FROM d, range({K}) k(i))),
s AS (SELECT o.i, w.i AS j, w.g AS s FROM w JOIN (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM d) o USING (t) WHERE o.i < {K}),
gram AS (SELECT a.i AS i, b.i AS j, sum(a.s * b.s) AS v FROM s a JOIN s b ON a.j = b.j GROUP BY 1, 2),
tk AS (SELECT lag, i, j, r / sum(r) OVER (PARTITION BY lag, j) AS p, CASE lag WHEN {LAGS[0]} THEN {ORDER[0]} ELSE {ORDER[1]} END AS o
 FROM (SELECT lag, a.i AS i, b.i AS j, CAST(1 + ((a.i + 1) * (b.i + 2) * lag) % 5 AS DOUBLE) AS r FROM range({K}) a(i), range({K}) b(i), (VALUES ({LAGS[0]}), ({LAGS[1]})) l(lag))),
z AS (SELECT g.t, g.i, sum(o * p * past.g) AS z FROM g JOIN tk ON tk.i = g.i JOIN g past ON past.t = g.t - lag AND past.i = tk.j WHERE g.t >= {max(LAGS)} GROUP BY 1, 2),
r AS (SELECT g.t, g.i, g, g - coalesce(z, g) AS r FROM g LEFT JOIN z USING (t, i))"""
_PENALTY = f"{EPSILON_WEIGHTS} / ({K} * ((SELECT rows FROM n) - {max(LAGS)}))"


def _mixture_step(spark: SparkSession, d: str, update: str) -> models.coding_long.LongCoding:
    days = frames.daily_shares(spark, d).select("series_id", "t", F.col("gamma").alias("x"), _gamma().alias("gamma"))
    states = np.array([r.x for r in days.orderBy("t").limit(K).collect()])
    start = {"states": states, "mixture": (ORDER, _transitions(K))}
    return models.ConvexCoding(K, 0.0, LAGS, EPSILON_WEIGHTS, max_iterations=1, init="custom", start=start, update=(update,)).fit_long(days)


@query(_DAYS + f""", back AS (SELECT r.t - lag AS t, tk.j AS i, sum(o * r * p) AS v FROM r JOIN tk USING (i) GROUP BY 1, 2),
loss AS (SELECT gs.t, gs.i, 2 / n * (gs.v - xs.v) AS v FROM (SELECT g.t AS t, gram.i AS i, sum(g.g * gram.v) AS v FROM gram JOIN g ON gram.j = g.i GROUP BY 1, 2) gs
 JOIN (SELECT w.t AS t, s.i AS i, sum(w.g * s.s) AS v FROM w JOIN s ON w.i = s.j GROUP BY 1, 2) xs ON gs.t = xs.t AND gs.i = xs.i, n),
gr AS (SELECT r.t, r.i, r.g, loss.v + 2 * {_PENALTY} * (r.r - coalesce(back.v, 0)) AS v FROM r JOIN loss ON loss.t = r.t AND loss.i = r.i LEFT JOIN back ON back.t = r.t AND back.i = r.i),
u AS (SELECT t, i, g - v AS u, sum(g - v) OVER o AS s, row_number() OVER o AS k FROM gr WINDOW o AS (PARTITION BY t ORDER BY g - v DESC, i ROWS UNBOUNDED PRECEDING)),
th AS (SELECT t, max((s - 1) / k) AS theta FROM u GROUP BY t),
dd AS (SELECT gr.t, gr.i, gr.g, gr.v, greatest(u - theta, 0) - gr.g AS d FROM gr JOIN u ON u.t = gr.t AND u.i = gr.i JOIN th ON th.t = gr.t),
dz AS (SELECT dd.t, dd.i, sum(o * p * past.d) AS z FROM dd JOIN tk ON tk.i = dd.i JOIN dd past ON past.t = dd.t - lag AND past.i = tk.j WHERE dd.t >= {max(LAGS)} GROUP BY 1, 2),
cw AS (SELECT a.i AS i, b.i AS j, sum(a.d * b.d) AS v FROM dd a JOIN dd b ON a.t = b.t GROUP BY 1, 2),
l AS (SELECT (SELECT sum(v * d) FROM dd) AS slope, (SELECT sum(cw.v * gram.v) FROM cw JOIN gram USING (i, j)) / (SELECT n FROM n) + {_PENALTY} * (SELECT sum((d - z) * (d - z)) FROM dd JOIN dz USING (t, i)) AS bend)
SELECT t, i, round(g + d * (SELECT {_STEP} FROM l), 6) AS g FROM dd""")
def q_mtd_fit_1step_weights(spark: SparkSession, d: str) -> DataFrame:
    """Weights after one step of the joint coding from a fixed start, by the fit of one long series."""
    return _cells(_mixture_step(spark, d, "weights").rows, "gamma", "g", "t", place="i")


_PARAMETERS = _DAYS + f""", rg AS (SELECT lag, tk.i, tk.j, p, o, sum(r.r * past.g) AS v FROM tk JOIN r ON r.i = tk.i JOIN g past ON past.t = r.t - lag AND past.i = tk.j WHERE r.t >= {max(LAGS)} GROUP BY ALL),
gt AS (SELECT lag, i, j, p, o, -2 * {_PENALTY} * o * v AS v FROM rg), gw AS (SELECT lag, any_value(o) AS o, -2 * {_PENALTY} * sum(p * v) AS v FROM rg GROUP BY lag),
ut AS (SELECT lag, i, j, p - v AS u, sum(p - v) OVER w AS s, row_number() OVER w AS k FROM gt WINDOW w AS (PARTITION BY lag, j ORDER BY p - v DESC, i ROWS UNBOUNDED PRECEDING)),
tt AS (SELECT lag, j, max((s - 1) / k) AS theta FROM ut GROUP BY 1, 2),
dt AS (SELECT gt.lag, gt.i, gt.j, gt.p, gt.v, greatest(u - theta, 0) - gt.p AS d FROM gt JOIN ut ON ut.lag = gt.lag AND ut.i = gt.i AND ut.j = gt.j JOIN tt ON tt.lag = gt.lag AND tt.j = gt.j),
uw AS (SELECT lag, o, v, o - v AS u, sum(o - v) OVER w AS s, row_number() OVER w AS k FROM gw WINDOW w AS (ORDER BY o - v DESC, lag ROWS UNBOUNDED PRECEDING)),
dw AS (SELECT lag, o, v, greatest(u - (SELECT max((s - 1) / k) FROM uw), 0) - o AS d FROM uw),
z1 AS (SELECT g.t, g.i, sum((dw.o + dw.d) * (dt.p + dt.d) * past.g) AS z FROM g JOIN dt ON dt.i = g.i JOIN dw ON dw.lag = dt.lag JOIN g past ON past.t = g.t - dt.lag AND past.i = dt.j WHERE g.t >= {max(LAGS)} GROUP BY 1, 2),
l AS (SELECT (SELECT sum(v * d) FROM dt) + (SELECT sum(v * d) FROM dw) AS slope, {_PENALTY} * ((SELECT sum((g - z) * (g - z)) FROM g JOIN z1 USING (t, i)) - (SELECT sum(r * r) FROM r)) AS change),
st AS (SELECT CASE WHEN change <= 1e-4 * slope THEN 1.0 WHEN -0.5 * slope / (change - slope) BETWEEN 0.1 AND 0.9 THEN -0.5 * slope / (change - slope) ELSE 0.5 END AS step FROM l)"""


@query(_PARAMETERS + " SELECT CAST(lag AS BIGINT) AS lag, i, j, round(p + d * step, 6) AS p FROM dt, st UNION ALL SELECT lag, -1, -1, round(o + d * step, 6) FROM dw, st")
def q_mtd_fit_1step_parameters(spark: SparkSession, d: str) -> DataFrame:
    """Transitions, and order weights as i = j = -1, after one step of the joint coding from a fixed start."""
    got = _mixture_step(spark, d, "parameters")
    rows = [(lag, int(i), int(j), float(m[i, j])) for lag, m in zip(LAGS, got.transitions, strict=True) for i, j in np.ndindex(*m.shape)]
    rows += [(lag, -1, -1, float(w)) for lag, w in zip(LAGS, got.order_weights, strict=True)]
    return spark.createDataFrame(rows, "lag long, i long, j long, p double").withColumn("p", F.round("p", 6))


# --- one iteration of archetypes ---------------------------------------------------

_DICTIONARY = f"""{{x g gtg gtx}} + c AS (SELECT t, i, r / sum(r) OVER (PARTITION BY i) AS c FROM (SELECT CAST(vec_id AS BIGINT) AS t, i, CAST(1 + (vec_id * (i + 2)) % 5 AS DOUBLE) AS r FROM embeddings, range({K}) k(i))),
za AS (SELECT i, j, sum(c * v) AS z FROM c JOIN x USING (t) GROUP BY 1, 2),
gz AS (SELECT gtx.i, gtx.j, 2 * (p.v - gtx.v) AS v FROM gtx JOIN (SELECT gtg.i AS i, za.j AS j, sum(gtg.v * za.z) AS v FROM gtg JOIN za ON gtg.j = za.i GROUP BY 1, 2) p ON p.i = gtx.i AND p.j = gtx.j),
gc AS (SELECT c.t, c.i, any_value(c) AS c, sum(x.v * gz.v) AS v FROM c JOIN x ON x.t = c.t JOIN gz ON gz.i = c.i AND gz.j = x.j GROUP BY 1, 2),
uc AS (SELECT t, i, c - v AS u, sum(c - v) OVER o AS s, row_number() OVER o AS k FROM gc WINDOW o AS (PARTITION BY i ORDER BY c - v DESC, t ROWS UNBOUNDED PRECEDING)),
tc AS (SELECT i, max((s - 1) / k) AS theta FROM uc GROUP BY i),
dc AS (SELECT gc.t, gc.i, gc.c, gc.v, greatest(u - theta, 0) - gc.c AS d FROM gc JOIN uc ON uc.t = gc.t AND uc.i = gc.i JOIN tc ON tc.i = gc.i),
dx AS (SELECT i, j, sum(d * x.v) AS v FROM dc JOIN x USING (t) GROUP BY 1, 2),
sl AS (SELECT (SELECT sum(v * d) FROM dc) AS slope, (SELECT sum(gtg.v * a.v * b.v) FROM gtg JOIN dx a ON a.i = gtg.i JOIN dx b ON b.i = gtg.j AND b.j = a.j) AS bend),
c1 AS (SELECT t, i, c + d * (SELECT {_STEP} FROM sl) AS c FROM dc)"""
_MIXED = ", z1 AS (SELECT i, j, sum(c * v) AS z FROM c1 JOIN x USING (t) GROUP BY 1, 2), zz AS (SELECT a.i AS i, b.i AS j, sum(a.z * b.z) AS v FROM z1 a JOIN z1 b ON a.j = b.j GROUP BY 1, 2)"
_ARCHETYPE_WEIGHTS = _MIXED + f""", gs AS (SELECT p.t, p.i, own.g, 2 * (p.v - q.v) AS v FROM (SELECT g.t AS t, zz.i AS i, sum(g.g * zz.v) AS v FROM g JOIN zz ON zz.j = g.i GROUP BY 1, 2) p
 JOIN (SELECT x.t AS t, z1.i AS i, sum(x.v * z1.z) AS v FROM x JOIN z1 ON x.j = z1.j GROUP BY 1, 2) q ON q.t = p.t AND q.i = p.i JOIN g own ON own.t = p.t AND own.i = p.i),
us AS (SELECT t, i, g - v AS u, sum(g - v) OVER o AS s, row_number() OVER o AS k FROM gs WINDOW o AS (PARTITION BY t ORDER BY g - v DESC, i ROWS UNBOUNDED PRECEDING)),
ts AS (SELECT t, max((s - 1) / k) AS theta FROM us GROUP BY t),
ds AS (SELECT gs.t, gs.i, gs.g, gs.v, greatest(u - theta, 0) - gs.g AS d FROM gs JOIN us ON us.t = gs.t AND us.i = gs.i JOIN ts ON ts.t = gs.t),
cs AS (SELECT a.i AS i, b.i AS j, sum(a.d * b.d) AS v FROM ds a JOIN ds b ON a.t = b.t GROUP BY 1, 2),
ls AS (SELECT (SELECT sum(v * d) FROM ds) AS slope, (SELECT sum(cs.v * zz.v) FROM cs JOIN zz USING (i, j)) AS bend)"""


def _with_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """Rows with the weights and the dictionary that archetypes start from."""
    raw = lambda i: (1 + F.col("t") * (i + 2) % 5).cast("double")
    rows = _rows(spark, d)
    sums = rows.agg(*[F.sum(raw(i)) for i in range(K)]).first()
    return rows.withColumn("c", F.array(*[raw(i) / sums[i] for i in range(K)]))


def _archetype_step(spark: SparkSession, d: str) -> DataFrame:
    """Rows after one step on the dictionary and one on the weights from a fixed start."""
    return models.ArchetypalAnalysis(K, init="custom", max_iterations=1).fit_long(_with_dictionary(spark, d)).rows


@query(_DICTIONARY + " SELECT t, i, round(c, 7) AS c FROM c1")
def q_aa_fit_1step_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_archetype_step(spark, d), "c", "c", "t", place="i", decimals=7)


@query(_DICTIONARY + _ARCHETYPE_WEIGHTS + f" SELECT t, i, round(g + d * (SELECT {_STEP} FROM ls), 6) AS g FROM ds")
def q_aa_fit_1step_weights(spark: SparkSession, d: str) -> DataFrame:
    return _cells(_archetype_step(spark, d), "gamma", "g", "t", place="i")


_DELTA = 0.25


def _scale_chain() -> str:
    """The scales one after the other: each is the minimum along itself, given those before it, within its bounds."""
    at = lambda table, i, j: f"(SELECT v FROM {table} WHERE i = {i} AND j = {j})"
    out = []
    for i in range(K):
        others = " ".join(f"- {at('gtg', i, j)} * {at('zz', i, j)}" + (f" * (SELECT v FROM sc{j})" if j < i else "") for j in range(K) if j != i)
        best = f"((SELECT sum(gtx.v * z1.z) FROM gtx JOIN z1 USING (i, j) WHERE i = {i}) {others}) / ({at('gtg', i, i)} * {at('zz', i, i)})"
        out.append(f"sc{i} AS (SELECT least({1 + _DELTA}, greatest({1 - _DELTA}, {best})) AS v)")
    return ", ".join(out)


@query(_DICTIONARY + _MIXED + ", " + _scale_chain() + " " + " UNION ALL ".join(f"SELECT CAST({i} AS BIGINT) AS i, round(v, 6) AS scale FROM sc{i}" for i in range(K)))
def q_aa_fit_1step_scales(spark: SparkSession, d: str) -> DataFrame:
    """Scales of relaxed archetypes after one step on the dictionary from a fixed start."""
    got = models.ArchetypalAnalysis(K, _DELTA, "custom", max_iterations=1, update=("dictionary",)).fit_long(_with_dictionary(spark, d))
    return spark.createDataFrame([(i, round(float(v), 6)) for i, v in enumerate(got.scales)], "i long, scale double")


@query(f"""{{x}} + o AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k FROM (SELECT DISTINCT t FROM x)), s AS (SELECT k // {K} AS r, k % {K} AS i, j, v AS s FROM x JOIN o USING (t) WHERE k < {2 * K}),
d1 AS (SELECT r, t, i, sum((v - s) * (v - s)) AS d FROM x JOIN s USING (j) GROUP BY ALL), l1 AS (SELECT r, t, arg_min(i, (d, i)) AS i FROM d1 GROUP BY ALL),
c1 AS (SELECT r, i, j, avg(v) AS s FROM x JOIN l1 USING (t) GROUP BY ALL), d2 AS (SELECT r, t, i, sum((v - s) * (v - s)) AS d FROM x JOIN c1 USING (j) GROUP BY ALL)
SELECT round(min(cost), 3) AS cost FROM (SELECT r, sum(d) AS cost FROM (SELECT r, t, min(d) AS d FROM d2 GROUP BY ALL) GROUP BY r)""")
def q_fembv_best_restart(spark: SparkSession, d: str) -> DataFrame:
    """The least cost of two restarts after two iterations, side by side on the same passes."""
    rows = frames.vectors(spark, d)
    starts = np.array([r.x for r in rows.orderBy("t").limit(2 * K).collect()]).reshape(2, K, -1)
    _, _, costs = models.BoundedRegimes(K, restarts=2, max_iterations=2).fit_long(rows, list(starts))
    return spark.createDataFrame([(round(costs[1], 3),)], "cost double")


@query(_FURTHEST + """, r AS (SELECT CAST(vec_id AS BIGINT) AS t, i, CAST(1 + (vec_id * (i + 1)) % 7 AS DOUBLE) AS r FROM embeddings, range(3) k(i))
SELECT r.t, picks.t AS sample, round(r / sum(r) OVER (PARTITION BY r.t), 6) AS value FROM r JOIN picks USING (i)""")
def q_mixtures_of_samples(spark: SparkSession, d: str) -> DataFrame:
    """Coded rows as mixtures of fitted samples, where archetypes are rows far from each other."""
    rows = frames.vectors(spark, d)
    c = models.ArchetypalAnalysis(3, update=(), max_iterations=1, extra_steps=2).fit_long(rows.where("t % 10 <> 3")).rows
    entries = c.select("series_id", F.lit("dictionary").alias("part"), F.lit(0).alias("a"), "t", F.lit(0).alias("i"), F.posexplode("c").alias("j", "value"))
    coded = rows.select("series_id", "t", _gamma(k=3).alias("gamma"))
    return models.Fitted(entries).mixtures(coded).select("t", "sample", F.round("value", 6).alias("value"))
