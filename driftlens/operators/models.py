"""Estimators over DataFrames: fit(df) gives an immutable model with tables and transform(df).

Every model is fitted for each series by one task of applyInPandas, so many
series, restarts or parameter sets run side by side; transform takes the rows
of a series and its parameters (not its samples) to one task likewise. Convex
codings, archetypes and regimes also have fit_long, for one series that does not
fit a task: its passes are aggregations over all rows. Failures of a series' own
data raise.

Starts: init "random", "furthest_sum" (extra_steps times a pick is replaced) or
"custom" with start, arrays by name, the same for every series. `update` names the blocks that a fit may change, the
others stay at their start. progress(series, iteration, cost, change) is called
in the workers while a fit runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.functions import vec
from driftlens.functions.fourier import FourierFeatures
from driftlens.functions.stochastic import random_weights
from driftlens.operators import coding_long, core, regimes_long
from driftlens.operators.moments import factor, factors, lagged_moments
from driftlens.operators.seeding import furthest_sum, random_rows
from driftlens.sources.frames import check_positive, check_vectors, lagged, numbered
from driftlens.sources.store import written

#: What every fit returns: one table, told apart by part.
PARTS = "series_id long, part string, a int, t long, i int, j int, value double"
_COLUMNS = ["series_id", "part", "a", "t", "i", "j", "value"]


def _entries(series: int, part: str, array: np.ndarray, times: np.ndarray | None = None) -> pd.DataFrame:
    """A (samples by k), (i by j) or (a by i by j) array in long form."""
    array = np.asarray(array, float)
    index = np.indices(array.shape).reshape(array.ndim, -1)
    zero = np.zeros(array.size, int)
    if times is not None:
        a, t, i, j = zero, np.asarray(times)[index[0]], zero, index[1]
    else:
        a, i, j = (index[0], index[1], index[2]) if array.ndim == 3 else (zero, index[0], index[1] if array.ndim > 1 else zero)
        t = zero
    return pd.DataFrame({"series_id": series, "part": part, "a": a, "t": t, "i": i, "j": j, "value": array.ravel()})[_COLUMNS]


#: (parameters of a series by name, x, u) -> weights of its rows.
Transform = Callable[[dict[str, np.ndarray], np.ndarray, np.ndarray | None], np.ndarray]


@dataclass(frozen=True)
class Fitted:
    """The parts of a fit, for every series."""

    parts: DataFrame
    weights: Transform | None = None
    #: (name of a part with a vector for each component, expression of weights from x and these vectors): weights of a row that depend on no other row.
    by_row: tuple[str, Callable[[F.Column], F.Column]] | None = None

    def parameters(self) -> DataFrame:
        """The parts that are not by sample, and not the costs."""
        return self.parts.where(~F.col("part").isin("gamma", "dictionary", "cost"))

    def transform(self, df: DataFrame) -> DataFrame:
        """(series_id, t, gamma): weights of new rows with the parameters of their series held fixed. Series that were not fitted have no rows."""
        if self.by_row:
            name, expression = self.by_row
            return self._with_vectors(df.select("series_id", "t", "x"), name, "_v").select("series_id", "t", expression(F.col("_v")).alias("gamma"))
        weights = self.weights
        if weights is None:
            raise ValueError("this fit has no transform")

        def run(rows: pd.DataFrame, parameters: pd.DataFrame) -> pd.DataFrame:
            if not len(rows) or not len(parameters):
                return pd.DataFrame({"series_id": pd.Series(dtype="int64"), "t": pd.Series(dtype="int64"), "gamma": pd.Series(dtype=object)})
            rows, x, u = _arrays(rows)
            return pd.DataFrame({"series_id": rows["series_id"], "t": rows["t"], "gamma": list(weights(_tables(parameters), x, u))})

        both = df.select(*_columns(df)).groupBy("series_id").cogroup(self.parameters().groupBy("series_id"))
        return both.applyInPandas(run, "series_id long, t long, gamma array<double>")

    def inverse_transform(self, coded: DataFrame, states: str = "states") -> DataFrame:
        """coded(series_id, t, gamma) with y: gamma times the states (or centres) of its series."""
        joined = self._with_vectors(coded, states, "_c", "j", "i")
        return joined.withColumn("y", F.transform("_c", lambda c: vec.dot("gamma", c))).drop("_c")

    def _with_vectors(self, df: DataFrame, part: str, name: str, outer: str = "i", inner: str = "j") -> DataFrame:
        """df with the vectors of a part of its series, an array for each `outer`; rows of series that were not fitted are dropped."""
        one = self.part(part).groupBy("series_id", outer).agg(F.array_sort(F.collect_list(F.struct(inner, "value"))).alias("v"))
        vectors = one.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct(outer, F.col("v.value").alias("s")))).alias("c")).select("series_id", F.col("c.s").alias(name))
        return df.join(F.broadcast(vectors) if vectors.limit(1001).count() <= 1000 else vectors, "series_id")

    def mixtures(self, coded: DataFrame) -> DataFrame:
        """(series_id, t, sample, value): coded(series_id, t, gamma) as mixtures of fitted samples, gamma times the dictionary; only what is not 0."""
        shares = self.part("dictionary").where("value <> 0").select("series_id", F.col("t").alias("sample"), "j", "value")
        each = coded.select("series_id", "t", F.posexplode("gamma").alias("j", "g")).where("g <> 0")
        return each.join(shares, ["series_id", "j"]).groupBy("series_id", "t", "sample").agg(F.sum(F.col("g") * F.col("value")).alias("value"))

    def part(self, name: str) -> DataFrame:
        return self.parts.where(F.col("part") == name).drop("part")

    def rows(self, name: str) -> DataFrame:
        """(series_id, t, values) of a part with a vector for each sample."""
        pairs = self.part(name).groupBy("series_id", "t").agg(F.array_sort(F.collect_list(F.struct("j", "value"))).alias("v"))
        return pairs.select("series_id", "t", F.col("v.value").alias("values"))

    def matrix(self, name: str, series: int = 0) -> np.ndarray:
        """A part of one series that is small: parameters, not samples."""
        rows = self.part(name).where(F.col("series_id") == series).collect()
        out = np.full(tuple(max(r[d] for r in rows) + 1 for d in ("a", "i", "j")), np.nan)
        for r in rows:
            out[r.a, r.i, r.j] = r.value
        return out[0] if out.shape[0] == 1 else out

    def summary(self) -> DataFrame:
        """(series_id, iteration, cost, delta)."""
        costs = self.part("cost").select("series_id", F.col("i").alias("iteration"), F.col("value").alias("cost"))
        before = F.lag("cost").over(Window.partitionBy("series_id").orderBy("iteration"))
        return costs.withColumn("delta", F.col("cost") - before)


def _arrays(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray | None]:
    """Rows of a series in order of t, their x, and their u."""
    pdf = pdf.sort_values("t", kind="stable")
    return pdf, np.stack(pdf["x"].to_numpy()).astype(float), np.stack(pdf["u"].to_numpy()).astype(float) if "u" in pdf else None


def _columns(df: DataFrame) -> list[str]:
    return ["series_id", "t", "x", *(["u"] if "u" in df.columns else [])]


def _tables(pdf: pd.DataFrame) -> dict[str, np.ndarray]:
    """The arrays of a series' parameters."""
    out = {}
    for name, part in pdf.groupby("part"):
        array = np.full(tuple(int(part[d].max()) + 1 for d in ("a", "i", "j")), np.nan)
        array[part["a"], part["i"], part["j"]] = part["value"]
        out[name] = array[0] if len(array) == 1 else array
    return out


def fit_series(df: DataFrame, fit: Callable[[np.ndarray, np.ndarray | None, int], list[tuple[str, np.ndarray, bool]]], transform: Transform | None = None) -> Fitted:
    """fit(x, u, series) -> [(part, array, whether it is by sample)], for each series in order of t."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, x, u = _arrays(pdf)
        series = int(pdf["series_id"].iloc[0])
        return pd.concat([_entries(series, n, a, pdf["t"].to_numpy() if by_sample else None) for n, a, by_sample in fit(x, u, series)], ignore_index=True)

    return Fitted(written(df.select(*_columns(df)).groupBy("series_id").applyInPandas(run, PARTS)), transform)


class ConvexCoding:
    """X is near gamma S: rows of gamma on the simplex, a penalty on distances between states.

    With lags, a Markov mixture of past weights is fitted too: jointly, if
    epsilon_weights is above 0, else after the coding.
    """

    def __init__(
        self, n_components: int, epsilon_states: float = 0.0, lags: Sequence[int] = (), epsilon_weights: float = 0.0, tolerance: float = 1e-6, max_iterations: int = 1000, seed: int = 0, init: str = "random",
        start: dict | None = None, update: Sequence[str] = ("states", "weights", "parameters"), monotonic: bool = True, memory: int = 1, progress: Callable[[int, int, float, float], None] | None = None, extra_steps: int = 10,
    ):
        check_positive(n_components=n_components, max_iterations=max_iterations, tolerance=tolerance, memory=memory)
        core.check_init(init, {} if init != "custom" else {"states": (start or {}).get("states")})
        if not set(update) <= {"states", "weights", "parameters"}:
            raise ValueError(f"update may name states, weights and parameters: {list(update)}")
        self.k, self.epsilon, self.lags = n_components, epsilon_states, core.check_lags(lags) if len(lags) else []
        self.epsilon_weights, self.tolerance, self.max_iterations, self.seed = epsilon_weights, tolerance, max_iterations, seed
        self.init, self.options = init, {**(start or {}), "init": init, "update": tuple(update), "monotonic": monotonic, "memory": memory, "extra_steps": extra_steps}
        self.progress = progress

    def _fit(self, x: np.ndarray, series: int, **options: object) -> core.Coding:
        joint = self.lags if self.epsilon_weights > 0 else []
        note = None if self.progress is None else lambda *a: self.progress(series, *a)
        limits = {"tolerance": self.tolerance, "max_iterations": self.max_iterations, "seed": self.seed}
        return core.fit_coding(x, self.k, self.epsilon, joint, self.epsilon_weights, **{**limits, **self.options, **options}, progress=note)

    def _weights(self, parameters: dict[str, np.ndarray], x: np.ndarray, u: np.ndarray | None) -> np.ndarray:
        """Weights for fixed states, and for a fixed mixture where they are coded jointly."""
        mixture = None
        if self.lags and self.epsilon_weights > 0:
            mixture = (parameters["order_weights"].ravel(), parameters["transitions"].reshape(len(self.lags), self.k, self.k))
        return self._fit(x, -1, states=parameters["states"], gamma=None, mixture=mixture, init="random", update=("weights",)).gamma

    def fit(self, df: DataFrame) -> Fitted:
        own = self

        def fit(x: np.ndarray, u: np.ndarray | None, series: int) -> list[tuple[str, np.ndarray, bool]]:
            got = own._fit(x, series)
            out = [("gamma", got.gamma, True), ("states", got.states, False), ("cost", np.array(got.trace.costs), False)]
            w, t = got.order_weights, got.transitions
            if own.lags and w is None and len(x) > max(own.lags):
                w, t, _ = core.fit_mixture(core.moments_of(got.gamma, own.lags), own.lags, len(x), own.k, seed=own.seed)
            if w is not None:
                out += [("order_weights", w, False), ("transitions", t.reshape(len(own.lags), own.k, own.k), False)]
            return out

        return fit_series(df, fit, self._weights)

    def fit_long(self, df: DataFrame) -> coding_long.LongCoding:
        """The fit of one series of any length, with the mixture in the loop where epsilon_weights is above 0 and lags are given.

        init "custom" takes states and, with lags, mixture from start; gamma is
        a column of df then. An iteration is one pass over the rows.
        """
        n, d = check_vectors(df)
        joint, rng, start = self.lags if self.epsilon_weights > 0 else [], np.random.RandomState(self.seed), self.options
        if self.init == "custom":
            states, mixture = np.asarray(start["states"], float), start.get("mixture")
            core.check_start(states, (self.k, d), None)
            check_vectors(df, "gamma", self.k)
        elif self.init == "furthest_sum":
            states, mixture = np.array([x for _, x in furthest_sum(df, self.k, None, extra_steps=start["extra_steps"])]), None
        else:
            states, mixture = random_rows(df, self.k, rng), None
        if joint and mixture is None:
            mixture = core.random_mtd(self.k, joint, rng)
        gamma = F.col("gamma") if self.init == "custom" else random_weights(self.k, self.seed, "series_id", "t")
        rows = numbered(df, ["series_id", "t"], "place")
        note = None if self.progress is None else lambda *a: self.progress(0, *a)
        got = coding_long.fit_coding(
            rows.select("place", "x", gamma.alias("gamma")), n, d, states, self.epsilon, joint, self.epsilon_weights, mixture,
            self.tolerance, self.max_iterations, self.options["update"], self.options["monotonic"], self.options["memory"], note,
        )
        return got._replace(rows=rows.drop("gamma").join(got.rows, "place").drop("place"))


def code(df: DataFrame, states: np.ndarray, rounds: int = 200, gap: str | None = None) -> DataFrame:
    """df with gamma: weights of each row for fixed states, by projected steps of one fixed length, row by row.

    The weights of rows are independent quadratic programmes, so no row waits
    for another; the start is uniform. rounds is a number of steps, not a test
    of convergence: gap names a column for the duality gap that is left, an upper
    bound of how far the row's squared error is above its least.
    """
    k, gram = len(states), states @ states.T
    length = 1 / max(np.linalg.eigvalsh(gram)[-1], 1e-12)
    linear = vec.matvec(states, "x")
    start = vec.literal(np.full(k, 1 / k))

    def step(g: F.Column, _: F.Column) -> F.Column:
        return vec.simplex_project(vec.add(g, vec.add(vec.matvec(gram, g), F.col("_linear"), -1.0), -length))

    out = df.withColumn("_linear", linear)
    out = out.withColumn("gamma", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step))
    if gap:
        out = out.withColumn("_slope", vec.add(vec.matvec(gram, "gamma"), "_linear", -1.0))
        out = out.withColumn(gap, 2 * (vec.dot("gamma", "_slope") - F.array_min("_slope"))).drop("_slope")
    return out.drop("_linear")


def reconstruct(df: DataFrame, states: np.ndarray, name: str = "y") -> DataFrame:
    """df with gamma S."""
    return df.withColumn(name, vec.weighted_rows("gamma", states))


def forecast(df: DataFrame, order_weights: np.ndarray, transitions: np.ndarray, lags: Sequence[int], horizon: int, by: str = "auto") -> DataFrame:
    """df(series_id, t, gamma) with ahead: the weights horizon steps on; null for the first max(lags) - 1 rows."""
    if horizon == 0:
        return df.withColumn("ahead", F.col("gamma"))
    blocks = core.forecast_blocks(order_weights, transitions, lags, horizon)
    rows = lagged(df, "gamma", range(1, max(lags)), by)
    total = vec.matvec(blocks[0], "gamma")
    for j in range(1, max(lags)):
        total = vec.add(total, vec.matvec(blocks[j], f"gamma_lag{j}"))
    oldest = F.col("gamma") if max(lags) == 1 else F.col(f"gamma_lag{max(lags) - 1}")
    return rows.withColumn("ahead", F.when(oldest.isNotNull(), total)).drop(*[f"gamma_lag{j}" for j in range(1, max(lags))])


def fit_markov_mixture(df: DataFrame, lags: Sequence[int], seed: int = 0, by: str = "auto", bounds: str = "within") -> tuple[np.ndarray, np.ndarray, float]:
    """Order weights and transitions for given weights, of any number of rows: one pass, then the driver; by: see frames.lagged.

    bounds="within" finds the least cost among stochastic matrices. bounds="after",
    for one lag, is a regression whose columns are projected on the simplex; the
    two differ only where the regression leaves it.
    """
    lags = core.check_lags(lags)
    if bounds not in ("within", "after") or (bounds == "after" and len(lags) > 1):
        raise ValueError(f"bounds are kept within or, for one lag, after the fit: {bounds!r}")
    moments = lagged_moments(df, "gamma", lags, by)
    n, k = df.count(), len(moments[0, 0])
    if bounds == "after":
        w, t = np.ones(1), core.regressed_transitions(moments, lags[0])[None]
        return w, t, core.mixture_cost(moments, lags, n, w, t)
    return core.fit_mixture(moments, lags, n, k, seed=seed)


class ArchetypalAnalysis:
    """X is near S C X; delta lets archetypes lie off the hull by that share.

    kernel: None for linear products; a function from the samples of a series to
    the matrix of their products; or "precomputed", where x is a sample's row of
    that matrix (in order of t). With a function, new rows are transformed by
    their products with `landmarks` fitted samples alone.
    """

    def __init__(
        self, n_components: int, delta: float = 0.0, init: str = "furthest_sum", tolerance: float = 1e-6, max_iterations: int = 1000, seed: int = 0, kernel: str | Callable[[np.ndarray], np.ndarray] | None = None,
        start: dict | None = None, update: Sequence[str] = ("dictionary", "weights"), monotonic: bool = True, memory: int = 1, progress: Callable[[int, int, float, float], None] | None = None, landmarks: int = 100, extra_steps: int = 10,
    ):
        check_positive(n_components=n_components, max_iterations=max_iterations, tolerance=tolerance, memory=memory, landmarks=landmarks)
        core.check_init(init, {})
        if not set(update) <= {"dictionary", "weights"}:
            raise ValueError(f"update may name dictionary and weights: {list(update)}")
        if not (kernel is None or kernel == "precomputed" or callable(kernel)):
            raise ValueError(f"kernel must be None, precomputed or a function: {kernel!r}")
        if not delta >= 0:
            raise ValueError(f"delta must not be negative: {delta}")
        self.k, self.delta, self.tolerance, self.max_iterations, self.seed, self.kernel = n_components, delta, tolerance, max_iterations, seed, kernel
        self.options = {**(start or {}), "init": init, "update": tuple(update), "monotonic": monotonic, "memory": memory, "extra_steps": extra_steps}
        self.progress, self.landmarks = progress, landmarks

    def _weights(self, parameters: dict[str, np.ndarray], x: np.ndarray, u: np.ndarray | None) -> np.ndarray:
        """Weights of new rows on the fixed archetypes; with a kernel, by landmarks."""
        if callable(self.kernel):
            marks, out = np.atleast_2d(parameters["landmarks"]), []
            for at in range(0, len(x), len(marks)):
                some = x[at : at + len(marks)]
                products = self.kernel(np.vstack([some, marks]))[: len(some), len(some) :]
                out.append(core.weights_by_products(products @ np.atleast_2d(parameters["mix"]).T, np.atleast_2d(parameters["products"]), self.tolerance, self.max_iterations))
            return np.vstack(out)
        states = parameters["states"]
        return core.fit_coding(x, self.k, tolerance=self.tolerance, max_iterations=self.max_iterations, seed=self.seed, states=states, update=("weights",)).gamma

    def fit(self, df: DataFrame) -> Fitted:
        own = self

        def fit(x: np.ndarray, u: np.ndarray | None, series: int) -> list[tuple[str, np.ndarray, bool]]:
            products = own.kernel(x) if callable(own.kernel) else x
            note = None if own.progress is None else lambda *a: own.progress(series, *a)
            got = core.fit_archetypes(products, own.k, own.delta, tolerance=own.tolerance, max_iterations=own.max_iterations, seed=own.seed, kernel=own.kernel is not None, **own.options, progress=note)
            states = got.states if own.kernel is None else got.scales[:, None] * (got.dictionary @ x)
            out = [("gamma", got.weights, True), ("dictionary", got.dictionary.T, True), ("states", states, False), ("scales", got.scales, False), ("cost", np.array(got.trace.costs), False)]
            if callable(own.kernel):
                marks = core.landmarks(x, products, got.dictionary, got.scales, own.landmarks)
                out += [("landmarks", marks.rows, False), ("mix", marks.mix, False), ("products", marks.products, False)]
            return out

        return fit_series(df, fit, None if self.kernel == "precomputed" else self._weights)


    def fit_long(self, df: DataFrame) -> coding_long.LongArchetypes:
        """The fit of one series of any length, with linear products. init "custom": gamma and c (a row's shares in the archetypes) are columns of df."""
        if self.kernel is not None:
            raise ValueError("long series are fitted with linear products")
        _, d = check_vectors(df)
        rows = numbered(df, ["series_id", "t"], "place")
        gamma = random_weights(self.k, self.seed, "series_id", "t")
        if self.options["init"] == "custom":
            gamma, c = F.col("gamma"), F.col("c")
        elif self.options["init"] == "furthest_sum":
            picks = [i for i, _ in furthest_sum(rows.select(F.col("place").alias("t"), "x"), self.k, None, extra_steps=self.options["extra_steps"])]
            c = F.array(*[F.when(F.col("place") == i, 1.0).otherwise(0.0) for i in picks])
        else:
            c = random_weights(self.k, self.seed + 1, "series_id", "t")
            sums = rows.select(F.posexplode(c).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
            c = F.array(*[F.get(c, F.lit(r.i)) / r.v for r in sums])
        note = None if self.progress is None else lambda *a: self.progress(0, *a)
        got = coding_long.fit_archetypes(
            rows.select("place", "x", gamma.alias("gamma"), c.alias("c")), d, self.k, self.delta, self.tolerance, self.max_iterations,
            self.options["update"], self.options["monotonic"], self.options["memory"], note,
        )
        return got._replace(rows=rows.drop("gamma", "c").join(got.rows, "place").drop("place"))


class BoundedRegimes:
    """Regimes whose weights have bounded total variation in time.

    kind "kmeans": a regime is a centre. kind "var": a regime is a vector
    autoregression of `memory` (an int, or one for each component), with a
    contemporaneous input where df has u. Any other core.Family is a kind too:
    three hooks (start, distances, update) and its parameters as tables.
    """

    def __init__(self, n_components: int, max_tv_norm: float | None = None, kind: str | core.Family = "kmeans", memory: int | Sequence[int] = 1, restarts: int = 1, tolerance: float = 1e-4, max_iterations: int = 500, seed: int = 0, progress: Callable[[int, int, float, float], None] | None = None):
        check_positive(n_components=n_components, max_iterations=max_iterations, restarts=restarts, tolerance=tolerance)
        memories = [memory] * n_components if isinstance(memory, int) else list(memory)
        if not isinstance(kind, core.Family) and (kind not in ("kmeans", "var") or len(memories) != n_components or min(memories) < 0):
            raise ValueError(f"kind {kind!r} with memory {memory!r} is not possible for {n_components} components")
        self.family = kind if isinstance(kind, core.Family) else core.Centers() if kind == "kmeans" else core.Autoregressions(memories)
        self.k, self.bound, self.restarts = n_components, max_tv_norm, restarts
        self.tolerance, self.max_iterations, self.seed, self.progress = tolerance, max_iterations, seed, progress

    def weights_of(self, parameters: dict[str, np.ndarray], x: np.ndarray, u: np.ndarray | None) -> np.ndarray:
        """Weights of a series' rows for fixed parameters."""
        return core.regime_weights(self.family, self.family.restored(parameters), x, u, self.bound)

    def fit(self, df: DataFrame) -> Fitted:
        """The restart of least cost for each series; restarts are groups of their own, so they run side by side."""
        own, r = self, self.restarts
        many = df.withColumn("restart", F.explode(F.sequence(F.lit(0), F.lit(r - 1)))).withColumn("series_id", F.col("series_id") * r + F.col("restart")) if r > 1 else df

        def fit(x: np.ndarray, u: np.ndarray | None, series: int) -> list[tuple[str, np.ndarray, bool]]:
            note = None if own.progress is None else lambda *a: own.progress(series, *a)
            got = core.fit_regimes(own.family, x, u, own.k, own.bound, own.tolerance, own.max_iterations, own.seed + series % r, note)
            return [("gamma", got.gamma, True), *((n, a, False) for n, a in own.family.tables(got.parameters)), ("cost", np.array(got.trace.costs), False)]

        parts = fit_series(many, fit).parts
        if r == 1:
            return self.fitted(parts)
        w = Window.partitionBy("whole").orderBy("value", "series_id")
        last = parts.where("part = 'cost'").groupBy("series_id").agg(F.max_by("value", "i").alias("value")).withColumn("whole", F.floor(F.col("series_id") / r))
        best = last.withColumn("place", F.row_number().over(w)).where("place = 1").select("series_id", "whole")
        return self.fitted(parts.join(best, "series_id").drop("series_id").withColumnRenamed("whole", "series_id").select(*_COLUMNS))

    def fitted(self, parts: DataFrame) -> Fitted:
        """A fit from its parts. Without a bound, centres give weights row by row, in expressions."""
        if isinstance(self.family, core.Centers) and (self.bound is None or self.bound < 0):
            nearest = lambda v: F.transform(v, lambda c: vec.sqdist("x", c))
            return Fitted(parts, self.weights_of, ("centers", lambda v: vec.one_hot(vec.argmin(nearest(v)), self.k)))
        return Fitted(parts, self.weights_of)

    def fit_long(self, df: DataFrame, starts: Sequence[object] | None = None) -> tuple[DataFrame, object, list[float]]:
        """(df with gamma, parameters, costs) for one series of any length, with or without a bound; no task holds more than a chunk of its rows.

        starts: parameters to begin with, one for each restart. Restarts run
        side by side on the same passes; the one of least cost is returned.
        """
        n, d = check_vectors(df)
        names, skipped = ["x"], 0
        if isinstance(self.family, core.Centers):
            family = regimes_long.LongCenters()
            starts = starts or [random_rows(df, self.k, np.random.RandomState(self.seed + r)) for r in range(self.restarts)]
        elif isinstance(self.family, core.Autoregressions):
            skipped, m = self.family.skipped, len(df.first().u) if "u" in df.columns else 0
            family = regimes_long.LongAutoregressions(self.family.memories, d, m)
            starts = starts or [None] * self.restarts
            names = [f"x_lag{p}" for p in range(1, skipped + 1)] + ["u"] * (m > 0) + ["x"]
        else:
            raise ValueError("long series are fitted with centres or autoregressions")
        if n <= skipped:
            raise ValueError(f"{n} rows are too few for a memory of {skipped}")
        rows = numbered(df, ["series_id", "t"], "place")
        wide = lagged(rows.select("series_id", "t", "place", *set(names) & {"x", "u"}), "x", range(1, skipped + 1), "chunk").where(F.col("place") >= skipped)
        block = F.concat(F.array(F.lit(1.0)), *names) if skipped or len(names) > 1 else F.col("x")
        passes = regimes_long.Passes(wide.select((F.col("place") - skipped).alias("place"), block.alias("v")), family, self.k, "v")
        note = None if self.progress is None else lambda *a: self.progress(0, *a)
        fits = [regimes_long.fit(family, s, self.k, self.bound, self.tolerance, self.max_iterations, self.seed + r, note) for r, s in enumerate(starts)]
        parameters, mixture, trace = min(regimes_long.run(passes, fits), key=lambda f: f[2].costs[-1])
        gamma = regimes_long.coded(passes, parameters, mixture).withColumnRenamed("place", "_of")
        joined = rows.withColumn("_of", F.greatest(F.col("place") - skipped, F.lit(0))).join(gamma, "_of")
        return joined.select(*df.columns, "gamma"), parameters, trace.costs


def regions_by_features(seed: int = 0, features: int = 100, width: float = 1.0, regularisation: float = 1e-3) -> Pipeline:
    """A classifier of "cluster" by "predictors": they are scaled to unit variance, taken to random Fourier features and classified by multinomial logistic regression."""
    scaled = StandardScaler(inputCol="predictors", outputCol="_scaled", withMean=True)
    fourier = FourierFeatures("_scaled", "_features", features, width, seed)
    linear = LogisticRegression(maxIter=50, family="multinomial", regParam=regularisation, featuresCol="_features", labelCol="cluster", predictionCol="region")
    return Pipeline(stages=[scaled, fourier, linear])


def regions_by_planes(max_iterations: int = 1000) -> LogisticRegression:
    """A classifier of "cluster" by "predictors" themselves, without regularisation: clusters that planes part are parted to the last row, however few rows lie near the border."""
    return LogisticRegression(maxIter=max_iterations, tol=1e-15, family="multinomial", featuresCol="predictors", labelCol="cluster", predictionCol="region")


class PiecewiseAutoregression:
    """Regions of phase space, each with its own autoregression.

    Rows [predictors, x] are clustered; a classifier learns the clusters from
    predictors alone, and its answers are the regions; each region has least
    squares of x on its predictors. Clusterer and classifier are any estimators
    of pyspark.ml with a prediction column. Lags are taken `by`: see frames.lagged.
    """

    def __init__(self, n_components: int, p: int = 1, s: int = 0, trend: bool = True, clusterer: Estimator | None = None, classifier: Estimator | None = None, seed: int = 0, by: str = "auto"):
        self.k, self.p, self.s, self.trend, self.by = n_components, p, s, trend, by
        self.clusterer = clusterer or KMeans(k=n_components, seed=seed, featuresCol="joint", predictionCol="cluster")
        self.classifier = classifier or regions_by_features(seed)

    def design(self, df: DataFrame) -> DataFrame:
        """(series_id, t, x, u, z); z has lags 1 to p of x, then 1 to s of u; rows before them are dropped."""
        rows = df.select("series_id", "t", "x", *(["u"] if self.s else []))
        rows = lagged(rows, "x", range(1, self.p + 1), self.by)
        rows = lagged(rows, "u", range(1, self.s + 1), self.by) if self.s else rows
        names = [f"x_lag{k}" for k in range(1, self.p + 1)] + [f"u_lag{k}" for k in range(1, self.s + 1)]
        there = F.lit(True)
        for n in names:
            there = there & F.col(n).isNotNull()
        return rows.where(there).withColumn("z", F.concat(*names)).drop(*names)

    def fit(self, df: DataFrame) -> PiecewiseModel:
        rows = written(self.design(df)).withColumns({"predictors": array_to_vector("z"), "joint": array_to_vector(F.concat("z", "x"))})
        clusters = self.clusterer.fit(rows)
        clustered = clusters.transform(rows).withColumn("cluster", F.col("cluster").cast("double"))
        n_clusters = clustered.select("cluster").distinct().count()
        regions = self.classifier.fit(clustered) if n_clusters > 1 else None
        labelled = regions.transform(clustered) if regions else clustered.withColumn("region", F.lit(0.0))
        labelled = written(labelled.select("series_id", "t", "x", "z", F.col("region").cast("int").alias("region")))
        d = len(labelled.first().x)
        m = len(df.first().u) if self.s else 0
        wide = labelled.withColumn("all", F.concat(*([F.array(F.lit(1.0))] if self.trend else []), "z", "x"))
        triangles, sizes = factors(wide, "all", "region"), dict(labelled.groupBy("region").count().collect())
        out = {r: core.from_factor(triangles[r], d, sizes[r], self.p, m, self.s, self.trend, False) for r in sorted(sizes)}
        return PiecewiseModel(self, clusters, regions, labelled, out)


@dataclass(frozen=True)
class PiecewiseModel:
    """A fit of PiecewiseAutoregression: clusterer, classifier (None if there is one region), the rows with their regions, an autoregression for each region."""

    estimator: PiecewiseAutoregression
    clusterer: Model
    classifier: Model | None
    rows: DataFrame
    regions: dict[int, core.Autoregression]

    def transform(self, df: DataFrame) -> DataFrame:
        """(series_id, t, x, z, region, y) of new rows that have all their lags: y is what the region's autoregression gives; null in a region that no fitted row had."""
        rows = self.estimator.design(df).withColumn("predictors", array_to_vector("z"))
        found = self.classifier.transform(rows) if self.classifier else rows.withColumn("region", F.lit(0.0))
        found = found.select("series_id", "t", "x", "z", F.col("region").cast("int").alias("region"))
        z = F.concat(F.array(F.lit(1.0)), "z") if self.estimator.trend else F.col("z")
        y = F.lit(None).cast("array<double>")
        for region, model in self.regions.items():
            y = F.when(F.col("region") == region, vec.matvec(model.coefficients.T, z)).otherwise(y)
        return found.withColumn("y", y)


def summarise_restarts(fits: Sequence[PiecewiseModel], spark: SparkSession) -> DataFrame:
    """(component, i, mean, std, restarts) of coefficient i of each component over restarts; a bounded number of rows.

    Components of a restart are put in the order of their constants (their
    coefficients, where there is no trend) before restarts are compared; std is
    that of a population.
    """
    each = [sorted((m.coefficients.ravel().tolist() for m in f.regions.values())) for f in fits]
    rows = [(k, c, i, float(v)) for k, fit in enumerate(each) for c, values in enumerate(fit) for i, v in enumerate(values)]
    table = spark.createDataFrame(rows, "restart int, component int, i int, value double")
    return table.groupBy("component", "i").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("*").alias("restarts"))


def autoregression(df: DataFrame, p: int, s: int = 0, weight: str | None = None, by: str = "auto") -> core.Autoregression:
    """x on [1, lags of x, lags of u, u] over all rows of all series: one pass over the lagged design, by orthogonal factors; by: see frames.lagged."""
    rows = lagged(df, "x", range(1, p + 1), by)
    names = [f"x_lag{k}" for k in range(1, p + 1)]
    m = 0
    if "u" in df.columns:
        rows, m = lagged(rows, "u", range(1, s + 1), by), len(df.first().u)
        names += [*(f"u_lag{k}" for k in range(1, s + 1)), "u"]
    for name in names:
        rows = rows.where(F.col(name).isNotNull())
    root = F.sqrt(F.col(weight)) if weight else F.lit(1.0)
    rows = written(rows.select(F.transform(F.concat(F.array(F.lit(1.0)), *names, "x"), lambda v: v * root).alias("all"), (F.col(weight) if weight else F.lit(1.0)).alias("w")))
    n, total = rows.agg(F.count("*"), F.sum("w")).first()
    d = len(df.first().x)
    triangle = factor(rows, "all")
    out = core.from_factor(triangle, d, n, p, m, s, True, bool(m))
    if weight and out.sigma is not None:
        free = total - 1
        out.sigma = out.sigma * (n - len(triangle) + d) / free if free > 0 else None
    return out
