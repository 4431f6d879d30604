"""Markov models of labels, and k-means states with transitions between them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions import vec
from driftlens.sources.frames import check_positive, lagged
from driftlens.sources.store import written


#: The most states of a transition matrix.
STATES = 2000


def transitions(labels: DataFrame, label: str = "label", series: str = "series_id", order: tuple[str, ...] = ("t",)) -> DataFrame:
    """(next_state, cur_state, n, p): counts and shares of steps from each state, over all series; p is null where a state has no next."""
    steps = lagged(labels.select(series, *order, F.col(label).alias("cur_state")), "cur_state", [-1], "auto", series, order).withColumnRenamed("cur_state_lag-1", "next_state")
    counts = steps.where("next_state IS NOT NULL AND cur_state IS NOT NULL").groupBy("next_state", "cur_state").agg(F.count("*").alias("n"))
    states = labels.where(F.col(label).isNotNull()).select(F.col(label).alias("next_state")).distinct()
    known = [r[0] for r in states.limit(STATES + 1).collect()]
    if len(known) > STATES:
        raise ValueError(f"there are more than {STATES} states; their pairs are the result")
    pairs = states.withColumn("cur_state", F.explode(F.array(*[F.lit(s) for s in known]))) if known else states.withColumn("cur_state", F.col("next_state"))
    full = pairs.join(counts, ["next_state", "cur_state"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    left = F.sum("n").over(Window.partitionBy("cur_state"))
    return full.withColumn("p", F.when(left > 0, F.col("n") / left))


def matrix(table: DataFrame) -> tuple[list, np.ndarray]:
    """States in order, and T[j, k] = P(next j | current k); NaN where unknown."""
    rows = table.collect()
    states = sorted({r.next_state for r in rows})
    at = {s: k for k, s in enumerate(states)}
    out = np.full((len(states), len(states)), np.nan)
    for r in rows:
        out[at[r.next_state], at[r.cur_state]] = np.nan if r.p is None else r.p
    return states, out


@dataclass(frozen=True)
class KMeansMarkovModel:
    """Centres, inertia, the transition matrix of the labels, labels(series_id, t, label) of the fitted rows, iterations."""

    centers: np.ndarray
    inertia: float
    transition: np.ndarray
    labels: DataFrame
    iterations: int

    def transform(self, df: DataFrame) -> DataFrame:
        """df with distance (to each centre) and label."""
        squared = vec.sqdists("x", self.centers)
        return df.withColumn("distance", F.transform(squared, lambda v: F.sqrt(v))).withColumn("label", vec.argmin("distance"))

    def predict(self, df: DataFrame, horizon: int = 1) -> DataFrame:
        """df with label and the distribution of the state horizon steps on."""
        ahead = np.linalg.matrix_power(self.transition, horizon)
        by_label = F.array(*[vec.literal(c) for c in ahead.T])
        return self.transform(df).withColumn("probability", F.get(by_label, F.col("label")))


class KMeansMarkov:
    """k-means on x, then the transitions of labels along t in each series."""

    def __init__(self, n_clusters: int = 2, max_iterations: int = 100, tolerance: float = 1e-4, seed: int = 0, weight: str | None = None):
        check_positive(n_clusters=n_clusters, max_iterations=max_iterations, tolerance=tolerance)
        self.n_clusters, self.max_iterations, self.tolerance, self.seed, self.weight = n_clusters, max_iterations, tolerance, seed, weight

    def fit(self, df: DataFrame) -> KMeansMarkovModel:
        kmeans = KMeans(k=self.n_clusters, maxIter=self.max_iterations, tol=self.tolerance, seed=self.seed, featuresCol="features", predictionCol="label")
        if self.weight:
            kmeans.setWeightCol(self.weight)
        rows = df.select("series_id", "t", array_to_vector(F.col("x")).alias("features"), *([self.weight] if self.weight else []))
        fitted = kmeans.fit(rows)
        labelled = written(fitted.transform(rows).select("series_id", "t", "label"))
        states, t = matrix(transitions(labelled))
        full = np.full((len(fitted.clusterCenters()),) * 2, np.nan)
        full[np.ix_(states, states)] = t
        return KMeansMarkovModel(np.array(fitted.clusterCenters()), float(fitted.summary.trainingCost), full, labelled, int(fitted.summary.numIter))


