"""Synthetic series with known structure, for tests and examples: regimes and maps drawn on the driver, autoregressions of any length in tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from driftlens.sources import frames
from driftlens.sources.store import workers_know

#: Means and variances of the Gaussian regimes.
MEANS = ((-1.0, 0.0), (1.0, 0.0), (0.0, 1.5))
VARIANCES = ((0.02, 0.05), (0.05, 0.02), (0.1, 0.1))


def _frame(spark: SparkSession, x: np.ndarray, ddl: str, *more: np.ndarray) -> DataFrame:
    rows = [(0, t, [float(v) for v in row], *(m[t].item() for m in more)) for t, row in enumerate(x)]
    return spark.createDataFrame(rows, f"series_id long, t long, x array<double>{ddl}")


def gaussian_regimes(spark: SparkSession, n: int = 500, switches: int = 2, seed: int = 0) -> DataFrame:
    """Runs of three Gaussians in turn; regime is the true one."""
    rng = np.random.default_rng(seed)
    regime = np.minimum(np.arange(n) * (switches + 1) // n, switches) % len(MEANS)
    x = np.asarray(MEANS)[regime] + rng.standard_normal((n, 2)) * np.sqrt(np.asarray(VARIANCES))[regime]
    return _frame(spark, x, ", regime int", regime)


def _stable(rng: np.random.Generator, order: int, d: int) -> np.ndarray:
    """Coefficients of `order` lags whose rows sum to less than 1 in absolute value."""
    return rng.uniform(-0.5, 0.5, (order, d, d)) / (d * order)


class _Map(NamedTuple):
    """What one chunk does to the rows before it: s -> m s + v, s being the last `order` rows, newest first."""

    chunk: int
    m: list[float]
    v: list[float]


def _recursion(spark: SparkSession, n: int, d: int, order: int, noise: float, seed: int, step: Callable[[int], tuple[np.ndarray, np.ndarray]], mark: Callable[[np.ndarray], np.ndarray], column: str) -> DataFrame:
    """x[t] = constant + sum of a[k] x[t - 1 - k] + noise, for (constant, a) = step(t), from `order` rows of 0; column holds mark(t).

    Chunks of CHUNK rows become affine maps side by side, the driver composes
    the maps, and chunks are made from the rows before them. The noise of a
    chunk is drawn from (seed, chunk), so a task that runs again draws it again.
    """
    size, wide = frames.CHUNK, order * d
    chunks = -(-n // size)

    def parts(chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(what is added, coefficients of the last rows) of the chunk's rows; (0, 0) for the first `order` rows of all."""
        at = np.arange(chunk * size, min(n, (chunk + 1) * size))
        e = np.sqrt(noise) * np.random.default_rng([seed, chunk]).standard_normal((len(at), d))
        for t, more in zip(at, e):
            constant, a = step(int(t))
            yield (constant + more, np.concatenate(list(a), axis=1)) if t >= order else (np.zeros(d), np.zeros((d, wide)))

    def maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for chunk in batch["chunk"]:
                m, v = np.eye(wide), np.zeros(wide)
                for b, a in parts(chunk):
                    m, v = np.vstack([a @ m, m[:-d]]), np.concatenate([a @ v + b, v[:-d]])
                out.append(_Map(chunk, m.ravel().tolist(), v.tolist()))
            yield pd.DataFrame(out, columns=_Map._fields)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, s in zip(batch["chunk"], batch["s"]):
                s, x = np.array(s), []
                for b, a in parts(chunk):
                    x.append(a @ s + b)
                    s = np.concatenate([x[-1], s[:-d]])
                t = np.arange(chunk * size, chunk * size + len(x))
                yield pd.DataFrame({"series_id": 0, "t": t, "x": [v.tolist() for v in x], column.split()[0]: mark(t)})

    workers_know(spark)
    tasks = min(chunks, 1000)
    found = spark.range(chunks).toDF("chunk").repartition(tasks).mapInPandas(maps, "chunk long, m array<double>, v array<double>").collect()
    state, starts = np.zeros(wide), []
    for r in sorted(found, key=lambda r: r.chunk):
        starts.append((r.chunk, state.tolist()))
        state = np.array(r.m).reshape(wide, wide) @ state + r.v
    begun = spark.createDataFrame(starts, "chunk long, s array<double>").repartition(tasks)
    return begun.mapInPandas(rows, f"series_id long, t long, x array<double>, {column}")


def periodic_var(spark: SparkSession, n: int = 500, d: int = 2, period: int = 10, noise: float = 1.0, seed: int = 0, order: int = 1) -> DataFrame:
    """A VAR of this order whose mean and coefficients follow cos(2 pi t / period), of any length."""
    rng = np.random.default_rng(seed)
    mu, a = rng.uniform(-1, 1, d), _stable(rng, order, d)
    phase = lambda t: np.cos(2 * np.pi * t / period)
    return _recursion(spark, n, d, order, noise, seed, lambda t: (phase(t) * mu, phase(t) * a), phase, "phase double")


def switching_var(spark: SparkSession, n: int = 500, d: int = 2, k: int = 2, switches: int = 3, noise: float = 1.0, seed: int = 0, order: int = 1) -> DataFrame:
    """A VAR of this order that takes turns between k sets of coefficients, of any length."""
    rng = np.random.default_rng(seed)
    mu, a = rng.uniform(-3, 3, (k, d)), np.stack([_stable(rng, order, d) for _ in range(k)])
    component = lambda t: np.minimum(t * (switches + 1) // n, switches) % k
    return _recursion(spark, n, d, order, noise, seed, lambda t: (mu[component(t)], a[component(t)]), component, "component int")


def piecewise_affine(spark: SparkSession, n: int = 500, seed: int = 0) -> DataFrame:
    """One output of one input; which of three affine maps holds depends on the sum of both one step before."""
    rng = np.random.default_rng(seed)
    u, e, y = rng.uniform(-4, 4, n), rng.uniform(-0.1, 0.1, n), np.zeros(n)
    region = np.zeros(n, int)
    for t in range(1, n):
        region[t] = int(np.digitize(y[t - 1] + u[t - 1], (-1.5, 1.5)))
        slope, gain, constant = ((0.6, 1.0, 2.0), (-0.5, 0.5, 0.0), (0.3, -1.0, -2.0))[region[t]]
        y[t] = slope * y[t - 1] + gain * u[t - 1] + constant + e[t]
    rows = [(0, t, [float(y[t])], [float(u[t])], int(region[t])) for t in range(n)]
    return spark.createDataFrame(rows, "series_id long, t long, x array<double>, u array<double>, region int")
