"""Choosing starting points."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from driftlens.functions import vec

Distance = Callable[[Column, Column], Column]


def euclidean(x: Column, y: Column) -> Column:
    return F.sqrt(vec.sqdist(x, y))


def furthest_sum(df: DataFrame, k: int, start: int | None, exclude: Sequence[int] | Column | DataFrame = (), extra_steps: int = 0, distance: Distance = euclidean) -> list[tuple[int, list[float]]]:
    """(id, vector) of k rows that are far from each other in sum; df has (t, x). start None: the row of the smallest id.

    exclude: ids, a condition on rows, or a table of ids (t). Greedy: each pick
    has the largest sum of distances to those picked before; then extra_steps
    times the oldest pick is put back and replaced. Among equals the smallest id
    is taken. Rows carry the sums of their distances, so a pick costs one new
    distance a row (two where one is put back); no matrix of all pairs exists.
    """
    if k == 0:
        return []
    if isinstance(exclude, DataFrame):
        usable = df.join(exclude.select("t"), "t", "left_anti")
    elif isinstance(exclude, Column):
        usable = df.where(~F.coalesce(exclude, F.lit(False)))
    else:
        usable = df.where(~F.col("t").isin(*exclude)) if len(exclude) else df
    n, there, least = usable.agg(F.count("*"), F.count_if(F.col("t") == start) if start is not None else F.count("*"), F.min("t")).first()
    start = least if start is None else start
    if not there:
        raise ValueError("the start is excluded, or not among the rows")
    if k > n:
        raise ValueError(f"{k} points were asked for, {n} are there")
    rows = usable.select("t", "x", F.lit(0.0).alias("s")).persist(StorageLevel.MEMORY_AND_DISK)
    first = rows.where(F.col("t") == start).first()
    picked = [(start, list(first.x))]
    change = [(picked[0], 1.0)]  # what the sums do not hold yet

    def furthest(others: list[tuple[int, list[float]]]) -> tuple[int, list[float]]:
        nonlocal rows
        s = sum((distance(F.col("x"), vec.literal(x)) * sign for (_, x), sign in change), F.col("s"))
        now = rows.select("t", "x", s.alias("s")).persist(StorageLevel.MEMORY_AND_DISK)
        rest = now.where(~F.col("t").isin(*[i for i, _ in others]))
        best = rest.select(F.struct("s", (-F.col("t")).alias("t"), "x").alias("r")).agg(F.max("r").alias("r")).first().r
        held.append(rows)
        rows = now
        return -best.t, list(best.x)

    held: list[DataFrame] = []
    try:
        while len(picked) < k:
            picked.append(furthest(picked))
            change = [(picked[-1], 1.0)]
        for step in range(extra_steps if 1 < k < n else 0):
            at = step % k
            change.append((picked[at], -1.0))
            picked[at] = furthest(picked[:at] + picked[at + 1 :])
            change = [(picked[at], 1.0)]
        return picked
    finally:
        for each in (*held, rows):
            each.unpersist()


def random_rows(df: DataFrame, k: int, state: np.random.RandomState) -> np.ndarray:
    """k rows of x without replacement: those of the k smallest keyed hashes of their ids."""
    seed = int(state.randint(1 << 31))
    rows = df.select("x", F.xxhash64("series_id", "t", F.lit(seed)).alias("h")).orderBy("h").limit(k).collect()
    if len(rows) < k:
        raise ValueError(f"{k} rows were asked for, {len(rows)} are there")
    return np.array([r.x for r in rows])
