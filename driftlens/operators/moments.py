"""Sums of products of vector columns: small matrices out of any number of rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.sources.frames import lagged
from driftlens.sources.store import written


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def cross(df: DataFrame, left: str, right: str) -> np.ndarray:
    """Sum over rows of the outer product of two vector columns.

    Each task adds up its batches; what is shuffled is one row for each task
    and entry, and what reaches the driver is the result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = _matrix(batch.column(0)).T @ _matrix(batch.column(1))
                total = part if total is None else total + part
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    sums = df.select(F.col(left).alias("l"), F.col(right).alias("r")).mapInArrow(run, "i int, j int, v double")
    got = sums.groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not got:
        return np.zeros((0, 0))
    out = np.zeros((max(r.i for r in got) + 1, max(r.j for r in got) + 1))
    for r in got:
        out[r.i, r.j] = r.v
    return out


#: Triangular factors that one task stacks and factors again.
FACTORS = 256


def factor(df: DataFrame, column: str) -> np.ndarray:
    """R of the QR decomposition of a vector column's rows: R'R is the sum of their outer products, without squaring their condition."""
    return next(iter(factors(df.withColumn("_all", F.lit(0)), column, "_all").values()), np.zeros((0, 0)))


def factors(df: DataFrame, column: str, key: str) -> dict[int, np.ndarray]:
    """The same for the rows of each key (an int; few of them), in one pass.

    Each task keeps a triangle for each key, factored again with every batch of
    its rows; triangles are stacked and factored by FACTORS in tasks until few
    are left.
    """

    def triangle(rows: np.ndarray) -> np.ndarray:
        r = np.linalg.qr(rows, mode="r")
        return np.vstack([r, np.zeros((max(0, rows.shape[1] - len(r)), rows.shape[1]))])

    def table(made: dict[int, np.ndarray]) -> list[pa.Array]:
        return [pa.array(list(made), pa.int32()), pa.array([r.tobytes() for r in made.values()], pa.binary()), pa.array([r.shape[1] for r in made.values()], pa.int32())]

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            keys, rows = batch.column(0).to_numpy(), _matrix(batch.column(1))
            for k in np.unique(keys):
                mine = rows[keys == k]
                total[int(k)] = triangle(np.vstack([total[int(k)], mine]) if int(k) in total else mine)
        if total:
            yield pa.RecordBatch.from_arrays(table(total), names=["k", "r", "width"])

    def stacked(rows: pa.Table) -> pa.Table:
        width = rows["width"][0].as_py()
        r = triangle(np.frombuffer(b"".join(rows["r"].to_pylist())).reshape(-1, width))
        return pa.Table.from_arrays(table({rows["k"][0].as_py(): r}), names=["k", "r", "width"])

    ddl = "k int, r binary, width int"
    made = written(df.select(F.col(key).cast("int").alias("k"), F.col(column).alias("v")).mapInArrow(own, ddl))
    while (n := made.groupBy("k").count().agg(F.max("count")).first()[0] or 0) > FACTORS:
        some = made.withColumn("part", F.pmod(F.xxhash64("r"), F.lit(-(-n // FACTORS))))
        made = written(some.groupBy("k", "part").applyInArrow(stacked, ddl))
    left: dict[int, list[np.ndarray]] = {}
    for r in made.orderBy("k", "r").collect():
        left.setdefault(r.k, []).append(np.frombuffer(r.r).reshape(-1, r.width))
    return {k: triangle(np.vstack(each)) for k, each in left.items()}


def as_rows(df: DataFrame, matrix: np.ndarray, name: str = "v") -> DataFrame:
    """A small matrix as (i, j, value)."""
    rows = [(int(i), int(j), float(matrix[i, j])) for i, j in np.ndindex(*matrix.shape)]
    return df.sparkSession.createDataFrame(rows, f"i int, j int, {name} double")


def simplex_columns(df: DataFrame, column: str, keys: list[str], rounds: int = 200) -> tuple[DataFrame, np.ndarray]:
    """Projects each component on the simplex across all rows.

    Thresholds come by Michelot's iteration: every round is one aggregation of
    the entries still above their thresholds, and no component's entries are
    gathered or sorted. Returns df with the projected column, and thresholds;
    raises if they are not found within the rounds.
    """
    entries = written(df.select(F.posexplode(column).alias("j", "v")))
    got = entries.groupBy("j").agg(F.sum("v").alias("s"), F.count("v").alias("n")).orderBy("j").collect()
    theta = np.array([(r.s - 1) / r.n for r in got])
    for _ in range(rounds):
        level = F.array(*[F.lit(float(x)) for x in theta])
        above = entries.where(F.col("v") > F.get(level, F.col("j"))).groupBy("j").agg(F.sum("v").alias("s"), F.count("v").alias("n")).collect()
        now = theta.copy()
        for r in above:
            now[r.j] = (r.s - 1) / r.n
        if np.allclose(now, theta, rtol=0, atol=1e-15):
            break
        theta = now
    else:
        raise RuntimeError(f"thresholds of the simplex are not found within {rounds} rounds")
    level = F.array(*[F.lit(float(x)) for x in theta])
    return df.withColumn(column, F.zip_with(column, level, lambda v, t: F.greatest(v - t, F.lit(0.0)))), theta


def lagged_moments(df: DataFrame, column: str, lags: list[int], by: str = "auto") -> dict[tuple[int, int], np.ndarray]:
    """M[a, b] = sum of x(t - a) x(t - b)' over t from the largest lag on, for a, b in {0, *lags}, in one pass; by: see frames.lagged."""
    all_ = [0, *lags]
    wide = lagged(df.select("series_id", "t", column), column, lags, by).where(F.col(f"{column}_lag{max(lags)}").isNotNull())
    whole = cross(wide.withColumn("all", F.concat(column, *[f"{column}_lag{k}" for k in lags])), "all", "all")
    k = len(whole) // len(all_)
    return {(a, b): whole[i * k : (i + 1) * k, j * k : (j + 1) * k] for i, a in enumerate(all_) for j, b in enumerate(all_)}
