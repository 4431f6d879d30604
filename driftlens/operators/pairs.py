"""All pairs of rows, by blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.sources.store import written

#: Rows of a block; a task holds two blocks and the values of their pairs. Pairs of a row that are given one way before they are given the other way. Components subtracted at once.
BLOCK, RUN, PIECE = 512, 128, 1 << 20

#: (rows, rows, decimals) to the values of their pairs, rounded; the value of (a, b) is that of (b, a).
Kernel = Callable[[np.ndarray, np.ndarray, int], np.ndarray]


def rounded(v: np.ndarray, decimals: int) -> np.ndarray:
    """Halves away from 0."""
    v = v * 10.0**decimals
    return np.trunc(v + np.copysign(0.5, v)) / 10.0**decimals


def products(a: np.ndarray, b: np.ndarray, decimals: int) -> np.ndarray:
    return rounded(a @ b.T, decimals)


def distances(a: np.ndarray, b: np.ndarray, decimals: int) -> np.ndarray:
    """Euclidean; by products where their error can't change the rounded value, from differences elsewhere, as for rows that are near each other."""
    eps, unit = np.finfo(float).eps, 10.0**decimals
    with np.errstate(all="ignore"):
        sums = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)
        squares = sums - 2 * (a @ b.T)
        error = 2 * (a.shape[1] + 4) * eps * sums
        out = np.sqrt(squares)
        scaled = out * unit
        # how far a value can be off, against how far it is from a half; NaN and infinity are never sure
        sure = (squares > 4 * error) & (np.abs(scaled - np.floor(scaled) - 0.5) > error * unit / out + 4 * eps * scaled)
        i, j = np.nonzero(~sure)
        step = max(1, PIECE // max(1, a.shape[1]))
        for at in range(0, len(i), step):
            k, m = i[at : at + step], j[at : at + step]
            d = b[m] - a[k]
            out[k, m] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return rounded(out, decimals)


def all_pairs(df: DataFrame, kernel: Kernel, name: str, decimals: int) -> DataFrame:
    """(i, j, value) for each pair of rows of df (t, x), rounded, halves away from 0; null where a vector is null.

    Two blocks meet once, and a pair is valued once. Spark gives each run of pairs of a
    row as (i, j) and right after that as (j, i), so files pack the second time to little.
    """
    ddl = "block bigint, n int, t array<bigint>, x binary, there array<boolean>"
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.bool_())]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = batch.slice(at, BLOCK)
                t, x = some.column(0).to_pylist(), some.column(1)
                there = x.is_valid().to_numpy(zero_copy_only=False)
                lengths = {len(v) for v in x.drop_null().to_pylist()} if there.any() else {0}
                if len(lengths) > 1 or x.drop_null().flatten().null_count:
                    raise ValueError("vectors must have one width and no null components")
                rows = np.zeros((len(t), lengths.pop()))
                rows[there] = x.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, rows.shape[1]) if rows.shape[1] else 0.0
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([block, len(t), t, rows.tobytes(), there.tolist()], kinds, strict=True)], names=["block", "n", "t", "x", "there"])
                block += 1

    def valued(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                p = batch.slice(k, 1).to_pylist()[0]
                a, b = (np.frombuffer(p["x" + s]).reshape(p["n" + s], len(p["x" + s]) // (8 * p["n" + s])) for s in ("", "2"))
                void = ~np.outer(p["there"], p["there2"])
                if a.shape[1] != b.shape[1]:
                    # a block of nulls alone has no width
                    if not void.all():
                        raise ValueError(f"vectors have widths {a.shape[1]} and {b.shape[1]}")
                    v = np.zeros(void.shape)
                else:
                    v = kernel(a, b, decimals)
                t, t2 = (pa.array(p["t" + s], pa.int64()) for s in ("", "2"))
                if p["block"] == p["block2"]:
                    yield from runs(t, t2, v, void, np.triu(np.ones(v.shape, bool), 1), True)
                    yield from runs(t, t2, v, void, np.eye(len(v), dtype=bool), False)
                else:
                    yield from runs(t, t2, v, void, np.ones(v.shape, bool), True)

    packs = written(df.select("t", "x").mapInArrow(packed, ddl))
    left = packs.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    right = packs.toDF("block2", "n2", "t2", "x2", "there2")
    # of two blocks either may be the left one: as a hash has it, so that tasks get as many
    one = F.xxhash64("block").bitwiseXOR(F.xxhash64("block2")).bitwiseAND(F.lit(1)) == 0
    meets = F.when(one, F.col("block") <= F.col("block2")).otherwise(F.col("block") > F.col("block2"))
    each = left.join(right, meets).mapInArrow(valued, "i bigint, js array<bigint>, vs array<double>, ways array<boolean>")
    each = each.select("i", "js", "vs", F.explode("ways").alias("way")).select("i", "js", "way", F.posexplode("vs").alias("at", name))
    j = F.get("js", F.col("at"))
    return each.select(F.when(F.col("way"), F.col("i")).otherwise(j).alias("i"), F.when(F.col("way"), j).otherwise(F.col("i")).alias("j"), name)


def runs(t: pa.Array, t2: pa.Array, v: np.ndarray, void: np.ndarray, wanted: np.ndarray, both: bool) -> Iterator[pa.RecordBatch]:
    """Rows (i, js, values, ways) of the wanted pairs, RUN of a row at most; ways: pairs are (i, j), and (j, i) where both."""
    ways = pa.array([[True, False] if both else [True]] * len(t), pa.list_(pa.bool_()))
    for at in range(0, len(t2), RUN):
        part = slice(at, at + RUN)
        keep = wanted[:, part]
        ends = pa.array(np.concatenate([[0], np.cumsum(keep.sum(1))]), pa.int32())
        js = t2.take(pa.array(at + np.nonzero(keep)[1]))
        vs = pa.array(v[:, part][keep], mask=void[:, part][keep] if void.any() else None)
        yield pa.RecordBatch.from_arrays([t, pa.ListArray.from_arrays(ends, js), pa.ListArray.from_arrays(ends, vs), ways], names=["i", "js", "vs", "ways"])
