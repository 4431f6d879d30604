"""Convex codings and archetypes of one series of any length.

CHUNK consecutive rows are one row of a table of packs, which holds their arrays
(x, weights, directions). An iteration is a pass over packs that gives the next
packs and sums of products; the costs along a direction are quadratics of these
sums, so line searches need no further pass. Where weights look at other rows
(the Markov mixture), a pack also gets the last rows before it and the first
after it, from the borders that every pack keeps beside its arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.operators import core, spg
from driftlens.sources import frames
from driftlens.sources.store import workers_know, written

Arrays = dict[str, np.ndarray]
#: Borders of more packs than these are joined by a shuffle, not broadcast.
FEW = 1 << 15


def packed(rows: DataFrame, columns: Sequence[str], size: int) -> DataFrame:
    """(chunk, n, columns: arrays as bytes) of rows(place, columns of vectors), written."""
    names = list(columns)

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        arrays = [np.ascontiguousarray(t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False), float).tobytes() for c in names]
        return pa.table({"chunk": t["chunk"][:1], "n": pa.array([t.num_rows], pa.int32()), **{c: pa.array([b], pa.binary()) for c, b in zip(names, arrays)}})

    workers_know(rows.sparkSession)
    chunked = rows.select(F.floor(F.col("place") / size).alias("chunk"), "place", *names)
    return written(chunked.groupBy("chunk").applyInArrow(pack, "chunk long, n int, " + ", ".join(f"{c} binary" for c in names)))


#: Arrays that are not of a pack's own rows.
_EDGES = ("head", "tail", "before", "after")


def _arrays(row: dict) -> Arrays:
    return {c: np.frombuffer(v, float) if c in _EDGES else np.frombuffer(v, float).reshape(row["n"], -1) for c, v in row.items() if isinstance(v, bytes)}


def _mapped(packs: DataFrame, run: Callable[[int, Arrays], dict[str, object]], schema: pa.Schema, ddl: str) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                made = run(row["chunk"], _arrays(row)) | {"chunk": row["chunk"], "n": row["n"]}
                yield pa.RecordBatch.from_arrays([pa.array([made[f.name]], f.type) for f in schema], schema=schema)

    return packs.mapInArrow(each, ddl)


def summed(packs: DataFrame, of: Callable[[int, Arrays], Sequence[np.ndarray]]) -> np.ndarray:
    """The sum over packs of arrays, all in one row of numbers."""
    schema = pa.schema([("sums", pa.list_(pa.float64()))])
    made = _mapped(packs, lambda chunk, a: {"sums": np.concatenate([np.ravel(s) for s in of(chunk, a)])}, schema, "sums array<double>")
    return _total(made)


def _total(made: DataFrame) -> np.ndarray:
    rows = made.select(F.posexplode("sums").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    return np.array([r.v for r in rows])


def advanced(packs: DataFrame, of: Callable[[int, Arrays], tuple[Arrays, Sequence[np.ndarray]]], names: Sequence[str]) -> tuple[DataFrame, np.ndarray]:
    """The next packs, written, and the sums that of(chunk, arrays) gives beside them."""
    schema = pa.schema([("chunk", pa.int64()), ("n", pa.int32()), *((c, pa.binary()) for c in names), ("sums", pa.list_(pa.float64()))])

    def run(chunk: int, a: Arrays) -> dict[str, object]:
        arrays, sums = of(chunk, a)
        return {**{c: np.ascontiguousarray(arrays[c], float).tobytes() for c in names}, "sums": np.concatenate([np.ravel(s) for s in sums])}

    made = written(_mapped(packs, run, schema, "chunk long, n int, " + ", ".join(f"{c} binary" for c in names) + ", sums array<double>"))
    return made.drop("sums"), _total(made)


def _split(flat: np.ndarray, *shapes: tuple[int, ...]) -> list[np.ndarray]:
    out, at = [], 0
    for s in shapes:
        size = int(np.prod(s))
        out.append(flat[at : at + size].reshape(s))
        at += size
    return out


def _step(block: core.Block, cost: float, slope: float, bend: float, dd: float) -> float:
    """The length of a step where the cost is a quadratic along the direction."""
    block.memory = [*block.memory, cost][-block.size :]
    step, _ = spg.line_search(spg.parabola(cost, slope, bend), slope, block.memory)
    block.alpha = spg.spectral_length(step * step * dd, 2 * step * step * bend)
    return step


class LongCoding(NamedTuple):
    """Rows with their weights gamma, states, costs, and the mixture where there is one."""

    rows: DataFrame
    states: np.ndarray
    costs: list[float]
    order_weights: np.ndarray | None = None
    transitions: np.ndarray | None = None


class LongArchetypes(NamedTuple):
    """Rows with their weights gamma and their shares c in each archetype, states, costs, scales."""

    rows: DataFrame
    states: np.ndarray
    costs: list[float]
    scales: np.ndarray


def rows_of(packs: DataFrame, size: int, of: Callable[[Arrays], Arrays], names: Sequence[str]) -> DataFrame:
    """(place, names: vectors) of all rows; of(arrays) gives the arrays."""
    vectors = pa.list_(pa.list_(pa.float64()))
    schema = pa.schema([("chunk", pa.int64()), *((c, vectors) for c in names)])
    made = _mapped(packs, lambda chunk, a: {c: v.tolist() for c, v in of(a).items()}, schema, "chunk long, " + ", ".join(f"{c} array<array<double>>" for c in names))
    out = made.select("chunk", F.posexplode(F.arrays_zip(*names)).alias("at", "r"))
    return out.select((F.col("chunk") * size + F.col("at")).alias("place"), *[F.col(f"r.{c}").alias(c) for c in names])


def _with_borders(packs: DataFrame) -> DataFrame:
    """packs with `before` (tail of the pack before) and `after` (head of the next); null at the ends."""
    few = packs.count() <= FEW
    for column, shift, name in (("tail", 1, "before"), ("head", -1, "after")):
        border = packs.select((F.col("chunk") + shift).alias("chunk"), F.col(column).alias(name))
        packs = packs.join(F.broadcast(border) if few else border, "chunk", "left")
    return packs


def _penalty(moments: np.ndarray, w: np.ndarray, t: np.ndarray) -> float:
    """The sum of squared residuals of a mixture, from the products of [gamma, lags of gamma]."""
    co = np.hstack([np.eye(t.shape[1]), *(-a * b for a, b in zip(w, t, strict=True))])
    return float(np.trace(co @ moments @ co.T))


def fit_coding(
    rows: DataFrame, n: int, d: int, states: np.ndarray, epsilon: float, lags: Sequence[int], epsilon_weights: float, mixture: tuple[np.ndarray, np.ndarray] | None,
    tolerance: float, max_iterations: int, update: Sequence[str], monotonic: bool, memory: int, progress: core.Progress | None = None,
) -> LongCoding:
    """The alternation of core.fit_coding over rows(place, x, gamma): one pass for each iteration."""
    k, m, lags, c = len(states), max(lags, default=0), list(lags), 1 / (n * d)
    size, parts, mixed = max(frames.CHUNK, 2 * m), 1 + len(lags), bool(lags) and n > m and k > 1
    w, t = mixture or (None, None)
    weight = epsilon_weights / (k * max(1, n - m))
    blocks, trace = {b: core.Block(memory) for b in ("states", "weights", "parameters")}, core.Trace(progress=progress)

    def one_pass(packs: DataFrame, before: float, length: float, states: np.ndarray, w: np.ndarray | None, t: np.ndarray | None) -> tuple[DataFrame, list[np.ndarray]]:
        """gamma advanced by `before` times its direction, the next direction of this length, and the sums of both."""

        def of(chunk: int, a: Arrays) -> tuple[Arrays, Sequence[np.ndarray]]:
            own = a["gamma"] + before * a["d"] if "d" in a else a["gamma"]
            x, gamma, ahead = a["x"], own, np.zeros((0, k))
            if "before" in a:  # 2 m rows: their directions are right from the middle on, which is as far as lags reach
                gamma_b, d_b, x_b = np.split(a["before"].reshape(2 * m, -1), [k, 2 * k], axis=1)
                x, gamma = np.vstack([x_b, x]), np.vstack([gamma_b + before * d_b, own])
            if "after" in a:
                gamma_a, d_a = np.split(a["after"].reshape(-1, 2 * k), 2, axis=1)
                ahead = gamma_a + before * d_a
            gradient = 2 * c * (gamma @ (states @ states.T) - x @ states.T)
            if mixed:
                wide = np.vstack([gamma, ahead])
                gradient += core.mtd_penalty_gradient(wide, w, t, lags, epsilon_weights * max(0, len(wide) - m) / (n - m))[: len(gamma)]
            direction = core.project_rows(gamma - length * gradient) - gamma
            at = len(gamma) - len(own)
            here = np.arange(max(at, m), len(gamma))
            lagged = np.hstack([v[here - lag] for v in (gamma, direction) for lag in (0, *lags)])
            both = np.hstack([own, direction[at:]])
            sums = [np.array([(a["x"] ** 2).sum(), (gradient[at:] * direction[at:]).sum()]), both.T @ a["x"], both.T @ both, lagged.T @ lagged]
            edge = np.hstack([both, a["x"]])
            return {"x": a["x"], "gamma": own, "d": direction[at:], "head": both[:m], "tail": edge[len(edge) - min(2 * m, len(edge)) :]}, sums

        packs, flat = advanced(packs, of, ["x", "gamma", "d", "head", "tail"])
        return packs, _split(flat, (2,), (2 * k, d), (2 * k, 2 * k), (2 * parts * k, 2 * parts * k))

    def bordered(packs: DataFrame) -> DataFrame:
        return _with_borders(packs) if m else packs

    packs = packed(rows, ["x", "gamma"], size)
    if m:  # the first pass only makes borders
        packs, _ = one_pass(packs, 0.0, 0.0, states, w, t)
    packs, ((xx, _), bx, bb, mm) = one_pass(bordered(packs), 0.0, 0.0, states, w, t)
    gtx, gtg, moments, before = bx[:k], bb[:k, :k], mm[: parts * k, : parts * k], 0.0

    def cost() -> float:
        out = c * float(xx - 2 * (gtx * states).sum() + (gtg * (states @ states.T)).sum()) + core.pair_penalty(states, epsilon)
        return out + weight * _penalty(moments, w, t) if mixed else out

    trace.step(cost(), tolerance, monotonic)
    for _ in range(max_iterations):
        if "states" in update:
            gradient = core.pair_penalty_gradient(states, epsilon) + 2 * c * (gtg @ states - gtx)
            states = blocks["states"].quadratic(states, gradient, lambda z: z, cost(), lambda v, g=gtg: c * (g * (v @ v.T)).sum() + core.pair_penalty(v, epsilon))
        if "weights" in update and k > 1:
            packs, ((_, slope), bx, bb, mm) = one_pass(bordered(packs), before, blocks["weights"].alpha, states, w, t)
            q = parts * k
            bend = c * float((bb[k:, k:] * (states @ states.T)).sum()) + (weight * _penalty(mm[q:, q:], w, t) if mixed else 0.0)
            before = _step(blocks["weights"], cost(), float(slope), bend, float(np.trace(bb[k:, k:])))
            gtx = bx[:k] + before * bx[k:]
            gtg = bb[:k, :k] + before * (bb[:k, k:] + bb[k:, :k]) + before**2 * bb[k:, k:]
            moments = mm[:q, :q] + before * (mm[:q, q:] + mm[q:, :q]) + before**2 * mm[q:, q:]
        if "parameters" in update and mixed:
            by_lag = {(a, b): moments[i * k : (i + 1) * k, j * k : (j + 1) * k] for i, a in enumerate((0, *lags)) for j, b in enumerate((0, *lags))}
            w, t, _ = core.fit_mtd_parameters(by_lag, lags, n, w, t, blocks["parameters"], max(epsilon_weights, 1e-300))
        if trace.step(cost(), tolerance, monotonic):
            break
    return LongCoding(rows_of(packs, size, lambda a: {"gamma": a["gamma"] + before * a["d"]}, ["gamma"]), states, trace.costs, w, t)


def _thresholds(packs: DataFrame, alpha: float, g: np.ndarray, start: np.ndarray, rounds: int = 200) -> np.ndarray:
    """What to take from all entries of each component of c - alpha x g' for it to lie on the simplex across rows: Newton's method, a pass for each step."""
    k, theta = len(g), start
    for _ in range(rounds):

        def of(chunk: int, a: Arrays, theta: np.ndarray = theta) -> Sequence[np.ndarray]:
            u = a["c"] - alpha * (a["x"] @ g.T)
            return [np.maximum(u - theta, 0).sum(0), (u > theta).sum(0), u.sum(0), np.full(k, len(u))]

        over, above, total, n = summed(packs, of).reshape(4, k)
        now = np.where(above > 0, theta + (over - 1) / np.maximum(above, 1), (total - 1) / n)
        if np.allclose(now, theta, rtol=0, atol=1e-14):
            return now
        theta = now
    raise RuntimeError(f"thresholds of the simplex are not found within {rounds} rounds")


def fit_archetypes(
    rows: DataFrame, d: int, k: int, delta: float, tolerance: float, max_iterations: int, update: Sequence[str], monotonic: bool, memory: int, progress: core.Progress | None = None,
) -> LongArchetypes:
    """The alternation of core.fit_archetypes over rows(place, x, gamma, c), with linear products. c is a row's share in each archetype.

    The projection of the dictionary is across rows: its thresholds take a few
    passes, begun at those of the iteration before; then there is one pass for
    its direction and one for that of the weights.
    """
    size, scales = frames.CHUNK, np.ones(k)
    blocks, trace = {b: core.Block(memory) for b in ("dictionary", "weights")}, core.Trace(progress=progress)
    packs = packed(rows, ["x", "gamma", "c"], size)
    (xx,), stx, sts, cx = _split(summed(packs, lambda _, a: [(a["x"] ** 2).sum(), a["gamma"].T @ a["x"], a["gamma"].T @ a["gamma"], a["c"].T @ a["x"]]), (1,), (k, d), (k, k), (k, d))
    theta, before = np.zeros(k), 0.0

    def cost() -> float:
        z = scales[:, None] * cx
        return float(xx - 2 * (stx * z).sum() + (sts * (z @ z.T)).sum())

    trace.step(cost(), tolerance, monotonic)
    for _ in range(max_iterations):
        alpha, g, took = blocks["dictionary"].alpha, scales[:, None] * 2 * (sts @ (scales[:, None] * cx) - stx), 0.0
        if "dictionary" in update:
            theta = _thresholds(packs, alpha, g, theta)

            def moved(a: Arrays, alpha: float = alpha, g: np.ndarray = g, theta: np.ndarray = theta) -> np.ndarray:
                return np.maximum(a["c"] - alpha * (a["x"] @ g.T) - theta, 0) - a["c"]

            def along(_: int, a: Arrays, g: np.ndarray = g, moved: Callable[[Arrays], np.ndarray] = moved) -> Sequence[np.ndarray]:
                move = moved(a)
                return [((a["x"] @ g.T) * move).sum(), (move * move).sum(), move.T @ a["x"]]

            (slope, dd), dx = _split(summed(packs, along), (2,), (k, d))
            scaled = scales[:, None] * dx
            took = _step(blocks["dictionary"], cost(), slope, float((sts * (scaled @ scaled.T)).sum()), dd)
            cx = cx + took * dx
            if delta > 0:
                gram = cx @ cx.T
                for i in range(k):
                    weight = sts[i, i] * gram[i, i]
                    if weight > 0:
                        left = stx[i] @ cx[i] - sum(sts[i, j] * scales[j] * gram[i, j] for j in range(k) if j != i)
                        scales[i] = np.clip(left / weight, 1 - delta, 1 + delta)
        z, length = scales[:, None] * cx, blocks["weights"].alpha if "weights" in update else 0.0

        def on(_: int, a: Arrays, z: np.ndarray = z, length: float = length, took: float = took, before: float = before, moved: Callable[[Arrays], np.ndarray] | None = moved if took else None) -> tuple[Arrays, Sequence[np.ndarray]]:
            gamma = a["gamma"] + before * a["e"] if "e" in a else a["gamma"]
            gradient = 2 * (gamma @ (z @ z.T) - a["x"] @ z.T)
            e = core.project_rows(gamma - length * gradient) - gamma
            both = np.hstack([gamma, e])
            c = a["c"] + took * moved(a) if moved else a["c"]
            return {"x": a["x"], "gamma": gamma, "e": e, "c": c}, [(gradient * e).sum(), both.T @ both, both.T @ a["x"]]

        packs, flat = advanced(packs, on, ["x", "gamma", "e", "c"])
        (slope,), bb, bx = _split(flat, (1,), (2 * k, 2 * k), (2 * k, d))
        before = 0.0
        if "weights" in update:
            before = _step(blocks["weights"], cost(), float(slope), float((bb[k:, k:] * (z @ z.T)).sum()), float(np.trace(bb[k:, k:])))
            sts = bb[:k, :k] + before * (bb[:k, k:] + bb[k:, :k]) + before**2 * bb[k:, k:]
            stx = bx[:k] + before * bx[k:]
        if trace.step(cost(), tolerance, monotonic):
            break
    out = rows_of(packs, size, lambda a: {"gamma": a["gamma"] + before * a["e"], "c": a["c"]}, ["gamma", "c"])
    return LongArchetypes(out, scales[:, None] * cx, trace.costs, scales)
