"""Bounded regimes of one series of any length.

Rows are numbered and CHUNK consecutive ones are packed into one row of a table,
which every pass reads without a shuffle. A pass reduces each pack to a small
matrix or to sums; neighbours' matrices compose by GROUP in tasks, and the
driver sees one for each GROUP chunks. What a fit needs of the data it asks for
by requests, so fits of several starts share every pass.
"""

from __future__ import annotations

from collections.abc import Callable, Generator, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.operators import core, paths
from driftlens.sources import frames
from driftlens.sources.store import workers_know, written

#: Chunks whose matrices compose in one task.
GROUP = 1024
_REDUCED = "job int, grp long, chunk long, m array<double>, turns array<double>"
_TYPES = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()), "array<array<double>>": pa.list_(pa.list_(pa.float64()))}


class LongFamily:
    """What a regime model does with a block of rows [chunk's rows by features]."""

    #: Whether parameters come before weights: then the first weights are random.
    weights_first = True

    def costs(self, parameters: object, block: np.ndarray) -> np.ndarray:
        """Costs of rows in each component (rows by k)."""
        raise NotImplementedError

    def sums(self, block: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """What update needs, as sums over rows."""
        raise NotImplementedError

    def update(self, parameters: object, sums: np.ndarray) -> object:
        """Parameters of least cost."""
        raise NotImplementedError


class LongCenters(LongFamily):
    """Components are points; blocks are x."""

    def costs(self, parameters: np.ndarray, block: np.ndarray) -> np.ndarray:
        return np.stack([((block - c) ** 2).sum(1) for c in parameters], 1)

    def sums(self, block: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        return gamma.T @ np.hstack([block, np.ones((len(block), 1))])

    def update(self, parameters: np.ndarray, sums: np.ndarray) -> np.ndarray:
        mass = sums[:, -1:]
        return np.where(mass > 0, sums[:, :-1] / np.where(mass > 0, mass, 1), parameters)


class LongAutoregressions(LongFamily):
    """Components are autoregressions with memories of their own; blocks are [1, lags of x, u, x].

    sums are the products of all columns weighted by each component: k
    regressions out of one pass.
    """

    weights_first = False

    def __init__(self, memories: Sequence[int], d: int, m: int):
        self.memories, self.d, self.m, self.longest = list(memories), d, m, max(memories)

    def _own(self, p: int) -> np.ndarray:
        """The columns of a component's design."""
        u = 1 + self.longest * self.d
        return np.concatenate([np.arange(1 + p * self.d), np.arange(u, u + self.m)]).astype(int)

    def costs(self, parameters: list[core.Autoregression], block: np.ndarray) -> np.ndarray:
        y = block[:, -self.d :]
        return np.stack([((y - block[:, self._own(p)] @ a.coefficients) ** 2).sum(1) for p, a in zip(self.memories, parameters, strict=True)], 1)

    def sums(self, block: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        return np.stack([(block * g[:, None]).T @ block for g in gamma.T])

    def update(self, parameters: object, sums: np.ndarray) -> list[core.Autoregression]:
        out = []
        for p, gram in zip(self.memories, sums, strict=True):
            own = np.concatenate([self._own(p), np.arange(len(gram) - self.d, len(gram))])
            total = gram[0, 0]
            part = core.from_gram(gram[np.ix_(own, own)], self.d, 1 + len(own), p, self.m, 0, True, self.m > 0)
            if part.sigma is not None:  # from_gram divides by rows less columns; here by the weight less 1
                part.sigma = part.sigma * (1 + len(own) - (len(own) - self.d)) / (total - 1) if total > 1 else None
            out.append(part)
        return out


class Passes:
    """A packed series and the passes over it."""

    def __init__(self, rows: DataFrame, family: LongFamily, k: int, column: str = "x"):
        """rows(place, column), place counting rows from 0."""
        workers_know(rows.sparkSession)
        self.family, self.k = family, k
        chunk = F.floor(F.col("place") / frames.CHUNK)
        chunked = rows.select(chunk.alias("chunk"), "place", F.col(column).alias("v"))
        self.packs = written(chunked.groupBy("chunk").applyInArrow(_pack, "chunk long, n int, v binary"))
        n, size = self.packs.select("n", F.length("v")).first()
        self.width = size // 8 // n

    def _map(self, run: Callable[[dict, np.ndarray], Iterator[tuple]], ddl: str, packs: DataFrame | None = None) -> DataFrame:
        """ddl rows of run(pack, its block) for each pack."""
        schema = pa.schema([(n, _TYPES[t]) for n, t in (c.split() for c in ddl.split(", "))])

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = np.frombuffer(row.pop("v"), float).reshape(row["n"], -1)
                    made = list(run(row, block))
                    if made:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made), schema)], schema=schema)

        return (packs or self.packs).mapInArrow(each, ddl)

    def summed(self, jobs: Sequence[object], of: Callable[[object, dict, np.ndarray], np.ndarray], packs: DataFrame | None = None) -> list[np.ndarray]:
        """For each job the sum of of(job, row, block) over all packs."""

        def run(row: dict, block: np.ndarray) -> Iterator[tuple]:
            for j, job in enumerate(jobs):
                value = of(job, row, block)
                yield j, list(value.shape), value.ravel().tolist()

        made = self._map(run, "job int, shape array<long>, v array<double>", packs)
        rows = made.select("job", "shape", F.posexplode("v").alias("i", "v")).groupBy("job", "shape", "i").agg(F.sum("v").alias("v")).orderBy("job", "i").collect()
        return [np.array([r.v for r in rows if r.job == j]).reshape(next(list(r.shape) for r in rows if r.job == j)) for j in range(len(jobs))]

    def rows(self, of: Callable[[dict, np.ndarray], np.ndarray], name: str, packs: DataFrame | None = None) -> DataFrame:
        """(place, name): the vectors of(row, block), one for each row of the series."""
        size = frames.CHUNK

        def run(row: dict, block: np.ndarray) -> Iterator[tuple]:
            yield row["chunk"] * size, of(row, block).tolist()

        made = self._map(run, "first long, v array<array<double>>", packs).select("first", F.posexplode("v").alias("at", name))
        return made.select((F.col("first") + F.col("at")).alias("place"), name)

    def reduced(self, jobs: Sequence[tuple[object, np.ndarray]]) -> DataFrame:
        """_REDUCED: the matrix of each chunk for each (parameters, toll)."""
        family = self.family

        def run(row: dict, block: np.ndarray) -> Iterator[tuple]:
            for j, (parameters, toll) in enumerate(jobs):
                m, turns = paths.reduced(family.costs(parameters, block), toll, row["chunk"] == 0)
                yield j, row["chunk"] // GROUP, row["chunk"], m.ravel().tolist(), turns.ravel().tolist()

        return self._map(run, _REDUCED)

    def _groups(self, reduced: DataFrame) -> dict[int, list[tuple[int, paths.Reduced]]]:
        """By job the matrices of GROUP chunks each, in order."""
        k = self.k

        def compose(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("chunk")
            m, turns = paths.composed([_reduced(r, k) for r in rows.itertuples()])
            return pd.DataFrame([(rows.job.iloc[0], rows.grp.iloc[0], rows.chunk.iloc[0], m.ravel(), turns.ravel())], columns=rows.columns)

        out: dict[int, list] = {}
        for r in reduced.groupBy("job", "grp").applyInPandas(compose, _REDUCED).orderBy("job", "grp").collect():
            out.setdefault(r.job, []).append((r.grp, _reduced(r, k)))
        return out

    def priced(self, jobs: Sequence[tuple[object, np.ndarray]]) -> list[tuple[float, np.ndarray]]:
        """For each (parameters, toll) the cost, without tolls, and the turns of the cheapest path."""
        out = []
        for j, groups in sorted(self._groups(self.reduced(jobs)).items()):
            m, turns = paths.composed([g for _, g in groups])
            last = int(m[0].argmin())
            out.append((float(m[0, last] - jobs[j][1] @ turns[0, last]), turns[0, last]))
        return out

    def with_ends(self, jobs: Sequence[tuple[object, np.ndarray]]) -> DataFrame:
        """The packs with ends: (job, label before the chunk, its last label) of each job's cheapest path."""
        k, reduced = self.k, written(self.reduced(jobs))
        known = []
        for j, groups in self._groups(reduced).items():
            each = [g for _, g in groups]
            last = int(paths.composed(each)[0][0].argmin())
            known += [(j, grp, a, b) for (grp, _), (a, b) in zip(groups, paths.ends(each, 0, last))]
        bounds = reduced.sparkSession.createDataFrame(known, "job int, grp long, entry int, last int")

        def ends(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("chunk")
            found = paths.ends([_reduced(r, k) for r in rows.itertuples()], int(rows.entry.iloc[0]), int(rows["last"].iloc[0]))
            return pd.DataFrame({"chunk": rows.chunk, "job": rows.job, "entry": [a for a, _ in found], "last": [b for _, b in found]})

        each = reduced.join(bounds, ["job", "grp"]).groupBy("job", "grp").applyInPandas(ends, "chunk long, job int, entry int, last int")
        each = each.groupBy("chunk").agg(F.collect_list(F.struct("job", "entry", "last")).alias("ends"))
        return self.packs.join(each, "chunk")

    def weights(self, mixtures: Sequence[tuple[object, list[tuple[np.ndarray | int, float]] | None]]) -> tuple[Callable[[int, dict, np.ndarray], np.ndarray], DataFrame]:
        """(gamma(number of a mixture, row, block), packs) of mixtures (parameters, [(toll of a path or the label of a constant one, share)] or None for the nearest components)."""
        family, k = self.family, self.k
        asked = [(j, s, p, toll, share) for j, (p, each) in enumerate(mixtures) for s, (toll, share) in enumerate(each or [])]
        tolls = [(j, s, p, toll) for j, s, p, toll, _ in asked if not isinstance(toll, int)]
        place = {(j, s): at for at, (j, s, *_) in enumerate(tolls)}
        packs = self.with_ends([(p, toll) for _, _, p, toll in tolls]) if tolls else self.packs

        def gamma(job: int, row: dict, block: np.ndarray) -> np.ndarray:
            parameters, each = mixtures[job]
            costs = family.costs(parameters, block)
            if each is None:
                return np.eye(k)[costs.argmin(1)]
            ends, out = {e["job"]: e for e in row.get("ends") or []}, np.zeros((len(block), k))
            for s, (toll, share) in enumerate(each):
                if isinstance(toll, int):
                    out[:, toll] += share
                else:
                    e = ends[place[job, s]]
                    out[np.arange(len(block)), paths.path(costs, toll, e["entry"], e["last"], row["chunk"] == 0)] += share
            return out / out.sum(1, keepdims=True)

        return gamma, packs


def _pack(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("place")
    v = np.ascontiguousarray(rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False), float)
    return pa.table({"chunk": rows["chunk"][:1], "n": pa.array([rows.num_rows], pa.int32()), "v": pa.array([v.tobytes()], pa.binary())})


def _reduced(row: object, k: int) -> paths.Reduced:
    return np.array(row.m).reshape(k, k), np.array(row.turns).reshape(k, k, k)


#: A fit asks ("first", seed), ("constant", parameters), ("price", (parameters, toll)) or ("weigh", (parameters, mixture)) and is sent the answer.
Fit = Generator[tuple[str, object], object, tuple[object, list[tuple[np.ndarray | int, float]] | None, core.Trace]]


def fit(family: LongFamily, start: object, k: int, bound: float | None, tolerance: float, max_iterations: int, seed: int, progress: core.Progress | None = None) -> Fit:
    """The alternation of core.fit_regimes: (parameters, mixture of paths, trace)."""
    trace, parameters, mixture, sums = core.Trace(progress=progress), start, None, None
    for iteration in range(max_iterations):
        if not iteration and not family.weights_first:
            sums = yield "first", seed
        if iteration or not family.weights_first:
            parameters = family.update(parameters, sums)
        if bound is not None and bound >= 0 and k > 1:
            solve = core.mixture_of_paths(k, bound)
            next(solve)
            totals, tolls = (yield "constant", parameters), [None]
            answer: object = totals
            while True:
                try:
                    tolls.append(solve.send(answer))
                except StopIteration as end:
                    shares = end.value
                    break
                answer = yield "price", (parameters, tolls[-1])
            mixture = [(int(np.argmin(totals)) if tolls[c] is None else tolls[c], x) for c, x in shares]
        both = yield "weigh", (parameters, mixture)
        cost, sums = float(both[0].sum()), both[1]
        if trace.step(cost, tolerance, False):
            break
    return parameters, mixture, trace


def run(passes: Passes, fits: Sequence[Fit]) -> list[tuple[object, object, core.Trace]]:
    """Runs fits side by side: what they ask for at a time is answered by one pass for each kind of question."""
    family, k, done, asked = passes.family, passes.k, {}, {}

    def go(j: int, answer: object) -> None:
        try:
            asked[j] = fits[j].send(answer)
        except StopIteration as end:
            done[j] = end.value
            asked.pop(j, None)

    def random(seed: int, row: dict, block: np.ndarray) -> np.ndarray:
        g = np.random.default_rng([seed, row["chunk"]]).uniform(size=(len(block), k))
        return family.sums(block, g / g.sum(1, keepdims=True))

    for j in range(len(fits)):
        go(j, None)
    while asked:
        kind = sorted({q for q, _ in asked.values()})[0]
        some = [j for j, (q, _) in asked.items() if q == kind]
        jobs = [asked[j][1] for j in some]
        if kind == "constant":
            answers = passes.summed(jobs, lambda p, row, block: family.costs(p, block).sum(0))
        elif kind == "first":
            answers = passes.summed(jobs, random)
        elif kind == "price":
            answers = passes.priced(jobs)
        else:
            gamma, packs = passes.weights(jobs)
            parameters = [p for p, _ in jobs]

            def both(j: int, row: dict, block: np.ndarray, gamma: Callable = gamma, parameters: list = parameters) -> np.ndarray:
                g = gamma(j, row, block)
                return np.concatenate([(g * family.costs(parameters[j], block)).sum(0), family.sums(block, g).ravel()])

            packs = written(packs) if packs is not passes.packs else packs
            shapes = family.sums(np.zeros((0, passes.width)), np.zeros((0, k))).shape
            answers = [(v[:k], v[k:].reshape(shapes)) for v in passes.summed(list(range(len(jobs))), both, packs)]
        for j, answer in zip(some, answers, strict=True):
            go(j, answer)
    return [done[j] for j in range(len(fits))]


def coded(passes: Passes, parameters: object, mixture: object) -> DataFrame:
    """(place, gamma) of all rows."""
    gamma, packs = passes.weights([(parameters, mixture)])
    return passes.rows(lambda row, block: gamma(0, row, block), "gamma", packs)
