"""Hard negatives by dual-tree search over anchors and candidates.

The top of the trees is one for both: splits along principal directions, fitted
on SAMPLE rows, by which every row finds its cell. Rows of a cell form blocks of
bounded size (a large cell has many), each a tree of its own: rows are ordered by
median splits, and the nodes of a level are equal ranges of them with a box and a
ball around them. For two nodes these bound all inner products of their rows.

A search asks, for each anchor, for the K best candidates with scores within one
or more ranges. First every anchor block meets one candidate block of its cell;
the K-th best score found there raises the lower end of the range. Then pairs of
cells, of blocks and, in a task, of nodes are pruned where their interval misses
the ranges of all anchors of the node; pairs of leaves that are left are scored
exactly. The first search finds positives, the second negatives in the ranges
that the positives set. No pair within the ranges is lost, whatever the sample.

Defined cases: rows with a null id, label or vector, or with a component that is
null, not finite or beyond LARGEST once scaled, take no part; of rows that share
an id the smallest (label, vector) counts; a shorter vector ends in zeros; an
anchor without other rows of its label has no rows, and a positive of negative
score, or without rows in its range, has none; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.llm.common import table, workers_know, written

SCALE, LARGEST = 256, 1 << 26
ANCHOR, MOVED, CLASSES = 100, 7, 10
POSITIVES, NEGATIVES, LOW, HIGH = 5, 10, 30, 90
#: Rows that the splits are fitted on, and numbers in them (64 rows at least), the most cells, rows of a block of each kind (about), rows of a leaf of each kind, anchor blocks that meet a candidate block in one group (about).
SAMPLE, SAMPLE_NUMBERS, CELLS, CANDIDATE_BLOCK, ANCHOR_BLOCK, CANDIDATE_LEAF, ANCHOR_LEAF, MEET = 8192, 1 << 20, 256, 4096, 256, 32, 8, 64
_END = 1 << 62
_SHAPE = "center array<double>, half array<double>, radius double, low long, high long"
_BLOCK = f"block long, cell int, ids binary, labels binary, vectors binary, lows binary, highs binary, {_SHAPE}"
_FOUND = "anchor_id long, q int, other long, score long"


def scaled(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v: integer components) of the rows that take part, one for each id."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.transform("embedding", lambda x: F.floor(SCALE * x.cast("double"))).alias("v"), "embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(SCALE * x.cast("double")) > LARGEST))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad)
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label"))
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v").withColumn("label", label)


def splits(sample: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Directions and thresholds of a complete binary tree with this many leaves, a power of two; node k has the children 2 k + 1 and 2 k + 2."""
    directions, at, members = np.zeros((cells - 1, sample.shape[1])), np.zeros(cells - 1), {0: sample}
    for k in range(cells - 1):
        x = members.pop(k)
        if len(x) > 1:
            directions[k] = np.linalg.svd(x - x.mean(0), full_matrices=False)[2][0]
            at[k] = np.median(x @ directions[k])
        right = x @ directions[k] > at[k]
        members[2 * k + 1], members[2 * k + 2] = x[~right], x[right]
    return directions, at


def cells_of(v: np.ndarray, directions: np.ndarray, at: np.ndarray) -> np.ndarray:
    k = np.zeros(len(v), np.int64)
    for _ in range(int(len(at) + 1).bit_length() - 1):
        k = 2 * k + 1 + (np.einsum("nd,nd->n", v, directions[k]) > at[k])
    return k - len(at)


def _padded(v: pa.ListArray, width: int) -> np.ndarray:
    lengths = np.diff(v.offsets.to_numpy())
    out = np.zeros((len(v), width), np.int32)
    out[np.arange(width) < lengths[:, None]] = v.flatten().to_numpy()
    return out


def _in_cells(width: int, tree: tuple[np.ndarray, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _padded(b.column(2), width)
            cells = pa.array(cells_of(v.astype(float), *tree), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.tobytes() for x in v], pa.binary()), cells], ["vec_id", "label", "v", "cell"])

    return run


def in_cells(rows: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, v: 32-bit components as bytes, cell) of all rows, written, and the number of components."""
    rows = written(rows, "scaled")
    n, width = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(SAMPLE, max(64, SAMPLE_NUMBERS // width))).select("v").collect()
    sample = [list(r.v) + [0] * (width - len(r.v)) for r in some]
    cells = min(CELLS, 1 << max(0, -(-n // CANDIDATE_BLOCK) - 1).bit_length())
    tree = splits(np.array(sample, float).reshape(-1, width), cells)
    workers_know(rows.sparkSession)
    return written(rows.mapInArrow(_in_cells(width, tree), "vec_id long, label int, v binary, cell int"), "cells"), width


def order(v: np.ndarray, leaf: int) -> np.ndarray:
    """Row numbers by median splits of the widest component, so that ranges of leaf * 2^k rows are nodes."""
    if len(v) <= leaf:
        return np.arange(len(v))
    left = leaf << ((-(-len(v) // leaf) - 1).bit_length() - 1)
    by = np.argsort(v[:, np.argmax(v.max(0) - v.min(0))], kind="stable")
    return np.concatenate([by[:left][order(v[by[:left]], leaf)], by[left:][order(v[by[left:]], leaf)]])


class Tree:
    """Rows in order, and for each level, leaves first, (center, half, radius, low, high, labels) of its nodes."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray, lows: np.ndarray, highs: np.ndarray, leaf: int):
        self.ids, self.labels, self.v, self.lows, self.highs, self.leaf = ids, labels, v.astype(float), lows, highs, leaf
        self.levels, size, mask = [], leaf, np.uint64(1) << (labels.astype(np.int64) % 64).astype(np.uint64)
        while True:
            starts = np.arange(0, len(ids), size)
            least, most = np.minimum.reduceat(self.v, starts), np.maximum.reduceat(self.v, starts)
            center = (least + most) / 2
            apart = self.v - np.repeat(center, np.diff([*starts, len(ids)]), axis=0)
            radius = np.sqrt(np.maximum.reduceat(np.einsum("nd,nd->n", apart, apart), starts)) * (1 + 1e-9)
            self.levels.append((center, (most - least) / 2, radius, np.minimum.reduceat(lows.min(1), starts), np.maximum.reduceat(highs.max(1), starts), np.bitwise_or.reduceat(mask, starts)))
            if len(starts) == 1:
                return
            size *= 2

    @classmethod
    def of(cls, row: pd.Series, leaf: int) -> Tree:
        ids, labels = np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int32)
        v, *ranges = (np.frombuffer(row[c], t).reshape(len(ids), -1) for c, t in (("vectors", np.int32), ("lows", np.int64), ("highs", np.int64)))
        return cls(ids, labels, v, *ranges, leaf)


def interval(a: tuple[np.ndarray, ...], b: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the inner products of rows within a[k] and b[k], from their boxes and their balls; a and b begin with center, half, radius."""
    dot = lambda x, y: np.einsum("nd,nd->n", x, y)
    middle, norms = dot(a[0], b[0]), [np.sqrt(dot(x[0], x[0])) for x in (a, b)]
    box = dot(np.abs(a[0]), b[1]) + dot(a[1], np.abs(b[0])) + dot(a[1], b[1])
    ball = norms[0] * b[2] + a[2] * norms[1] + a[2] * b[2]
    width = np.minimum(box, ball) * (1 + 1e-9) + 1e-6
    return middle - width, middle + width


def leaf_pairs(a: Tree, c: Tree, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of leaves of anchors a and candidates c that may hold scores within the anchors' ranges."""
    at, ct = len(a.levels) - 1, len(c.levels) - 1
    i, j = np.zeros(1, np.intp), np.zeros(1, np.intp)
    while True:
        x, y = [f[i] for f in a.levels[at]], [f[j] for f in c.levels[ct]]
        least, most = interval(x, y)
        keep = (most >= x[3]) & (least <= x[4])
        if same:
            keep &= x[5] & y[5] != 0
        i, j = i[keep], j[keep]
        if at == ct == 0 or not len(i):
            return i, j
        if ct >= at:
            ct -= 1
            i, j = np.concatenate([i, i]), np.concatenate([2 * j, 2 * j + 1])
            there = j < len(c.levels[ct][0])
        else:
            at -= 1
            i, j = np.concatenate([2 * i, 2 * i + 1]), np.concatenate([j, j])
            there = i < len(a.levels[at][0])
        i, j = i[there], j[there]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integers: in floating point where sums stay below 2^53."""
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 1 << 53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best(a: Tree, c: Tree, same: bool, k: int) -> list[tuple[np.ndarray, ...]]:
    """For each anchor and range the k best candidates (or fewer) of the same label, or of another one, as columns of _FOUND."""
    out, (leaves, others) = [], leaf_pairs(a, c, same)
    for leaf in np.unique(leaves):
        rows = (np.sort(others[leaves == leaf])[:, None] * c.leaf + np.arange(c.leaf)).ravel()
        rows = rows[rows < len(c.ids)]
        first = leaf * a.leaf
        scores = _products(a.v[first : first + a.leaf], c.v[rows])
        for n, mine in enumerate(scores, first):
            ok = ((c.labels[rows] == a.labels[n]) == same) & (c.ids[rows] != a.ids[n]) & (mine >= a.lows[n].min()) & (mine <= a.highs[n].max())
            found, ids = mine[ok], c.ids[rows[ok]]
            by = np.lexsort((ids, -found))
            found, ids = found[by], ids[by]
            for q, (low, high) in enumerate(zip(a.lows[n], a.highs[n])):
                begin = np.searchsorted(-found, -high)
                end = begin + np.count_nonzero(found[begin : begin + k] >= low)
                if end > begin:
                    out.append((np.full(end - begin, a.ids[n]), np.full(end - begin, q), ids[begin:end], found[begin:end]))
    return out


def _packed(leaf: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        v = np.stack([np.frombuffer(x, np.int32) for x in rows.v])
        by = order(v, leaf)
        rows, v = rows.iloc[by], v[by]
        columns = [rows.vec_id.to_numpy(np.int64), rows.label.to_numpy(np.int32), v, np.array(rows.lows.tolist(), np.int64), np.array(rows.highs.tolist(), np.int64)]
        center, half, radius, low, high, _ = (f[0] for f in Tree(*columns, leaf).levels[-1])
        return pd.DataFrame([(rows.block.iloc[0], rows.cell.iloc[0], *(c.tobytes() for c in columns), center, half, radius, low, high)], columns=[c.split()[0] for c in _BLOCK.split(", ")])

    return pack


def blocks(rows: DataFrame, size: int, leaf: int) -> DataFrame:
    """rows(vec_id, label, v, cell, lows, highs) as blocks of about size rows of one cell, written; see _BLOCK."""
    counts = {r.cell: -(-r.n // size) for r in rows.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    number = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in counts.items() for x in p)), F.col("cell")), F.lit(1)) if counts else F.lit(1)
    block = F.col("cell").cast("long") * (1 << 40) + F.pmod(F.xxhash64("vec_id"), number)
    return written(rows.withColumn("block", block).groupBy("block").applyInPandas(_packed(leaf), _BLOCK), "blocks")


def _meeting(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        a, c = ([np.stack(b[f"{s}_center"]), np.stack(b[f"{s}_half"]), b[f"{s}_radius"].to_numpy()] for s in "ac") if len(b) else ([], [])
        keep = np.zeros(0, bool)
        if len(b):
            least, most = interval(a, c)
            keep = (most >= b.a_low) & (least <= b.a_high)
        yield b.loc[keep, ["a", "c"]]


def _cell_shapes(blocks_: DataFrame) -> tuple[np.ndarray, tuple[np.ndarray, ...]]:
    """The cells of blocks and the shape of each, CELLS at most."""
    least, most = F.zip_with("center", "half", lambda x, h: x - h), F.zip_with("center", "half", lambda x, h: x + h)
    edges = blocks_.select("cell", "low", "high", F.posexplode(F.arrays_zip(least.alias("least"), most.alias("most"))).alias("d", "x"))
    rows = edges.groupBy("cell", "d").agg(F.min("x.least"), F.max("x.most"), F.min("low"), F.max("high")).orderBy("cell", "d").collect()
    cells = np.unique([r[0] for r in rows]).astype(int)
    x = np.array([r[2:4] for r in rows], float).reshape(len(cells), len(rows) // max(1, len(cells)), 2)
    half = (x[:, :, 1] - x[:, :, 0]) / 2
    low, high = (np.array([r[k] for r in rows if r[1] == 0], np.int64) for k in (4, 5))
    return cells, ((x[:, :, 0] + x[:, :, 1]) / 2, half, np.sqrt((half * half).sum(1)), low, high)


def meeting(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """(a, c): pairs of blocks that may hold scores within the anchors' ranges; first by cells, then by blocks."""
    (ac, a), (cc, c) = _cell_shapes(anchors), _cell_shapes(candidates)
    i, j = (x.ravel() for x in np.indices((len(ac), len(cc))))
    least, most = interval([f[i] for f in a[:3]], [f[j] for f in c[:3]])
    keep = (most >= a[3][i]) & (least <= a[4][i])
    cells = anchors.sparkSession.createDataFrame(list(zip(ac[i[keep]].tolist(), cc[j[keep]].tolist())), "a_cell int, c_cell int")
    shape = lambda s, rows: rows.select(F.col("block").alias(s), *[F.col(n).alias(f"{s}_{n}") for n in ("cell", "center", "half", "radius", "low", "high")])
    pairs = shape("a", anchors).join(F.broadcast(cells), "a_cell").join(shape("c", candidates), "c_cell")
    return pairs.select("a", "c", *[f"{s}_{n}" for s in "ac" for n in ("center", "half", "radius")], "a_low", "a_high").mapInPandas(_meeting, "a long, c long")


def _scored(same: bool, k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def score(anchors: pd.DataFrame, candidates: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, ...]] = []
        for _, c in candidates.iterrows():
            c = Tree.of(c, CANDIDATE_LEAF)
            for _, a in anchors.iterrows():
                found += best(Tree.of(a, ANCHOR_LEAF), c, same, k)
        columns = [np.concatenate(x) for x in zip(*found)] or [np.zeros(0, np.int64)] * 4
        return pd.DataFrame(dict(zip(["anchor_id", "q", "other", "score"], columns)))

    return score


def scores(pairs: DataFrame, anchors: DataFrame, candidates: DataFrame, same: bool, k: int) -> DataFrame:
    """_FOUND of pairs(a, c) of blocks, written. A candidate block is in one group with about MEET anchor blocks, and in several groups if it meets more."""
    pairs = written(pairs, "pairs")
    groups = pairs.groupBy("c").agg(F.ceil(F.count("*") / MEET).cast("int").alias("groups"))
    dealt = pairs.join(groups, "c").withColumn("g", F.pmod(F.xxhash64("a"), F.col("groups")).cast("int"))
    payload = ["ids", "labels", "vectors", "lows", "highs"]
    left = dealt.select("a", "c", "g").join(anchors.select(F.col("block").alias("a"), *payload), "a")
    right = candidates.select(F.col("block").alias("c"), *payload).join(dealt.select("c", F.col("g").alias("h")).distinct(), "c")
    return written(left.groupBy("c", "g").cogroup(right.groupBy("c", "h")).applyInPandas(_scored(same, k), _FOUND), "found")


def _first(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("anchor_id", "q").orderBy(F.desc("score"), "other"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(anchors: DataFrame, candidates: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor_id, q, other, score, rank): the k best candidates of blocks within each range of anchors(vec_id, label, v, cell, lows, highs), of the same label or of another one."""
    first = blocks(anchors, ANCHOR_BLOCK, ANCHOR_LEAF)
    near = candidates.groupBy("cell").agg(F.min("block").alias("c"))
    seeds = scores(first.select(F.col("block").alias("a"), "cell").join(near, "cell").select("a", "c"), first, candidates, same, k)
    least = _first(seeds, k).where(F.col("rank") == k).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("q", "score"))).alias("least"))
    raised = F.when(F.col("least").isNull(), F.col("lows")).otherwise(F.transform("lows", lambda x, q: F.greatest(x, F.coalesce(F.element_at("least", q), x))))
    known = anchors.join(least.withColumnRenamed("anchor_id", "vec_id"), "vec_id", "left").withColumn("lows", raised).drop("least")
    second = blocks(known, ANCHOR_BLOCK, ANCHOR_LEAF)
    seen = second.select(F.col("block").alias("a"), "cell").join(near, "cell").select("a", "c")
    rest = scores(meeting(second, candidates).join(seen, ["a", "c"], "left_anti"), second, candidates, same, k)
    return _first(seeds.unionByName(rest), k)


def _ranges(lows: Column, highs: Column) -> list[Column]:
    return [lows.cast("array<long>").alias("lows"), highs.cast("array<long>").alias("highs")]


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows, _ = in_cells(scaled(embeddings))
    every = _ranges(F.array(F.lit(-_END)), F.array(F.lit(_END)))
    candidates = blocks(rows.select("*", *every), CANDIDATE_BLOCK, CANDIDATE_LEAF)
    anchors = rows.where(F.col("vec_id") % ANCHOR == 0)
    positives = search(anchors.select("*", *every), candidates, True, POSITIVES).where("score >= 0")
    positives = written(positives.select("anchor_id", (F.col("rank") - 1).alias("q"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # an anchor's positives have the ranks 1 to n, so q is their place in the arrays
    of = positives.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.sort_array(F.collect_list(F.struct("q", "positive_score"))).alias("of"))
    percent = lambda part, more: F.transform("of", lambda x: F.call_function("div", x["positive_score"] * part + more, F.lit(100)))
    asked = written(anchors.join(of, "vec_id").select(*anchors.columns, *_ranges(percent(LOW, 99), percent(HIGH, 0))), "asked")
    width = F.lit(POSITIVES) - F.size("lows")
    none = lambda at: F.array_repeat(F.lit(at).cast("long"), width)
    asked = asked.select(*anchors.columns, F.concat("lows", none(_END)).alias("lows"), F.concat("highs", none(-_END)).alias("highs"))
    found = search(asked, candidates, False, NEGATIVES).join(positives, ["anchor_id", "q"])
    return found.select("anchor_id", "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS other, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM r a JOIN r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id
), p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
), n AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank,
    other AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM n WHERE rank <= 10
"""
