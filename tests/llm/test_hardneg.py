import math

import numpy as np
import pytest

from driftlens.llm import hardneg as H

DDL = "vec_id long, embedding array<float>, label int, q int, low long, cell int, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, 3, 4) for i, v, label in rows], DDL)


def brute(rows):
    known = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        v = [math.floor(256 * float(np.float32(x))) for x in v]
        known[i] = min(known.get(i, (label, v)), (label, v))
    known = {i: ((label + 1) % 10 if i % 7 == 0 else label, v) for i, (label, v) in known.items()}
    out = set()
    for a in (i for i in known if i % 100 == 0):
        scored = sorted((-sum(x * y for x, y in zip(known[a][1], v)), i) for i, (_, v) in known.items() if i != a)
        same = [(-s, i) for s, i in scored if known[i][0] == known[a][0]][:5]
        for p, positive in same:
            negatives = [(-s, i) for s, i in scored if known[i][0] != known[a][0] and 30 * p <= 100 * -s <= 90 * p]
            out |= {(a, positive, rank, i, p, s) for rank, (s, i) in enumerate(negatives[:10], 1)}
    return out


def rows_of(n, dims, seed, coarse=False):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dims))
    v = centers[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dims))
    v /= np.linalg.norm(v, axis=1)[:, None]
    if coarse:
        v = np.round(v * 4) / 4  # many ties
    return [(int(i), v[k].astype(np.float32).tolist(), int(rng.integers(0, 4))) for k, i in enumerate(rng.permutation(n))]


@pytest.mark.parametrize("coarse", [False, True])
def test_against_brute_force(spark, monkeypatch, coarse):
    for name, value in (("CANDIDATE_BLOCK", 150), ("ANCHOR_BLOCK", 4), ("CANDIDATE_LEAF", 4), ("ANCHOR_LEAF", 1), ("SAMPLE", 200), ("MEET", 2)):
        monkeypatch.setattr(H, name, value)
    rows = rows_of(1500, 8, 2, coarse)
    assert {tuple(r) for r in H.hard_negatives(frame(spark, rows)).collect()} == brute(rows)


def test_odd_rows(spark):
    rows = [*rows_of(300, 5, 1), (None, [1.0] * 5, 1), (1000, None, 1), (1001, [1.0, None, 1.0, 1.0, 1.0], 2), (1002, [math.nan] * 5, 1), (1100, [math.inf] * 5, 1), (1200, [0.5] * 5, None)]
    rows += rows[:40] + [(0, [0.1] * 5, 3), (1300, [], 2), (1400, [0.3, 0.2], 1)]
    got = [tuple(r) for r in H.hard_negatives(frame(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute([(i, v if v is None else [*v, *[0.0] * (5 - len(v))], k) for i, v, k in rows])
    assert H.hard_negatives(frame(spark, [])).count() == 0
    assert H.hard_negatives(frame(spark, [(100, [1.0], 1)])).count() == 0
    assert H.hard_negatives(frame(spark, [(100, [1.0], 1), (101, [1.0], 1)])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_intervals_hold_all_products_and_pruning_loses_none(seed):
    rng = np.random.default_rng(seed)
    make = lambda n, leaf, low: H.Tree(np.arange(n), rng.integers(0, 3, n).astype(np.int32), rng.integers(-200, 200, (n, 6)), np.full((n, 1), low), np.full((n, 1), 1 << 40), leaf)
    a, c = make(37, 4, 60_000), make(90, 8, 0)
    products = a.v @ c.v.T
    for level, (x, y) in enumerate(zip(a.levels, c.levels)):
        i, j = (k.ravel() for k in np.indices((len(x[0]), len(y[0]))))
        least, most = H.interval([f[i] for f in x], [f[j] for f in y])
        across, down = a.leaf << level, c.leaf << level
        for k in range(len(i)):
            block = products[i[k] * across : (i[k] + 1) * across, j[k] * down : (j[k] + 1) * down]
            assert least[k] <= block.min() and block.max() <= most[k]
    left = set(zip(*(x.tolist() for x in H.leaf_pairs(a, c, False))))
    assert {(n // 4, m // 8) for n, m in zip(*np.nonzero(products >= 60_000))} <= left


def test_clusters_far_from_an_anchor_group_are_pruned_at_their_root():
    rng = np.random.default_rng(0)
    near, far = rng.integers(90, 110, (64, 4)), rng.integers(-110, -90, (64, 4))
    tree = lambda v, low, leaf: H.Tree(np.arange(len(v)), np.zeros(len(v), np.int32), v, np.full((len(v), 1), low), np.full((len(v), 1), 1 << 40), leaf)
    assert len(H.leaf_pairs(tree(near, 1000, 8), tree(far, 0, 8), False)[0]) == 0
    assert len(H.leaf_pairs(tree(near, 1000, 8), tree(near, 0, 8), False)[0]) == 64


def test_products_beyond_floating_point_are_exact():
    a = np.full((1, 3), float((1 << 26) - 1))
    assert H._products(a, a)[0, 0] == 3 * ((1 << 26) - 1) ** 2
    a[0, 0] += 1
    assert H._products(np.repeat(a, 100, 1), np.repeat(a, 100, 1))[0, 0] == 100 * ((1 << 52) + 2 * ((1 << 26) - 1) ** 2)
