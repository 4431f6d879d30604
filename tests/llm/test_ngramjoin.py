import glob
import random
import re
import time

import numpy as np
import pytest

from driftlens.llm import ngramjoin as J
from driftlens.llm import signatures as S

from tests.llm.conftest import frame


def brute(rows):
    sets = {}
    for i, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    while any(root[a] != root[b] for a, b in links):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return {(i, len(s), root[i]) for i, s in sets.items()}


def near(rng, length, n, edits):
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(length)] = f"n{rng.randrange(10**6)}"
        yield " ".join(w)


def fixture():
    """Groups around the threshold at all sizes, chains of which the ends are not similar, one passage in many documents, short sets."""
    rng = random.Random(3)
    texts = [t for length, n in ((11, 12), (12, 12), (20, 12), (70, 30), (280, 20), (600, 14), (1400, 8)) for t in near(rng, length, n, max(1, length // 25))]
    passage = " ".join(f"p{k}" for k in range(55))
    texts += [f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(k)) for k in range(60)]
    chain = [f"c{k}" for k in range(140)]
    texts += [" ".join(chain[k : k + 100]) for k in range(0, 40, 5)]
    texts += ["", None, "a b", "A B", "a", "a b c", "A  b\tC", " ".join(map(str, range(11))), " ".join(map(str, range(12)))]
    rng.shuffle(texts)
    return list(enumerate(texts, 5))


def test_against_brute_force(spark):
    rows = fixture()
    assert {tuple(r) for r in J.joined(frame(spark, rows)).collect()} == brute(rows)


def test_order_and_blocks_change_nothing(spark, monkeypatch):
    rows = fixture()
    for name, value in (("BLOCK", 8), ("OFTEN", 2), ("REPORTED", 2), ("ROWS", 16)):
        monkeypatch.setattr(J, name, value)
    rng = random.Random(1)
    some = np.unique(np.array([rng.choice(s) for _, t in rows if len(s := J.shingle_sets([t or ""])[0])], np.uint64))
    monkeypatch.setattr(J, "frequent", lambda docs: some)
    assert {tuple(r) for r in J.joined(frame(spark, rows)).collect()} == brute(rows)


def test_without_the_first_traversal(spark, monkeypatch):
    """The second traversal alone finds every link."""
    rows, traversed = fixture(), J._traversed
    monkeypatch.setattr(J, "_traversed", lambda rows, shapes, component, all_pairs: traversed(rows, shapes, component, all_pairs) if all_pairs else spark.createDataFrame([], "a long, b long"))
    assert {tuple(r) for r in J.joined(frame(spark, rows)).collect()} == brute(rows)


def test_groups_are_of_sets_near_in_size_and_no_two_have_the_same_records(spark, monkeypatch):
    rows, traversed = [], J._traversed
    monkeypatch.setattr(J, "_traversed", lambda groups, *rest: rows.append(groups.collect()) or traversed(groups, *rest))
    words = [f"w{k}" for k in range(60)]
    texts = [(1, " ".join(words)), (2, " ".join([*words[:-1], "x"])), (3, " ".join(words[:42])), (4, " ".join(words))]
    assert {tuple(r) for r in J.joined(frame(spark, texts)).collect()} == brute(texts)
    assert sorted((r.id, r.n) for r in rows[0]) == [(1, 2), (2, 2)]


def test_shuffle_files_go_with_their_queries(spark):
    """What the steps shuffled is gone before the result is read, though nothing has made the driver collect garbage."""
    folders = list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString())
    there = lambda: {f for d in folders for f in glob.glob(f"{d}/*/shuffle_*.data")}
    before, rows = there(), fixture()
    out = J.joined(frame(spark, rows))
    until = time.time() + 20
    while there() - before and time.time() < until:
        time.sleep(0.2)
    assert not there() - before
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    assert {tuple(r) for r in out.collect()} == brute(rows)


def test_no_pair_is_confirmed_twice(spark, monkeypatch):
    tried, confirmed = [], J._confirmed
    monkeypatch.setattr(J, "_confirmed", lambda pairs, docs: tried.append({tuple(r) for r in pairs.collect()}) or confirmed(pairs, docs))
    rows = fixture()
    assert {tuple(r) for r in J.joined(frame(spark, rows)).collect()} == brute(rows)
    assert len(tried) == 2 and tried[0] and not tried[0] & tried[1]


def test_hot_groups_and_many_copies(spark, monkeypatch):
    for name, value in (("LEAST_HOT", 4), ("HOT", 1 << 20), ("REMAINDERS", 3), ("FEW_IDS", 0)):
        monkeypatch.setattr(J, name, value)
    monkeypatch.setattr(J, "hot_keys", lambda counts, key: sorted(r[0] for r in counts.select(key).collect()))
    rows = [*fixture(), *((k, t) for k, (_, t) in enumerate(fixture()[:40], 1000)), (None, "n1 " * 3 + " ".join(map(str, range(30))))]
    assert {tuple(r) for r in J.joined(frame(spark, rows)).where("doc_id IS NOT NULL").collect()} == brute(rows[:-1])


@pytest.mark.parametrize("seed", range(4))
def test_traversal_loses_no_pair(seed):
    rng = np.random.default_rng(seed)
    sizes, trees = rng.integers(20, 60, 150), np.sort(rng.integers(0, 6, 150))
    base = [rng.integers(0, 1 << 62, 70) for _ in range(5)]
    sets = [{*base[k % 5][: sizes[k]].tolist()} ^ {*rng.choice(base[k % 5], 2).tolist()} for k in range(150)]
    bits = np.stack([np.packbits(np.bincount([x % J.BITS for x in s], minlength=J.BITS) > 0).view(np.uint64) for s in sets])
    forest = S.Forest(trees, bits, np.array([len(s) for s in sets]), np.ones(150, bool), 90)
    similar = {(x, y) for x in range(150) for y in range(x + 1, 150) if 100 * len(sets[x] & sets[y]) >= 90 * len(sets[x] | sets[y])}
    labels, joined = rng.integers(0, 3, 150), np.array([True] * 4 + [False] * 2)
    found = {(int(x), int(y)) for a, b in forest.pairs(labels, joined, (np.array([4]), np.array([5]))) for x, y in zip(a, b)}
    want = {(x, y) for x, y in similar if labels[x] != labels[y] and (trees[x] == trees[y] < 4 or {trees[x], trees[y]} == {4, 5})}
    assert want <= found
    assert all(labels[x] != labels[y] for x, y in found)
    some = {(int(x), int(y)) for a, b in forest.spanning(joined, (np.array([4]), np.array([5]))) for x, y in zip(a, b)}
    every = {(int(x), int(y)) for a, b in forest.pairs(np.arange(150), joined, (np.array([4]), np.array([5]))) for x, y in zip(a, b)}
    assert some <= every


def test_frequent_items_bound(monkeypatch):
    monkeypatch.setattr(J, "HELD", 50)
    monkeypatch.setattr(J, "REPORTED", 1)
    import pyarrow as pa

    texts = [f"all of you x{k} y{k} z{k}" for k in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    out = pa.Table.from_batches(J._often(iter([batch.slice(0, 100), batch.slice(100, 100), batch.slice(200)])))
    common = J.shingle_sets(["all of you"])[0].view(np.int64)[0]
    assert out.num_rows <= 50 and dict(zip(out["shingle"].to_pylist(), out["n"].to_pylist()))[common] >= 290


def test_odd_rows(odd, none, spark):
    rows = J.joined(odd).collect()
    assert len(rows) == 12
    assert {r.component_id for r in rows if r.doc_id == 3} == {3}
    assert {r.component_id for r in rows if r.doc_id is None} == {3, None}
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in rows if r.doc_id in (1, 2)} == {(1, 0, 1), (2, 0, 2)}
    assert J.joined(none).count() == 0
    words = [f"w{k}" for k in range(60)]
    shared = [(1, " ".join(words)), (1, "other words " * 3 + " ".join(words[::-1])), (2, " ".join(words[:-1])), (3, "other words " * 3 + " ".join(words[:0:-1]))]
    assert {(r.doc_id, r.component_id) for r in J.joined(frame(spark, shared)).collect()} == {(1, 1), (2, 1), (3, 1)}
