import random
import re

from driftlens.llm import neardup as N

from tests.llm.conftest import frame


def brute(rows):
    sets = {}
    for i, text in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {(i, len(s), root(i), root(i) == i) for i, s in sets.items()}


def variants(rng, n, edits):
    base = [f"w{rng.randrange(400)}" for _ in range(150)]
    for _ in range(n):
        w = base[:]
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
        yield " ".join(w)


def fixture():
    rng = random.Random(5)
    texts = [*variants(rng, 60, 12), *variants(rng, 30, 4), "", None, "a b", "A B", "a b c d e", "a b c d e"]
    texts += [" ".join(f"u{rng.randrange(10**6)}" for _ in range(80)) for _ in range(30)]
    chain = [f"c{k}" for k in range(100)]
    texts += [" ".join(chain[k : k + 60]) for k in range(0, 40, 5)]  # neighbours are similar, ends are not
    rng.shuffle(texts)
    return list(enumerate(texts, 10))


def test_against_brute_force(spark):
    rows = fixture()
    assert {tuple(r) for r in N.near_duplicates(frame(spark, rows)).collect()} == brute(rows)


def test_divided_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(N, "PAIRS", 4)
    monkeypatch.setattr(N, "DEPTH", 2)
    rows = fixture()
    assert {tuple(r) for r in N.near_duplicates(frame(spark, rows)).collect()} == brute(rows)


def test_pairs_of_divided_buckets_that_agree_in_no_other_band(spark, monkeypatch):
    monkeypatch.setattr(N, "PAIRS", 4)
    monkeypatch.setattr(N, "BLOCK", 3)
    ids = range(1, 13)
    nodes = spark.createDataFrame([(i, 10, [7] + [100 * i + k for k in range(1, N.BANDS)], [0] * (N.BITS // 64)) for i in ids], "id long, n int, bands array<long>, bits array<long>")
    rows = spark.createDataFrame([(7, 0, i, 10) for i in ids], "key long, band int, id long, n int")
    found = spark.createDataFrame([(1, 1), (2, 1)], "id long, component long")
    divided, hot = N._left_over(rows, nodes, found)
    got = [tuple(r) for r in divided.union(N._in_full(hot, nodes, found)).collect()]
    want = {(a, b) for a in ids for b in ids if a < b} - {(1, 2)}
    assert set(got) == want and len(got) == len(want)


def test_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "PAIRS", 0)
    monkeypatch.setattr(N, "DEPTH", 1)  # no division: every bucket with open pairs goes to the blocks
    monkeypatch.setattr(N, "BLOCK", 4)
    rows = fixture()
    assert {tuple(r) for r in N.near_duplicates(frame(spark, rows)).collect()} == brute(rows)


def test_parity_never_counts_more_than_differs():
    rng = random.Random(1)
    for _ in range(50):
        a = N.shingles(" ".join(f"w{rng.randrange(60)}" for _ in range(90)))
        b = N.shingles(" ".join(f"w{rng.randrange(60)}" for _ in range(90)))
        differ = len(set(a.tolist()) ^ set(b.tolist()))
        assert sum(int(x).bit_count() for x in (N.parity(a) ^ N.parity(b)).view("uint64")) <= differ


def test_sketch_agreement_estimates_similarity():
    a, b = N.shingles(" ".join(map(str, range(1000)))), N.shingles(" ".join(map(str, range(200, 1200))))
    assert abs((N.sketch(a) == N.sketch(b)).mean() - 2 / 3) < 0.15
    assert (N.sketch(a[:1]) == N.sketch(a[:1])).all()  # one element fills every coordinate


def test_odd_rows(odd, none):
    rows = N.near_duplicates(odd).collect()
    assert len(rows) == 12
    assert {(r.component_id, r.kept) for r in rows if r.doc_id == 3} == {(3, True)}
    assert {r.component_id for r in rows if r.doc_id is None} == {3, None}
    assert {(r.doc_id, r.n_shingles, r.kept) for r in rows if r.doc_id in (1, 2)} == {(1, 0, True), (2, 0, True)}
    assert N.near_duplicates(none).count() == 0
    kept = N.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == 12
