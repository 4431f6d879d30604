import random
import re
import tracemalloc

import numpy as np
import pytest
from driftlens.llm import decontam as D

from tests.llm.conftest import frame


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())


def distance(item, run):
    row = [0] * (len(run) + 1)
    for k, w in enumerate(item, 1):
        now = [k]
        for j, v in enumerate(run, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (v != w)))
        row = now
    return min(row)


def changed(rng, item, n):
    w = item[:]
    for _ in range(n):
        kind, at = rng.randrange(3), rng.randrange(len(w))
        if kind == 0:
            w[at] = f"z{rng.randrange(999)}"
        elif kind == 1 and len(w) > 2:
            del w[at]
        else:
            w.insert(at, f"z{rng.randrange(999)}")
    return w


def test_against_brute_force(spark):
    rng = random.Random(2)
    items = [[f"v{rng.randrange(3000)}" for _ in range(n)] for n in (14, 20, 33, 59, 18, 25)]
    docs = []
    for k in range(60):
        around = [f"v{rng.randrange(3000)}" for _ in range(rng.randrange(200))]
        at = rng.randrange(len(around) + 1)
        item = items[k % 6]
        docs.append((k, " ".join([*around[:at], *changed(rng, item, rng.randrange(len(item) // 4 + 2)), *around[at:]]).upper()))
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in enumerate(items)] + [(9, None, "x"), (10, "", "x")], "item_id long, text string, doc_id string")
    want = {(d, i) for d, t in docs for i, w in enumerate(items) if distance([x.encode() for x in w], words(t)) <= int(D.TOLERANCE * len(w))}
    rows = D.contaminated(frame(spark, docs), bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got <= want and len(got) >= 0.95 * len(want) > 20
    for r in rows:
        item, text = [x.encode() for x in items[r.item_id]], words(docs[r.doc_id][1])
        assert r.edits == distance(item, text)


def test_short_items_match_exactly(spark):
    bench = spark.createDataFrame([(0, "one two three")], "item_id long, text string")
    docs = frame(spark, [(1, "zero one, two. THREE four"), (2, "one two four three"), (3, None), (4, "one two three"), (None, "one two three")])
    assert sorted(str(r.doc_id) for r in D.contaminated(docs, bench).collect()) == ["1", "4", "None"]
    assert sorted(str(r.doc_id) for r in D.drop_contaminated(docs, bench).collect()) == ["2", "3"]


def found_in_own_text(rng, items, edits):
    """Share of items that are found where each stands, changed, in a text of its own."""
    known = D.Items([(i, D.words(" ".join(w))) for i, w in enumerate(items)])
    texts = []
    for w in items:
        around = [f"u{rng.randrange(3000)}" for _ in range(40)]
        at = rng.randrange(41)
        texts.append(" ".join([*around[:at], *changed(rng, w, edits(len(w))), *around[at:]]))
    tokens = [D.words(t) for t in texts]
    got = known.matches(np.concatenate(tokens), np.cumsum([0, *map(len, tokens)]))
    return len({(t, k) for t, k, *_ in got if t == k}) / len(items)


def test_walks_find_whole_copies_of_every_size():
    rng = random.Random(5)
    items = [[f"v{rng.randrange(3000)}" for _ in range(n)] for n in (1, 2, 4, 5, 9, 14, 15, 16, 40, 90, 300, 1200)]
    assert found_in_own_text(rng, items, lambda n: 0) == 1


@pytest.mark.parametrize("n", [5, 6, 7, 8, 9, 10, 12, 14, 15, 16, 18, 20, 25, 30, 40, 59, 100, 300, 1200])
def test_recall_of_the_walks_at_the_most_edits_of_each_length(n):
    rng = random.Random(n)
    items = [[f"v{rng.randrange(3000)}" for _ in range(n)] for _ in range(300 if n < 200 else 30)]
    assert found_in_own_text(rng, items, lambda n: int(D.TOLERANCE * n)) >= 0.95


def test_samples_of_long_texts_across_batches_and_texts():
    """Copies at every place about the border of a batch, and texts that end within an item."""
    rng = random.Random(8)
    item = [f"v{rng.randrange(3000)}" for _ in range(20)]
    known = D.Items([(0, D.words(" ".join(item)))])
    filler = [f"u{rng.randrange(3000)}" for _ in range(D.BATCH)]
    for back in (0, 1, 7, 19, 20):
        long = D.words(" ".join([*filler[: D.BATCH - back], *item, *filler[:50]]))
        short = D.words(" ".join(item[:10]))
        got = known.matches(np.concatenate([short, long, short]), np.cumsum([0, 10, len(long), 10]))
        assert got == [(1, 0, 0, D.BATCH - back, D.BATCH - back + 20)]


def test_items_with_a_common_beginning_stay_within_memory():
    """2,000 items that begin alike, against a text that repeats those words: what is held does not grow with both."""
    rng = random.Random(9)
    common = "which of the following is".split()
    items = [(i, D.words(" ".join(common + [f"v{rng.randrange(9000)}" for _ in range(15)]))) for i in range(2000)]
    known = D.Items(items)
    text = np.concatenate([np.tile(D.words(" ".join(common)), 20_000), items[77][1], D.words("u v w")])
    tracemalloc.start()
    got = known.matches(text, np.array([0, len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(k, e, start) for _, k, e, start, _ in got] == [(77, 0, 100_000)]
    assert peak < 500 << 20


def test_recall_on_a_table_by_number_of_edits(spark):
    """Every document of a table gets a benchmark item with 0, half of, or all the edits it may have."""
    rng = random.Random(6)
    d = "/root/testdata/sf0.001"
    bench = spark.read.parquet(f"{d}/benchmark.parquet")
    items = [(r.item_id, [w.decode() for w in words(r.text)]) for r in bench.collect()]
    docs, want = [], {}
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        own = [w.decode(errors="replace") for w in words(r.text)]
        item, at, part = rng.choice(items), rng.randrange(len(own) + 1), rng.choice((0, 0.5, 1))
        docs.append((r.doc_id, " ".join([*own[:at], *changed(rng, item[1], int(part * int(D.TOLERANCE * len(item[1])))), *own[at:]])))
        want[r.doc_id] = item[0]
    got = {(r.doc_id, r.item_id) for r in D.contaminated(frame(spark, docs), bench).collect()}
    assert all((doc, item) in got for doc, item in want.items())


def test_odd_rows(spark, odd, none):
    bench = spark.createDataFrame([(0, "word " * 30), (1, None)], "item_id long, text string")
    assert [r.doc_id for r in D.contaminated(odd, bench).collect()] == [9]
    assert D.contaminated(none, bench).count() == 0
    assert D.contaminated(odd, bench.limit(0)).count() == 0


def test_edit_distance():
    rng = np.random.default_rng(0)
    for _ in range(100):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(0, 15))
        assert D.edit_distance(a, b)[0] == distance(a.tolist(), b.tolist())
