import math
import time
import zlib
from collections import Counter
from concurrent.futures import ProcessPoolExecutor
from multiprocessing import get_context

import numpy as np
import pyarrow as pa
import pytest
from driftlens.llm import lblm as L
from driftlens.llm.common import table


def test_base_against_brute_force_and_model_beats_it(spark, monkeypatch):
    monkeypatch.setattr(L, "HEAD", 500)  # most words then come by the join
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    counts = Counter()
    for i, t in texts:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(L.words(t))
    n, v = sum(counts.values()), len(counts)
    rows = {r.doc_id: r for r in L.score(docs).collect()}
    assert len(rows) == len(texts)
    for i, t in texts:
        w, r = L.words(t), rows[i]
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
    held = [r for r in rows.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_against_brute_force(spark, monkeypatch):
    """Word by word, with the softmax written out, from the network and the counts."""
    monkeypatch.setattr(L, "HEAD", 300)
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    training = L.texts(docs).where(~L._held_out())
    counts = L.written(L._counted(training))
    known, count_of = L.vocabulary(counts), {bytes(r.word): r.c for r in counts.collect()}
    network = L.train_apart(L._class_runs(training, spark.sparkContext.broadcast(known)), known.class_total)
    got = {r.doc_id: r.score for r in L.score(docs).collect()}

    def kind(word):
        return int(known.head_class[known.head[word]]) if word in known.head else known.endings.get(word.decode()[-2:], L.CLASSES - 2)

    for doc, text in [(r.doc_id, r.text) for r in docs.orderBy("doc_id").limit(25).collect()]:
        total, before = 0.0, [L.CLASSES - 1, L.CLASSES - 1]
        for word in L.words(text or ""):
            own = kind(word)
            q = [network.scale[0][d] * network.context[before[0]][d] + network.scale[1][d] * network.context[before[1]][d] for d in range(L.WIDTH)]
            z = network.target @ np.array(q) + network.bias
            total += (z[own] - z.max() - math.log(sum(math.exp(v) for v in z - z.max()))) / math.log(10)
            if own >= L.HEAD_CLASSES:  # a word shares its class with others
                total += math.log10((count_of.get(word, 0) + 0.5) / known.class_total[own])
            before = [before[1], own]
        assert got[doc] == pytest.approx(total, rel=1e-4)


def test_probabilities_sum_to_one():
    network = L.train(np.arange(0, L.CLASSES**3, 997), np.ones(len(range(0, L.CLASSES**3, 997))))
    assert np.allclose((10 ** network.log10(np.arange(L.CLASSES**2))).sum(1), 1)


def test_training_grows_with_the_tokens():
    assert (L.CLASSES, L.HEAD_CLASSES, L.HEAD) == (160, 96, 100_000)
    assert L.steps(100) == L.STEPS and L.steps(10**9) == math.ceil(10**9 / L.BATCH)


def test_tasks_train_together_as_well_as_one_alone(spark):
    rng = np.random.default_rng(4)
    last, n = rng.integers(0, 20, 4000), rng.integers(1, 30, 4000)
    codes, counts = np.unique((last * L.CLASSES + last) * L.CLASSES + (last + rng.integers(0, 3, 4000)) % 20, return_inverse=True)
    counts = np.bincount(counts, n).astype(np.int64)
    rows = spark.createDataFrame([(int(c), int(k)) for c, k in zip(codes, counts, strict=True)], "code long, n long").repartitionByRange(3, "n")
    classes = np.bincount(codes % L.CLASSES, counts, L.CLASSES) + 0.5
    apart, again, alone = L.train_apart(rows, classes), L.train_apart(rows, classes), L.train(codes, counts)
    base = np.log10(classes / classes.sum())

    def gain(network):
        return counts @ (network.log10(codes // L.CLASSES)[np.arange(len(codes)), codes % L.CLASSES] - base[codes % L.CLASSES]) / counts.sum()

    assert gain(apart) > 0.8 * gain(alone) > 0.4
    assert (apart.context == again.context).all()


def test_odd_rows(odd, none):
    rows = L.score(odd).collect()
    assert len(rows) == 12 and all(math.isfinite(r.score) and r.score <= 0 for r in rows)
    assert {r.n_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert L.score(none).count() == 0


def _scatter(out, at, rows):
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
    out[at[order][first]] += np.add.reduceat(rows[order], first)


def _token_by_token(state, codes, counts, noise, n, draw):
    """The steps of _descend with a vector for each token of a batch, forth and back."""
    share, noise_sums, p, seen = np.cumsum(counts) / counts.sum(), np.cumsum(noise), state[:4], state[4:]
    log_rate = np.log(noise) + np.log(L.NOISE)
    for step in range(n):
        code = codes[np.searchsorted(share, draw.random(L.BATCH))]
        last2, last1, true = code // L.CLASSES // L.CLASSES, code // L.CLASSES % L.CLASSES, code % L.CLASSES
        false = np.searchsorted(noise_sums, draw.random(L.NOISE)).clip(0, L.CLASSES - 1)
        r2, r1 = p[0][last2], p[0][last1]
        predicted = p[2][0] * r2 + p[2][1] * r1
        d_true = 1 / (1 + np.exp(-((predicted * p[1][true]).sum(1) + p[3][true] - log_rate[true]).clip(-30, 30))) - 1
        d_false = 1 / (1 + np.exp(-(predicted @ p[1][false].T + p[3][false] - log_rate[false]).clip(-30, 30)))
        g = [np.zeros_like(x) for x in p]
        back = d_true[:, None] * p[1][true] + d_false @ p[1][false]
        _scatter(g[1], true, d_true[:, None] * predicted)
        np.add.at(g[1], false, d_false.T @ predicted)
        g[3] += np.bincount(true, d_true, L.CLASSES)
        np.add.at(g[3], false, d_false.sum(0))
        _scatter(g[0], last2, back * p[2][0])
        _scatter(g[0], last1, back * p[2][1])
        g[2] = np.stack([(back * r2).sum(0), (back * r1).sum(0)])
        for x, s, d in zip(p, seen, g, strict=True):
            d /= L.BATCH
            s += d * d
            x -= (L.RATE * (1 - step / n) + 0.002) * d / np.sqrt(s)


def _run(descend, n=200):
    """The state after n steps on 500,000 codes, and the CPU seconds they took."""
    rng = np.random.default_rng(6)
    codes = np.unique(rng.integers(0, (L.CLASSES - 2) ** 3, 500_000))
    counts, noise = rng.integers(1, 30, len(codes)), L._noise(np.bincount(codes % L.CLASSES, minlength=L.CLASSES) + 0.5)
    state, began = L._begin(noise, np.random.default_rng(1)), time.process_time()
    descend(state, codes, counts, noise, n, np.random.default_rng(2))
    return state, time.process_time() - began


def _least_seconds():
    return [min(_run(descend)[1] for _ in range(5)) for descend in (L._descend, _token_by_token)]


def test_steps_by_classes_are_those_token_by_token_in_less_time(monkeypatch):
    for x, y in zip(_run(L._descend)[0], _run(_token_by_token)[0], strict=True):
        assert np.allclose(x, y, rtol=1e-9, atol=1e-12)
    monkeypatch.setenv("OMP_NUM_THREADS", "1")  # as Spark starts its workers
    with ProcessPoolExecutor(1, get_context("spawn")) as pool:
        ours, plain = pool.submit(_least_seconds).result()
    assert ours < 0.7 * plain


def test_tokens_and_codes_of_many_texts_are_those_of_each():
    texts = ["", " ", "A b", "\t\x0bÄb  ÄB\x1cc\x85d\n", "e", "日本語 ÉÀ x", "\r\n\x0c", "end <b>"]
    batch = pa.RecordBatch.from_arrays([pa.array(["left out", *texts])], names=["text"]).slice(1)
    tokens, lengths = L._tokens(batch)
    each = [L.words(t) for t in texts]
    assert tokens.cast(pa.binary()).to_pylist() == sum(each, []) and lengths.tolist() == [len(w) for w in each]
    known = L.Vocabulary({b"b": 0, L.END: 1}, np.ones(2), np.array([0, 1]), {"語x": 2, "本語": 3, "ÉÀ": 4, "e": 5}, 9, 9, np.ones(L.CLASSES))
    places, classes = L._Coder(known)(tokens)
    assert places.tolist() == [known.head.get(w, -1) for w in tokens.cast(pa.binary()).to_pylist()]
    assert classes.tolist() == [known.head_class[p] if p >= 0 else known.endings.get(w.as_py()[-2:], L._OTHER) for p, w in zip(places, tokens, strict=True)]
    before = [c for w, k in zip(each, np.split(classes, np.cumsum(lengths)[:-1]), strict=True) for c in zip([L._START, L._START, *k][: len(w)], [L._START, *k][: len(w)], strict=True)]
    assert L._contexts(classes, lengths).tolist() == [a * L.CLASSES + b for a, b in before]
