import math
import re
import zlib

import numpy as np
import pytest
from driftlens.llm import toxicity as T
from driftlens.llm.common import table
from pyspark.sql import functions as F


def auc(y, s):
    order = np.argsort(s, kind="stable")
    rank = np.empty(len(s))
    rank[order] = np.arange(1, len(s) + 1)
    return (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = T.op3_toxicity_label_model(spark, d).join(table(spark, d, "labels"), "doc_id").where("held_out").toPandas()
    assert auc(rows.toxic.to_numpy(), rows.score.to_numpy()) > 0.95
    assert rows.predicted[rows.toxic == 0].mean() < 0.01


def test_label_model_finds_accuracies_by_agreement_and_counts_copies_once():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.3
    flip = lambda right: np.where(rng.random(6000) < right, y, ~y)
    a, b, c, noise = flip(0.9), flip(0.85), flip(0.8), rng.random(6000) < 0.3
    votes = np.stack([a, a.copy(), b, c, noise], 1).astype(float)
    guess = np.where(rng.random(6000) < 0.95, y, ~y)
    model = T.fit_label_model(votes, guess, rounds=60)
    for voter, right in ((0, 0.9), (2, 0.85), (3, 0.8)):
        assert abs(model.rates[1, voter] - right) < 0.15 and abs(1 - model.rates[0, voter] - right) < 0.15
    assert abs(model.rates[1, 4] - model.rates[0, 4]) < 0.1
    assert model.correlations[0, 1] > 0.9 > 0.3 > abs(model.correlations[2, 4])
    assert model.parents[1] == 0
    logit = lambda m, v: (lambda p: np.log(p / (1 - p)))(m.posterior(np.array([v], float)))[0]
    alone = T.fit_label_model(votes[:, 1:], guess, rounds=60)
    assert abs(logit(model, [1, 1, 0, 0, 0]) - logit(alone, [1, 0, 0, 0])) < 0.5
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.9


def brute(text, model):
    """The score of a text from the classifier's features, word by word."""
    mask, base = (1 << 64) - 1, 0x9E3779B97F4A7C15

    def mixed(x):
        x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
        x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
        return x ^ (x >> 31)

    def value(word):
        return sum((b + 1) * pow(base, k, 1 << 64) for k, b in enumerate(word)) & mask

    found = set()
    for word in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower()):
        for kind, n in enumerate(T.LENGTHS):
            if len(word) > n:
                found.add(((mixed((value(word[:n]) + n) & mask) | 1) >> 44) * 8 + kind)
        found.add(((mixed(value(word)) | 1) >> 44) * 8 + len(T.LENGTHS))
    weights = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    return 1 / (1 + math.exp(-(model.constant + sum(weights.get(k, 0.0) for k in found))))


def test_scores_against_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = table(spark, d, "documents").limit(300)
    model = T.fit(table(spark, d, "documents"), table(spark, d, "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in T.toxicity_scores(docs, model).collect():
        assert r.score == pytest.approx(brute(texts[r.doc_id], model), rel=1e-9)
        assert r.predicted == int(r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_held_out_labels_change_nothing(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    other = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.fit(docs, labels), T.fit(docs, other)
    assert (a.keys == b.keys).all() and np.allclose(a.weights, b.weights) and a.constant == pytest.approx(b.constant)


def test_odd_rows_and_missing_labels(spark, odd, none):
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = T.toxicity_scores(odd, T.fit(odd, empty)).collect()
    assert len(rows) == 12 and all(r.score == 0 and r.predicted == 0 for r in rows)
    assert T.toxicity_scores(none, T.fit(none, empty)).count() == 0
    assert T.drop_toxic(odd, T.fit(odd, empty)).count() == 12


def test_a_repeated_id_brings_one_row_to_the_sample(spark, monkeypatch):
    rows = [(k, f"word{k} you {'idiot' if k % 2 else 'friend'}") for k in range(40)] + [(1, f"other text {k}") for k in range(500)] + [(3, "word3 you idiot")] * 500
    seen = []
    original = T.fit_label_model
    monkeypatch.setattr(T, "fit_label_model", lambda votes, start, **k: seen.append((len(votes), int(start.sum()))) or original(votes, start, **k))
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    kept = [k for k in range(40) if zlib.crc32(str(k).encode()) % 4 != 2]
    T.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    assert seen == [(len(kept), sum(k % 2 for k in kept))]


def test_em_ends_by_its_posterior_and_not_without_a_word():
    rng = np.random.default_rng(1)
    y = rng.random(3000) < 0.2
    votes = np.stack([np.where(rng.random(3000) < right, y, ~y) for right in (0.9, 0.85, 0.8, 0.75)], 1).astype(float)
    short, longer = (T.fit_label_model(votes, y, tolerance=t).posterior(votes) for t in (1e-3, 9e-4))
    assert ((short > 0.5) == (longer > 0.5)).mean() > 0.99 and ((short > 0.5) == y).mean() > 0.9
    with pytest.raises(RuntimeError, match="EM"):
        T.fit_label_model(votes, y, rounds=1)
