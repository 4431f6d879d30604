"""Toxicity by weak supervision.

Voters look at texts: hand-written lexicons and patterns, and lexicons of word
beginnings and words mined from labelled training rows, one voter for each
length of beginning and each band of precision. In a generative label model the
label is latent; voters depend on it and, along a tree, on each other. EM
estimates how often each voter fires on toxic and on clean texts (its accuracy)
and how it goes along with its neighbour in the tree (correlations), from how
voters agree, until its posterior stands still. Known labels say where EM starts, and mine the lexicons; they are
no part of the model. Its posterior labels train a logistic classifier on the presence of
word beginnings and words, hashed to 2^20 slots. Scores come from the text alone.

Fitting takes a sample of at most SAMPLE labelled training rows, those of the
smallest hashes of their ids, and of an id with several texts that of the
smallest hash, so that no repeated id makes the sample larger; rows with
crc32(id as text) mod 4 = 2 are held out. Every document is scored, by its whole text.

Defined cases: a null text is empty; an empty text has the score of the
classifier's constant; a null id is not held out; a document with several
labels is toxic if one says so; null labels are left out; without labels of
both classes all scores are 0; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import map_rows, parts, table, texts, written
from driftlens.llm.wordhash import grouped, prefix_hashes, word_table

SAMPLE, FEATURES, LEAST, THRESHOLD = 20_000, 3000, 5, 0.3
SLOTS = 1 << 20
LENGTHS = (3, 4, 5, 6, 7, 8)
TREE_ROUNDS = 50
_ALNUM = word_table("alnum")

#: Hand-written lexicons: whole words, lower case.
LEXICONS = {
    "insult_en": "idiot idiots moron morons loser losers stupid dumb fool fools imbecile jerk clown clowns",
    "contempt_en": "pathetic worthless disgusting useless hopeless vile repulsive despicable filthy",
    "dehumanise_en": "scum trash vermin garbage parasite parasites filth subhuman pig pigs rat rats",
    "insult_de": "idiot dummkopf trottel depp arschloch abschaum versager widerlich ekelhaft wertlos",
    "insult_fr": "idiot imbécile crétin connard abruti ordure minable dégoûtant pathétique débile",
    "insult_es": "idiota imbécil estúpido tonto basura escoria asqueroso patético inútil payaso",
    "threat": "kill die hurt destroy burn hang shoot",
    "hate": "hate hates despise loathe",
}
#: Hand-written patterns over the text as it is.
PATTERNS = {
    "you_are": r"(?i)\byou(?:'re| are) (?:an? |such an? |so )?(?:idiot|moron|loser|stupid|pathetic|worthless|disgusting|clown|trash|scum)",
    "shut_up": r"(?i)\b(?:shut up|get lost|go to hell|drop dead)\b",
    "harm": r"(?i)\b(?:kill yourself|go die|i will (?:kill|hurt|find) you)\b",
    "nobody": r"(?i)\b(?:nobody|no one) (?:likes|wants|cares about) you\b",
    "masked": r"\b[a-zA-Z]+[*@#$%]{1,3}[a-zA-Z]+\b",
    "shouting": r"\b[A-Z]{4,}(?: [A-Z]{3,}){3,}",
    "exclaiming": r"[!?]{3,}",
}


def slots(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, kind, slot) of every word and word beginning; kind is the place in LENGTHS, or its length for whole words."""
    hashes, bounds = prefix_hashes(raw, _ALNUM, LENGTHS)
    text = np.repeat(np.arange(len(raw)), np.diff(bounds))
    out = []
    for kind, h in enumerate(hashes):
        there = h != 0
        out.append((text[there], np.full(int(there.sum()), kind, np.int64), (h[there] >> np.uint64(44)).astype(np.int64)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def hand_votes(text: str, raw: bytes) -> list[int]:
    """1 for each lexicon and pattern that fires."""
    words = set(re.findall(rb"[0-9a-z\x80-\xff]+", raw))
    return [int(not words.isdisjoint(x)) for x in _LEXICONS] + [int(p.search(text) is not None) for p in _PATTERNS]


_LEXICONS = [frozenset(w.encode() for w in x.split()) for x in LEXICONS.values()]
_PATTERNS = [re.compile(p) for p in PATTERNS.values()]


@dataclass(frozen=True)
class LabelModel:
    """A latent label and voters that depend on it and, along a tree, on each other.

    rates: how often a voter fires on clean and on toxic texts (its accuracies).
    parents: the voter that each one goes along with most, given the label; -1
    for the root. tables[y, i, a]: how often voter i fires on texts of label y
    where its parent has voted a. correlations: between voters, given the label.
    """

    prior: float
    rates: np.ndarray  # (2, voters)
    parents: np.ndarray
    tables: np.ndarray  # (2, voters, 2)
    correlations: np.ndarray  # (voters, voters)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        votes = votes.astype(int)
        own = np.arange(votes.shape[1])
        before = np.where(self.parents >= 0, votes[:, self.parents], 0)
        fires = self.tables[:, own, before]  # (2, texts, voters)
        chance = np.log(np.where(votes == 1, fires, 1 - fires)).sum(2)
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + chance[1] - chance[0], -50, 50)))


def _tree(both: np.ndarray, single: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """Parents along the tree of most mutual information between voters given the label, from counts by label: of pairs firing, of voters firing, of texts."""
    information = np.zeros(both.shape[1:])
    for y in (0, 1):
        n = mass[y] + 2
        one = (single[y] + 1) / n
        for a in (0, 1):
            for b in (0, 1):
                cell = both[y] if a and b else single[y][:, None] - both[y] if a else single[y][None] - both[y] if b else mass[y] - single[y][:, None] - single[y][None] + both[y]
                p = (np.maximum(cell, 0) + 0.5) / n
                information = information + n * p * np.log(p / np.outer(one if a else 1 - one, one if b else 1 - one))
    m = len(information)
    parents, nearest, best, left = np.full(m, -1), np.full(m, -1), np.zeros(m), np.ones(m, bool)
    for _ in range(m):
        k = int(np.where(left, best, -1).argmax())
        parents[k], left[k] = nearest[k], False
        closer = left & (information[k] > best)
        nearest[closer], best[closer] = k, information[k][closer]
    return parents


def fit_label_model(votes: np.ndarray, start: np.ndarray, rounds: int = 1000, tolerance: float = 1e-3) -> LabelModel:
    """EM: labels are latent, and start is only where their posterior begins (known labels, or a guess).

    Ends when no text's posterior moves by more than tolerance; raises if that takes
    more rounds. The tree is that of the first TREE_ROUNDS rounds, so that no two
    trees take turns for ever.

    What ties the latent label to toxicity is that start; accuracies and
    correlations then come from how voters agree on all these texts.
    """
    votes = votes.astype(float)
    p, own = start.astype(float), np.arange(votes.shape[1])
    for round_ in range(rounds):
        weights = np.stack([1 - p, p])
        mass, single = weights.sum(1), weights @ votes
        both = np.stack([votes.T @ (w[:, None] * votes) for w in weights])
        left = both.sum(0) - sum(np.outer(s, s) / max(m, 1e-9) for s, m in zip(single, mass, strict=True))
        scale = np.sqrt(np.maximum(np.diag(left), 1e-9))
        correlations = np.clip(left / np.outer(scale, scale), -1, 1)
        if round_ < TREE_ROUNDS:
            parents = _tree(both, single, mass)
        rates = (single + 0.5) / (mass[:, None] + 1)
        with_parent = both[:, own, parents]
        of_parent = single[:, parents]
        on, off = (with_parent + rates) / (of_parent + 1), (single - with_parent + rates) / (mass[:, None] - of_parent + 1)
        tables = np.where((parents >= 0)[None, :, None], np.stack([off, on], 2), rates[:, :, None]).clip(1e-6, 1 - 1e-6)
        model = LabelModel(float(np.clip(p.mean(), 1e-3, 1 - 1e-3)), rates, parents, tables, correlations)
        before, p = p, model.posterior(votes)
        if np.abs(p - before).max(initial=0) <= tolerance:
            return model
    raise RuntimeError(f"EM has not ended after {rounds} rounds")


def fit_linear(rows: np.ndarray, columns: np.ndarray, n: int, m: int, target: np.ndarray, steps: int = 400, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse binary features by Adam: weights and constant."""
    w, b = np.zeros(m), float(np.log(target.mean() / (1 - target.mean())))
    first, second = np.zeros(m + 1), np.zeros(m + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(rows, w[columns], n) + b, -50, 50)))
        error = (p - target) / n
        gradient = np.append(np.bincount(columns, error[rows], m) + decay * w, error.sum())
        first, second = 0.9 * first + 0.1 * gradient, 0.99 * second + 0.01 * gradient**2
        move = 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:m], b - move[m]
    return w, b


@dataclass(frozen=True)
class Classifier:
    """slot * 8 + kind of each feature, in order, its weight, and the constant; None where there was nothing to learn."""

    keys: np.ndarray
    weights: np.ndarray
    constant: float | None

    def scores(self, batch: list[str]) -> np.ndarray:
        if self.constant is None:
            return np.zeros(len(batch))
        out = np.full(len(batch), self.constant)
        raw = [t.encode().lower() for t in batch]
        for part in grouped(raw) if len(self.keys) else ():
            text, kind, slot = slots(raw[part.start : part.stop])
            pairs, at = _present(text, slot * 8 + kind, self.keys)
            out[part.start : part.stop] += np.bincount(pairs, self.weights[at], len(part))
        return 1 / (1 + np.exp(-np.clip(out, -700, 700)))


def _present(text: np.ndarray, key: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, place in keys) of keys that are there, each once a text."""
    at = np.searchsorted(keys, key)
    at[at == len(keys)] = 0
    there = keys[at] == key
    both = np.unique(text[there] * len(keys) + at[there])
    return both // len(keys), both % len(keys)


def _counter() -> Callable[[dict[str, list]], dict[str, list]]:
    def one(columns: dict[str, list]) -> dict[str, list]:
        raw, toxic = [t.encode().lower() for t in columns["text"]], np.array(columns["toxic"])
        found = []
        for part in grouped(raw):
            text, kind, slot = slots(raw[part.start : part.stop])
            both = np.unique(text * (SLOTS * 8) + slot * 8 + kind)
            found.append(both % (SLOTS * 8) * 2 + toxic[part.start + both // (SLOTS * 8)])
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        return {"key": keys // 2, "toxic": np.where(keys % 2, n, 0), "clean": np.where(keys % 2, 0, n)}

    return one


def _voting(keys: np.ndarray) -> Callable[[], Callable[[dict[str, list]], dict[str, list]]]:
    def one(columns: dict[str, list]) -> dict[str, list]:
        raw = [t.encode().lower() for t in columns["text"]]
        features: list[list[int]] = []
        for part in grouped(raw):
            text, kind, slot = slots(raw[part.start : part.stop])
            pairs, at = _present(text, slot * 8 + kind, keys)
            features += [x.tolist() for x in np.split(at, np.searchsorted(pairs, np.arange(1, len(part))))]
        return {"toxic": columns["toxic"], "votes": [hand_votes(t, r) for t, r in zip(columns["text"], raw, strict=True)], "features": features}

    return lambda: one


def _held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame) -> Classifier:
    """Learns from labels of documents that are not held out."""
    nothing = Classifier(np.empty(0, np.int64), np.empty(0), None)
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~_held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    sample = known.agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    one = texts(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"))
    rows = written(one.select("text", "toxic"), "labelled")
    sizes = rows.agg(F.count("*"), F.sum("toxic")).first()
    n, n_toxic = sizes[0], sizes[1] or 0
    if not 0 < n_toxic < n:
        return nothing
    counts = map_rows(rows, _counter, "key long, toxic long, clean long").groupBy("key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n_clean = n - n_toxic
    lift = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    chosen = counts.where(F.col("toxic") >= LEAST).select("key", "toxic", "clean", lift.alias("lift")).where("lift > 1")
    chosen = sorted(map(tuple, chosen.orderBy(F.desc(F.col("lift") * F.sqrt("toxic")), "key").limit(FEATURES).collect()))
    if not chosen:
        return nothing
    keys = np.array([x[0] for x in chosen])
    precision = np.array([x[1] / (x[1] + x[2] * n_toxic / n_clean) for x in chosen])
    got = map_rows(rows, _voting(keys), "toxic int, votes array<int>, features array<int>").collect()
    labels_, hand = np.array([r[0] for r in got]), np.array([r[1] for r in got])
    at = np.repeat(np.arange(len(got)), [len(r[2]) for r in got])
    columns = np.concatenate([np.array(r[2], np.int64) for r in got])
    # mined voters: a kind and a band of precision; the same lexicon, asked for one word or two, is two voters
    band = np.digitize(precision, (0.9, 0.97, 0.995))
    groups = keys % 8 * 4 + band
    hits = np.zeros((len(got), 32))
    np.add.at(hits, (at, groups[columns]), 1)
    votes = np.concatenate([hand, hits >= 1, hits >= 2], 1)
    votes = votes[:, votes.any(0)]
    posterior = fit_label_model(votes, labels_).posterior(votes)
    weights, constant = fit_linear(at, columns, len(got), len(keys), np.clip(posterior, 1e-4, 1 - 1e-4))
    return Classifier(keys, weights, constant)


def _scoring(model: Classifier) -> Callable[[], Callable[[dict[str, list]], dict[str, list]]]:
    return lambda: lambda columns: {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": model.scores(columns["text"])}


def toxicity_scores(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, held_out, score and predicted, one row for each document."""
    rows = texts(docs).withColumn("held_out", _held_out())
    scored = map_rows(rows, _scoring(model), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model: Classifier) -> DataFrame:
    """docs without those whose score reaches the threshold; rows are judged where they are, without a shuffle."""

    def run(batches):  # noqa: ANN001, ANN202
        for batch in batches:
            for part in parts(batch):
                scores = model.scores([t or "" for t in part.column("text").to_pylist()])
                yield part.filter(pa.array(scores < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op3_toxicity_label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, fit(docs, table(spark, sf_dir, "labels")))
