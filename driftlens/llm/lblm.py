"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

Tokens are words (A-Z lower-cased, split at white space) and one end for each
text. The model predicts the class of a token from the classes of the two
before it, as a log-bilinear network: the context's vectors, scaled, sum to a
prediction; its product with the target vectors, plus biases, goes through a
softmax. Within its class a token has its smoothed share. The HEAD_CLASSES most
frequent tokens are classes of their own, others share a class with the words
of the same last two letters, if that ending is among the most frequent ones.

All training texts are counted: words in one pass, class trigrams in a second,
which stay where they were counted. The network is trained by the tasks that
hold them, each with as many draws from its counts as it has tokens (STEPS
batches at least), against noise from the class frequencies of all texts. After
each of ROUNDS rounds the driver gets the tasks' parameters summed by weight of
tokens, and the next round starts from their mean. Scoring normalises with
batched matrix products over all contexts. Counts of the HEAD most frequent
words are broadcast, a fixed number; counts of all other words come by a join.

Defined cases: a null text is empty; an empty text is one end; null ids are in
training; repeated rows count and are scored each; without training texts
scores are those of the base; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import arrow_schema, forget_others, parts, table, texts, written

CLASSES, HEAD_CLASSES, HEAD = 160, 96, 100_000
WIDTH, NOISE, BATCH, STEPS, RATE, ROUNDS = 32, 16, 1024, 2500, 0.05, 4
#: Batches are drawn for so many steps at once, which changes no draw.
STRETCH = 64
#: Parameters are summed as whole numbers of this part, so that the order of tasks does not matter.
UNIT = 1 << 20
END = b"\n"  # no word holds white space
_START, _OTHER = CLASSES - 1, CLASSES - 2
#: Tokens that a task counts together.
_FLUSH = 1 << 22


def words(text: str) -> list[bytes]:
    """The tokens of a text; _tokens gives the same of many."""
    return [*text.encode().lower().split(), END]


def _ending(word: bytes) -> str:
    return word.decode()[-2:]


@dataclass(frozen=True)
class Vocabulary:
    """Counts of frequent words, classes of all, and the totals behind the shares."""

    head: dict[bytes, int]  # word: its place
    counts: np.ndarray  # of head words
    head_class: np.ndarray
    endings: dict[str, int]  # class by ending
    tokens: int
    distinct: int
    class_total: np.ndarray  # the denominator of shares in each class


class _Coder:
    """Places and classes of many tokens at once."""

    def __init__(self, vocabulary: Vocabulary):
        self.head, self.head_class = pa.array(vocabulary.head, pa.string()), vocabulary.head_class
        self.endings, self.ending_class = pa.array(vocabulary.endings, pa.string()), np.array([*vocabulary.endings.values(), _OTHER])

    def __call__(self, tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places in the head, -1 where a token is not in it; classes."""
        places = pc.index_in(tokens, self.head).fill_null(-1).to_numpy()
        classes = self.head_class[places] if len(self.head) else np.empty(len(places), np.int64)
        rare = np.flatnonzero(places < 0)
        ending = pc.utf8_slice_codeunits(tokens.take(pa.array(rare)), -2)
        classes[rare] = self.ending_class[pc.index_in(ending, self.endings).fill_null(-1).to_numpy()]
        return places, classes


def _tokens(batch: pa.RecordBatch) -> tuple[pa.Array, np.ndarray]:
    """The tokens of all texts of a batch, one text after the other, and how many each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(batch.column("text")))
    flat = split.flatten()
    full = pc.binary_length(flat).to_numpy() > 0  # white space at either end of a text leaves an empty word
    ends = np.concatenate(([0], np.cumsum(full)))[np.cumsum(split.value_lengths().to_numpy())]
    with_ends = pa.concat_arrays([flat, pa.array([END.decode()])])
    return with_ends.take(pa.array(np.insert(np.flatnonzero(full), ends, len(flat)))), np.diff(ends, prepend=0) + 1


def _counted(docs: DataFrame) -> DataFrame:
    """(word, n) of all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Array] = []

        def flush() -> pa.RecordBatch:
            word, n = pc.value_counts(pa.chunked_array(waiting)).flatten()
            waiting.clear()
            return pa.RecordBatch.from_arrays([word.cast(pa.binary()), n], schema=arrow_schema("word binary, n long"))

        for batch in chain.from_iterable(map(parts, batches)):
            waiting.append(_tokens(batch)[0])
            if sum(map(len, waiting)) > _FLUSH:
                yield flush()
        if waiting:
            yield flush()

    each = docs.select("text").mapInArrow(run, "word binary, n long")
    return each.groupBy("word").agg(F.sum("n").alias("c"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The classes and the head of counts(word, c)."""
    total, distinct = counts.agg(F.sum("c"), F.count("*")).first()
    frequent = counts.orderBy(F.desc("c"), "word").limit(HEAD).toArrow()
    head = list(zip(frequent.column("word").to_pylist(), frequent.column("c").to_pylist(), strict=True))
    top = head[:HEAD_CLASSES]
    ending = F.right(F.decode("word", "UTF-8"), F.lit(2))
    by_ending = counts.groupBy(ending.alias("e")).agg(F.sum("c").alias("c"), F.count("*").alias("v"))
    shared = {e: (c, v) for e, c, v in by_ending.orderBy(F.desc("c"), "e").limit(_OTHER).collect()}
    for w, c in top:  # these are classes of their own
        if (e := _ending(w)) in shared:
            shared[e] = (shared[e][0] - c, shared[e][1] - 1)
    endings = {e: len(top) + k for k, e in enumerate(sorted(shared, key=lambda e: (-shared[e][0], e))[: _OTHER - len(top)])}
    tokens, kinds = np.zeros(CLASSES), np.zeros(CLASSES)
    for k, (_, c) in enumerate(top):
        tokens[k], kinds[k] = c, 1
    for e, k in endings.items():
        tokens[k], kinds[k] = shared[e]
    tokens[_OTHER], kinds[_OTHER] = (total or 0) - tokens.sum(), distinct - kinds.sum()
    classes = [k if k < len(top) else endings.get(_ending(w), _OTHER) for k, (w, _) in enumerate(head)]
    return Vocabulary({w: k for k, (w, _) in enumerate(head)}, np.array([c for _, c in head], float), np.array(classes, np.int64), endings, total or 0, distinct, tokens + 0.5 * (kinds + 1))


def _class_runs(docs: DataFrame, shared: object) -> DataFrame:
    """(code, n) of the class trigrams of each task; code is (before last * CLASSES + last) * CLASSES + class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, total = _Coder(shared.value), np.zeros(CLASSES**3, np.int32)
        for batch in chain.from_iterable(map(parts, batches)):
            tokens, lengths = _tokens(batch)
            c = coder(tokens)[1]
            codes, n = np.unique((_contexts(c, lengths) * CLASSES + c).astype(np.int32), return_counts=True)
            total[codes] += n.astype(np.int32)
        there = np.flatnonzero(total)
        for at in range(0, len(there), 1 << 16):
            part = there[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part].astype(np.int64))], schema=arrow_schema("code long, n long"))

    return written(docs.select("text").mapInArrow(run, "code long, n long"), "runs")


def _contexts(classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The code of the two classes before each token, in texts of these lengths, at least 1, one after the other."""
    first = np.cumsum(lengths) - lengths
    before, last = np.concatenate(([_START, _START], classes))[:-2], np.concatenate(([_START], classes))[:-1]
    before[first] = last[first] = before[first[lengths > 1] + 1] = _START
    return before * CLASSES + last


@dataclass(frozen=True)
class Network:
    """Vectors of context classes and targets, scales of the two places, biases."""

    context: np.ndarray
    target: np.ndarray
    scale: np.ndarray
    bias: np.ndarray

    def log10(self, contexts: np.ndarray) -> np.ndarray:
        """Normalised log10 probabilities of all classes in each context, by one matrix product."""
        predicted = self.scale[0] * self.context[contexts // CLASSES] + self.scale[1] * self.context[contexts % CLASSES]
        z = predicted @ self.target.T + self.bias
        top = z.max(1, keepdims=True)
        return (z - top - np.log(np.exp(z - top).sum(1, keepdims=True))) / np.log(10)


def _noise(class_counts: np.ndarray) -> np.ndarray:
    noise = class_counts.copy()
    noise[_START] = 1e-9
    return noise / noise.sum()


def _begin(noise: np.ndarray, draw: np.random.Generator) -> list[np.ndarray]:
    """Parameters, then Adagrad's sums for each."""
    p = [draw.normal(0, 0.1, (CLASSES, WIDTH)), draw.normal(0, 0.1, (CLASSES, WIDTH)), np.ones((2, WIDTH)), np.log(noise)]
    return p + [np.full_like(x, 1e-2) for x in p]


def _network(state: list[np.ndarray]) -> Network:
    bias = state[3].copy()
    bias[_START] = -1e4  # never a target
    return Network(state[0], state[1], state[2], bias)


def steps(tokens: int) -> int:
    """Batches of training for so many tokens: each token is drawn once on average."""
    return max(STEPS, -(-tokens // BATCH))


def _places(share: np.ndarray, at: np.ndarray) -> np.ndarray:
    """np.searchsorted(share, at), by ascending order, so that neighbours in a long share are read together."""
    flat = at.ravel()
    order, out = np.argsort(flat), np.empty(len(flat), np.int64)
    out[order] = np.searchsorted(share, flat[order])
    return out.reshape(at.shape).clip(0, len(share) - 1)


def _descend(state: list[np.ndarray], codes: np.ndarray, counts: np.ndarray, noise: np.ndarray, n: int, draw: np.random.Generator, done: float = 0.0, part: float = 1.0) -> None:
    """n steps of noise-contrastive estimation on draws from the trigrams' counts, with Adagrad; before them was the share done of all, they are the share part.

    A score is a sum of two products of a context class, scaled for its place, and
    a target. A batch has more tokens than there are classes, so all products are
    computed once, and the errors of tokens are summed by pairs of context class and
    target before they go back through the vectors. Context classes of the last
    place count from CLASSES on.
    """
    share = np.cumsum(counts, dtype=float)
    share /= share[-1]
    noise_sums, rate_of = np.cumsum(noise), np.log(noise) + np.log(NOISE)
    p, seen = (np.concatenate([x.ravel() for x in half]) for half in (state[:4], state[4:]))
    g, ends, wide = np.empty_like(p), np.cumsum([x.size for x in state[:3]]), np.arange(NOISE)

    def shaped(flat: np.ndarray) -> list[np.ndarray]:
        return [x.reshape(like.shape) for x, like in zip(np.split(flat, ends), state, strict=False)]

    (context, target, scale, bias), (g_context, g_target, g_scale, g_bias) = shaped(p), shaped(g)
    for step in range(n):
        at = step % STRETCH
        if at == 0:
            drawn = draw.random((min(STRETCH, n - step), BATCH + NOISE))
            code = codes[_places(share, drawn[:, :BATCH])].astype(np.int64)
            trues, falses = code % CLASSES, _places(noise_sums, drawn[:, BATCH:])  # noise is shared by a batch
            rows = np.stack([code // CLASSES // CLASSES, CLASSES + code // CLASSES % CLASSES], 1)
        true, false, row = trues[at], falses[at], rows[at]
        scaled = np.concatenate([scale[0] * context, scale[1] * context])
        product, threshold, pair = scaled @ target.T, bias - rate_of, row * CLASSES + true
        # the classifier's error: data or noise, from the score less the log of the noise's rate
        d_true = 1 / (1 + np.exp(-(product.take(pair).sum(0) + threshold[true]).clip(-30, 30))) - 1
        of_false = product[:, false]
        of_false[:CLASSES] += threshold[false]
        d_false = of_false.take(row[0], 0)
        d_false += of_false.take(row[1], 0)
        d_false = 1 / (1 + np.exp(-d_false.clip(-30, 30, out=d_false)))
        by_true = np.bincount(pair.ravel(), np.tile(d_true, 2), 2 * CLASSES**2).reshape(2 * CLASSES, CLASSES)
        by_false = np.concatenate([np.bincount((r[:, None] * NOISE + wide).ravel(), d_false.ravel(), CLASSES * NOISE) for r in (row[0], row[1] - CLASSES)]).reshape(2 * CLASSES, NOISE)
        back = (by_true @ target + by_false @ target[false]).reshape(2, CLASSES, WIDTH)
        g_context[:] = back[0] * scale[0] + back[1] * scale[1]
        g_scale[:] = (back * context).sum(1)
        g_target[:] = by_true.T @ scaled
        np.add.at(g_target, false, by_false.T @ scaled)
        g_bias[:] = np.bincount(true, d_true, CLASSES)
        np.add.at(g_bias, false, by_false[:CLASSES].sum(0))
        rate = RATE * (1 - done - part * step / n) + 0.002
        g /= BATCH
        seen += g * g
        p -= rate * g / np.sqrt(seen)
    for x, new in zip(state, shaped(p) + shaped(seen), strict=True):
        x[:] = new


def train(codes: np.ndarray, counts: np.ndarray, seed: int = 5) -> Network:
    """The network of these trigrams, by one task alone."""
    draw, order = np.random.default_rng(seed), np.argsort(codes)
    noise = _noise(np.bincount(codes % CLASSES, counts, CLASSES) + 0.5)
    state = _begin(noise, draw)
    _descend(state, codes[order], counts[order], noise, steps(int(counts.sum())), draw)
    return _network(state)


def train_apart(runs: DataFrame, class_counts: np.ndarray, seed: int = 5) -> Network:
    """The network of runs(code, n), trained where they lie."""
    noise = _noise(class_counts)
    state = _begin(noise, np.random.default_rng(seed))
    for number in range(ROUNDS):
        sums = runs.mapInArrow(_tasks(state, noise, number, seed), "place int, value long").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").toArrow()
        value = sums.column("value").to_numpy()
        mean, at = value[:-1] / (float(value[-1]) * UNIT), np.cumsum([0, *(x.size for x in state)])
        state = [mean[low:high].reshape(x.shape) for x, low, high in zip(state, at, at[1:])]
    return _network(state)


def _tasks(state: list[np.ndarray], noise: np.ndarray, number: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A round: (place, parameter times tokens in UNIT) of each task, and its tokens in the last place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            np.add.at(total, batch.column("code").to_numpy(), batch.column("n").to_numpy())
        codes = np.flatnonzero(total)
        if not len(codes):
            return
        counts, own = total[codes], [x.copy() for x in state]
        del total
        tokens = int(counts.sum())
        _descend(own, codes, counts, noise, -(-steps(tokens) // ROUNDS), np.random.default_rng([seed, number]), number / ROUNDS, 1 / ROUNDS)
        flat = np.concatenate([x.ravel() for x in own])
        value = np.append(np.rint(flat * tokens * UNIT).astype(np.int64), tokens)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value)], schema=arrow_schema("place int, value long"))

    return run


def _held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1


def _parts(docs: DataFrame, shared: object, network: Network) -> DataFrame:
    """Sums of each text, and the words that are not in the head; log10 of their counts is yet to be added to both sums."""
    ddl = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, model double, tail array<binary>, tail_n array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(__name__)
        own, schema = shared.value, arrow_schema(ddl)
        coder = _Coder(own)
        log10 = np.concatenate([network.log10(k * CLASSES + np.arange(CLASSES)).astype(np.float32) for k in range(CLASSES)])
        count = np.append(np.log10(own.counts + 0.5), 0.0)  # the last place is that of words outside the head
        base, total = count - np.log10(own.tokens + 0.5 * (own.distinct + 1)), np.log10(own.class_total)
        alone = min(HEAD_CLASSES, len(own.counts))
        count[:alone] = total[:alone]  # alone in their classes

        for batch in chain.from_iterable(map(parts, batches)):
            tokens, lengths = _tokens(batch)
            places, classes = coder(tokens)
            first, here = np.cumsum(lengths) - lengths, places >= 0
            known = np.add.reduceat(here.astype(np.int64), first)
            model = log10[_contexts(classes, lengths), classes] + (count[places] - total[classes])
            sums = (lengths, known, np.add.reduceat(base[places], first), np.add.reduceat(model, first))
            # each text's other words, once each, with their numbers
            tail = tokens.take(pa.array(np.flatnonzero(~here))).dictionary_encode()
            kinds = max(1, len(tail.dictionary))
            key, n = np.unique(np.repeat(np.arange(len(lengths)), lengths - known) * kinds + tail.indices.to_numpy(), return_counts=True)
            offsets = pa.array(np.searchsorted(key, np.arange(len(lengths) + 1) * kinds), pa.int32())
            lists = (tail.dictionary.take(pa.array(key % kinds)).cast(pa.binary()), pa.array(n, pa.int32()))
            columns = [batch.column(c) for c in ("row", "doc_id", "held_out")] + [pa.array(x) for x in sums] + [pa.ListArray.from_arrays(offsets, x) for x in lists]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = texts(docs).withColumns({"held_out": _held_out(), "row": F.monotonically_increasing_id()})
    return rows.mapInArrow(run, ddl)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row for each document."""
    spark = docs.sparkSession
    training = texts(docs).where(~_held_out())
    counts = written(_counted(training), "counts")
    known = vocabulary(counts)
    shared = spark.sparkContext.broadcast(known)
    if known.tokens:
        network = train_apart(_class_runs(training, shared), known.class_total)
    else:
        network = Network(np.zeros((CLASSES, 1)), np.zeros((CLASSES, 1)), np.zeros((2, 1)), np.zeros(CLASSES))
    scored = written(_parts(docs, shared, network), "parts")
    rare = scored.select("row", F.explode(F.arrays_zip("tail", "tail_n")).alias("t")).select("row", F.col("t.tail").alias("word"), F.col("t.tail_n").alias("n"))
    least = float(known.counts[-1]) if len(known.head) == HEAD else 0.0  # no word outside the head is more frequent
    each = rare.join(counts.where(F.col("c") <= least), "word", "left").select(
        "row",
        F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0).alias("known"),
        (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("count"),
    )
    sums = each.groupBy("row").agg(F.sum("known").alias("tail_known"), F.sum("count").alias("tail_count"))
    base, model = (F.col(x) + F.coalesce("tail_count", F.lit(0.0)) for x in ("base", "model"))
    return scored.drop("tail", "tail_n").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        base.alias("base_score"),
        (model if known.tokens else base).alias("score"),
    )


def op9_lm_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
