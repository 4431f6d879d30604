"""Benchmark decontamination by edit distance.

An item is found in a document if some run of the document's words is within
TOLERANCE of it: word edits, at most that share of the item's words, rounded
down. Words are runs of letters and digits, A-Z lower-cased, so case, spacing
and punctuation do not hide a passage.

Candidates come from the CGK random walk, which maps edit distance to Hamming
distance: in each step it puts out the word under its pointer and moves on or
stays by a random bit of (step, word). A walk starts at every word of a document
and, for an item, at its first words up to as many as it may have edits, so that
windows are as long as the item, give or take its edits; steps whose pointer has
left the item are not sampled. So walks of a document serve items of all sizes.
Two walks over texts that differ by an edit come together again after it, and stay
so until the next one. A sampling therefore takes its steps within one stretch of
the walk, and samplings repeat along it: an occurrence is found where two walks
are together in any of them. Steps beyond FIRST are only walked from every second
word on, those beyond twice as many from every fourth one, and so on, as longer
items hold more starts. Samples of an item that hold too few of its words are left
out. `tests/llm/test_decontam.py` measures the recall that this reaches for each
length of items, at the most edits an item may have.

Samples that are equal mark (item, place) on a map of bounded size, whatever their
number; what is marked is confirmed by the exact edit distance of the item to the
best run of words around. Items too short for an edit are looked up whole.

Items are a stated query set: they are broadcast, and one pass over the documents
looks for all of them, in blocks of BLOCK items, BATCH words at a time.

Defined cases: items without words (or null texts) match nothing; items of fewer
than 5 words may have no edit and are matched exactly as word runs; null and empty documents match nothing; rows with
null ids are reported with a null id; repeated rows are reported each; other
columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import forget_others, map_rows, memory, parts, table, texts
from driftlens.llm.wordhash import grouped, hashed_words, mix, word_table
from driftlens.sources.store import workers_know

TOLERANCE, BLOCK = 0.2, 2000
#: Items of fewer words are short: they have more walks, and samples that hold fewer words.
SHORT = 15
#: Steps that are walked from every word on, and stretches sampled in them and in each later part of a walk.
FIRST, STRETCHES = 40, 8
#: Starts within an item are at most so many, spread over as many words as it may have edits.
STARTS = 32
#: Words a batch has, places that share a mark, candidates taken at once, marks of a batch above which items are first held against all its words.
BATCH, GRAIN, AT_ONCE, MANY = 1 << 16, 16, 1 << 20, 1000
_ALNUM = word_table("alnum")
_PIECE = np.random.default_rng(13).integers(1, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.random.default_rng(11).integers(1, 1 << 62, 8, np.int64) * 2 + 1


def _odd(walk: int, n: int) -> np.ndarray:
    """An odd factor for each of the first n steps of a walk: the sign of its product with a word is the random bit."""
    return mix((np.uint64(walk + 1) << np.uint64(32)) + np.arange(n, dtype=np.uint64)).view(np.int64) | 1


def words(text: str) -> np.ndarray:
    """Hashes of the words of a text."""
    return hashed_words([text.encode().lower()], _ALNUM)[0]


def _symbols(tokens: np.ndarray) -> np.ndarray:
    """The alphabet of the walks: hashes, and one more symbol for what lies beyond the end."""
    return np.append(tokens.view(np.int64) | 1, 0)


@dataclass(frozen=True)
class Sampling:
    """Steps of a walk whose symbols make a key."""

    walk: int
    steps: tuple[int, ...]


def _samplings(walks: int, keys: int, stretch: int, firsts: list[int]) -> list[Sampling]:
    draw = np.random.default_rng(12 + keys)
    return [Sampling(w, tuple(int(k) for k in first + np.sort(draw.choice(stretch, keys, replace=False)))) for w in range(walks) for first in firsts]


def short_samplings() -> list[Sampling]:
    """Three of four steps, in four walks: two or three words."""
    return _samplings(4, 3, 4, list(range(0, 2 * SHORT - 4, 2)))


def long_samplings(most: int) -> list[Sampling]:
    """Five of ten steps, in two walks, as far as items of most words go: three to five words."""
    firsts, low, high = [], 0, FIRST
    while low < 2 * most:
        firsts += np.linspace(low, high - 10, STRETCHES).astype(int).tolist()
        low, high = high, 2 * high
    return _samplings(2, 5, 10, [f for f in firsts if f < 2 * most])


def samples(symbols: np.ndarray, starts: np.ndarray, samplings: list[Sampling], thin: bool) -> Iterator[tuple[Sampling, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(sampling, starts, keys, different words in a sample, last symbol) of the CGK walks from starts; thin: later steps from fewer starts."""
    for walk in sorted({s.walk for s in samplings}):
        own = [s for s in samplings if s.walk == walk]
        n = 1 + max(s.steps[-1] for s in own)
        at_step = [[(s, s.steps.index(step)) for s in own if step in s.steps] for step in range(n)]
        odd, at, pointer = _odd(walk, n), starts, starts.copy()
        first, every = FIRST, 2
        state: dict[Sampling, list[np.ndarray]] = {}
        for step in range(n):
            if thin and step == first:
                keep = at % every == 0
                at, pointer = at[keep], pointer[keep]
                first, every = 2 * first, 2 * every
            under = symbols.take(pointer, mode="clip")
            for s, k in at_step[step]:
                if not k:
                    state[s] = [np.zeros(len(at), np.int64), np.ones(len(at), np.int8), pointer.copy()] if not thin else [np.zeros(len(at), np.int64)]
                key = state[s][0]
                key ^= under
                key *= _MIX[k]
                key ^= key >> 29
                if not thin:
                    state[s][1] += pointer > state[s][2]
                    state[s][2] = pointer.copy()
                if k + 1 == len(s.steps):
                    yield s, at, key, state[s][1] if not thin else key, under
                    del state[s]
            pointer += (under * odd[step]) < 0


def runs(tokens: np.ndarray, width: int) -> np.ndarray:
    """A hash of the width words from each place on."""
    total = np.zeros(max(0, len(tokens) - width + 1), np.uint64)
    for k in range(width):
        total += tokens[k : k + len(total)] * _PIECE[k]
    return mix(total)


def edit_distance(item: np.ndarray, run: np.ndarray) -> tuple[int, int]:
    """(fewest edits from the item to any part of run, end of the first such part)."""
    ramp = np.arange(len(run) + 1)
    row = np.zeros(len(run) + 1, np.int64)
    for k, word in enumerate(item):
        best = np.minimum(row[1:] + 1, row[:-1] + (run != word))
        # insertions: a running minimum along the row
        row = np.minimum.accumulate(np.concatenate(([k + 1], best)) - ramp) + ramp
    end = int(row.argmin())
    return int(row[end]), end


@dataclass(frozen=True)
class Keys:
    """Keys of one kind, in order, with the item of each and its place in it."""

    keys: np.ndarray
    owner: np.ndarray
    offset: np.ndarray
    seen: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, owner: np.ndarray, offset: np.ndarray) -> Keys:
        order, seen = np.argsort(keys, kind="stable"), np.zeros(1 << 20, bool)
        seen[(keys & 0xFFFFF).astype(np.intp)] = True
        return cls(keys[order], owner[order], offset[order], seen)

    def hits(self, found: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(items, places where they would start) that share a key with what was found at these places, AT_ONCE or so together."""
        maybe = np.flatnonzero(self.seen.take((found & 0xFFFFF).astype(np.intp, copy=False)))
        low, high = np.searchsorted(self.keys, found[maybe], "left"), np.searchsorted(self.keys, found[maybe], "right")
        there = low < high
        at, low, n = at[maybe[there]], low[there], (high - low)[there]
        part = np.cumsum(n) // AT_ONCE
        for cut in np.split(np.arange(len(n)), np.flatnonzero(np.diff(part)) + 1) if len(n) else ():
            m = n[cut]
            row = np.repeat(low[cut] - np.cumsum(m) + m, m) + np.arange(m.sum())
            yield self.owner[row], np.repeat(at[cut], m) - self.offset[row]


class Items:
    """A block of items and the keys of their samples."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.items = items
        self.sizes = np.array([len(w) for _, w in items], np.int64)
        self.allowed = (TOLERANCE * self.sizes).astype(np.int64)
        self.reach = int((self.sizes + self.allowed).max(initial=0)) + GRAIN
        self.whole: dict[int, Keys] = {}
        for width in sorted(set(self.sizes[self.allowed == 0].tolist())):
            own = np.flatnonzero(self.sizes == width)
            self.whole[width] = Keys.of(np.concatenate([runs(items[k][1], width) for k in own]).view(np.int64), own, np.zeros(len(own), np.int64))
        self.sampled: dict[Sampling, Keys] = {}
        edited, short = self.allowed > 0, self.sizes < SHORT
        self._sample(np.flatnonzero(edited & short), short_samplings())
        self._sample(np.flatnonzero(edited & ~short), long_samplings(int(self.sizes.max(initial=0))))

    def _sample(self, own: np.ndarray, samplings: list[Sampling]) -> None:
        if not len(own):
            return
        symbols = np.concatenate([_symbols(self.items[k][1]) for k in own])
        begin = np.cumsum(self.sizes[own] + 1) - self.sizes[own] - 1
        inside = [np.unique(np.linspace(0, d, min(d, STARTS) + 1).astype(np.int64)) for d in self.allowed[own]]
        offset, owner = np.concatenate(inside), np.repeat(own, [len(x) for x in inside])
        start = np.repeat(begin, [len(x) for x in inside]) + offset
        least = np.where(self.sizes[owner] < 10, 2, np.where(self.sizes[owner] < 30, 3, 4))
        for s, _, keys, different, last in samples(symbols, start, samplings, thin=False):
            good = (last != 0) & (different >= least)
            if good.any():
                self.sampled[s] = Keys.of(keys[good], owner[good], offset[good])

    def candidates(self, tokens: np.ndarray, symbols: np.ndarray, base: int) -> Iterator[tuple[int, int, int]]:
        """(item, from, to): where in tokens an item that begins in the batch from base on may lie, in order; what overlaps is one."""
        starts = np.arange(base, min(base + BATCH, len(tokens)))
        marks = np.zeros((len(self.items), (len(starts) + self.reach) // GRAIN + 2), bool)
        found = [(self.whole[w], k.view(np.int64), starts[: len(k)]) for w in self.whole if len(k := runs(tokens[base : base + BATCH + w - 1], w))]
        walked = ((self.sampled[s], keys, at) for s, at, keys, _, _ in samples(symbols, starts, list(self.sampled), thin=True)) if self.sampled else ()
        for table_, keys, at in itertools.chain(found, walked):
            for item, place in table_.hits(keys, at):
                marks[item, (place - base + self.reach) // GRAIN] = True
        marked = np.flatnonzero(marks.any(1))
        if not len(marked):
            return
        near = np.unique(tokens[max(0, base - 2 * self.reach) : base + BATCH + 2 * self.reach]) if np.count_nonzero(marks) > MANY else None
        for k in marked.tolist():
            item, allowed = self.items[k][1], int(self.allowed[k])
            if near is not None and np.count_nonzero(near[np.searchsorted(near, item).clip(max=len(near) - 1)] == item) < len(item) - allowed:  # each word that is not there is an edit
                continue
            low = np.flatnonzero(marks[k]) * GRAIN + base - self.reach - allowed
            high = low + GRAIN + len(item) + 2 * allowed
            new = np.flatnonzero(np.append(True, low[1:] >= high[:-1]))
            for a, b in zip(low[new].tolist(), high[np.append(new[1:], len(low)) - 1].tolist(), strict=True):
                yield k, max(0, a), min(len(tokens), b)

    def matches(self, tokens: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item's number, edits, first word, end) of the best confirmed place of each item in each text, in order.

        Text k has tokens bounds[k] to bounds[k + 1].
        """
        best: dict[tuple[int, int], tuple[int, int]] = {}
        symbols = _symbols(tokens)
        for base in range(0, len(tokens), BATCH):
            for k, low, high in self.candidates(tokens, symbols, base):
                item, allowed = self.items[k][1], int(self.allowed[k])
                for text in range(int(np.searchsorted(bounds, low, "right")) - 1, int(np.searchsorted(bounds, high, "left"))):
                    first, last = max(low, int(bounds[text])), min(high, int(bounds[text + 1]))
                    run = tokens[first:last]
                    if len(run) < len(item) - allowed or np.count_nonzero(np.isin(item, run)) < len(item) - allowed:
                        continue
                    edits, end = edit_distance(item, run)
                    if edits <= allowed:
                        place = edits, end + first - int(bounds[text])
                        best[text, k] = min(best.get((text, k), place), place)
        return [(t, k, e, max(0, end - len(self.items[k][1])), end) for (t, k), (e, end) in sorted(best.items())]


class Finder:
    """The items of a benchmark, in blocks, prepared once in each worker."""

    def __init__(self, items: list[tuple[int, str]]):
        known = [(i, w) for i, t in items if len(w := words(t))]
        self.blocks = [Items(known[k : k + BLOCK]) for k in range(0, len(known), BLOCK)]

    def matches(self, texts_: list[str]) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(text, item id, edits, item's words, first word, end) of every item in every text, in order of text within a block and group."""
        raw = [t.encode().lower() for t in texts_]
        for part in grouped(raw):
            tokens, bounds = hashed_words(raw[part.start : part.stop], _ALNUM)
            for block in self.blocks:
                for text, k, edits, start, end in block.matches(tokens, bounds):
                    yield part.start + text, block.items[k][0], edits, len(block.items[k][1]), start, end


_finders: dict[str, Finder] = memory(__name__)


def _shared(benchmark: DataFrame) -> Callable[[], Finder]:
    """Sends the stated items to all workers; gives the worker's finder of them."""
    rows = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long"), "text").orderBy("item_id", "text").collect()
    shared, name = benchmark.sparkSession.sparkContext.broadcast([tuple(r) for r in rows]), uuid.uuid4().hex

    def finder() -> Finder:
        if name not in _finders:
            _finders.clear()
            _finders[name] = Finder(shared.value)
        return _finders[name]

    return finder


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, item_words, word_start, word_end) for every document that holds an item; clean documents have no row."""
    finder = _shared(benchmark)

    def make() -> Callable[[dict[str, list]], dict[str, list]]:
        own = finder()

        def one(columns: dict[str, list]) -> dict[str, list]:
            found = list(own.matches(columns["text"]))
            names = ("item_id", "edits", "item_words", "word_start", "word_end")
            return {"doc_id": [columns["doc_id"][m[0]] for m in found], **{n: [m[k] for m in found] for k, n in enumerate(names, 1)}}

        return one

    return map_rows(texts(docs), make, "doc_id long, item_id long, edits long, item_words long, word_start long, word_end long")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that hold an item; rows are judged where they are, without a shuffle, whatever their ids."""
    finder = _shared(benchmark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(__name__)
        own = finder()
        for batch in batches:
            for part in parts(batch):
                clean = np.ones(part.num_rows, bool)
                clean[[m[0] for m in own.matches([t or "" for t in part.column("text").to_pylist()])]] = False
                yield part.filter(pa.array(clean))

    workers_know(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op8_decontaminate_cgk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
