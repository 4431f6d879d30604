"""Byte-level BPE, encoded and decoded by recursive DuckDB queries in each partition.

A partition's texts are taken in runs of about RUN_BYTES. Words (matches of the
pattern) of a run that are new become rows (word, position, id), at first one
for each byte. A recursive query joins neighbours with the merge table and
contracts the leftmost pair of least rank in every word, round by round, until
no word has a pair. The merge table has a row for every way to split a token
into two; the merged id is the rank (mark: twice that, plus 1 for the tokens of
_alone).
An ordered aggregation gives each word's ids, and one over the bytes of these
ids decodes them. A worker remembers the words of earlier runs, about MEMO_BYTES
of them: beyond that, those used least are forgotten.

In the same round other pairs of a word are contracted too, where that changes
nothing: pairs that no other merge can come before, whatever happens around them
(_WORDS), and in long pieces further places of the same pair, so that a long run
of one letter takes few rounds (_RUNS). Tokens that may then have a merge of a
lower rank (_alone) are contracted at the leftmost place alone.

Words of more than WHOLE bytes are cut before at places that no token of the
vocabulary, wherever it occurs in the word, lies across: no merge can cross
them. New words are merged in blocks of about BLOCK_BYTES, a longer piece alone.

Defined cases: a null text is empty; an empty text has no ids; null ids are
kept; repeated rows give repeated results; other columns are ignored; an empty
table gives no rows. Special tokens in a text are ordinary text. A word that is
a token itself is that token, as in the library.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import islice

import ahocorasick
import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from driftlens.llm.common import PART_BYTES, arrow_schema, forget_others, memory, parts, release, table, texts
from driftlens.sources.store import workers_know

WHOLE, RUN_BYTES, BLOCK_BYTES, MEMO_BYTES = 24, 4 << 20, 256 << 10, 64 << 20
#: What a remembered word takes beside its own bytes, about.
_ENTRY = 220
#: Ids and their ranges: pairs and (id, byte) are one number each.
_STEP = 1 << 20
#: For words. Beside the leftmost pair of least rank, pairs are contracted that nothing can come before: whatever may stand left of such a pair, or
#: right of it, and ends or begins with the byte that is there, has no merge with it of a lower rank (before and after are the least such ranks).
_WORDS = f"""
WITH RECURSIVE begun AS (
  SELECT *, lead(CASE WHEN pos > word THEN id END) OVER (ORDER BY pos) AS beside FROM fresh
), merging AS (
  SELECT begun.*, mark, before, after, 0 AS round
  FROM begun LEFT JOIN merges ON pair = id::BIGINT * {_STEP} + beside LEFT JOIN befores ON befores.place = left_byte * {_STEP} + id LEFT JOIN afters ON afters.place = right_byte * {_STEP} + id
  UNION ALL
  SELECT u.word, u.pos, u.id, u.left_byte, u.right_byte, u.beside, merges.mark, befores.before, afters.after, u.round FROM (
    SELECT word, pos, left_byte, round + 1 AS round,
      CASE WHEN chosen THEN right_byte1 ELSE right_byte END AS right_byte,
      CASE WHEN chosen THEN mark >> 1 ELSE id END AS id,
      CASE WHEN beside IS NULL THEN NULL WHEN NOT chosen THEN CASE WHEN chosen1 THEN mark1 >> 1 ELSE beside END
           WHEN chosen2 AND beside1 IS NOT NULL THEN mark2 >> 1 ELSE beside1 END AS beside
    FROM (
      SELECT *, lag(chosen) OVER o AS gone, lead(chosen) OVER o AS chosen1, lead(chosen, 2) OVER o AS chosen2,
        lead(mark) OVER o AS mark1, lead(mark, 2) OVER o AS mark2, lead(beside) OVER o AS beside1, lead(right_byte) OVER o AS right_byte1
      FROM (
        SELECT *, mark IS NOT NULL AND (pos = leftmost OR mark & 1 = 0 AND mark < coalesce(before, 2147483647) AND mark < coalesce(after1, 2147483647)) AS chosen
        FROM (
          SELECT *, lead(after) OVER (ORDER BY pos) AS after1 FROM merging JOIN (
            SELECT word, (least & 4294967295)::INTEGER AS leftmost
            FROM (SELECT word, min((mark::BIGINT << 32) + pos) AS least FROM merging GROUP BY word) WHERE least IS NOT NULL
          ) USING (word)
        )
      ) WINDOW o AS (ORDER BY pos)
    ) WHERE gone IS DISTINCT FROM true
  ) u LEFT JOIN merges ON pair = u.id::BIGINT * {_STEP} + u.beside LEFT JOIN befores ON befores.place = u.left_byte * {_STEP} + u.id LEFT JOIN afters ON afters.place = u.right_byte * {_STEP} + u.id
)"""
#: For long pieces, which may be runs of one letter: the pair of least rank, at every other place where such pairs overlap. All of these have one size,
#: so places count from where the first one begins.
_RUNS = f"""
WITH RECURSIVE begun AS (
  SELECT word, pos, pos + 1 AS stop, id, lead(CASE WHEN pos > word THEN id END) OVER (ORDER BY pos) AS beside FROM fresh
), merging AS (
  SELECT begun.*, mark, 0 AS round FROM begun LEFT JOIN merges ON pair = id::BIGINT * {_STEP} + beside
  UNION ALL
  SELECT u.word, u.pos, u.stop, u.id, u.beside, merges.mark, u.round FROM (
    SELECT word, pos, round + 1 AS round,
      CASE WHEN chosen THEN stop1 ELSE stop END AS stop,
      CASE WHEN chosen THEN best >> 1 ELSE id END AS id,
      CASE WHEN chosen AND chosen2 AND beside1 IS NOT NULL OR NOT chosen AND chosen1 AND beside IS NOT NULL THEN best >> 1
           WHEN chosen THEN beside1 ELSE beside END AS beside
    FROM (
      SELECT *, lead(beside) OVER o AS beside1, lag(chosen) OVER o AS gone, lead(chosen) OVER o AS chosen1, lead(chosen, 2) OVER o AS chosen2
      FROM (
        SELECT *, coalesce(mark = best AND (pos - greatest(since, word)) % (stop1 - pos) = 0 AND (best & 1 = 0 OR pos = leftmost), false) AS chosen
        FROM (
          SELECT *, lead(stop) OVER o AS stop1, max(CASE WHEN mark IS DISTINCT FROM best THEN stop END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since
          FROM merging JOIN (
            SELECT word, (least >> 32)::INTEGER AS best, (least & 4294967295)::INTEGER AS leftmost
            FROM (SELECT word, min((mark::BIGINT << 32) + pos) AS least FROM merging GROUP BY word) WHERE least IS NOT NULL
          ) USING (word) WINDOW o AS (ORDER BY pos)
        )
      ) WINDOW o AS (ORDER BY pos)
    ) WHERE gone IS DISTINCT FROM true
  ) u LEFT JOIN merges ON pair = u.id::BIGINT * {_STEP} + u.beside
)"""
_ENDED = """
SELECT list(id ORDER BY pos) AS ids, list(token ORDER BY pos) AS tokens
FROM merging JOIN (SELECT word, max(round) AS round FROM merging GROUP BY word) USING (word, round) JOIN vocabulary USING (id)
GROUP BY word ORDER BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _passes(ranks: dict[bytes, int], state: list[bytes]) -> bool:
    """Whether merging the bytes of these tokens, on their own, comes to this state."""
    now = [bytes([b]) for b in b"".join(state)]
    while len(now) > len(state):
        found = [(r, k) for k in range(len(now) - 1) if (r := ranks.get(now[k] + now[k + 1])) is not None]
        if not found:
            return False
        k = min(found)[1]
        now[k : k + 2] = [now[k] + now[k + 1]]
    return now == state


def _splits(ranks: dict[bytes, int], token: bytes) -> list[tuple[bytes, bytes]]:
    return [(token[:k], token[k:]) for k in range(1, len(token)) if token[:k] in ranks and token[k:] in ranks]


def _alone(ranks: dict[bytes, int]) -> set[int]:
    """Tokens that must be contracted at one place at a time.

    Those after whose contraction, of a and b, a merge with a neighbour y can
    have a lower rank, though b and y have none. No merge crosses the edges of
    what becomes a, b and y, so their bytes come to that state in a word only if
    they do so alone.
    """
    out = set()
    for token, rank in ranks.items():
        for a, b in _splits(ranks, token):
            x, y = ranks[a], ranks[b]
            if x > rank and x not in out and any(ranks.get(q + b, len(ranks)) > x and _passes(ranks, [p, q, b]) for p, q in _splits(ranks, a)):
                out.add(x)
            if y > rank and y not in out and any(ranks.get(a + p, len(ranks)) >= y and _passes(ranks, [a, p, q]) for p, q in _splits(ranks, b)):
                out.add(y)
    return out


class _Numbers(dict):
    """word: its number, in the order in which words are first seen."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class Codec:
    """Encodes and decodes texts by one rank file."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN):
        ranks = read_ranks(path)
        self.pattern = regex.compile(pattern)
        self.forget()
        tokens, ids = list(ranks), np.fromiter(ranks.values(), np.int64, len(ranks))
        splits = [(a, b, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
        lhs, rhs, merged = np.array(splits, np.int64).reshape(-1, 3).T
        self.bytes_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        self.ranks, self.names = ranks, {rank: token for token, rank in ranks.items()}
        self.automaton: ahocorasick.Automaton | None = None
        self.db = duckdb.connect(config={"threads": "1", "temp_directory": "", "allocator_flush_threshold": "1MB", "allocator_bulk_deallocation_flush_threshold": "1MB"})
        alone = _alone(ranks)
        merges = pa.table({"pair": pa.array(lhs * _STEP + rhs), "mark": pa.array(2 * merged + np.isin(merged, list(alone)), pa.int32())})
        vocabulary = pa.table({"id": pa.array(ids, pa.int32()), "token": pa.array(tokens, pa.binary())})
        # the least mark of a merge of a token with anything that ends, or begins, with a byte
        ends = np.zeros((2, int(ids.max()) + 1), np.int64)
        ends[:, ids] = np.array([[t[-1] for t in tokens], [t[0] for t in tokens]])
        bounds = {}
        for name, places in (("before", ends[0][lhs] * _STEP + rhs), ("after", ends[1][rhs] * _STEP + lhs)):
            place, at = np.unique(places, return_inverse=True)
            least = np.full(len(place), np.iinfo(np.int32).max)
            np.minimum.at(least, at, 2 * merged)
            bounds[f"{name}s"] = pa.table({"place": pa.array(place), name: pa.array(least, pa.int32())})
        for name, rows in (("merges", merges), ("vocabulary", vocabulary), *bounds.items()):
            self.db.register("rows", rows)
            self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM rows")
            self.db.unregister("rows")

    def forget(self, share: float = 0.0) -> None:
        """Keeps about this share of MEMO_BYTES, the words that were used most, each with half of its uses."""
        if not share:
            self.numbers, self.ids, self.back, self.held, self.uses = _Numbers(), [], [], 0, np.zeros(0, np.int32)
            return
        order = np.argsort(-self.uses, kind="stable")
        words, ids, back = list(self.numbers), self.ids, self.back
        sizes = np.fromiter((_ENTRY + len(ids[k]) + 2 * len(back[k]) for k in order.tolist()), np.int64, len(order))
        kept = order[: int(np.searchsorted(np.cumsum(sizes), share * MEMO_BYTES))].tolist()
        uses = self.uses[kept] // 2
        self.forget()
        self.numbers.update((words[k], n) for n, k in enumerate(kept))
        self.ids, self.back, self.uses, self.held = [ids[k] for k in kept], [back[k] for k in kept], uses, int(sizes[: len(kept)].sum())
        del words, ids, back
        release()

    def _pieces(self, word: bytes) -> list[bytes]:
        """A long word, cut where no token that occurs in it lies across."""
        if self.automaton is None:
            self.automaton = ahocorasick.Automaton()
            for token in self.ranks:
                if len(token) > 1:
                    self.automaton.add_word(token.decode("latin-1"), len(token))
            self.automaton.make_automaton()
        across = np.zeros(len(word) + 1, np.int64)
        for end, size in self.automaton.iter(word.decode("latin-1")):
            across[end - size + 2] += 1
            across[end + 1] -= 1
        cuts = np.flatnonzero(np.cumsum(across)[1 : len(word)] == 0) + 1
        edges = [0, *cuts.tolist(), len(word)]
        return [word[x:y] for x, y in zip(edges, edges[1:])]

    def _merged(self, pieces: list[bytes], query: str) -> tuple[list[bytes], list[bytes]]:
        """(ids, bytes decoded from them) of each piece, by one recursive query. A piece's number is its first byte's place among all."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(pieces), np.uint8)
        word, around = np.repeat(ends - sizes, sizes), np.concatenate(([0], raw, [0])).astype(np.int32)
        left, right = around[:-2].copy(), around[2:].copy()
        left[ends - sizes], right[ends - 1] = 256, 256  # nothing is there
        self.db.register("fresh", pa.table({"word": pa.array(word.astype(np.int32)), "pos": pa.array(np.arange(len(raw), dtype=np.int32)), "id": pa.array(self.bytes_id[raw]), "left_byte": pa.array(left), "right_byte": pa.array(right)}))
        found = self.db.sql(query + _ENDED).to_arrow_table().combine_chunks()
        self.db.unregister("fresh")
        lists, tokens = found.column("ids").chunk(0), found.column("tokens").chunk(0).flatten()
        bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        flat = lists.flatten().to_numpy().astype("<u4").tobytes()
        starts = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset : tokens.offset + len(tokens) + 1]
        text = tokens.buffers()[2].to_pybytes()
        at, spelled = (4 * bounds).tolist(), starts[bounds].tolist()
        return [flat[x:y] for x, y in zip(at, at[1:])], [text[x:y] for x, y in zip(spelled, spelled[1:])]

    def merged(self, pieces: list[bytes], query: str = _WORDS) -> tuple[list[bytes], list[bytes]]:
        """The same for any number of pieces, in blocks of about BLOCK_BYTES."""
        ids, back, first, size = [], [], 0, 0
        for k, piece in enumerate(pieces):
            if size and size + len(piece) > BLOCK_BYTES:
                for out, more in zip((ids, back), self._merged(pieces[first:k], query), strict=True):
                    out += more
                first, size = k, 0
            size += len(piece)
        for out, more in zip((ids, back), self._merged(pieces[first:], query) if size else ((), ()), strict=True):
            out += more
        return ids, back

    def learn(self, words: list[bytes]) -> None:
        """Encodes and decodes the words that were numbered since the last call, in order."""
        n = len(self.ids)
        self.ids += [b""] * len(words)
        self.back += [b""] * len(words)
        short, long = [], []
        for k, word in enumerate(words, n):
            if (rank := self.ranks.get(word)) is not None:
                self.ids[k], self.back[k] = rank.to_bytes(4, "little"), self.names[rank]
            else:
                (short if len(word) <= WHOLE else long).append(k)
        for k, a, b in zip(short, *self.merged([words[k - n] for k in short]), strict=True):
            self.ids[k], self.back[k] = a, b
        if long:
            cut = [self._pieces(words[k - n]) for k in long]
            pieces = list(dict.fromkeys(p for own in cut for p in own))
            done = dict(zip(pieces, zip(*self.merged(pieces, _RUNS), strict=True), strict=True))
            for k, own in zip(long, cut, strict=True):
                self.ids[k], self.back[k] = (b"".join(x) for x in zip(*map(done.__getitem__, own), strict=True))
        self.held += sum(map(len, self.ids[n:])) + 2 * sum(map(len, self.back[n:])) + _ENTRY * len(words)

    def encode(self, run: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """(ids as little-endian unsigned 32-bit integers, bytes decoded from them) of each text."""
        if self.held > MEMO_BYTES:
            self.forget(0.5)
        known, number = len(self.numbers), self.numbers.__getitem__
        rows = [np.fromiter(map(number, self.pattern.findall(t)), np.int32) for t in run]
        if not rows:
            return
        if len(self.numbers) > known:
            self.learn([w.encode() for w in islice(self.numbers, known, None)])
        used = np.bincount(np.concatenate(rows), minlength=len(self.ids)).astype(np.int32)
        used[: len(self.uses)] += self.uses
        self.uses = used
        ids, back = self.ids.__getitem__, self.back.__getitem__
        for row in rows:
            own = row.tolist()
            yield b"".join(map(ids, own)), b"".join(map(back, own))


_codecs: dict[str, Codec] = memory(__name__)


def codec(path: str) -> Codec:
    """The worker's codec for a rank file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _coded(docs: DataFrame, path: str, ddl: str, columns: Callable[[list[bytes], list[bytes]], list[list]]) -> DataFrame:
    """doc_id and what columns makes of the ids and of the decoded bytes of a run of texts."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
        ids, held, size = [], [], 0
        for batch in batches:
            for part in parts(batch):
                ids += part.column("doc_id").to_pylist()
                held += part.column("text").to_pylist()
                size += part.nbytes
                if size >= RUN_BYTES:
                    yield ids, held
                    ids, held, size = [], [], 0
        if held:
            yield ids, held

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(__name__)
        schema, own = arrow_schema(ddl), codec(path)
        for ids, held in runs(batches):
            at = size = 0
            found: list[tuple[bytes, bytes]] = []
            for pair in own.encode(held):
                found.append(pair)
                size += len(pair[0])
                if size >= PART_BYTES or at + len(found) == len(held):
                    out = [ids[at : at + len(found)], *columns([a for a, _ in found], [b for _, b in found])]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
                    at, size, found = at + len(found), 0, []

    workers_know(docs.sparkSession)
    return texts(docs).mapInArrow(work, ddl)


def _digest(parts_: list[bytes]) -> list[str]:
    return [hashlib.sha256(x).hexdigest() for x in parts_]


def _arrays(ids: list[bytes]) -> list[np.ndarray]:
    return [np.frombuffer(x, "<u4") for x in ids]


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded): the ids of each text and the text that they decode to."""
    return _coded(docs, path, "doc_id long, ids array<int>, decoded string", lambda ids, back: [_arrays(ids), [b.decode() for b in back]])


def encode_ids(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded_sha256): as encode_decode, with a digest in place of the text."""
    return _coded(docs, path, "doc_id long, ids array<int>, decoded_sha256 string", lambda ids, back: [_arrays(ids), _digest(back)])


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text."""
    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _coded(docs, path, ddl, lambda ids, back: [[len(x) // 4 for x in ids], _digest(ids), _digest(back)])


def op2_bpe_duckdb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
