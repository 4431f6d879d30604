"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's set is its distinct shingles of five words. Its sketch has T
coordinates: in round i < T every element is hashed to a bin, in round T + b
every element goes to bin b, and a bin keeps the smallest value of the first
round that reaches it; rounds end when all bins are filled, so after 2 T rounds
at most, and agreement of coordinates concentrates around the similarity. Bands
of R coordinates make buckets of candidates (a pair of similarity 0.75 misses
all 32 bands with probability 5e-6), and links are confirmed on full sets.

Work that grows with the square of a bucket is avoided without a cap:
1. Documents of equal sets are one node.
2. In each bucket every node is verified against the smallest one.
3. Links make components. Only pairs of nodes in one bucket but in different
   components are left. A pair goes on only if its parity bitmaps (a bit for
   each of BITS hash values, flipped by every element) differ in few enough
   bits: each differing bit is an element of one set only, so no link is lost.
   Where a bucket has very many pairs left, it is divided by the node's other
   bands, again and again, which links most of its nodes at little cost.
4. Pairs that go on are verified and components are taken once more. Of the
   buckets that were divided, all pairs of nodes still in different components
   are then tried, block against block in tasks of bounded size, and verified:
   a division alone loses no pair.

Defined cases: documents without words (or null texts) have empty sets, are
linked with nothing and kept; rows with one id are one document; rows with null
ids take no part in links among themselves, have the component of documents
with ids of the same set, if there are any, else null, and are not kept; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import hot_keys, join_to_one, map_rows, table, texts, without_ids, written
from driftlens.llm.components import components
from driftlens.llm.wordhash import grouped, hashed_words, mix, word_table

WORDS, PERCENT = 5, 75
BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: A bucket with more pairs than these between components is divided by SPLITS other bands, DEPTH - 1 times at most; then blocks of BLOCK nodes are compared.
PAIRS, SPLITS, DEPTH, BLOCK = 1 << 20, 8, 4, 1024
#: Bits of parity bitmaps (for pairs), and of the map of ids whose sets are wanted.
BITS, WANTED = 1024, 1 << 26
#: Pairs of one node that are verified by one copy of its set.
SHARE = 256
_NONSPACE = word_table("nonspace")  # words end at space and 0x09 to 0x0D
_ODD = np.random.default_rng(7).integers(1, 1 << 63, WORDS + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_WIDTHS = _ODD[WORDS] * np.arange(WORDS + 1, dtype=np.uint64)
_SEEDS = np.random.default_rng(8).integers(1, 1 << 63, 2 * BINS, np.uint64)


def _shingled(each: np.ndarray) -> np.ndarray:
    if not len(each):
        return np.empty(0, np.uint64)
    width = min(WORDS, len(each))
    total = np.zeros(len(each) - width + 1, np.uint64)
    for k in range(width):
        total += each[k : len(each) - width + 1 + k] * _ODD[k]
    return np.unique(mix(total ^ _WIDTHS[width]))


def shingle_sets(texts_: list[str]) -> list[np.ndarray]:
    """The set of each document: distinct 64-bit hashes of its shingles, in order of hash."""
    raw, out = [t.encode().lower() for t in texts_], []
    for part in grouped(raw):
        hashes, bounds = hashed_words(raw[part.start : part.stop], _NONSPACE)
        out += [_shingled(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
    return out


def shingles(text: str) -> np.ndarray:
    return shingle_sets([text])[0]


def sketch(elements: np.ndarray) -> np.ndarray:
    """BINS coordinates of a set that is not empty."""
    out = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    low = np.uint64((1 << 55) - 1)
    for i in range(BINS):
        h = mix(elements ^ _SEEDS[i])
        np.minimum.at(out, (h >> np.uint64(57)).astype(np.intp), (h & low) | np.uint64(i << 55))
        if (out >> np.uint64(63) == 0).all():
            return out
    for b in np.flatnonzero(out >> np.uint64(63)):
        i = BINS + int(b)
        out[b] = (mix(elements ^ _SEEDS[i]) & low).min() | np.uint64(i) << np.uint64(55)
    return out


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One hash for each band; bands have different keys for equal coordinates."""
    parts = coordinates.reshape(BANDS, ROWS)
    total = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD[WORDS]
    for k in range(ROWS):
        total = mix(total + parts[:, k] * _ODD[k])
    return total


def parity(elements: np.ndarray) -> np.ndarray:
    """BITS bits as 64-bit integers; each element flips one."""
    odd = np.bincount((elements >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sketches() -> Callable[[dict[str, list]], dict[str, list]]:
    def one(columns: dict[str, list]) -> dict[str, list]:
        sets = shingle_sets(columns["text"])
        return {
            "doc_id": columns["doc_id"],
            "n_shingles": [len(s) for s in sets],
            "digest": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets],
            "bands": [band_keys(sketch(s)).view(np.int64) if len(s) else [] for s in sets],
            "bits": [parity(s) for s in sets],
        }

    return one


def _sets() -> Callable[[dict[str, list]], dict[str, list]]:
    return lambda columns: {"id": columns["doc_id"], "elements": [s.view(np.int64) for s in shingle_sets(columns["text"])]}


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, elements) of documents with these distinct ids, and of a few others.

    Texts are not shuffled while ids are few: a map of 8 bits for each id, WANTED
    bits (8 MB) at most, is broadcast and tells which documents may be wanted.
    Beyond that, documents are joined to the ids.
    """
    n = ids.count()
    if n > WANTED // 8:
        there = docs.join(ids, "doc_id", "left_semi")
    else:
        size = max(1 << 12, 1 << (8 * n).bit_length())
        bit = F.pmod(F.xxhash64("doc_id"), F.lit(size))
        mask = F.expr(f"shiftleft(1L, int(pmod(xxhash64(doc_id), {size}L) % 64))")
        wanted = ids.groupBy(F.floor(bit / 64).alias("place")).agg(F.bit_or(mask).alias("mask"))
        there = docs.withColumn("place", F.floor(bit / 64)).join(F.broadcast(wanted), "place").where(F.col("mask").bitwiseAND(mask) != 0)
    return written(map_rows(there.select("doc_id", "text"), _sets, "id long, elements array<long>"), "sets")


def _dealt(pairs: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
    """pairs with share_{side}, and (id, copies) of nodes with very many pairs (centres of stars): one copy of the set for each SHARE of them."""
    counts = pairs.groupBy(side).agg(F.count("*").alias("n")).where(F.col("n") > SHARE)
    many = written(counts.select(side, "n", F.ceil(F.col("n") / SHARE).cast("int").alias("copies")), "many")
    found = join_to_one(pairs, many.drop("n"), side, "left", hot_keys(many, side))
    share = F.coalesce(F.pmod(F.xxhash64("b" if side == "a" else "a"), F.col("copies")), F.lit(0)).cast("int")
    return found.withColumn(f"share_{side}", share).drop("copies"), many.select(F.col(side).alias("id"), "copies")


def _verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of the pairs(a, b), written and distinct, whose full sets are similar enough."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs)
    dealt, many_a = _dealt(pairs, "a")
    dealt, many_b = _dealt(dealt, "b")
    for side, elements, many in (("a", "x", many_a), ("b", "y", many_b)):
        copies = sets.join(many, "id", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
        dealt = dealt.join(copies.select(F.col("id").alias(side), F.col("share").alias(f"share_{side}"), F.col("elements").alias(elements)), [side, f"share_{side}"])
    shared = F.size(F.array_intersect("x", "y"))
    return dealt.where(100 * shared >= PERCENT * (F.size("x") + F.size("y") - shared)).select("a", "b")


def _near(n: str, m: str) -> F.Column:
    """Whether sets of these sizes can be similar enough."""
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _close(x: str, y: str, n: str, m: str) -> F.Column:
    """Whether sets of these parity bitmaps and sizes can be similar enough: linked sets differ in (100 - PERCENT) / (100 + PERCENT) of n + m elements at most."""
    apart = sum(F.bit_count(F.get(x, F.lit(k)).bitwiseXOR(F.get(y, F.lit(k)))) for k in range(BITS // 64))
    return (100 + PERCENT) * apart <= (100 - PERCENT) * (F.col(n) + F.col(m))


def _open(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """rows(key, band, id, n) of the buckets that have pairs between components, with component, bits, bands and twice the number of such pairs."""
    rows = rows.join(found, "id", "left").select("key", "band", "id", "n", F.coalesce("component", "id").alias("component"))
    by = rows.groupBy("key", "component").agg(F.count("*").alias("c"))
    open_ = by.groupBy("key").agg((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))).alias("twice"), F.sum("c").alias("n")).where("twice > 0")
    open_ = written(open_, "keys")
    rows = join_to_one(rows, open_.select("key", "twice"), "key", hot=hot_keys(open_, "key"))
    return written(rows.join(nodes.select("id", "bits", "bands"), "id"), "open")


def _pairs(a: DataFrame, b: DataFrame, met: Callable[[DataFrame, DataFrame], F.Column]) -> DataFrame:
    """(a, b) of rows that meet, are in different components so far and can be linked."""
    a, b = (x.select(*[F.col(c).alias(f"{c}_{side}") for c in x.columns]) for x, side in ((a, "a"), (b, "b")))
    apart = F.col("component_a") != F.col("component_b")
    made = a.join(b, met(a, b) & apart & _near("n_a", "n_b") & _close("bits_a", "bits_b", "n_a", "n_b"))
    return made.select(F.least("id_a", "id_b").alias("a"), F.greatest("id_a", "id_b").alias("b"))


def _left_over(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows(key, band, id, n), the buckets of several nodes: all pairs left in small buckets and in divisions that are small; and the rows of the buckets that were divided, whose other pairs are still to be tried."""
    pairs = hot = None
    for depth in range(DEPTH):
        rows = _open(rows, nodes, found)
        small = rows.where(F.col("twice") <= 2 * PAIRS).select("key", "id", "n", "component", "bits")
        made = _pairs(small, small, lambda a, b: (a["key_a"] == b["key_b"]) & (a["id_a"] < b["id_b"]))
        pairs = made if pairs is None else pairs.union(made)
        rows = rows.where(F.col("twice") > 2 * PAIRS)
        hot = rows.select("key", "band", "id", "n") if hot is None else hot
        if depth == DEPTH - 1 or rows.isEmpty():
            break
        rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(SPLITS))))
        other = (F.col("band") + F.col("step")) % BANDS
        rows = rows.select(F.xxhash64("key", "step", F.get("bands", other)).alias("key"), other.alias("band"), "id", "n")
    return written(pairs.distinct(), "pairs"), hot


def _in_full(rows: DataFrame, nodes: DataFrame, found: DataFrame) -> DataFrame:
    """All pairs left in the buckets of rows(key, band, id, n). A bucket's nodes are dealt to blocks of about BLOCK; each two blocks meet under a key of their own."""
    rows = _open(rows, nodes, found)
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = rows.join(blocks, "key").select("key", "id", "n", "component", "bits", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    low = rows.withColumn("other", F.explode(F.sequence(F.col("block"), F.col("blocks") - 1))).drop("blocks")
    high = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("block")))).drop("blocks")

    def met(a: DataFrame, b: DataFrame) -> F.Column:
        once = (a["block_a"] < b["block_b"]) | (a["id_a"] < b["id_b"])
        return (a["key_a"] == b["key_b"]) & (a["block_a"] == b["other_b"]) & (a["other_a"] == b["block_b"]) & once

    return written(_pairs(low, high, met).distinct(), "pairs")


def _linked(found: DataFrame, pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The components with the links among pairs."""
    more = written(_verified(pairs, docs), "links")
    if more.isEmpty():
        return found
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable over links) and kept (it is the smallest), a row for each row."""
    docs = texts(docs)
    marked = written(map_rows(docs, _sketches, "doc_id long, n_shingles long, digest binary, bands array<long>, bits array<long>"), "sketches")
    nodes = marked.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
    nodes = written(nodes.agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("bits").alias("bits"), F.count("*").alias("rows")), "nodes")
    rows = nodes.select("id", "n", F.posexplode("bands").alias("band", "key"))
    buckets = rows.groupBy("key").agg(F.min(F.struct("id", "n")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    buckets = written(buckets, "firsts")
    hot = hot_keys(buckets.select("key", F.col("rows").alias("n")), "key")
    rows = written(join_to_one(rows, buckets.select("key", "first"), "key", hot=hot), "buckets")
    star = rows.where((F.col("id") != F.col("first.id")) & _near("n", "first.n")).select(F.col("first.id").alias("a"), F.col("id").alias("b"))
    found = components(_verified(written(star.distinct(), "pairs"), docs))
    rest, hot = _left_over(rows.select("key", "band", "id", "n"), nodes, found)
    found = _linked(found, rest, docs)
    if not hot.isEmpty():
        found = _linked(found, _in_full(hot, nodes, found), docs)
    # the same id may stand for several sets; its component is then common to them
    by_set = nodes.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component"))
    hot = hot_keys(nodes.select("digest", F.col("rows").alias("n")), "digest")
    out = join_to_one(marked.select("doc_id", "n_shingles", "digest"), by_set, "digest", "left", hot).select("doc_id", "n_shingles", F.coalesce("component", F.when(F.col("n_shingles") == 0, F.col("doc_id"))).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one document of each group, the one with the smallest id; rows with null ids stay."""
    copies = near_duplicates(docs).where("NOT kept AND doc_id IS NOT NULL").select("doc_id")
    return without_ids(docs, written(copies.distinct(), "copies"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4])) END AS s FROM t
), e AS (SELECT doc_id, hash(unnest(s)) AS h, len(s) AS n FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM s JOIN c USING (doc_id)
"""
