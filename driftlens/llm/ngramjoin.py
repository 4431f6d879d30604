"""Documents joined on the Jaccard similarity of their 3-word shingles, by signature trees.

Sets are compared within classes of size (powers of two; a set just above a
power is in the class below too), and in classes above PART in parts: shingles
are dealt to parts by hash, and similar sets have a part that is at least as
similar. Every part is a record with a bitmap of its shingles.

1. Routing. In any common order similar records share one of their first s / 10
   + 1 shingles, s being the size. A record goes to the groups of these, but not
   where no other record of the group is of a set near enough in size, which
   linked sets are. In the order, shingles that tasks have met often come
   last (a summary of frequent items over all texts, FREQUENT of them), so that
   common passages make no groups. The order changes no result.
2. Each group is a signature tree (signatures.py), or where it is large a tree
   for each block of it, and each two blocks meet in one task. A first dual
   traversal gives about one pair for each record; these are confirmed on full
   sets and make components.
3. In groups that hold several components a second traversal gives every pair of
   records in different components that the trees can't rule out. Those that the
   first one has not given are confirmed on full sets.

Sets below 9 shingles are similar to equal ones only; equal sets are one node from
the start.

Defined cases: documents without words (or null texts) have empty sets and are
linked with nothing; rows with one id are one document; rows with null ids take
no part in links among themselves and have the component of documents with ids
of the same set, if there are any, else null; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.llm.common import FEW_IDS, HOT, LEAST_HOT, arrow_schema, forget_others, hot_keys, join_to_one, map_rows, parts, shuffles_end, table, texts, workers_know, written
from driftlens.llm.components import components
from driftlens.llm.neardup import _dealt
from driftlens.llm.signatures import Forest
from driftlens.llm.wordhash import grouped, hashed_words, mix, word_table

WORDS, PERCENT = 3, 90
#: The least size of a set that can be similar to another one.
LEAST = 100 // (100 - PERCENT) - 1
#: Classes of at least twice this size are cut into parts of about this size to twice it; bits of a bitmap.
PART, BITS = 128, 512
#: Shingles that a task counts, the least count that it reports, and the most that come last in the order (those of at least OFTEN documents).
HELD, REPORTED, FREQUENT, OFTEN = 1 << 16, 8, 1 << 17, 32
#: Keys are counted by so many remainders; only where one has very many rows are they counted one by one.
REMAINDERS = 1 << 16
#: Larger groups are divided into blocks of about this size. A task builds trees over about so many rows at once.
BLOCK, ROWS = 4096, 1 << 15
_NONSPACE = word_table("nonspace")  # words end at space and 0x09 to 0x0D
_ODD = np.random.default_rng(11).integers(1, 1 << 63, WORDS + 1, np.uint64) * np.uint64(2) + np.uint64(1)
_WIDTHS = _ODD[WORDS] * np.arange(WORDS + 1, dtype=np.uint64)
_RECORDS = pa.list_(pa.struct([("own", pa.bool_()), ("size", pa.int32()), ("least", pa.int64()), ("keys", pa.list_(pa.int64())), ("bits", pa.binary())]))


def _shingled(each: np.ndarray) -> np.ndarray:
    if not len(each):
        return np.empty(0, np.uint64)
    width = min(WORDS, len(each))
    total = np.zeros(len(each) - width + 1, np.uint64)
    for k in range(width):
        total += each[k : len(each) - width + 1 + k] * _ODD[k]
    return np.unique(mix(total ^ _WIDTHS[width]))


def shingle_sets(texts_: list[str]) -> list[np.ndarray]:
    """The set of each document: distinct 64-bit hashes of its shingles, in order."""
    raw, out = [t.encode().lower() for t in texts_], []
    for some in grouped(raw):
        hashes, bounds = hashed_words(raw[some.start : some.stop], _NONSPACE)
        out += [_shingled(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
    return out


def _often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shingles that are in many of a task's documents, with their numbers, too low by the same amount where more than HELD were met."""
    forget_others(__name__)
    held, times = np.empty(0, np.uint64), np.empty(0, np.int64)
    for batch in batches:
        for part in parts(batch):
            sets = shingle_sets(part.column(0).to_pylist())
            every = np.concatenate([held, *sets])
            held, place = np.unique(every, return_inverse=True)
            times = np.bincount(place, np.concatenate([times, np.ones(len(every) - len(times))])).astype(np.int64)
            if len(held) > HELD:
                times -= np.partition(times, -HELD - 1)[-HELD - 1]
                held, times = held[times > 0], times[times > 0]
    some = times >= REPORTED
    yield pa.RecordBatch.from_arrays([pa.array(held[some].view(np.int64)), pa.array(times[some])], schema=arrow_schema("shingle long, n long"))


def frequent(docs: DataFrame) -> np.ndarray:
    """The shingles that come last in the order of all, FREQUENT at most, the rarest first."""
    counts = docs.select("text").mapInArrow(_often, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))
    rows = counts.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(FREQUENT).toArrow()
    return rows["shingle"].to_numpy().view(np.uint64)[::-1]


def records(elements: np.ndarray, last: np.ndarray, rank: np.ndarray) -> Iterator[dict]:
    """The records of a set in order; last are the frequent shingles in order, rank their places among them."""
    n = len(elements)
    if n < LEAST:
        return
    place = np.minimum(np.searchsorted(last, elements), max(0, len(last) - 1))
    is_last = last[place] == elements if len(last) else np.zeros(n, bool)
    own = n.bit_length() - 1
    for size_class in (own, own - 1):
        if 100 * ((1 << size_class + 1) - 1) < PERCENT * n:
            return
        number = max(1, (1 << size_class) // PART)
        bounds = np.searchsorted(elements, np.arange(1, number, dtype=np.uint64) * np.uint64((1 << 64) // number)) if number > 1 else []
        for some in np.split(np.arange(n), bounds):
            size = len(some)
            if not size:
                continue
            wanted = size * (100 - PERCENT) // 100 + 1
            first = some[~is_last[some]][:wanted]
            if len(first) < wanted:
                more = some[is_last[some]]
                first = np.concatenate([first, more[np.argsort(rank[place[more]])][: wanted - len(first)]])
            bits = np.bincount((elements[some] >> np.uint64(20)).astype(np.int64) % BITS, minlength=BITS) > 0
            keys = mix(elements[first] ^ _WIDTHS[1] * np.uint64(size_class + 2))
            yield {"own": size_class == own, "size": size, "least": int(elements[some[0]].view(np.int64)), "keys": keys.view(np.int64), "bits": np.packbits(bits).tobytes()}


def _marked(last_first: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(__name__)
        rank = np.argsort(last_first)
        last = last_first[rank]
        for batch in batches:
            for part in parts(batch):
                sets = shingle_sets(part.column(1).to_pylist())
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                made = pa.array([list(records(s, last, rank)) for s in sets], _RECORDS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), part.column(2), made], ["doc_id", "n_shingles", "digest", "row", "records"])

    return run


def _nodes(marked: DataFrame) -> tuple[DataFrame, bool]:
    """((digest, id, row, rows, at) of each set that a document with an id has, whether an id has several sets).

    id is the smallest, row the row that stands for the set, and at is 0 but where an id has several sets.
    """
    nodes = marked.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest")
    nodes = nodes.agg(F.min(F.struct("doc_id", "row")).alias("first"), F.count("*").alias("rows"))
    nodes = written(nodes.select("digest", F.col("first.doc_id").alias("id"), "first.row", "rows"), "nodes")
    count, ids = nodes.agg(F.count("*"), F.count_distinct("id")).first()
    at = F.row_number().over(Window.partitionBy("id").orderBy("digest")).cast("long") - 1 if ids < count else F.lit(0).cast("long")
    return nodes.withColumn("at", at), ids < count


def _records(marked: DataFrame, nodes: DataFrame, several: bool) -> DataFrame:
    """(id, at, total, r) of each record r of each set. Records stay where they are, but where the rows to leave out are too many to broadcast or an id has several sets."""
    large = marked.where(F.col("n_shingles") >= LEAST)
    copies = written(large.select("row").join(nodes.select("row"), "row", "left_anti"), "copies")
    few = copies.count() <= FEW_IDS
    sets = large.join(F.broadcast(copies) if few else copies, "row", "left_anti")
    sets = sets.join(nodes.select("row", "at"), "row") if several else sets.withColumn("at", F.lit(0).cast("long"))
    sets = sets.select(F.col("doc_id").alias("id"), "at", F.col("n_shingles").alias("total"), "records")
    sets = sets if few and not several else written(sets, "apart")
    return sets.select("id", "total", "at", F.posexplode("records").alias("k", "r")).select("id", F.expr("at * 4294967296 + k").alias("at"), "total", "r")


def _hot_groups(rows: DataFrame) -> tuple[DataFrame, list]:
    """((key, n) of the keys of rows that are hot, their list)."""
    remainder = F.pmod("key", F.lit(REMAINDERS))
    by = written(rows.groupBy(remainder.alias("remainder")).agg(F.count("*").alias("n")), "remainders")
    total = by.agg(F.sum("n")).first()[0] or 0
    counts = rows.where(remainder.isin(hot_keys(by, "remainder"))).groupBy("key").agg(F.count("*").alias("n"))
    hot = written(counts.where((F.col("n") >= LEAST_HOT) & (F.col("n") * HOT > total)), "hot")
    return hot, sorted(r[0] for r in hot.select("key").collect())


def _met(rows: DataFrame) -> DataFrame:
    """(key, id, at, n) of those rows(key, id, at, total) that share their key with a record of a set near enough in size, in groups of n.

    Groups of up to BLOCK that have the same records become one, as the key is made of these then; others that
    meet in one key by chance are compared too. Rows of hot keys, which are in no one task, are all kept.
    """
    counts, hot = _hot_groups(rows)
    is_hot, group = F.col("key").isin(hot), Window.partitionBy("key")
    cold = rows.where(~is_hot).withColumns({c: f("total").over(group.orderBy("total")) for c, f in (("before", F.lag), ("after", F.lead))})
    cold = cold.where((100 * F.col("before") >= PERCENT * F.col("total")) | (100 * F.col("total") >= PERCENT * F.col("after")))
    cold = cold.withColumns({"n": F.count("*").over(group), "members": F.bit_xor(F.xxhash64("id", "at")).over(group)})
    cold = cold.select(F.when(F.col("n") <= BLOCK, F.col("members")).otherwise(F.col("key")).alias("key"), "id", "at", "n")
    return cold.repartition("id", "at").distinct().unionByName(rows.where(is_hot).join(F.broadcast(counts), "key").select("key", "id", "at", "n"))


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.sort_by([(c, "ascending") for c in ("key", "i", "j", "side", "component", "least", "size")])


def _compared(all_pairs: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs of records of the trees of rows sorted by (key, i, j)."""

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = _in_order(rows)
        number = {c: rows[c].to_numpy() for c in rows.column_names if c != "bits"}
        changed = lambda *names: np.append(True, np.logical_or.reduce([number[c][1:] != number[c][:-1] for c in names]))
        tree_starts = changed("key", "i", "j", "side")
        tree, group = np.cumsum(tree_starts) - 1, np.cumsum(changed("key", "i", "j")) - 1
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        forest = Forest(tree, bits, number["size"], number["own"].astype(bool), PERCENT)
        firsts = np.flatnonzero(tree_starts)
        joined, of = number["i"][firsts] == number["j"][firsts], group[firsts]
        x = np.flatnonzero((of[1:] == of[:-1]) & ~joined[1:])
        roots = x, x + 1
        made = forest.pairs(number["component"], joined, roots) if all_pairs else forest.spanning(joined, roots)
        ids, total = number["id"], number["total"].astype(np.int64)
        for x, y in made:
            a, b = np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y])
            some = (a < b) & (100 * np.minimum(total[x], total[y]) >= PERCENT * np.maximum(total[x], total[y]))
            yield pa.RecordBatch.from_arrays([pa.array(a[some]), pa.array(b[some])], schema=arrow_schema("a long, b long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(__name__)
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < ROWS:
                continue
            rows = pa.Table.from_batches(held)
            last = [rows[c].to_numpy() for c in ("key", "i", "j")]
            whole = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in last]))
            end = whole[-1] + 1 if len(whole) else 0  # the last group may go on
            if end:
                yield from pairs(rows.slice(0, end))
            held = rows.slice(end).combine_chunks().to_batches()
        if sum(b.num_rows for b in held):
            yield from pairs(pa.Table.from_batches(held))

    return run


def _traversed(rows: DataFrame, records_: DataFrame, component: Column, all_pairs: bool) -> DataFrame:
    """Distinct pairs(a, b) of ids, written, from rows(key, id, at, n) of groups of n records."""
    rows = rows.join(records_, ["id", "at"])
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    i, j, side = F.least("block", "other"), F.greatest("block", "other"), (F.col("block") > F.col("other")).cast("int")
    rows = rows.select("key", i.alias("i"), j.alias("j"), side.alias("side"), component.alias("component"), "least", "size", "total", "own", "id", "bits")
    workers_know(rows.sparkSession)
    found = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(_compared(all_pairs), "a long, b long")
    return written(found.distinct(), "pairs")


def _sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, elements) of documents with these distinct ids, written. Few ids are broadcast, so that texts stay where they are."""
    ids = written(ids, "ids")
    few = ids.count() <= FEW_IDS
    there = docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    sets = map_rows(there, lambda: lambda c: {"id": c["doc_id"], "elements": [s.view(np.int64) for s in shingle_sets(c["text"])]}, "id long, elements array<long>")
    return written(sets, "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Those of distinct pairs(a, b) whose full sets are similar enough."""
    sets = _sets_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), docs.dropDuplicates(["doc_id", "text"]) if _repeated(docs) else docs)
    dealt, many_a = _dealt(pairs, "a")
    dealt, many_b = _dealt(dealt, "b")
    for side, elements, many in (("a", "x", many_a), ("b", "y", many_b)):  # a set that is in very many pairs has a copy for each share of them
        copies = sets.join(many, "id", "left").withColumn("share", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)))
        dealt = dealt.join(copies.select(F.col("id").alias(side), F.col("share").alias(f"share_{side}"), F.col("elements").alias(elements)), [side, f"share_{side}"])
    shared = F.size(F.array_intersect("x", "y"))
    return dealt.where(100 * shared >= PERCENT * (F.size("x") + F.size("y") - shared)).select("a", "b").distinct()


def _repeated(docs: DataFrame) -> bool:
    """Whether an id has several rows."""
    return not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def joined(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest id reachable over links), a row for each row."""
    with shuffles_end(docs.sparkSession):
        return _joined(texts(docs))


def _joined(docs: DataFrame) -> DataFrame:
    marks = "doc_id long, n_shingles long, digest binary, row long, records array<struct<own:boolean,size:int,least:bigint,keys:array<bigint>,bits:binary>>"
    marked = written(docs.withColumn("row", F.monotonically_increasing_id()).mapInArrow(_marked(frequent(docs)), marks), "marked")
    nodes, several = _nodes(marked)
    every = _records(marked, nodes, several)
    shapes = every.select("id", "at", "total", "r.own", "r.size", "r.least", "r.bits")
    rows = written(_met(every.select("id", "at", "total", F.explode("r.keys").alias("key"))), "rows")
    tried = _traversed(rows, shapes, F.lit(0).cast("long"), False)
    found = components(_confirmed(tried, docs))

    rows = rows.join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("least"), F.max("component").alias("most")).where("least < most")
    split = written(split.select("key", "n"), "split")
    rows = join_to_one(rows.drop("n"), split, "key", hot=hot_keys(split, "key"))
    new = written(_traversed(rows, shapes, F.col("component"), True).join(tried, ["a", "b"], "left_anti"), "new")
    more = written(_confirmed(new, docs), "links")
    if not more.isEmpty():
        found = components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).union(more))

    by_set = nodes.join(found, "id", "left").select("digest", F.coalesce("component", "id").alias("component_id"))
    hot = hot_keys(nodes.select("digest", F.col("rows").alias("n")), "digest")
    out = join_to_one(marked.select("doc_id", "n_shingles", "digest"), by_set, "digest", "left", hot)
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", F.when(F.col("n_shingles") == 0, F.col("doc_id"))).alias("component_id"))


def op11_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) END AS s FROM t
), e AS (SELECT doc_id, hash(unnest(s)) AS h, len(s) AS n FROM s
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  SELECT reach.a, pairs.b FROM reach JOIN pairs ON reach.b = pairs.a
), c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, component_id FROM s JOIN c USING (doc_id)
"""
