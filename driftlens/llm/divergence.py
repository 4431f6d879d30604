"""How far the sources of a language are apart, by wide vectors of term counts.

A task counts the terms of its documents, as occurrences and as documents, by
blocks of texts. A term of a language is pivoted into one array with a place for
each source of that language. Higher-order functions turn counts into shares
(parts of UNIT, add-one smoothing) and emit what the term adds to each ordered
pair of sources that have it; these are summed before the shuffle. What a term
adds to pairs of which a source lacks it depends on its counts alone, so terms
of equal counts are added at once (_pairs).

Arithmetic is exact in 64 bits: quotients are taken in three steps of 1000, so
counts of a language may reach 9e15, and a sum over V terms stays below
(UNIT + 2 V)^2. Beyond that Spark raises.

Defined cases: null text, lang and source are ''; repeated rows count each; bytes
that are no UTF-8 are part of terms, as all bytes from 128 on; a group without
terms, or a language without kept terms, has pairs of value 0 and no terms; other
columns are ignored; an empty table gives no rows. The array of a term and the
sources of a language are one row, so sources of one language should number
thousands at most; their pairs are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.llm.common import arrow_schema, forget_others, join_to_one, table, workers_know, written

LEAST_DOCS, TOP, UNIT = 3, 200, 1_000_000_000
#: Texts are counted together up to this many bytes, or one longer text.
BLOCK_BYTES = 8 << 20
#: Letters A to Z become lower case, other bytes below 128 that are no letters part terms.
_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_DDL = "lang binary, source binary, term binary, n long, docs long"


def _words(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """All terms of texts in order, and the text of each."""
    joined = np.frombuffer(b" " + b" ".join(t.translate(_BYTES) for t in texts) + b" ", np.uint8)
    inside = joined != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    begin, end = edge[0::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - begin)]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(joined[inside])])
    return words, np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begin, "right")


def _sums(groups: list[tuple[bytes, bytes]], texts: list[bytes]) -> pa.RecordBatch:
    """Counts of the terms of each group among texts[k] of groups[k]; the empty term says that a group is there."""
    known = {g: k for k, g in enumerate(dict.fromkeys(groups))}
    group = np.array([known[g] for g in groups])
    words, of = _words(texts)
    encoded = words.dictionary_encode()
    n_terms = max(1, len(encoded.dictionary))
    in_text, times = np.unique(of * n_terms + encoded.indices.to_numpy(), return_counts=True)
    in_group, place = np.unique(group[in_text // n_terms] * n_terms + in_text % n_terms, return_inverse=True)
    ids = np.concatenate([in_group // n_terms, np.arange(len(known))])
    terms = pa.concat_arrays([encoded.dictionary.take(pa.array(in_group % n_terms)), pa.array([b""] * len(known), pa.binary())])
    none = np.zeros(len(known), np.int64)
    n = np.concatenate([np.bincount(place, times, len(in_group)).astype(np.int64), none])
    docs = np.concatenate([np.bincount(place, minlength=len(in_group)), none])
    lang, source = (pa.array([g[k] for g in known], pa.binary()).take(pa.array(ids)) for k in (0, 1))
    return pa.RecordBatch.from_arrays([lang, source, terms, pa.array(n), pa.array(docs)], schema=arrow_schema(_DDL))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget_others(__name__)
    groups, texts, size = [], [], 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3))):
            if texts and size + len(text.as_buffer()) > BLOCK_BYTES:
                yield _sums(groups, texts)
                groups, texts, size = [], [], 0
            groups.append((lang.as_py(), source.as_py()))
            texts.append(text.as_py())
            size += len(texts[-1]) + 1
    if texts:
        yield _sums(groups, texts)


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents; every group also has the term '' with zeros."""
    workers_know(docs.sparkSession)
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).cast("binary").alias(c) for c in ("lang", "source", "text")])
    rows = rows.mapInArrow(_counted, _DDL).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    return rows.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "n", "docs")


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _share(count: Column, of: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / of), by three digits of base 1000; count + 1 is of at most."""
    rest, digits = (count + 1) * 1000, F.lit(0).cast("long")
    for _ in range(3):
        rest, digits = rest % of * 1000, digits * 1000 + _div(rest, of)
    return 1 + digits


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return _div((p - q) * (p - q), q)


def _sum(of: str) -> Column:
    return F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + x)


def _none(places: str) -> Column:
    return F.coalesce(places, F.lit(0).cast("long"))


def wide_vectors(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both written: the kept terms as (lang, term, sources, base, n, p, q), and the languages as (lang, sources, base, totals, v).

    Arrays have a place for each source of the language. n is 0 and p null where
    the source lacks the term; base is the p of such terms, q the language's p.
    """
    cells = counts.where("term <> ''").groupBy("lang", "term").agg(F.sum("docs").alias("d"), F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("cells"))
    cells = written(cells.where(F.col("d") >= LEAST_DOCS).select("lang", "term", "cells"), "cells")
    sources = counts.where("term = ''").groupBy("lang").agg(F.sort_array(F.collect_list("source")).alias("sources"))
    totals = cells.select("lang", F.explode("cells").alias("source", "n")).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    totals = totals.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("totals"))
    langs = sources.join(totals, "lang", "left").join(cells.groupBy("lang").agg(F.count("*").alias("v")), "lang", "left")
    by_source = lambda m: F.transform("sources", lambda s: _none(F.element_at(m, s)))
    langs = langs.select("lang", "sources", by_source("totals").alias("totals"), _none("v").alias("v"))
    langs = langs.withColumn("base", F.when(F.col("v") > 0, F.transform("totals", lambda t: _share(F.lit(0).cast("long"), t + F.col("v")))))
    langs = written(langs.withColumn("whole", _sum("totals") + F.col("v")), "langs")
    wide = join_to_one(cells, langs, "lang").withColumn("n", by_source("cells")).withColumn("all", _sum("n"))
    p = F.transform("n", lambda c, i: F.when(c > 0, _share(c, F.get("totals", i) + F.col("v"))))
    wide = wide.select("lang", "term", "sources", "base", "n", p.alias("p"), _share(F.col("all"), F.col("whole")).alias("q"))
    return written(wide, "wide"), langs.drop("whole")


def _pairs(wide: DataFrame, langs: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources i, j of a language.

    With b for base, a term that both have emits f(pi, pj) - f(pi, bj) - f(bi, pj)
    + f(bi, bj). The rest needs no pairs of terms: f(pi, bj) over all terms of i
    and f(bi, pj) over all of j, by the numbers of terms of equal p, and f(bi, bj)
    times the number of terms, less those of i and those of j.
    """
    has = F.filter(F.sequence(F.lit(0), F.size("n") - 1), lambda i: F.get("n", i) > 0)
    p, b = (lambda k: F.get("p", k)), (lambda k: F.get("base", k))
    both = F.transform("has", lambda i: F.transform(F.filter("has", lambda j: j != i), lambda j: F.struct(i.alias("i"), j.alias("j"), p(i).alias("pi"), p(j).alias("pj"), b(i).alias("bi"), b(j).alias("bj"))))
    both = wide.select("lang", "n", "p", "base", has.alias("has")).where("size(has) > 1").select("lang", F.explode(F.flatten(both)).alias("x")).select("lang", "x.*")
    f = lambda x, y: _apart(F.col(x), F.col(y))
    more = both.groupBy("lang", "i", "j").agg(F.sum(f("pi", "pj") - f("pi", "bj") - f("bi", "pj") + f("bi", "bj")).alias("f"))
    alike = wide.select("lang", F.posexplode("p").alias("k", "p")).where("p IS NOT NULL").groupBy("lang", "k", "p").agg(F.count("*").alias("terms"))
    alike = join_to_one(written(alike, "alike"), langs.select("lang", "base"), "lang").select("*", F.posexplode("base").alias("o", "b")).where("k <> o").drop("base")
    own = alike.groupBy("lang", F.col("k").alias("i"), F.col("o").alias("j")).agg(F.sum(F.col("terms") * f("p", "b")).alias("f"), F.sum("terms").alias("of_i"))
    others = alike.groupBy("lang", F.col("o").alias("i"), F.col("k").alias("j")).agg(F.sum(F.col("terms") * f("b", "p")).alias("g"), F.sum("terms").alias("of_j"))
    every = langs.select("*", F.posexplode("sources").alias("i", "source")).select("*", F.posexplode("sources").alias("j", "item")).where("i <> j")
    every = every.select("lang", "i", "j", "source", "item", "v", b(F.col("i")).alias("bi"), b(F.col("j")).alias("bj"))
    every = every.join(more, ["lang", "i", "j"], "left").join(own.withColumnRenamed("f", "h"), ["lang", "i", "j"], "left").join(others, ["lang", "i", "j"], "left")
    rest = (F.col("v") - _none("of_i") - _none("of_j")) * f("bi", "bj")
    value = F.when(F.col("v") > 0, _none("f") + _none("h") + _none("g") + rest).otherwise(0)
    return every.select("lang", "source", "item", value.alias("value"))


def _terms(wide: DataFrame) -> DataFrame:
    """(lang, source, item, value) of the terms that a source has in a larger share than its language."""
    rows = wide.select("lang", "term", "sources", "q", F.posexplode("p").alias("i", "p")).where(F.col("p") > F.col("q"))
    return rows.select("lang", F.get("sources", F.col("i")).alias("source"), F.col("term").alias("item"), _apart(F.col("p"), F.col("q")).alias("value"))


def divergences(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distances to the others of its language, and the terms that set it apart from the language."""
    wide, langs = wide_vectors(written(term_counts(docs), "counts"))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", rank.alias("rank"))
    return ranked(_pairs(wide, langs), "pair").unionByName(ranked(_terms(wide), "term").where(F.col("rank") <= TOP))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), t AS (SELECT r, lang, source, unnest(w) AS term FROM d
), k AS (SELECT lang, term FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 3
), g AS (SELECT DISTINCT lang, source FROM d
), c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY ALL
), a AS (
  SELECT lang, g.source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN c USING (lang, source, term)
), b AS (SELECT *, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p FROM a
), l AS (SELECT lang, term, sum(n) AS n FROM a GROUP BY ALL
), q AS (SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS q FROM l
), pairs AS (
  SELECT x.lang, x.source, y.source AS item, coalesce(f, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN (
    SELECT u.lang, u.source, w.source AS item, sum(((u.p - w.p) * (u.p - w.p)) // w.p) AS f FROM b u JOIN b w ON u.lang = w.lang AND u.term = w.term AND u.source <> w.source GROUP BY ALL
  ) s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
), terms AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // q AS value FROM b JOIN q USING (lang, term) WHERE n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
  UNION ALL
  SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM terms
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
