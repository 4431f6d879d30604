"""Sharding by sampled splitters, in DataFrame functions alone.

Records are ordered by a key: (md5 of the text, md5 of the id, id), so equal
texts stand together and a text that holds a third of all rows still spreads
over many key ranges. A sample drawn with probability proportional to size
gives quantile boundaries; records are range-partitioned by them, ranges that
turn out overfull are subdivided at the sampled keys inside them, and running
sums of bytes within ranges, on top of the sums of the ranges before, place
every record exactly: shard = shards * (bytes before it) div (all bytes). So
law `bytes` holds: shards differ by less than two records' sizes. slot numbers
a shard's records from 0 in key order.

The sample is bounded by `sample` keys on average; it only balances the work.
The result is exact and the same for every sample.

Defined cases: a null text has size `overhead` and is stored as empty; null ids
come first among equal texts; repeated rows get slots of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.llm.common import table, written

SHARDS, OVERHEAD, SAMPLE = 40, 16, 8192
#: Ranges: one for each RANGE_BYTES, so that a range's records (without their texts) suit a task; between these bounds.
RANGE_BYTES, RANGES, MOST_RANGES = 256 << 20, 128, 4096


def _unit(*parts: Column) -> Column:
    """A number in [0, 1) that depends on the values alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 40)) / float(1 << 40)


def _range(key: Column, splitters: list[str]) -> Column:
    """How many splitters are at or below the key, by bisection as nested conditions."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < splitters[middle], between(low, middle)).otherwise(between(middle + 1, high))

    return between(0, len(splitters))


def assign_shards(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, sample: int = SAMPLE, ranges: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law), one row for each record; ranges: by size unless given."""
    text = F.coalesce("text", F.lit(""))
    records = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.concat(F.md5(text), F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit(""))).alias("key"),
    )
    records = written(records, "records")
    total = records.agg(F.sum("size")).first()[0] or 0
    if not total:
        return _shaped(records.limit(0).withColumns({"shard": F.lit(0), "slot": F.lit(0)}))
    ranges = ranges or min(MOST_RANGES, max(RANGES, total // RANGE_BYTES))
    sample = max(sample, 4 * ranges)
    drawn = records.where(_unit(F.col("key"), F.lit(6)) < F.col("size") * (sample / total)).select("key").distinct()
    keys = sorted(r[0] for r in drawn.collect())
    step = max(1, len(keys) // ranges)
    splitters = keys[step::step]
    # exact sizes of the ranges; an overfull one is cut at all sampled keys inside it
    sizes = dict(records.groupBy(_range(F.col("key"), splitters).alias("r")).agg(F.sum("size")).collect())
    fair = total / (len(splitters) + 1)
    cut = [k for r, s in sizes.items() if s > 1.5 * fair for k in keys[r * step + 1 : (r + 1) * step]]
    splitters = sorted({*splitters, *cut})
    ranged = records.withColumn("r", _range(F.col("key"), splitters))
    before_bytes, before_rows, seen_bytes, seen_rows = {}, {}, 0, 0
    for r, s, n in sorted(ranged.groupBy("r").agg(F.sum("size"), F.count("*")).collect()):
        before_bytes[r], before_rows[r] = seen_bytes, seen_rows
        seen_bytes, seen_rows = seen_bytes + s, seen_rows + n
    lookup = records.sparkSession.createDataFrame([(r, before_bytes[r], before_rows[r]) for r in before_bytes], "r int, bytes_before long, rows_before long")
    inner = Window.partitionBy("r").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumns({"bytes_in": F.sum("size").over(inner) - F.col("size"), "rows_in": F.count("*").over(inner) - 1})
    placed = placed.join(F.broadcast(lookup), "r").withColumns({
        "shard": F.expr(f"int((bytes_in + bytes_before) * {shards}L div {total}L)"),
        "rank": F.col("rows_in") + F.col("rows_before"),
    })
    placed = written(placed.select("doc_id", "size", "text_crc32", "shard", "rank"), "placed")
    first = placed.groupBy("shard").agg(F.min("rank").alias("first"))
    return _shaped(placed.join(F.broadcast(first), "shard").withColumn("slot", F.col("rank") - F.col("first")))


def _shaped(placed: DataFrame) -> DataFrame:
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, path: str, **options: int) -> DataFrame:
    """Writes the documents as path/shard=N, each in slot order, and returns the assignment. Ids must be distinct and not null."""
    assigned = written(assign_shards(docs, **options))
    places = assigned.select("doc_id", F.col("shard").alias("shard"), "slot")
    rows = docs.drop("shard", "slot").join(places, "doc_id")
    rows.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return assigned


def op6_shard_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents"))


#: DuckDB has no crc32: it is taken bit by bit over a table of the 256 bytes, then byte by byte.
OP6_SQL = """
WITH RECURSIVE steps(i, k, c) AS (
  SELECT range, 0, CAST(range AS BIGINT) FROM range(256)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END FROM steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS crcs FROM steps WHERE k = 8
), d AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(strlen(coalesce(text, '')) + 16 AS BIGINT) AS size,
    md5(coalesce(text, '')) || coalesce(md5(CAST(doc_id AS VARCHAR)), '') AS key FROM documents
), bytes AS (
  SELECT text, list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, strlen(text) + 1), lambda p: CAST('0x' || hex(text)[2 * p - 1:2 * p] AS BIGINT))) AS b
  FROM (SELECT DISTINCT text FROM d)
), sums AS (
  SELECT text, xor(list_reduce(b, lambda acc, x: xor(crcs[CAST(xor(acc, x) & 255 AS INTEGER) + 1], acc >> 8)), CAST(4294967295 AS BIGINT)) AS crc FROM bytes, crc_table
), w AS (
  SELECT *, CAST(sum(size) OVER (ORDER BY key, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS before,
    row_number() OVER (ORDER BY key, doc_id NULLS FIRST, size) - 1 AS rank, CAST(sum(size) OVER () AS BIGINT) AS total FROM d
), s AS (SELECT *, CAST(before * 40 // total AS INTEGER) AS shard FROM w)
SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard,
  CAST(rank - min(rank) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM s JOIN sums USING (text)
"""
