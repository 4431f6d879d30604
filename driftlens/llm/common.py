"""What the operators of this subpackage share: tables, shared folders, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.sources.store import shared_dir, shuffles_end, workers_know, written

_TYPES = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(),
    "binary": pa.binary(), "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key with more than 1 / HOT of the rows, and at least LEAST_HOT of them, is hot.
HOT, LEAST_HOT = 1000, 200


def hot_keys(counts: DataFrame, key: str) -> list:
    """Keys whose count n is hot, by counts(key, n) of all keys: fewer than HOT, whatever the size."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    return sorted(r[0] for r in counts.where((F.col("n") >= LEAST_HOT) & (F.col("n") * HOT > total)).select(key).collect())


def join_to_one(rows: DataFrame, ones: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """rows joined to ones, which has at most one row for each key; null keys find nothing.

    What belongs to hot keys is broadcast, fewer than HOT rows, and their rows
    stay where they are; so do rows of null keys. Only the rest is shuffled.
    """
    known = F.col(key).isNotNull()
    if hot is None:
        hot = hot_keys(rows.where(known).groupBy(key).agg(F.count("*").alias("n")), key)
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    out = rows.where(known & ~is_hot).join(ones, key, how)
    if hot:
        out = out.unionByName(rows.where(known & is_hot).join(F.broadcast(ones.where(F.col(key).isin(hot))), key, how))
    if how == "left":
        others = [F.lit(None).cast(f.dataType).alias(f.name) for f in ones.schema if f.name != key]
        out = out.unionByName(rows.where(~known).select("*", *others))
    return out


#: Ids up to this many are broadcast.
FEW_IDS = 1 << 20


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for the rows of ids(doc_id), distinct and written. Few ids are broadcast, so that texts stay where they are; many are joined by a shuffle."""
    few = ids.count() <= FEW_IDS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti").select(*docs.columns)


def arrow_schema(ddl: str) -> pa.Schema:
    """The Arrow schema of "name type, name type"."""
    return pa.schema([(n, _TYPES[t]) for n, t in (part.split() for part in ddl.split(", "))])


#: What operators remember in a worker, by module. A task of another module drops it.
_memories: dict[str, dict] = {}


def memory(module: str) -> dict:
    """The worker's memory of a module."""
    return _memories.setdefault(module, {})


def forget_others(module: str) -> None:
    """Workers live on between stages: what an earlier operator remembered is dropped before another one starts."""
    others = [m for name, m in _memories.items() if name != module and m]
    for m in others:
        m.clear()
    if others:
        release()


def release() -> None:
    """Gives memory that is no longer used back to the machine, where the C library can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: Arrow batches are handed to functions in parts of about this many bytes.
PART_BYTES = 4 << 20


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about PART_BYTES, so that what is made of them stays small too."""
    step = max(1, batch.num_rows * PART_BYTES // max(1, batch.nbytes))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict[str, list]], dict[str, list]]], ddl: str) -> DataFrame:
    """Applies a function from columns to columns to every part of every Arrow batch.

    make() runs once in each task and returns the function, so that what it
    prepares is not pickled. Batches are taken in parts, so memory is bounded.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others(make.__module__)
        schema, one = arrow_schema(ddl), make()
        for batch in batches:
            for part in parts(batch):
                out = one({n: part.column(k).to_pylist() for k, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    workers_know(df.sparkSession)
    return df.mapInArrow(run, ddl)


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and text of documents; null texts become empty, other columns are dropped."""
    workers_know(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
