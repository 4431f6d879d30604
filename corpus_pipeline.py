"""Cleans a corpus and encodes it: toxic documents go, one of each group of near
duplicates stays, documents that hold benchmark items go, the rest is encoded.

Each stage is a function of (spark, docs, sf_dir), works on all that its
predecessor kept and returns the columns of documents; the last returns ids.
run() writes each stage's result to the shared folder and reads it back.

Defined cases: a null text is empty; such rows and empty texts are clean, no
near duplicates and no contamination, and have no ids at the end. Toxic and
contaminated rows go whatever their ids are. Rows with null ids are no near
duplicates of anything; rows that share an id are one document there and stay
or go together. Extra columns of documents go along until the last stage. Empty
tables give no rows; without labels of both classes no document is toxic,
without benchmark items none is contaminated.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import bpe, decontam, neardup, toxicity
from driftlens.llm.common import table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold; the classifier learns from labelled ones among docs."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, that of the smallest id."""
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, decoded_sha256) of each document."""
    rows = bpe.encode_ids(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.col("ids").alias("token_ids"), "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("bpe", encode),
]

#: SQL can express neither the classifier nor the merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
