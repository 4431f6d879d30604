"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from driftlens.llm import bpe, chat, decontam, divergence, hardneg, idfiles, lblm, licenses, neardup, ngramjoin, ogg, shards, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_bpe_duckdb": bpe.op2_bpe_duckdb,
    "op3_toxicity_label_model": toxicity.op3_toxicity_label_model,
    "op4_chat_perspectives": chat.op4_chat_perspectives,
    "op5_ids_zstd_dictionary": idfiles.op5_ids_zstd_dictionary,
    "op6_shard_sampled_splitters": shards.op6_shard_sampled_splitters,
    "op7_minhash_neardup": neardup.op7_minhash_neardup,
    "op8_decontaminate_cgk": decontam.op8_decontaminate_cgk,
    "op9_lm_log_bilinear": lblm.op9_lm_log_bilinear,
    "op10_media_ogg": ogg.op10_media_ogg,
    "op11_ngram_jaccard": ngramjoin.op11_ngram_jaccard,
    "op12_hard_negatives": hardneg.op12_hard_negatives,
    "op13_source_divergence": divergence.op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op4_chat_perspectives": chat.OP4_SQL,
    "op6_shard_sampled_splitters": shards.OP6_SQL,
    "op7_minhash_neardup": neardup.OP7_SQL,
    "op11_ngram_jaccard": ngramjoin.OP11_SQL,
    "op12_hard_negatives": hardneg.OP12_SQL,
    "op13_source_divergence": divergence.OP13_SQL,
}
