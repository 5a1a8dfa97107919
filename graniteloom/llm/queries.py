"""The queries of this subpackage: whole tables, production parameters, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from graniteloom.llm import bpe, chat, clustering, embedding_dedup, mixing, ngram_join, packing, pii, quality, rules, sharding, toxicity, whitening
from graniteloom.llm.oracles import ORACLE


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_segment_toxicity": toxicity.op1,
        "op2_contextual_pii": pii.op2,
        "op3_multi_index_dedup": embedding_dedup.op3,
        "op4_sainte_lague_mix": mixing.op4,
        "op5_bounded_ring": sharding.op5,
        "op6_signature_tree_join": ngram_join.op6,
        "op7_budgeted_chat": chat.op7,
        "op8_byte_bpe": bpe.op8,
        "op9_compression_quality": quality.op9,
        "op10_quality_rules": rules.op10,
        "op11_jacobi_whitening": whitening.op11,
        "op12_certified_packing": packing.op12,
        "op13_block_norm_clusters": clustering.op13,
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
