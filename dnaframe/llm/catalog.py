"""The registered queries of the operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dnaframe.llm import clusters, langid, lm, mixing, packing, prefixtrie, pstable, quality, secrets, sharding, simhash, suffix, topk


def _on(table: str, query) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def _lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_query(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_divergence": _on("documents", quality.quality_query),
        "op2_simhash_dedup": _on("documents", simhash.simhash_query),
        "op3_best_fit_packing": _on("documents", packing.packing_query),
        "op4_secret_scan": _on("documents", secrets.secrets_query),
        "op5_language_id": _on("documents", langid.langid_query),
        "op6_source_mixing": _on("documents", mixing.mixing_query),
        "op7_top_inner_products": _on("embeddings", topk.topk_query),
        "op8_lm_difference": _lm,
        "op9_suffix_dedup": _on("documents", suffix.suffix_query),
        "op10_balanced_sharding": _on("documents", sharding.sharding_query),
        "op11_vector_dedup": _on("embeddings", pstable.pstable_query),
        "op12_conversation_trie": _on("conversations", prefixtrie.trie_query),
        "op13_centroid_clusters": _on("embeddings", clusters.clusters_query),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_secret_scan": secrets.ORACLE_SQL,
        "op7_top_inner_products": topk.ORACLE_SQL,
        "op11_vector_dedup": pstable.ORACLE_SQL,
        "op12_conversation_trie": prefixtrie.ORACLE_SQL,
        "op13_centroid_clusters": clusters.ORACLE_SQL,
    }
