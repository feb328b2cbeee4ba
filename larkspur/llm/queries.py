"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontamination, embedding_dedup, jaccard_join, packing, pii, sharding, substring_dedup, token_files, toxicity, warc_zip
from larkspur.llm.common import table


def _on(name: str, f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: f(table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": _on("documents", sharding.op1),
        "op2_substring_dedup": _on("documents", substring_dedup.op2),
        "op3_jaccard_join": _on("documents", jaccard_join.op3),
        "op4_token_files": _on("documents", token_files.op4),
        "op5_pii": _on("documents", pii.op5),
        "op6_decontamination": lambda spark, sf_dir: decontamination.op6(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op7_toxicity": lambda spark, sf_dir: toxicity.op7(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op8_packing": _on("documents", packing.op8),
        "op9_embedding_dedup": _on("embeddings", embedding_dedup.op9),
        "op10_warc_zip": _on("pages", warc_zip.op10),
    }


#: SQL where it can say what the operator does; the others are tested against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_sharding": sharding.OP1_SQL,
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op3_jaccard_join": jaccard_join.OP3_SQL,
    "op9_embedding_dedup": embedding_dedup.OP9_SQL,
    "op10_warc_zip": warc_zip.OP10_SQL,
}
