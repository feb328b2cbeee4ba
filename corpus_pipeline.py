"""A corpus in five stages: toxic documents go, one of each near-duplicate class stays, benchmark
leaks go, personal data are redacted, and what is left is packed.

Each stage takes all that the one before kept, with all columns of documents; null texts and ids,
repeated rows and empty tables pass as each stage says. Stages lie in the shared folder until the
next is written; the last of them stays until larkspur.llm.common.cleanup(spark) is called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larkspur.llm import decontamination, jaccard_join, packing, pii, toxicity
from larkspur.llm.common import drop, materialize, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score less than the threshold; the model is fitted on labels of documents as they came.

    A null text scores as an empty one; null ids and repeated rows are judged by their texts.
    """
    model = toxicity.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return toxicity.reject(docs, model)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 or more over five words, one row with the smallest id.

    Rows with a null id stay; texts without words, null ones too, are connected with nothing.
    """
    return jaccard_join.keep_one(docs, n=5, num=80, den=100)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of benchmark; null texts stay, and odd items remove nothing."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with redacted texts and n_chars set anew; null texts stay null."""
    return pii.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, piece_start, piece_bytes, bin_id, bin_start): each row's bytes in bins; a null text is a piece of none."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_leaks),
    ("pii", without_pii),
    ("best_fit_packing", packed),
]

#: The stages fit models and walk connected components, which SQL can't express; a brute-force version tests them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on documents, one after the other, each written before the next."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs, path = materialize(stage(spark, docs, sf_dir), name)
        drop(spark, *before)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
