"""The logical side of delta, run-length and dictionary coding, block by block.

Blocks are independent, as storage blocks are: a block's rows are ordered by `order`, and no window
spans two blocks, so the work splits by block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST = 65_535


def delta_encode(df: DataFrame, block: str, order: str, value: str, to: str = "delta") -> DataFrame:
    """The first value of a block, then differences modulo 2**64."""
    w = W.partitionBy(block).orderBy(order)
    before = F.lag(value).over(w)
    wide = (F.col(value).cast("decimal(38,0)") - before.cast("decimal(38,0)"))
    half, size = F.lit(str(1 << 63)).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")
    return df.withColumn(to, F.when(before.isNull(), F.col(value)).otherwise((F.pmod(wide + half, size) - half).cast("long")))


def delta_decode(df: DataFrame, block: str, order: str, delta: str = "delta", to: str = "value") -> DataFrame:
    w = W.partitionBy(block).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    total = F.sum(F.col(delta).cast("decimal(38,0)")).over(w)
    half, size = F.lit(str(1 << 63)).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")
    return df.withColumn(to, (F.pmod(total + half, size) - half).cast("long"))


def run_lengths(df: DataFrame, block: str, order: str, value: str) -> DataFrame:
    """(block, run, value, n): maximal runs of equal values, split after 65,535."""
    w = W.partitionBy(block).orderBy(order)
    start = df.select(F.col(block).alias("block"), F.col(order).alias("at"), F.col(value).alias("value"), F.when(F.lag(value).over(w).eqNullSafe(F.col(value)) & (F.row_number().over(w) > 1), 0).otherwise(1).alias("new"))
    runs = start.withColumn("island", F.sum("new").over(W.partitionBy("block").orderBy("at").rowsBetween(W.unboundedPreceding, 0)))
    place = F.row_number().over(W.partitionBy("block", "island").orderBy("at")) - 1
    cut = runs.withColumn("part", F.floor(place / MOST))
    rows = cut.groupBy("block", "island", "part").agg(F.first("value").alias("value"), F.count("*").alias("n"))
    return rows.select("block", (F.row_number().over(W.partitionBy("block").orderBy("island", "part")) - 1).cast("long").alias("run"), "value", "n")


def run_lengths_decode(runs: DataFrame) -> DataFrame:
    """(block, value), a row for each of a run's n."""
    return runs.select("block", "run", "value", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).drop("i")


def dictionary_encode(df: DataFrame, block: str, order: str, value: str) -> tuple[DataFrame, DataFrame]:
    """(rows with `code`, dictionary of (block, code, value)); codes from 0, in order of first occurrence in the block."""
    first = df.groupBy(F.col(block).alias("block"), F.col(value).alias("value")).agg(F.min(order).alias("first"))
    words = first.select("block", (F.row_number().over(W.partitionBy("block").orderBy("first")) - 1).cast("long").alias("code"), "value")
    joined = df.join(words.withColumnRenamed("value", "__v").withColumnRenamed("block", "__b"), (F.col(block) == F.col("__b")) & F.col(value).eqNullSafe(F.col("__v")))
    return joined.drop("__b", "__v"), words


def dictionary_decode(coded: DataFrame, words: DataFrame, block: str, to: str = "value") -> DataFrame:
    """The coded rows with each code's value; coded has `block` and `code`, words is (block, code, value)."""
    w = words.select(F.col("block").alias("__b"), F.col("code").alias("__c"), F.col("value").alias(to))
    return coded.join(w, (F.col(block) == F.col("__b")) & (F.col("code") == F.col("__c"))).drop("__b", "__c")
