"""Count-min counters and top-k lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEPTH, WIDTH = 5, 2048
MOST = (1 << 32) - 1


def _slots(col, depth: int, width: int, seed: int):
    """Every counter of a value: one slot in each row."""
    if width & (width - 1) or width < 1 or depth < 1:
        raise ValueError("width must be a power of two, depth 1 at least")
    return F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), F.pmod(F.xxhash64(F.lit(seed + d), col), F.lit(width)).cast("int").alias("slot")) for d in range(depth)))).alias("at")


def count_min(df: DataFrame, column: str, depth: int = DEPTH, width: int = WIDTH, seed: int = 0) -> DataFrame:
    """The sketch as (depth, slot, n), depth * width rows at most; counters stop at 2**32 - 1.

    Each task adds up its own counters, so the shuffle sees depth * width rows a task at most,
    however many distinct values there are.
    """
    hits = df.select(_slots(F.col(column), depth, width, seed))
    return hits.groupBy(F.col("at.depth").alias("depth"), F.col("at.slot").alias("slot")).agg(F.least(F.count("*"), F.lit(MOST)).alias("n"))


def estimate(items: DataFrame, column: str, sketch: DataFrame, depth: int = DEPTH, width: int = WIDTH, seed: int = 0) -> DataFrame:
    """items with `estimate`, the least of each value's counters: never under the true count, 0 for what hits an empty one.

    The sketch is broadcast: it has depth * width rows at most.
    """
    kinds = items.select(F.col(column).alias("value")).distinct()
    hit = kinds.select("value", _slots(F.col("value"), depth, width, seed))
    s = sketch.select(F.col("depth").alias("d"), F.col("slot").alias("s"), "n")
    hit = hit.join(F.broadcast(s), (F.col("at.depth") == F.col("d")) & (F.col("at.slot") == F.col("s")), "left")
    least = hit.groupBy("value").agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))
    return items.join(least, items[column].eqNullSafe(least["value"])).drop("value")


def top_k(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values, exactly, with `n`; ties go to the smaller value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.col(column)).limit(k)


def approx_top_k(df: DataFrame, column: str, k: int, tracked: int = 10_000) -> DataFrame:
    """The k most frequent values from a mergeable summary of at most `tracked` items."""
    got = df.agg(F.expr(f"approx_top_k(`{column}`, {k}, {tracked})").alias("top"))
    return got.select(F.explode("top").alias("t")).select(F.col("t.item").alias(column), F.col("t.count").alias("n"))
