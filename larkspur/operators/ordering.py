"""Row numbers and zone maps without a task that holds all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GRANULE = 512
PART_ROWS = 1_000_000


def numbered(df: DataFrame, key: str, to: str = "row", part_rows: int = PART_ROWS) -> DataFrame:
    """df with the place of each row in ascending order of a numeric key, from 0.

    Ranges of the key hold about part_rows rows each; their counts, a row a range, give each its offset.
    """
    parts = max(1, -(-df.count() // part_rows))
    bounds = sorted(set(df.approxQuantile(key, [i / parts for i in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    cut = df.withColumn("__part", F.lit(0.0))
    if bounds:  # a binary search a row, in the JVM
        edges = [float("-inf"), *bounds, float("inf")]
        cut = Bucketizer(splits=edges, inputCol="__key", outputCol="__part", handleInvalid="keep").transform(df.withColumn("__key", F.col(key).cast("double"))).drop("__key")
    cut = cut.withColumn("__part", F.when(F.col(key).isNull(), -1.0).otherwise(F.col("__part")))
    counts = cut.groupBy("__part").agg(F.count("*").alias("__n"))
    first = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    place = cut.withColumn("__row", F.row_number().over(W.partitionBy("__part").orderBy(key)) - 1)
    return place.join(F.broadcast(first), F.col("__part") == F.col("__p")).select(*df.columns, (F.col("__first") + F.col("__row")).cast("long").alias(to))


def zone_map(df: DataFrame, key: str, columns: list[str], granule: int = GRANULE) -> DataFrame:
    """Rows, least and greatest value of each granule of rows in key order."""
    rows = numbered(df.select(key, *(c for c in columns if c != key)), key, "__place").withColumn("granule", F.floor(F.col("__place") / granule))
    return rows.groupBy("granule").agg(F.count("*").alias("n_rows"), *(f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))))


def read_granules(df: DataFrame, key: str, zones: DataFrame, granules: Sequence[int]) -> DataFrame:
    """The rows of some granules of a zone map that covers its key, which is unique.

    Only the key's bounds of these granules come to the driver; the scan skips what lies outside
    of them by the statistics of its files.
    """
    found = zones.filter(F.col("granule").isin(*granules)).select(F.col(f"min_{key}").alias("low"), F.col(f"max_{key}").alias("high")).collect()
    wanted = F.lit(False)
    for r in found:
        wanted = wanted | F.col(key).between(r.low, r.high)
    return df.filter(wanted)
