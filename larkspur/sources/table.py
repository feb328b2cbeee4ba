"""Parquet tables: a definition, and immutable parts sorted by the table's key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.sources.schema import TableDef, exists, read_definition, write_definition
from larkspur.sources.validate import checked, checked_frame


class Table:
    """A table in a folder of any store that Spark reads.

    Each insert of rows appends one sorted file. Readers see a file once its job has committed.
    Writers of one table must take turns, as they share Spark's temporary folder.
    """

    def __init__(self, spark: SparkSession, folder: str, definition: TableDef):
        self.spark, self.folder, self.definition = spark, folder.rstrip("/"), definition

    @staticmethod
    def create(spark: SparkSession, folder: str, definition: TableDef) -> Table:
        write_definition(spark, folder, definition)
        return Table(spark, folder, definition)

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Table:
        table = Table(spark, folder, read_definition(spark, folder))
        table._recover()
        return table

    @property
    def data(self) -> str:
        return f"{self.folder}/data"

    def scan(self, columns: Sequence[str] | None = None) -> DataFrame:
        """All parts; empty and typed if there is none."""
        schema = self.definition.spark
        df = self.spark.read.schema(schema).parquet(self.data) if exists(self.spark, self.data) else self.spark.createDataFrame([], schema)
        df = df.select(*(F.col(f.name).alias(f.name, metadata=f.metadata) for f in schema))
        return df if columns is None else df.select(*(f"`{c}`" for c in columns))

    def _write(self, df: DataFrame, folder: str, mode: str) -> None:
        """lz4_raw pages; integers delta-coded (pages of the second version, no dictionary for them)."""
        out = df.write.mode(mode).option("compression", "lz4_raw").option("parquet.writer.version", "PARQUET_2_0")
        for f in df.schema:
            if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
                out = out.option(f"parquet.enable.dictionary#{f.name}", "false")
        out.parquet(folder)

    def _append(self, df: DataFrame) -> None:
        keys = self.definition.sort_columns
        self._write(df.sortWithinPartitions(*keys) if keys else df, self.data, "append")

    def insert(self, rows: Sequence[Sequence], columns: Sequence[str] | None = None) -> int:
        """Append rows as one part, all of them or none; returns how many. Rows with equal keys keep their order."""
        good = checked(self.definition, rows, columns)
        if good:
            schema, keys = self.definition.spark, self.definition.sort_columns
            numbered = T.StructType([*schema.fields, T.StructField("__place", T.LongType())])
            df = self.spark.createDataFrame([(*r, i) for i, r in enumerate(good)], numbered).coalesce(1)
            self._write(df.sortWithinPartitions(*keys, "__place").drop("__place"), self.data, "append")
        return len(good)

    def insert_frame(self, df: DataFrame, parts: int | None = None) -> None:
        """Append a DataFrame, checked by column, as parts that are ranges of the sort key."""
        good, keys = checked_frame(self.definition, df), self.definition.sort_columns
        if keys:
            good = good.repartitionByRange(parts, *keys) if parts else good.repartitionByRange(*keys)
        elif parts:
            good = good.repartition(parts)
        self._append(good)

    def parts(self) -> DataFrame:
        """(part, n_rows) of each file."""
        return self.scan_with_part().groupBy("part").agg(F.count("*").alias("n_rows"))

    def scan_with_part(self) -> DataFrame:
        if not exists(self.spark, self.data):
            return self.scan().withColumn("part", F.lit(None).cast("string"))
        return self.spark.read.schema(self.definition.spark).parquet(self.data).select("*", F.col("_metadata.file_name").alias("part"))

    def compact(self, parts: int = 1) -> None:
        """Rewrite all parts as so many ranges of the sort key.

        The new folder is written whole, the old one is renamed away, the new one is renamed in and
        the old one deleted. What a crash leaves in between, `open` puts right; readers that start
        between the two renames fail and must read again.
        """
        keys = self.definition.sort_columns
        df = self.scan()
        df = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) if keys else df.repartition(parts)
        self._write(df, self._fresh, "overwrite")
        self._rename(self.data, self._old)
        self._rename(self._fresh, self.data)
        self._delete(self._old)

    @property
    def _fresh(self) -> str:
        return f"{self.folder}/data-new"

    @property
    def _old(self) -> str:
        return f"{self.folder}/data-old"

    def _path(self, folder: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _rename(self, a: str, b: str) -> None:
        (p, fs), (q, _) = self._path(a), self._path(b)
        if not fs.rename(p, q):
            raise OSError(f"can't rename {a} to {b}")

    def _delete(self, folder: str) -> None:
        p, fs = self._path(folder)
        fs.delete(p, True)

    def _recover(self) -> None:
        """After a crash in `compact`: all rows are in data, or else in data-old."""
        if exists(self.spark, self._old):
            if exists(self.spark, self.data):
                self._delete(self._old)
            else:
                self._rename(self._old, self.data)
