"""Table definitions and their schema.json."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import types as T

from larkspur.functions.types import DeclaredType, field


@dataclass(frozen=True)
class TableDef:
    """A name, ordered columns (name, type) and the indices of the sort key."""

    name: str
    columns: tuple[tuple[str, DeclaredType], ...]
    sort_key: tuple[int, ...] = ()

    def __post_init__(self):
        names = [n for n, _ in self.columns]
        if len(set(names)) < len(names) or not names:
            raise ValueError("column names must be distinct, one at least")
        if any(not 0 <= i < len(names) for i in self.sort_key):
            raise ValueError("sort key out of range")

    @property
    def spark(self) -> T.StructType:
        return T.StructType([field(n, t) for n, t in self.columns])

    @property
    def sort_columns(self) -> list[str]:
        return [self.columns[i][0] for i in self.sort_key]

    def json(self) -> str:
        return json.dumps({"name": self.name, "columns": [{"name": n, "type": t.value} for n, t in self.columns], "sort_key": list(self.sort_key)}, indent=1)

    @staticmethod
    def parse(text: str) -> TableDef:
        d = json.loads(text)
        return TableDef(d["name"], tuple((c["name"], DeclaredType(c["type"])) for c in d["columns"]), tuple(d["sort_key"]))


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_definition(spark: SparkSession, folder: str, table: TableDef) -> None:
    fs, p = _file(spark, f"{folder}/schema.json")
    if fs.exists(p):
        raise FileExistsError(f"{folder} already holds a table")
    out = fs.create(p, False)
    try:
        out.write(bytearray(table.json().encode()))
    finally:
        out.close()


def read_definition(spark: SparkSession, folder: str) -> TableDef:
    fs, p = _file(spark, f"{folder}/schema.json")
    if not fs.exists(p):
        raise FileNotFoundError(f"{folder} holds no table")
    rows = spark.read.text(f"{folder}/schema.json", wholetext=True).collect()
    return TableDef.parse(rows[0][0])


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _file(spark, path)
    return bool(fs.exists(p))
