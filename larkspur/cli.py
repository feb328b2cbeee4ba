"""python -m larkspur.cli FOLDER...: read statements, print their results, until the end of input."""

from __future__ import annotations

import sys

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from larkspur.plans.sql import Engine


def main(folders: list[str]) -> None:
    engine = Engine(SparkSession.builder.getOrCreate())
    for f in folders:
        engine.attach(f)
    while True:
        try:
            line = input("> ")
        except (EOFError, KeyboardInterrupt):
            return
        if not line.strip():
            continue
        try:
            got = engine.sql(line)
            got.show(truncate=False) if isinstance(got, DataFrame) else print(f"{got} rows")
        except (ValueError, PySparkException) as e:
            print(f"error: {e}")


if __name__ == "__main__":
    main(sys.argv[1:])
