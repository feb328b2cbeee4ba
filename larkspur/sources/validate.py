"""Checks of inserted values, cell by cell for literals and by column for DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions.types import DeclaredType
from larkspur.sources.schema import TableDef


class InsertError(ValueError):
    """Rows that a table can't take."""


def reordered(table: TableDef, rows: Sequence[Sequence], columns: Sequence[str] | None) -> list[list]:
    """Rows in the table's column order; a column list must name each column once."""
    names = [n for n, _ in table.columns]
    order = list(range(len(names)))
    if columns is not None:
        if sorted(columns) != sorted(names):
            raise InsertError(f"the column list must name every column of '{table.name}' once")
        order = [list(columns).index(n) for n in names]
    out = []
    for i, row in enumerate(rows):
        if len(row) != len(names):
            raise InsertError(f"row {i}: expected {len(names)} values, got {len(row)}")
        out.append([row[j] for j in order])
    return out


def _cell(value, declared: DeclaredType):
    """The value as the type takes it; TypeError: of another kind, OverflowError: out of range."""
    if declared is DeclaredType.BOOL or isinstance(value, bool):
        if declared is DeclaredType.BOOL and isinstance(value, bool):
            return value
        raise TypeError
    if declared is DeclaredType.STR or isinstance(value, str):
        if declared is DeclaredType.STR and isinstance(value, str):
            return value
        raise TypeError
    if declared.integral:
        if not isinstance(value, int):
            raise TypeError
        low, high = declared.bounds
        if not low <= value <= high:
            raise OverflowError
        return Decimal(value) if declared is DeclaredType.U64 else value
    if isinstance(value, (int, float, Decimal)):
        return float(value)
    raise TypeError


def checked(table: TableDef, rows: Sequence[Sequence], columns: Sequence[str] | None = None) -> list[list]:
    """Rows ready for the table, or an InsertError that names the first bad cell."""
    out = []
    for i, row in enumerate(reordered(table, rows, columns)):
        made = []
        for j, (value, (name, declared)) in enumerate(zip(row, table.columns, strict=True)):
            at = f"row {i}, col {j} ('{name}')"
            if value is None:
                raise InsertError(f"{at}: NULL is not allowed")
            try:
                made.append(_cell(value, declared))
            except TypeError:
                raise InsertError(f"{at}: value type does not match column type") from None
            except OverflowError:
                raise InsertError(f"{at}: {value} is out of range for {declared.value}") from None
        out.append(made)
    return out


def checked_frame(table: TableDef, df: DataFrame) -> DataFrame:
    """df cast to the table's types, or an InsertError; one pass counts nulls and values out of range."""
    names = [n for n, _ in table.columns]
    if sorted(df.columns) != sorted(names):
        raise InsertError(f"expected columns {names}, got {df.columns}")
    kinds = dict(df.dtypes)
    faults = []
    for n, t in table.columns:
        kind = kinds[n]
        number = kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal")
        whole = number and kind not in ("float", "double") and (not kind.startswith("decimal") or kind.endswith(",0)"))
        if not (whole if t.integral else number if t.floating else kind == ("boolean" if t is DeclaredType.BOOL else "string")):
            raise InsertError(f"column '{n}': {kind} does not match column type {t.value}")
        faults.append(F.count(F.when(F.col(n).isNull(), 1)).alias(f"{n} null"))
        if t.integral:
            low, high = (F.lit(str(b)).cast("decimal(38,0)") for b in t.bounds)
            faults.append(F.count(F.when(~F.col(n).cast("decimal(38,0)").between(low, high), 1)).alias(f"{n} out of range"))
    for what, n in df.agg(*faults).first().asDict().items():
        if n:
            raise InsertError(f"{n} rows: {what}")
    return df.select(*(F.col(n).cast(t.spark).alias(n) for n, t in table.columns))
