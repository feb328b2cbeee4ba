"""SUM, AVG, MIN, MAX and COUNT for the non-null model: an aggregate of nothing is 0, and NaN loses to any number."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.types import DeclaredType, declared_of

FUNCTIONS = ("sum", "avg", "min", "max", "count")


class AggregateError(ValueError):
    """An unknown function or column, or a type the function doesn't take."""


@dataclass(frozen=True)
class Agg:
    """func(column) AS alias; `*` is for count only. exact_width: a sum of its column's type that wraps."""

    func: str
    column: str
    alias: str | None = None
    exact_width: bool = False

    @property
    def name(self) -> str:
        return self.alias or f"{self.func.lower()}({self.column})"


def wrapped(total: Column, declared: DeclaredType) -> Column:
    """An exact integer total modulo the type's width."""
    size = F.lit(str(1 << declared.bits)).cast("decimal(38,0)")
    wide = total.cast("decimal(38,0)")
    if not declared.signed:
        return F.pmod(wide, size).cast(declared.spark)
    half = F.lit(str(1 << declared.bits - 1)).cast("decimal(38,0)")
    return (F.pmod(wide + half, size) - half).cast(declared.spark)


def build(df: DataFrame, agg: Agg) -> Column:
    func = agg.func.lower()
    if func not in FUNCTIONS:
        raise AggregateError(f"unknown function '{agg.func}'")
    if agg.column == "*":
        if func != "count":
            raise AggregateError(f"{func}(*) is not defined")
        return F.count(F.lit(1)).alias(agg.name)
    if agg.column not in df.columns:
        raise AggregateError(f"unknown column '{agg.column}'")
    col, field = F.col(f"`{agg.column}`"), df.schema[agg.column]
    declared = declared_of(field)
    if func == "count":
        return F.count(col).alias(agg.name)
    if declared is not None and not declared.numeric:
        raise AggregateError(f"{func} doesn't take column '{agg.column}' ({declared.value})")
    if func == "sum":
        if agg.exact_width and declared and declared.integral:
            return wrapped(F.coalesce(F.sum(col.cast("decimal(38,0)")), F.lit(0)), declared).alias(agg.name)
        total = F.coalesce(F.sum(col), F.lit(0))
        return (total.cast(field.dataType) if agg.exact_width else total).alias(agg.name)
    if func == "avg":
        return F.coalesce(F.avg(col.cast("double")), F.lit(0.0)).alias(agg.name)
    pick = F.min if func == "min" else F.max
    zero = F.lit(0).cast(field.dataType)
    if declared and declared.floating:
        return F.coalesce(pick(F.when(~F.isnan(col), col)), pick(col), zero).alias(agg.name)
    return F.coalesce(pick(col), zero).alias(agg.name)
