"""Comparisons with literals, and their combinations, as columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.functions.types import declared_of

OPERATORS = {"=": "__eq__", "!=": "__ne__", "<": "__lt__", "<=": "__le__", ">": "__gt__", ">=": "__ge__"}


class PredicateError(ValueError):
    """An unknown column or operator, or a literal that can't be compared with its column."""


def compare(df: DataFrame, name: str, op: str, value) -> Column:
    """`name op value`, in IEEE order: a NaN is unequal to, and neither below nor above, every number."""
    if name not in df.columns:
        raise PredicateError(f"unknown column '{name}'")
    if op not in OPERATORS:
        raise PredicateError(f"unknown operator '{op}'")
    declared = declared_of(df.schema[name])
    if value is None:
        raise PredicateError("NULL can't be compared")
    kind = "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float, Decimal)) else "str" if isinstance(value, str) else "other"
    wanted = None if declared is None else "number" if declared.numeric else "bool" if declared.value == "Bool" else "str"
    if wanted and kind != wanted:
        raise PredicateError(f"column '{name}' ({declared.value}) can't be compared with {value!r}")
    lit = F.lit(Decimal(value)) if kind == "number" and isinstance(value, int) and not -(1 << 63) <= value < 1 << 63 else F.lit(value)
    col = F.col(f"`{name}`")
    out = getattr(col, OPERATORS[op])(lit)
    if declared and declared.floating and op in (">", ">="):
        out = out & ~F.isnan(col)
    return out


def all_of(*parts: Column) -> Column:
    out = F.lit(True)
    for p in parts:
        out = out & p
    return out


def any_of(*parts: Column) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def negate(part: Column) -> Column:
    return ~part
