"""Projection, filter, global and grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from larkspur.functions.aggregates import Agg, AggregateError, build


def project(df: DataFrame, columns: Sequence[str] | str = "*") -> DataFrame:
    """The columns in the order given; `*` alone gives all."""
    if columns == "*" or list(columns) == ["*"]:
        return df
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"unknown column '{missing[0]}'")
    return df.select(*(f"`{c}`" for c in columns))


def keep(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def aggregate(df: DataFrame, aggs: Sequence[Agg]) -> DataFrame:
    """One row, over no rows too."""
    if not aggs:
        raise AggregateError("no aggregate")
    return df.agg(*(build(df, a) for a in aggs))


def group(df: DataFrame, keys: Sequence[str], aggs: Sequence[Agg] = ()) -> DataFrame:
    """Keys, then aggregates; without aggregates the distinct keys. NaN keys are one key, and -0.0 is 0.0."""
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"unknown column '{missing[0]}'")
    if not aggs:
        return df.select(*(f"`{k}`" for k in keys)).distinct()
    return df.groupBy(*(f"`{k}`" for k in keys)).agg(*(build(df, a) for a in aggs))
