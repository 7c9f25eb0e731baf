"""Grouping and aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .relational import name_of, quoted

FUNCTIONS = ("count", "sum", "avg", "min", "max")


def expression(df: DataFrame, function: str, column: str = "*", distinct: bool = False) -> Column:
    """An aggregate over a column of df, or over rows for count(*)."""
    function = function.lower()
    if function not in FUNCTIONS:
        raise ValueError(f"unknown aggregate {function!r}")
    if column == "*":
        if function != "count":
            raise ValueError(f"{function}(*) is no aggregate")
        return F.count(F.lit(1))
    c = quoted(name_of(df, column))
    if distinct:
        return F.count_distinct(c) if function == "count" else F.sum_distinct(c) if function == "sum" else getattr(F, function)(c)
    return getattr(F, function)(c)


def aggregate(df: DataFrame, aggregates: Sequence[tuple[str, str, str]], by: Sequence[str] = ()) -> DataFrame:
    """(function, column or '*', name) aggregates of each group, or of all rows."""
    made = [expression(df, f, c).alias(name) for f, c, name in aggregates]
    if not by:
        return df.agg(*made)
    return df.groupBy(*[quoted(name_of(df, c)) for c in by]).agg(*made)
