"""Joins with the dialect's output columns: left fields bare, right fields behind the right table's name.

The right side's columns are always the prefixed ones, whichever side Spark builds a hash table on. Keys of equal
value and type match; a null or missing key matches nothing. Strategy hints leave the decision to Catalyst unless a
caller insists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relational import INTERNAL, name_of, quoted

STRATEGIES = {"hash": "shuffle_hash", "merge": "merge", "nested_loop": "shuffle_replicate_nl", "broadcast": "broadcast"}
HOW = ("inner", "left", "right", "full", "semi", "anti", "cross")


def prefixed(df: DataFrame, name: str) -> DataFrame:
    """df with its columns behind `name_`, without internal ones."""
    return df.select(*[quoted(c).alias(f"{name}_{c}") for c in df.columns if not c.startswith(INTERNAL)])


def _same_kind(a: T.DataType, b: T.DataType) -> bool:
    return a == b or (isinstance(a, T.NumericType) and isinstance(b, T.NumericType))


def equi_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]], right_name: str, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """Join on pairs of a left and a right column. Keys of different kinds never match."""
    if how not in HOW:
        raise ValueError(f"unknown join {how!r}")
    renamed = prefixed(right, right_name)
    if strategy:
        renamed = renamed.hint(STRATEGIES[strategy])
    if how == "cross":
        return left.crossJoin(renamed)
    condition = None
    for l, r in on:
        a, b = name_of(left, l), name_of(right, r)
        same = _same_kind(left.schema[a].dataType, right.schema[b].dataType)
        key = (left["`" + a + "`"] == renamed[f"`{right_name}_{b}`"]) if same else F.lit(False)
        condition = key if condition is None else condition & key
    return left.join(renamed, condition, {"semi": "left_semi", "anti": "left_anti"}.get(how, how))


def join_same_column(left: DataFrame, right: DataFrame, column: str, right_name: str, strategy: str | None = None) -> DataFrame:
    """Inner join of two tables on one column that both have under the same name."""
    return equi_join(left, right, [(column, column)], right_name, "inner", strategy)


def cross_join(left: DataFrame, right: DataFrame, right_name: str) -> DataFrame:
    return equi_join(left, right, [], right_name, "cross")


def join_chain(first: DataFrame, rest: Sequence[tuple[DataFrame, str, Sequence[tuple[str, str]], str]]) -> DataFrame:
    """Several joins in a row: (table, name, key pairs, how). Left keys may name prefixed columns of earlier tables."""
    out = first
    for table, name, on, how in rest:
        out = equi_join(out, table, on, name, how)
    return out
