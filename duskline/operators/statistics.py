"""Table and column statistics, selectivity estimates, index advice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .relational import quoted, user_columns

MANY_VALUES = 1000
#: Past NDV_EXACT distinct values an estimate stands for the exact number.
NDV_EXACT = 1000
UNKNOWN_EQUALITY, UNKNOWN_RANGE, UNKNOWN_JOIN = 0.1, 0.5, 0.1
AUTO_INDEX_QUERIES, AUTO_INDEX_MOST = 100, 5
USE_INDEX_BELOW = 0.2


def table_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def column_statistics(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """A row for each column: n_rows, n_values, n_nulls, ndv, min_value, max_value, avg_number, avg_length.

    One pass over the table for all columns. ndv is an estimate unless `exact`; min and max are text.
    """
    own = list(columns or user_columns(df))
    parts = []
    for i, c in enumerate(own):
        kind, x = df.schema[c].dataType, quoted(c)
        ordered = not isinstance(kind, (T.MapType, T.VariantType))
        number = isinstance(kind, T.NumericType)
        parts += [
            F.count(x).alias(f"n{i}"),
            (F.count_distinct(x) if exact else F.approx_count_distinct(x)).alias(f"d{i}") if ordered else F.lit(None).cast("long").alias(f"d{i}"),
            (F.min(x).cast("string") if ordered else F.lit(None).cast("string")).alias(f"lo{i}"),
            (F.max(x).cast("string") if ordered else F.lit(None).cast("string")).alias(f"hi{i}"),
            (F.avg(x).cast("double") if number else F.lit(None).cast("double")).alias(f"a{i}"),
            (F.avg(F.length(x)) if isinstance(kind, T.StringType) else F.lit(None).cast("double")).alias(f"l{i}"),
        ]
    wide = df.agg(F.count(F.lit(1)).alias("n"), *parts)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"n{i}").alias("n_values"), (F.col("n") - F.col(f"n{i}")).alias("n_nulls"), F.col(f"d{i}").alias("ndv"), F.col(f"lo{i}").alias("min_value"), F.col(f"hi{i}").alias("max_value"), F.col(f"a{i}").alias("avg_number"), F.col(f"l{i}").alias("avg_length")) for i, c in enumerate(own)]
    return wide.select(F.inline(F.array(*rows)))


def equality_selectivity(ndv: int | None) -> float:
    return UNKNOWN_EQUALITY if not ndv or ndv > NDV_EXACT else 1 / ndv


def range_selectivity(low: float | None, high: float | None, op: str, value: float) -> float:
    """The share of a closed interval of values on one side of a value, if values are spread evenly."""
    if low is None or high is None or high <= low:
        return UNKNOWN_RANGE
    below = min(1.0, max(0.0, (value - low) / (high - low)))
    return below if op in ("<", "<=") else 1 - below


def join_selectivity(left_ndv: int | None, right_ndv: int | None) -> float:
    most = max(left_ndv or 0, right_ndv or 0)
    return 1 / most if most else UNKNOWN_JOIN


def index_pays(selectivity: float) -> bool:
    """Whether so few rows qualify that an ordered copy is worth reading."""
    return selectivity <= USE_INDEX_BELOW


def index_advice(statistics: DataFrame) -> DataFrame:
    """Columns worth an index: over MANY_VALUES values, of which between a thousandth and a half are distinct."""
    share = F.col("ndv") / F.col("n_values")
    return statistics.where((F.col("n_values") > MANY_VALUES) & (share > 0.001) & (share < 0.5)).select("column_name", "n_values", "ndv", share.alias("distinct_share"))


def frequent_predicates(log: DataFrame, least: int = AUTO_INDEX_QUERIES, most: int = AUTO_INDEX_MOST) -> DataFrame:
    """Columns that a query log (db, tbl, col) filters on often: at least `least` times, `most` columns a table."""
    counted = log.groupBy("db", "tbl", "col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    rank = F.row_number().over(Window.partitionBy("db", "tbl").orderBy(F.col("n").desc(), "col"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= most).select("db", "tbl", "col", "n")


def has_compound_index(indexed: Sequence[str], columns: Sequence[str]) -> bool:
    return all(c in indexed for c in columns)


def best_index(selectivities: dict[str, float]) -> str | None:
    """The indexed column whose predicate leaves fewest rows, if it pays at all."""
    pays = {c: s for c, s in selectivities.items() if index_pays(s)}
    return min(pays, key=lambda c: (pays[c], c)) if pays else None
