"""Scans, projections, filters, sorting, pagination and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce, scalars, text

INTERNAL = "__"


def internal_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(INTERNAL)]


def user_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith(INTERNAL)]


def name_of(df: DataFrame, column: str) -> str:
    """The column's own spelling in df; raises KeyError if there is none."""
    for c in df.columns:
        if c == column:
            return c
    for c in df.columns:
        if c.lower() == column.lower():
            return c
    raise KeyError(column)


def quoted(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def typed(df: DataFrame, column: str) -> tuple[Column, T.DataType]:
    name = name_of(df, column)
    return quoted(name), df.schema[name].dataType


def project(df: DataFrame, columns: Sequence[str], keep_internal: bool = True) -> DataFrame:
    """The listed columns that exist, in the order listed, and the internal ones."""
    known = {c.lower(): c for c in df.columns}
    own = [known[c.lower()] for c in dict.fromkeys(columns) if c.lower() in known]
    rest = [c for c in internal_columns(df) if c not in own] if keep_internal else []
    return df.select(*[quoted(c) for c in [*own, *rest]])


def filter_compare(df: DataFrame, column: str, op: str, value: object) -> DataFrame:
    """Rows that a coercing comparison holds for; none if the column does not exist."""
    try:
        return df.where(coerce.compare(*typed(df, column), op, value))
    except KeyError:
        return df.where(F.lit(False))


def filter_like(df: DataFrame, column: str, pattern: str) -> DataFrame:
    c, _ = typed(df, column)
    return df.where(c.cast("string").like(coerce.like_pattern(pattern)))


def filter_in(df: DataFrame, column: str, values: Sequence[object]) -> DataFrame:
    return df.where(coerce.is_in(*typed(df, column), values))


def filter_in_rows(df: DataFrame, column: str, other: DataFrame, negated: bool = False) -> DataFrame:
    """Rows whose value is (not) in the first column of other. A null value is neither in nor out."""
    c, key, given = _comparable(df, column, other)
    if negated:
        return df.where(c.isNotNull()).join(given, c == key, "left_anti")
    return df.join(given, c == key, "left_semi")


def _comparable(df: DataFrame, column: str, other: DataFrame) -> tuple[Column, Column, DataFrame]:
    """A column of df, the values of other's first column to compare it with, and those values as `__in`, without nulls."""
    c, kind = typed(df, column)
    given = other.select(quoted(other.columns[0]).alias("__in")).where("__in is not null")
    key = F.col("__in")
    if given.schema["__in"].dataType != kind and not (isinstance(kind, T.NumericType) and isinstance(given.schema["__in"].dataType, T.NumericType)):
        return c.cast("string"), key.cast("string"), given
    return c, key, given


def mark_in_rows(df: DataFrame, column: str, other: DataFrame, mark: str) -> DataFrame:
    """df with a Boolean column: whether its value is in the first column of other; null for a null value."""
    c, key, given = _comparable(df, column, other)
    found = given.select(key.alias("__in")).distinct().withColumn("__found", F.lit(True))
    joined = df.join(found, c == F.col("__in"), "left")
    return joined.withColumn(mark, F.when(c.isNotNull(), F.col("__found").isNotNull())).drop("__in", "__found")


def filter_between(df: DataFrame, column: str, low: object, high: object) -> DataFrame:
    return df.where(coerce.between(*typed(df, column), low, high))


def in_range(df: DataFrame, column: str, low: object = None, high: object = None) -> DataFrame:
    """An ordered-index range: closed at both ends, an absent bound is open; nulls are never in it."""
    c, kind = typed(df, column)
    out = df.where(c.isNotNull())
    if low is not None:
        out = out.where(coerce.compare(c, kind, ">=", low))
    if high is not None:
        out = out.where(coerce.compare(c, kind, "<=", high))
    return out


def range_search(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows whose value is a number, or text that is one, from low to high."""
    c, kind = typed(df, column)
    number = c if isinstance(kind, T.NumericType) else coerce.as_number(c, kind)
    return df.where(number.between(F.lit(low), F.lit(high)))


def regex_search(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows in whose text the pattern is found. A pattern that cannot be read matches nothing."""
    if not valid_pattern(df, pattern):
        return df.where(F.lit(False))
    c, _ = typed(df, column)
    return df.where(text.matches(c.cast("string"), pattern))


def valid_pattern(df: DataFrame, pattern: str) -> bool:
    jvm = df.sparkSession.sparkContext._jvm
    try:
        jvm.java.util.regex.Pattern.compile(pattern)
    except (IllegalArgumentException, Py4JJavaError):
        return False
    return True


def sort(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """Order by (column, ascending) pairs: nulls first ascending, last descending. Unknown columns order nothing."""
    order = []
    for column, ascending in keys:
        try:
            c, kind = typed(df, column)
        except KeyError:
            continue
        order.append(c.asc_nulls_first() if ascending else c.desc_nulls_last())
    return df.orderBy(*order) if order else df


def _count(value: object) -> int | None:
    if isinstance(value, bool) or value is None:
        return None
    try:
        return max(0, int(str(value).strip()))
    except ValueError:
        return None


def limit_offset(df: DataFrame, limit: object = None, offset: object = None) -> DataFrame:
    """A limit that is no number keeps all rows, such an offset is 0; negative numbers are 0."""
    start, n = _count(offset), _count(limit)
    if start:
        df = df.offset(start)
    return df if n is None else df.limit(n)


def distinct(df: DataFrame) -> DataFrame:
    """Rows that differ in a column other than the internal ones."""
    return df.select(*[quoted(c) for c in user_columns(df)]).distinct()


def without_replicas(df: DataFrame, row_id: str = "__uuid") -> DataFrame:
    """One row for each row id, of replicas that were read together."""
    return df.dropDuplicates([row_id])


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """SQL UNION: distinct rows of both, matched by position."""
    return a.union(b).distinct()


def union_all(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b)


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def except_(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def add_column(df: DataFrame, column: str, kind: str) -> DataFrame:
    return df.withColumn(column, F.lit(None).cast(kind))


def drop_column(df: DataFrame, column: str) -> DataFrame:
    return df.drop(name_of(df, column))


def merge(df: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of df with those of changes put in: a change replaces the rows of its key, others are added. Null keys are keys like others."""
    asked = changes.select(*[quoted(k).alias(f"__m{i}") for i, k in enumerate(keys)]).distinct()
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & quoted(k).eqNullSafe(F.col(f"__m{i}"))
    return df.join(asked, same, "left_anti").unionByName(changes)


def key_range_overlaps(df: DataFrame, low: str, high: str, other_low: object, other_high: object) -> DataFrame:
    """Rows whose key interval meets the given one: files or blocks that a range scan has to read."""
    return df.where(scalars.ranges_overlap(quoted(low), quoted(high), F.lit(other_low), F.lit(other_high)))
