"""Comparisons between a column and a literal under the dialect's loose types.

A literal that reads as a plain number is compared as a number wherever the column holds a number or text that reads
as one; everything else is compared as text. A null or missing value satisfies no comparison. Columns that are
already of the literal's type are compared bare, so that the predicate reaches the Parquet scan.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = r"^[+-]?[0-9]+(\.[0-9]*)?$"
OPERATORS = ("=", "!=", "<>", ">", "<", ">=", "<=")
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TEMPORAL = (T.TimestampType, T.TimestampNTZType, T.DateType)
_LONG = 1 << 63


def parse_number(text: str) -> int | float | None:
    """The number that a text plainly is, or None. Integers of any size stay integers."""
    text = text.strip()
    if not re.match(NUMBER, text):
        return None
    return float(text) if "." in text else int(text)


def as_number(column: Column, kind: T.DataType) -> Column:
    """A double where the value is a number or text that plainly is one, else null."""
    if isinstance(kind, T.NumericType):
        return column.cast("double")
    if isinstance(kind, T.StringType):
        return F.when(F.trim(column).rlike(NUMBER), F.trim(column).try_cast("double"))
    return F.lit(None).cast("double")


def _apply(a: Column, op: str, b: Column) -> Column:
    if op == "=":
        return a == b
    if op in ("!=", "<>"):
        return a != b
    if op == ">":
        return a > b
    if op == "<":
        return a < b
    if op == ">=":
        return a >= b
    if op == "<=":
        return a <= b
    raise ValueError(f"unknown operator {op!r}")


def _text(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    return str(value)


def _temporal(value: object, kind: T.DataType) -> Column | None:
    try:
        moment = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(str(value))
    except ValueError:
        return None
    name = {T.DateType: "date", T.TimestampType: "timestamp"}.get(type(kind), "timestamp_ntz")
    return F.lit(moment.isoformat(sep=" ")).cast("timestamp_ntz").cast(name)


def compare(column: Column, kind: T.DataType, op: str, value: object) -> Column:
    """The predicate `column op value`. kind: the column's type."""
    if value is None:
        return F.lit(None).cast("boolean")
    number = value if isinstance(value, (int, float)) and not isinstance(value, bool) else parse_number(value) if isinstance(value, str) else None
    if isinstance(number, int) and not -_LONG <= number < _LONG:
        number = float(number)
    if isinstance(kind, T.BooleanType):
        if _text(value).lower() in ("true", "false") and op in ("=", "!=", "<>"):
            return _apply(column, op, F.lit(_text(value).lower() == "true"))
        return _apply(column.cast("string"), op, F.lit(_text(value)))
    if isinstance(kind, _TEMPORAL) and (moment := _temporal(value, kind)) is not None:
        return _apply(column, op, moment)
    if isinstance(kind, T.NumericType) and number is not None:
        if isinstance(kind, _INTEGRAL) and isinstance(number, int):
            return _apply(column, op, F.lit(number))
        return _apply(column.cast("double"), op, F.lit(float(number)))
    if isinstance(kind, T.StringType) and number is not None:
        numeric = as_number(column, kind)
        return F.when(numeric.isNotNull(), _apply(numeric, op, F.lit(float(number)))).otherwise(_apply(column, op, F.lit(_text(value))))
    text = column if isinstance(kind, T.StringType) else column.cast("string")
    return _apply(text, op, F.lit(_text(value)))


def is_in(column: Column, kind: T.DataType, values: Sequence[object]) -> Column:
    """The predicate `column in (values)`; values of one native type become a single IN."""
    values = [v for v in values if v is not None]
    if not values:
        return F.lit(False)
    plain = isinstance(kind, T.StringType) and all(isinstance(v, str) and parse_number(v) is None for v in values)
    whole = isinstance(kind, _INTEGRAL) and all(isinstance(v, int) and not isinstance(v, bool) and -_LONG <= v < _LONG for v in values)
    if plain or whole:
        return column.isin(list(values))
    out = compare(column, kind, "=", values[0])
    for v in values[1:]:
        out = out | compare(column, kind, "=", v)
    return out


def between(column: Column, kind: T.DataType, low: object, high: object) -> Column:
    """Both ends included."""
    return compare(column, kind, ">=", low) & compare(column, kind, "<=", high)


def like_pattern(text: str) -> str:
    """A pattern without '%' matches anywhere."""
    return text if "%" in text else f"%{text}%"
