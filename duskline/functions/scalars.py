"""Arithmetic, time and formatting expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def severity(value: Column, threshold: float) -> Column:
    """How far a value is over a threshold: 0 at it, 1 from three times it on."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), (value / F.lit(float(threshold)) - 1) / 2))


def percent_difference(base: Column, current: Column) -> Column:
    """Size of the change in percent of the base; from 0 it is 0 without a change, else 100."""
    return F.when(base == 0, F.when(current == 0, F.lit(0.0)).otherwise(F.lit(100.0))).otherwise(F.abs((current - base) / base * 100))


def bucket(epoch_ms: Column, width_ms: int) -> Column:
    """The start of the bucket that a time in epoch milliseconds is in; buckets are aligned to the epoch."""
    return epoch_ms - F.pmod(epoch_ms, F.lit(width_ms))


def epoch_ms(moment: Column) -> Column:
    """Epoch milliseconds of a timestamp, with or without a zone (then UTC is meant)."""
    return F.unix_millis(F.to_utc_timestamp(moment.cast("timestamp"), F.current_timezone()))


def format_time(epoch_ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(epoch_ms), TIME_FORMAT)


def human_bytes(n: Column, largest: str = UNITS[-1]) -> Column:
    """A size with its largest unit of at least 1, up to `largest`, in steps of 1024 and two decimals; plain bytes without decimals."""
    out = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    for i, unit in enumerate(UNITS[1 : UNITS.index(largest) + 1], 1):
        out = F.when(n >= F.lit(float(1 << (10 * i))), F.concat(F.format_string("%.2f", n / F.lit(float(1 << (10 * i)))), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n.isNotNull(), out)


def ranges_overlap(low: Column, high: Column, other_low: Column, other_high: Column) -> Column:
    """Whether two closed intervals meet."""
    return (low <= other_high) & (high >= other_low)


def unquote_identifier(text: str) -> str:
    """A name without its quotes (double, back quote, brackets), lower-cased."""
    found = re.fullmatch(r'"(.*)"|`(.*)`|\[(.*)\]', text.strip(), re.S)
    return (next(g for g in found.groups() if g is not None) if found else text.strip()).lower()


def unquote_literal(text: str) -> str:
    """A literal without single or double quotes; doubled quotes inside stand for one."""
    text = text.strip()
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1].replace(text[0] * 2, text[0])
    return text
