"""Log-structured tables: newest version of a key, compaction, replay."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: Sequence[str], sequence: Column | str, deleted: Column | None = None) -> DataFrame:
    """The newest row of each key; keys whose newest row is a tombstone are gone.

    An aggregate of whole rows: partial maxima are combined before the shuffle, so a hot key never gathers in one task.
    """
    order = F.col(sequence) if isinstance(sequence, str) else sequence
    row = F.struct(*[F.col(c) for c in df.columns], (F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))).alias("__deleted"))
    best = df.groupBy(*keys).agg(F.max_by(row, order).alias("__row"))
    return best.where(~F.col("__row.__deleted")).select(*[F.col("__row")[c].alias(c) for c in df.columns])


def latest_ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in an order of several columns."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") == 1).drop("__rank")


def get(log: DataFrame, key: object) -> DataFrame:
    """The live value of one key in a log of (key, value, seq, op)."""
    return live(log.where(F.col("key") == F.lit(key)))


def live(log: DataFrame) -> DataFrame:
    """key, value of all keys that a log of (key, value, seq, op: PUT or DELETE) leaves."""
    return latest(log, ["key"], "seq", F.col("op") == "DELETE").select("key", "value")


def replay(base: DataFrame, log: DataFrame) -> DataFrame:
    """A base table (key, value) with a change log applied in the order of its sequence numbers."""
    start = base.select("key", "value", F.lit(-1).cast("long").alias("seq"), F.lit("PUT").alias("op"))
    return live(start.unionByName(log.select("key", "value", F.col("seq").cast("long").alias("seq"), "op")))


def merge_runs(runs: Sequence[DataFrame], keep_tombstones: bool = False) -> DataFrame:
    """Sorted runs (key, value, seq, op) merged into one: the newest version of each key, ordered by key within partitions."""
    merged = runs[0]
    for r in runs[1:]:
        merged = merged.unionByName(r)
    newest = latest(merged, ["key"], "seq", None if keep_tombstones else F.col("op") == "DELETE")
    return newest.sortWithinPartitions("key")
