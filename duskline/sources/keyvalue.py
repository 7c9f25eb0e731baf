"""Key-value tables: a log of puts and deletes in the catalog, read newest first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import versions
from ..plans.catalog import Catalog

COLUMNS = (("key", "varchar"), ("value", "varchar"), ("seq", "bigint"), ("op", "varchar"))


class KeyValueTable:
    """Writes append to a log; reads take the newest entry of a key; compaction keeps live entries only.

    The sequence number of a batch is the table's version when it was written, so of two writers with the same number one
    fails on its commit. Of entries of one batch for one key the largest value wins, a delete last of all.
    """

    def __init__(self, catalog: Catalog, db: str, table: str):
        self.catalog, self.db, self.table = catalog, db, table
        if not catalog.has(db, table):
            catalog.create_table(db, table, COLUMNS)

    def _append(self, df: DataFrame, op: str) -> int:
        seq = self.catalog.version(self.db, self.table)
        own = df.select(F.col("key").cast("string").alias("key"), (F.col("value") if op == "PUT" else F.lit(None)).cast("string").alias("value"), F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"))
        if op == "PUT":
            own = own.groupBy("key", "seq", "op").agg(F.max("value").alias("value"))
        return self.catalog.append(self.db, self.table, own)

    def put(self, df: DataFrame) -> int:
        """Set key -> value for the rows of df (key, value)."""
        return self._append(df, "PUT")

    def delete(self, df: DataFrame) -> int:
        """Forget the keys of df (key)."""
        return self._append(df.select("key").distinct(), "DELETE")

    def log(self) -> DataFrame:
        return self.catalog.read(self.db, self.table).select("key", "value", "seq", "op")

    def get(self, key: str) -> str | None:
        found = versions.get(self.log(), key).first()
        return found.value if found else None

    def scan(self, low: str | None = None, high: str | None = None) -> DataFrame:
        """key, value of the live keys from low to high, both included."""
        log = self.log()
        if low is not None:
            log = log.where(F.col("key") >= low)
        if high is not None:
            log = log.where(F.col("key") <= high)
        return versions.live(log)

    def compact(self) -> None:
        """Rewrite the log as one sorted run without tombstones and old versions."""
        self.catalog.replace(self.db, self.table, versions.merge_runs([self.log()]))
