"""Apply a stream of changes to a table of the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators import versions
from ..plans.catalog import Catalog

COLUMNS = ("key", "value", "seq", "op")


#: Parts of a table from which a batch also merges them into one.
MERGE_PARTS = 64


def apply_changes(changes: DataFrame, catalog: Catalog, db: str, table: str, merge_parts: int = MERGE_PARTS) -> DataStreamWriter:
    """A stream writer that adds change batches (key, value, seq, op: PUT or DELETE) to a log table of these columns.

    A batch is appended, and current() reads the newest change of each key; only when the table has many parts are they merged. Of changes to
    one key only the newest counts, whichever batch it comes in, so a batch that Spark delivers again
    after a failure changes nothing: tombstones stay in the table until purge() and remember their sequence number.
    """

    def on_batch(batch: DataFrame, _: int) -> None:
        catalog.append(db, table, batch.select(*COLUMNS))
        if len(catalog.manifest(db, table).parts) >= merge_parts:
            catalog.replace(db, table, _newest(catalog, db, table))

    return changes.writeStream.foreachBatch(on_batch)


def _newest(catalog: Catalog, db: str, table: str) -> DataFrame:
    return versions.latest(catalog.read(db, table).select(*COLUMNS), ["key"], "seq")


def current(catalog: Catalog, db: str, table: str) -> DataFrame:
    """The live rows (key, value, seq) of a table of changes."""
    return _newest(catalog, db, table).where("op != 'DELETE'").select("key", "value", "seq")


def purge(catalog: Catalog, db: str, table: str) -> None:
    """Forget old versions and deleted keys. Changes older than this call must not come any more."""
    catalog.replace(db, table, _newest(catalog, db, table).where("op != 'DELETE'"))
