"""Replay a log of replicated actions onto a catalog: definitions in order, changes of rows as set operations between them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import versions
from ..operators.relational import quoted
from ..plans.catalog import ROW_ID, Catalog, CatalogProblem

DEFINITIONS = ("create_database", "drop_database", "create_table", "drop_table", "delete_everything")
CHANGES = ("insert", "update", "delete")
#: Definitions that one replay may hold; they are read on the driver.
MOST_DEFINITIONS = 100_000


def replay(catalog: Catalog, log: DataFrame) -> None:
    """Apply log (seq, kind, db, table, row_id, values: map of column to text) to the catalog, in the order of seq.

    insert and update set the given columns of a row and leave the others; delete takes the row away. Of the changes of one row between
    two definitions, those after its last delete count, each column by the newest that sets it. Definitions that are already done are skipped, so a log may
    be replayed from any earlier place. Rows of tables that do not exist raise CatalogProblem.
    """
    bad = log.where(~F.col("kind").isin(*DEFINITIONS, *CHANGES)).select("kind").first()
    if bad:
        raise CatalogProblem(f"unknown action '{bad.kind}'")
    steps = log.where(F.col("kind").isin(*DEFINITIONS)).select("seq", "kind", "db", "table").orderBy("seq").limit(MOST_DEFINITIONS + 1).collect()
    if len(steps) > MOST_DEFINITIONS:
        raise CatalogProblem(f"more than {MOST_DEFINITIONS} definitions in one log")
    done = None
    for step in [*steps, None]:
        part = log.where(F.col("kind").isin(*CHANGES))
        part = part if done is None else part.where(F.col("seq") > done)
        part = part if step is None else part.where(F.col("seq") < step.seq)
        for r in part.select("db", "table").distinct().collect():
            _change(catalog, r.db, r.table, part.where((F.col("db") == r.db) & (F.col("table") == r.table)))
        if step is not None:
            _define(catalog, step)
            done = step.seq


def _define(catalog: Catalog, step) -> None:
    have = step.db is not None and step.db in catalog.databases()
    if step.kind == "create_database" and not have:
        catalog.create_database(step.db)
    elif step.kind == "drop_database" and have:
        catalog.drop_database(step.db)
    elif step.kind == "create_table" and not catalog.has(step.db, step.table):
        catalog.create_table(step.db, step.table)
    elif step.kind == "drop_table" and have and catalog.has(step.db, step.table):
        catalog.drop_table(step.db, step.table)
    elif step.kind == "delete_everything":
        catalog.drop_everything()


def _change(catalog: Catalog, db: str, table: str, changes: DataFrame) -> None:
    """One merge of a table with the newest value of each changed column of each row."""
    last = changes.groupBy("row_id").agg(F.max(F.when(F.col("kind") == "delete", F.col("seq"))).alias("cut"))
    own = changes.where("kind <> 'delete'").join(last, "row_id").where("cut is null or seq > cut")
    cells = own.select("row_id", "seq", F.explode("values").alias("column", "value"))
    cells = versions.latest(cells, ["row_id", "column"], "seq")
    names = sorted(r.column for r in cells.select("column").distinct().collect())
    made = cells.groupBy("row_id").agg(*[F.max(F.when(F.col("column") == n, F.struct(F.col("value").alias("v")))).alias(n) for n in names], F.count(F.lit(1)).alias("__cells"))
    have = catalog.read(db, table)
    base = have.join(last.select(F.col("row_id").alias(ROW_ID), F.col("cut").isNotNull().alias("__gone"), F.lit(True).alias("__touched")), ROW_ID, "full")
    joined = base.join(made.withColumnRenamed("row_id", ROW_ID).select(ROW_ID, "__cells", *[F.col(f"`{n}`").alias(f"__new_{n}") for n in names]), ROW_ID, "left")
    stays = F.col("__touched").isNull() | ~F.col("__gone") | F.col("__cells").isNotNull()
    old = {c: F.when(F.coalesce("__gone", F.lit(False)), F.lit(None)).otherwise(quoted(c).cast("string")) for c in have.columns if c != ROW_ID}
    new = {n: F.when(F.col(f"`__new_{n}`").isNotNull(), F.col(f"`__new_{n}`")["v"]).otherwise(old.get(n, F.lit(None).cast("string"))) for n in names}
    rows = joined.where(stays).select(ROW_ID, *[x.alias(c) for c, x in (old | new).items()])
    known = dict(catalog.manifest(db, table).columns)
    for n in names:
        if n not in known:
            catalog.add_column(db, table, n, "varchar")
    catalog.replace(db, table, rows)
