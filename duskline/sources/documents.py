"""Document tables: a row id and a VARIANT, for rows that share no schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROW_ID, DOC = "__uuid", "doc"


def from_json(df: DataFrame, text: str = "value", row_id: Column | None = None) -> DataFrame:
    """__uuid, doc of a column of JSON texts; texts that are no JSON objects are left out.

    An `id` that is text in the document serves as its row id, as in the log store; others get a random one.
    """
    doc = F.try_parse_json(F.col(text))
    rows = df.select(doc.alias(DOC)).where(F.col(DOC).isNotNull() & F.schema_of_variant(F.col(DOC)).startswith("OBJECT"))
    given = F.try_variant_get(F.col(DOC), "$.id", "string")
    return rows.select(F.coalesce(row_id if row_id is not None else given, F.expr("uuid()")).alias(ROW_ID), DOC)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A file of one JSON document a line."""
    return from_json(spark.read.text(path))


def field(name: str, kind: str = "string") -> Column:
    """A top-level field of the document; null if it is missing, null or of another kind."""
    return F.try_variant_get(F.col(DOC), "$." + _key(name), kind)


def _key(name: str) -> str:
    return name if name.isidentifier() else "['" + name.replace("'", "\\'") + "']"


def has(name: str) -> Column:
    return F.try_variant_get(F.col(DOC), "$." + _key(name), "variant").isNotNull()


def to_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The row id and these fields as typed columns; only they are read out of the documents."""
    return df.select(ROW_ID, *[field(c, kind).alias(c) for c, kind in columns.items()])


def put(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Documents with a field set to a value."""
    entries = F.expr("cast(doc as map<string, variant>)")
    one = F.create_map(F.lit(name), F.variant_get(F.parse_json(F.to_json(F.struct(value.alias("v")))), "$.v", "variant"))
    return _with_entries(df, F.map_concat(F.map_filter(entries, lambda k, v: k != name), one))


def remove(df: DataFrame, name: str) -> DataFrame:
    """Documents without a field."""
    return _with_entries(df, F.map_filter(F.expr("cast(doc as map<string, variant>)"), lambda k, v: k != name))


def _with_entries(df: DataFrame, entries: Column) -> DataFrame:
    return df.withColumn("__entries", entries).withColumn(DOC, F.expr("to_variant_object(__entries)")).drop("__entries")


def to_json(df: DataFrame) -> DataFrame:
    """A column of JSON texts with the row id in each document."""
    return put(df, ROW_ID, F.col(ROW_ID)).select(F.to_json(DOC).alias("value"))
