"""Readers and writers for Parquet, JSON lines and CSV."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CODECS = ("none", "gzip", "lz4", "snappy", "zstd")
RAW_METRIC = "timestamp long, datetime string, value string"
ROLLED_METRIC = "timestamp long, datetime string, min double, max double, avg double, count long"


def read_parquet(spark: SparkSession, *paths: str, schema: T.StructType | str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*paths)


def write_parquet(df: DataFrame, path: str, codec: str = "snappy", mode: str = "errorifexists", partition_by: Sequence[str] = (), sort_by: Sequence[str] = (), bloom_by: Sequence[str] = ()) -> None:
    """Write Parquet. sort_by: rows are dealt out by range and sorted, so that scans prune on these columns; bloom_by: columns with bloom filters."""
    if codec not in CODECS:
        raise ValueError(f"unknown codec {codec!r}")
    if sort_by:
        df = df.repartitionByRange(*[F.col(c) for c in sort_by]).sortWithinPartitions(*sort_by)
    writer = df.write.mode(mode).option("compression", codec)
    for c in bloom_by:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Newline-delimited JSON. Without a schema Spark reads the data once more to find it: give one for large inputs."""
    reader = spark.read.option("mode", "DROPMALFORMED")
    return (reader if schema is None else reader.schema(schema)).json(path)


def append_json_lines(df: DataFrame, path: str, codec: str = "none") -> None:
    df.write.mode("append").option("compression", "uncompressed" if codec == "none" else codec).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: dict[str, str] | None = None) -> DataFrame:
    """CSV with a header. columns: CSV name -> name in the result; others are dropped. Without a schema all is text."""
    reader = spark.read.option("header", True).option("mode", "DROPMALFORMED")
    df = (reader if schema is None else reader.schema(schema).option("enforceSchema", False)).csv(path)
    return df if columns is None else df.select(*[F.col(f"`{a}`").alias(b) for a, b in columns.items()])


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode(mode).option("header", True)
    (writer.partitionBy(*partition_by) if partition_by else writer).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def write_metrics(points: DataFrame, path: str) -> None:
    """Points as CSV, a folder for each metric (component.operation.name): timestamp, datetime, value."""
    at = F.timestamp_millis("timestamp")
    rows = points.select(F.concat_ws(".", "component", "operation", "name").alias("metric"), "timestamp", F.date_format(at, "yyyy-MM-dd HH:mm:ss").alias("datetime"), F.col("value").cast("string").alias("value"))
    write_csv(rows, path, "append", ["metric"])


def read_metrics(spark: SparkSession, path: str, metric: str | None = None, start: int | None = None, end: int | None = None) -> DataFrame:
    """Points of a closed range of times. Lines whose time is no number are left out; value is a number where it reads as one, else null, and text stays in `raw`."""
    df = spark.read.schema(f"{RAW_METRIC}, metric string").option("header", True).option("mode", "DROPMALFORMED").csv(path)
    if metric is not None:
        df = df.where(F.col("metric") == metric)  # a folder: pruned
    df = df.where("timestamp is not null")
    if start is not None:
        df = df.where(F.col("timestamp") >= start)
    if end is not None:
        df = df.where(F.col("timestamp") <= end)
    return df.select("metric", "timestamp", "datetime", F.col("value").try_cast("double").alias("value"), F.col("value").alias("raw"))
