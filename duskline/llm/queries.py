"""The operators of this subpackage as queries over whole tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, linededup, neardup, packing, quality, sentencepieces, sharding, substrings, topk, toxicity


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(_documents(spark, sf_dir), k=2)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_near(_documents(spark, sf_dir))
    return packed.select(F.col("id").alias("doc_id"), "piece", "first_word", "n_words", "source", "cluster", "bin", "bin_start")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.by_bytes(_documents(spark, sf_dir), shards=24)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return toxicity.score(documents, toxicity.fit(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(rows, rows.where("vec_id % 20 = 0"), k=20)


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_documents(spark, sf_dir))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.clean_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_documents(spark, sf_dir))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepieces.digests(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(_documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_minhash_near_dedup, op2_best_fit_packing, op3_sharding, op4_toxicity, op5_top_k, op6_license_scans, op7_line_dedup, op8_quality_rules, op9_sentencepiece, op10_substring_dedup)}
ORACLE_SQL: dict[str, str] = {"op1_minhash_near_dedup": neardup.SQL, "op5_top_k": topk.SQL, "op7_line_dedup": linededup.SQL, "op8_quality_rules": quality.SQL, "op10_substring_dedup": substrings.SQL}
