"""A corpus pipeline: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet to the
shared folder and reads it again as the next one's docs, so a lost executor costs no more than a stage. All stages but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duskline.llm import linededup, neardup, packing, quality, substrings
from duskline.llm.common import release, settle, settled


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no rule rejects."""
    return quality.keep(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that too many documents of their source hold."""
    return linededup.clean_documents(docs, common=linededup.COMMON)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near-duplicates (five words, 0.8)."""
    return neardup.keep_one(docs, k=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages of 35 words or more that stand in the corpus more than once."""
    return substrings.remove(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and the bin of each."""
    packed = packing.pack(docs)
    return packed.select(F.col("id").alias("doc_id"), "piece", "first_word", "n_words", "source", "cluster", "bin", "bin_start")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", best_fit_packing),
]
#: Near-duplicate components and best fit are no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mine: list[str] = []
    for _, stage in STAGES[:-1]:
        before = settled()
        docs = settle(stage(spark, docs, sf_dir))
        made = [x for x in settled() if x not in before]
        release(spark, mine + made[:-1])  # what the stage needed on its way, and the stage before it
        mine = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
