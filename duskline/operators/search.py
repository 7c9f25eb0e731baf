"""Text search: overlap, TF-IDF, regular expressions, edit distance."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..session import scratch_folder
from .relational import name_of, quoted

RELEVANCE = "__relevance"
DISTANCE = "__fuzzy_distance"


def overlap_search(df: DataFrame, column: str, query: str, limit: int | None = None) -> DataFrame:
    """Rows that share a token with the query, with their relevance; best first."""
    c, asked = quoted(name_of(df, column)).cast("string"), text.ascii_tokens(query)
    if not asked:
        return _ranked(df.where(F.lit(False)).withColumn(RELEVANCE, F.lit(0.0)), F.col(RELEVANCE).desc(), limit)
    near = df.where(text.has_any(c, asked, ascii_only=True))
    return _ranked(near.withColumn(RELEVANCE, text.overlap(c, query)), F.col(RELEVANCE).desc(), limit)


def fuzzy_search(df: DataFrame, column: str, term: str, most: int = text.DEFAULT_DISTANCE, limit: int | None = None) -> DataFrame:
    """Rows whose whole text is within an edit distance of the term; nearest first."""
    found = df.withColumn(DISTANCE, text.fuzzy_distance(quoted(name_of(df, column)).cast("string"), term, most)).where(F.col(DISTANCE).isNotNull())
    return _ranked(found, F.col(DISTANCE).asc(), limit)


def _ranked(df: DataFrame, order, limit: int | None) -> DataFrame:
    """Ordered, ties by the first column that can be ordered."""
    plain = [c for c in df.columns if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType))]
    ties = [quoted(c) for c in plain[:1]]
    out = df.orderBy(order, *ties)
    return out if limit is None else out.limit(limit)


def postings(df: DataFrame, row_id: str, column: str) -> DataFrame:
    """An inverted index: token, row id, tf (share of the row's tokens that are this one). Tokens are counted within their row: nothing is shuffled."""
    rows = df.select(quoted(row_id).alias("row_id"), text.tokens(quoted(column).cast("string")).alias("tokens"))
    flat = rows.select("row_id", F.size("tokens").alias("n"), F.explode(text.counted(F.col("tokens"))).alias("c"))
    return flat.select(F.col("c.token").alias("token"), "row_id", (F.col("c.k") / F.col("n")).alias("tf"))


#: Stored postings. `row` numbers the rows of a segment; a row's own posting, of the token '', has its id instead of a tf.
SEGMENT = "token string, row long, tf double, row_id {}, segment string, version long"
#: Ids of rows whose postings in segments of earlier versions are void.
GONE = "row_id {}, version long"


def write_segment(df: DataFrame, row_id: str, column: str, path: str, version: int = 0) -> int:
    """Write the postings of a frame as a segment; returns how many rows have a token.

    Each task writes the postings of its own rows, sorted by token, so nothing is shuffled and a search reads a few pages of each file.
    Postings have a row's number in place of its id, which is written once for each row.
    """
    seen, n = Observation(), F.size("tokens")
    rows = df.select(F.monotonically_increasing_id().alias("row"), quoted(row_id).alias("id"), text.tokens(quoted(column).cast("string")).alias("tokens"))
    rows = rows.observe(seen, F.count_if(n > 0).alias("rows"))
    own = F.struct(F.lit("").alias("token"), F.lit(None).cast("int").alias("k"))
    flat = rows.select("row", "id", n.alias("n"), F.explode(F.when(n > 0, F.concat(F.array(own), text.counted(F.col("tokens"))))).alias("c"))
    made = flat.select(F.col("c.token").alias("token"), "row", (F.col("c.k") / F.col("n")).alias("tf"), F.when(F.col("c.token") == "", F.col("id")).alias("row_id"))
    made = made.sortWithinPartitions("token", "row").withColumns({"segment": F.lit(uuid.uuid4().hex), "version": F.lit(version).cast("long")})
    made.write.option("compression", "zstd").parquet(path)
    return seen.get["rows"]


def count_voided(segments: DataFrame, gone: DataFrame | None, more: DataFrame) -> int:
    """How many rows with a token stand in segments, beside those gone before, and have their id in `more`."""
    rows = segments.where(F.col("token") == "").select("row_id", "version")
    return (rows if gone is None else _standing(rows, gone)).join(more.select("row_id"), "row_id", "left_semi").count()


def _standing(rows: DataFrame, gone: DataFrame) -> DataFrame:
    last = gone.groupBy("row_id").agg(F.max("version").alias("gone_at")).withColumnRenamed("row_id", "gone_id")
    return rows.join(last, (F.col("row_id") == F.col("gone_id")) & (F.col("version") < F.col("gone_at")), "left_anti")


def segment_search(segments: DataFrame, query: str, n_rows: int, row_id: str = "row_id", limit: int | None = None, gone: DataFrame | None = None) -> DataFrame:
    """indexed_search over stored segments: the scan is pruned to the query's tokens and the rows' own postings."""
    asked = segments.sparkSession.range(1).select(text.tokens(F.lit(query)).alias("t")).first().t
    wanted = sorted(set(asked))
    if not wanted:
        return segments.select(F.col("row_id").alias(row_id), F.lit(0.0).alias(RELEVANCE)).where(F.lit(False))
    # A row's postings are all in one file, so most are put together before the exchange.
    tfs = [F.sum(F.when(F.col("token") == w, F.col("tf"))).alias(f"tf{i}") for i, w in enumerate(wanted)]
    hits = segments.where(F.col("token").isin("", *wanted)).groupBy("segment", "row").agg(F.max("row_id").alias("row_id"), F.max("version").alias("version"), *tfs)
    hits = hits.where(F.coalesce(*[F.col(f"tf{i}") for i in range(len(wanted))]).isNotNull())
    if gone is not None:
        hits = _standing(hits, gone)
    held = hits.agg(*[F.count(f"tf{i}").alias(f"df{i}") for i in range(len(wanted))])
    score = F.lit(0.0)
    for i, w in enumerate(wanted):
        score = score + F.coalesce(F.col(f"tf{i}") * F.log(F.lit(float(n_rows)) / F.col(f"df{i}")) * F.lit(asked.count(w)), F.lit(0.0))
    scored = hits.crossJoin(F.broadcast(held)).groupBy("row_id").agg(F.sum(score).alias(RELEVANCE))
    return _ranked(scored.withColumnRenamed("row_id", row_id), F.col(RELEVANCE).desc(), limit)


def tfidf_search(df: DataFrame, row_id: str, column: str, query: str, limit: int | None = None) -> DataFrame:
    """row id and relevance of rows that hold a token of the query; best first.

    idf = ln(N / df), N: rows with a token. Query tokens that repeat count as often; rows that score 0 stay. Texts are read once: of those
    that hold a token of the query, their number of tokens and of each query token is written to the shared folder (a few numbers
    a row), and idf, scores and order come from there.
    """
    spark = df.sparkSession
    asked = spark.range(1).select(text.tokens(F.lit(query)).alias("t")).first().t
    wanted, c = sorted(set(asked)), quoted(column).cast("string")
    if not wanted:
        return df.select(quoted(row_id).alias(row_id), F.lit(0.0).alias(RELEVANCE)).where(F.lit(False))

    def counts(own: Column) -> Column:
        return F.struct(F.size(own).alias("n"), *[(F.size(own) - F.size(F.array_remove(own, w))).alias(f"k{i}") for i, w in enumerate(wanted)])

    any_of = F.lit(False)
    for i in range(len(wanted)):
        any_of = any_of | F.col(f"p.k{i}")
    seen, path = Observation(), f"{scratch_folder(spark)}/hits-{uuid.uuid4().hex}"
    rows = df.select(quoted(row_id).alias("row_id"), c.alias("text"), text.presence(c, wanted).alias("p")).observe(seen, F.count_if("p.any").alias("rows"))
    hits = rows.where(any_of).select("row_id", text.once(text.tokens(F.col("text")), counts).alias("c")).select("row_id", "c.*")
    hits.write.parquet(path)
    hits = spark.read.schema(hits.schema).parquet(path)
    held = hits.agg(*[F.count_if(F.col(f"k{i}") > 0).alias(f"k{i}") for i in range(len(wanted))]).first()
    score = F.lit(0.0)
    for i, w in enumerate(wanted):
        if held[f"k{i}"]:
            score = score + F.col(f"k{i}") / F.col("n") * F.log(F.lit(seen.get["rows"] / held[f"k{i}"])) * F.lit(asked.count(w))
    return _ranked(hits.select(F.col("row_id").alias(row_id), score.alias(RELEVANCE)), F.col(RELEVANCE).desc(), limit)


def indexed_search(index: DataFrame, query: str, n_rows: int, row_id: str = "row_id", limit: int | None = None) -> DataFrame:
    """The same from stored postings: the scan is pruned to the query's tokens before anything else."""
    asked = index.sparkSession.range(1).select(text.tokens(F.lit(query)).alias("t")).first().t
    if not asked:
        return index.select(F.col("row_id").alias(row_id), F.lit(0.0).alias(RELEVANCE)).where(F.lit(False))
    weights = {w: asked.count(w) for w in sorted(set(asked))}
    hits = index.where(F.col("token").isin(list(weights)))
    df = hits.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]), F.col("token"))
    idf = df.select("token", (F.log(F.lit(float(n_rows)) / F.col("df")) * weight).alias("idf"))
    scored = hits.join(F.broadcast(idf), "token").groupBy("row_id").agg(F.sum(F.col("tf") * F.col("idf")).alias(RELEVANCE))
    return _ranked(scored.withColumnRenamed("row_id", row_id), F.col(RELEVANCE).desc(), limit)
