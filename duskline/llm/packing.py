"""Conflict-constrained best-fit packing of documents into bins of a fixed number of words.

Documents are dealt by a hash of id and text into groups of bounded size (the number of groups follows from a
count), and each group is packed on its own, longest piece first: among open bins ordered by what is left in
them, the search starts at the smallest residual that holds the piece and goes on to the next larger one until
a bin is compatible. Bins are bits: for each residual there is a bitmap of its bins, for each source a bitmap of
bins that hold its quota of pieces, for each duplicate cluster a bitmap of bins that hold one of it; a compatible bin of a
residual is a bit left over when the last two are taken out. No document is dropped: if no bin fits, one opens.

A document longer than a bin is cut into pieces: full bins of its own, and a last piece that is packed like
any other. A tighter bin of another group is not seen: a group of about 4096 documents is packed as well as if it were the corpus, and
what that costs is one part-filled bin or a few for each group (fill() measures it). The cluster is the hash of the text with A-Z folded and white space made even, unless a column
names it. Documents without words (null, empty) are returned with a null bin. Null sources share one quota. Repeated rows are
documents of their own, in one cluster. Ties: longer first, then smaller hash, then smaller id; of equal bins the
first opened.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, settle
from .neardup import near_rows
from .textbytes import SPACE_SPLIT, chunks, mix, spans, word_hashes

CAPACITY = 2048
#: Pieces of one source that a bin may hold, and documents aimed at in a group that is packed together.
SOURCE_QUOTA = 4
GROUP_ROWS = 4096


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int, quota: int) -> tuple[list[int], list[int]]:
    """The bin of each piece and where in the bin it begins. Pieces are placed in the order given."""
    by_residual = [0] * (capacity + 1)  # bitmaps of bins
    open_residuals = 0  # bit r: some bin has r words left
    left: list[int] = []
    held: dict[tuple[int, object], int] = {}
    full: dict[object, int] = {}
    within: dict[object, int] = {}
    bins, starts = [], []
    for size, source, cluster in zip(lengths, sources, clusters, strict=True):
        barred = full.get(source, 0) | within.get(cluster, 0)
        larger = (open_residuals >> size) << size
        bin_ = -1
        while larger:
            residual = (larger & -larger).bit_length() - 1
            free = by_residual[residual] & ~barred
            if free:
                bin_ = (free & -free).bit_length() - 1
                break
            larger &= larger - 1
        if bin_ < 0:
            bin_, residual = len(left), capacity
            left.append(capacity)
        else:
            by_residual[residual] &= ~(1 << bin_)
            if not by_residual[residual]:
                open_residuals &= ~(1 << residual)
        bit = 1 << bin_
        bins.append(bin_)
        starts.append(capacity - residual)
        left[bin_] = rest = residual - size
        if rest:
            by_residual[rest] |= bit
            open_residuals |= 1 << rest
        within[cluster] = within.get(cluster, 0) | bit
        n = held[bin_, source] = held.get((bin_, source), 0) + 1
        if n >= quota:
            full[source] = full.get(source, 0) | bit
    return bins, starts


def measured(df: DataFrame, doc_id: str, text: str, source: str, cluster: str | None) -> DataFrame:
    """id, key, source, cluster, n_words of every row; key is a hash of id and text."""

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(column(batch, "text")):
                words = spans(chunk, SPACE_SPLIT)
                hashed = word_hashes(chunk, words, True)
                place = (np.arange(len(hashed)) - np.repeat(words.first[:-1], words.counts)).astype(np.uint64)
                prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashed + place * np.uint64(0x9E3779B97F4A7C15)))])
                same = mix(prefix[words.first[1:]] - prefix[words.first[:-1]]).view(np.int64)
                part = batch.slice(chunk.first, len(chunk))
                given = column(part, "cluster")
                yield pa.RecordBatch.from_arrays([column(part, "id"), column(part, "key"), column(part, "source"), pa.array(same) if cluster is None else given, pa.array(words.counts, pa.int64())], ["id", "key", "source", "cluster", "n_words"])

    own = F.lit(None).cast("long") if cluster is None else F.xxhash64(cluster)
    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(doc_id, text).alias("key"), F.col(source).cast("string").alias("source"), own.alias("cluster"), F.col(text).alias("text"))
    return rows.mapInArrow(on_batches, "id long, key long, source string, cluster long, n_words long")


def pack(df: DataFrame, capacity: int = CAPACITY, quota: int = SOURCE_QUOTA, doc_id: str = "doc_id", text: str = "text", source: str = "source", cluster: str | None = None, group_rows: int = GROUP_ROWS) -> DataFrame:
    """A row for each piece of each row of df: id, piece, first_word, n_words, source, cluster, bin, bin_start.

    bin is a long, unique over all groups, or null for a document without words.
    """
    return _dealt(settle(measured(df, doc_id, text, source, cluster)), capacity, quota, group_rows)


def pack_near(df: DataFrame, k: int = 5, capacity: int = CAPACITY, quota: int = SOURCE_QUOTA, doc_id: str = "doc_id", text: str = "text", source: str = "source", group_rows: int = GROUP_ROWS) -> DataFrame:
    """pack() of near_clusters(): words are counted where near-duplicates are looked for, so texts are neither joined nor counted again."""
    rows = near_rows(df, k, doc_id, text, key=F.xxhash64(doc_id, text), source=F.col(source).cast("string"))
    return _dealt(settle(rows.select("id", "key", "source", F.xxhash64(_near_cluster()).alias("cluster"), "n_words")), capacity, quota, group_rows)


def _dealt(rows: DataFrame, capacity: int, quota: int, group_rows: int) -> DataFrame:
    """The pieces of these rows (id, key, source, cluster, n_words; settled), packed group by group."""
    groups = max(1, rows.count() // group_rows)

    def on_table(table: pa.Table) -> pa.Table:
        n = np.asarray(table["n_words"])
        group = int(table["group"][0].as_py())
        pieces = np.maximum(1, -(-n // capacity))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(capacity, n[row] - piece * capacity)
        ids = np.asarray(table["id"].fill_null(np.iinfo(np.int64).max))
        key, clusters = np.asarray(table["key"]), np.asarray(table["cluster"])
        order = np.lexsort((piece, ids[row], key[row], -size))
        order = order[size[order] > 0]
        names = table["source"].to_pylist()
        bins, starts = best_fit(size[order].tolist(), [names[i] for i in row[order].tolist()], clusters[row[order]].tolist(), capacity, quota)
        bin_, start = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
        bin_[order], start[order] = bins, starts
        none = size <= 0
        take = pa.array(row)
        return pa.table([table["id"].take(take), pa.array(piece, pa.int32()), pa.array(piece * capacity, pa.int64()), pa.array(np.maximum(size, 0), pa.int64()), table["source"].take(take), table["cluster"].take(take), pa.array(bin_ * groups + group, pa.int64(), mask=none), pa.array(start, pa.int32(), mask=none)], names=["id", "piece", "first_word", "n_words", "source", "cluster", "bin", "bin_start"])

    schema = "id long, piece int, first_word long, n_words long, source string, cluster long, bin long, bin_start int"
    # Equal rows are counted and dealt by their number, so copies of one row fill no group and groups do not depend on partitions.
    copies = rows.groupBy("id", "key", "source", "cluster", "n_words").agg(F.count("*").alias("copies"))
    dealt = copies.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).withColumn("group", F.expr(f"pmod(xxhash64(key, id, copy), {groups})"))
    return dealt.groupBy("group").applyInArrow(on_table, schema)


def fill(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """n_words, n_bins and fill (share of all bins' room that words take) of what pack() returned."""
    made = packed.where("bin is not null").agg(F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"), F.count_distinct("bin").alias("n_bins"))
    return made.withColumn("fill", F.try_divide(F.col("n_words"), F.col("n_bins") * F.lit(capacity)))


def _near_cluster() -> Column:
    """Of a row of near_rows(): the least id of its group, or the group's own hash where no row of it has an id."""
    return F.coalesce("component_id", "comp", "text_hash")


def near_clusters(df: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The id, text and source of every row of df with `near_cluster`, the same for near-duplicates, for pack().

    It is the least id of the group, or a hash of the group where no row of it has an id.
    """
    found = near_rows(df, k, doc_id, text).groupBy("id", "text_hash").agg(F.min(_near_cluster()).alias("near_cluster"))
    found = found.select(F.col("id").alias("n_id"), F.col("text_hash").alias("n_hash"), "near_cluster")
    rows = df.select(F.col(doc_id).alias(doc_id), F.col(text).alias(text), F.col(source).alias(source))
    joined = rows.join(found, F.col(doc_id).cast("long").eqNullSafe(F.col("n_id")) & (F.xxhash64(text) == F.col("n_hash")), "left")
    return joined.select(doc_id, text, source, "near_cluster")
