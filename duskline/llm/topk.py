"""Exact top-k search by distributed histogram selection.

All scores of a query set against all rows are counted into histograms: for each query the interval of scores that must hold
its k-th best is cut into at most BINS bins, counts are summed over all rows, and the bin that holds the k-th best is the next interval,
until it is one score wide. A last pass returns only scores at or above that value, ties at it by the smaller vec_id. A task
reports bins from its best score down to where it alone has k scores: what lies below cannot hold the k-th best.

Candidates stay where they are: no round shuffles a vector. Queries are dealt by a hash of vec_id into blocks of at most about QUERY_ROWS rows
and QUERY_BYTES bytes; one block at a time is sent to all tasks (its size is what a broadcast holds, however large the table) and the
tasks score their rows against it batch by batch, with one histogram for a task. What is shuffled in a round is the bins: queries times
tasks times at most k, and so not more as tables grow on the same cluster but by the queries. One row for each query of a block
comes back to the driver. Scores are computed again in each round instead of being kept.

A component x counts as floor(64 * x). Vectors that are null, or hold a null or a component that is not finite, and rows without a
vec_id, take no part. If scores could exceed a long (largest component squared times dimension), the search raises ValueError and
returns nothing wrong. Only vectors of equal length are compared. If a vec_id repeats, its smallest vector is the query, every row is a
candidate for others, and none for itself. Fewer than k candidates: all are returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, settle, settled

BINS = 1024
#: A block of queries, which is broadcast.
QUERY_ROWS, QUERY_BYTES = 4096, 32 << 20
#: Scores of one matrix product.
PRODUCT = 2_000_000
SCALE = 64


def quantised(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, dim, ints: the vectors that take part, as little-endian longs."""

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            ok = np.asarray(lists.is_valid()) & np.asarray(ids.is_valid())
            kept = lists.filter(pa.array(ok))
            flat = np.asarray(kept.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False))
            offsets = np.concatenate([[0], np.cumsum(np.asarray(kept.value_lengths()).astype(np.int64))])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = bad[offsets[1:]] == bad[offsets[:-1]]
            with np.errstate(invalid="ignore"):
                scaled = np.floor(SCALE * np.where(np.isfinite(flat), flat, 0))
            if len(scaled) and np.abs(scaled).max() >= 2.0**62:
                raise ValueError("a component is too large for scores that fit a long")
            ints = scaled.astype(np.int64)
            own = np.flatnonzero(good)
            rows = [ints[offsets[i] : offsets[i + 1]].tobytes() for i in own.tolist()]
            yield pa.RecordBatch.from_arrays([ids.filter(pa.array(ok)).take(pa.array(own)), pa.array(np.diff(offsets)[own], pa.int32()), pa.array(rows, pa.binary())], ["vec_id", "dim", "ints"])

    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("e")).mapInArrow(on_batches, "vec_id long, dim int, ints binary")


def scores(queries: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of longs."""
    dim = queries.shape[1]
    most = [float(np.abs(x).max(initial=0)) for x in (queries, candidates)]
    if dim * most[0] * most[1] < 2.0**53:  # doubles hold such sums exactly
        return (queries.astype(np.float64) @ candidates.astype(np.float64).T).astype(np.int64)
    return queries @ candidates.T


class Block:
    """Queries of one block by their dimension: ids in rising order, vectors, and the rows of both in the block."""

    def __init__(self, rows: list):
        self.ids = np.array([r.vec_id for r in rows], np.int64)
        self.dims: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        dims = np.array([r.dim for r in rows], np.int64)
        for dim in np.unique(dims).tolist():
            own = np.flatnonzero(dims == dim)
            own = own[np.argsort(self.ids[own], kind="stable")]
            vectors = np.frombuffer(b"".join(bytes(rows[i].ints) for i in own.tolist()), np.int64).reshape(len(own), dim)
            self.dims[dim] = self.ids[own], vectors, own

    def reach(self, widest: int) -> np.ndarray:
        """A bound of the scores of each query, without their sign."""
        out = np.zeros(len(self.ids), np.int64)
        for _, vectors, own in self.dims.values():
            out[own] = np.abs(vectors).sum(axis=1) * widest + 1
        return out

    def products(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows of the block, candidate ids, and the scores between them; the score of a query with its own id is the least long."""
        ids, dims = np.asarray(column(batch, "vec_id")), np.asarray(column(batch, "dim"))
        for dim in np.unique(dims).tolist():
            if dim not in self.dims:
                continue
            asked, vectors, own = self.dims[dim]
            take = np.flatnonzero(dims == dim)
            found = np.frombuffer(b"".join(column(batch, "ints").take(pa.array(take)).to_pylist()), np.int64).reshape(len(take), dim)
            some = max(1, PRODUCT // len(asked))
            for at in range(0, len(take), some):
                part = ids[take[at : at + some]]
                made = scores(vectors, found[at : at + some])
                place = np.minimum(np.searchsorted(asked, part), len(asked) - 1)
                self_ = np.flatnonzero(asked[place] == part)
                made[place[self_], self_] = np.iinfo(np.int64).min
                yield own, part, made


def _histograms(rows: DataFrame, block: Broadcast, lo: np.ndarray, hi: np.ndarray, shift: np.ndarray, k: int) -> DataFrame:
    """query, bin, n: counts of scores in the bins of each query's interval, from the best down."""
    todo = hi - lo > 1

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(lo), BINS), np.int64)
        for batch in batches:
            for own, _, score in block.value.products(batch):
                low, high = lo[own][:, None], np.where(todo[own], hi[own], lo[own])[:, None]
                q, c = np.nonzero((score >= low) & (score < high))
                row = own[q]
                flat = row * BINS + ((score[q, c] - lo[row]) >> shift[row])
                counts += np.bincount(flat, minlength=counts.size).reshape(counts.shape)
        over = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts  # scores of this task in better bins of the interval
        q, b = np.nonzero((counts > 0) & (over < k))
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(counts[q, b])], ["query", "bin", "n"])

    return rows.mapInArrow(on_batches, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _kth_values(rows: DataFrame, block: Block, sent: Broadcast, widest: int, k: int) -> np.ndarray:
    """For each query of a block the k-th best score, or a bound of all its scores if it has fewer candidates."""
    reach = block.reach(widest)
    lo, hi, above = -reach, reach, np.zeros(len(reach), np.int64)
    best = Window.partitionBy("query").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    while (hi - lo > 1).any():
        shift = np.array([max(0, (int(w) - 1).bit_length() - (BINS.bit_length() - 1)) for w in (hi - lo).tolist()], np.int64)
        found = _histograms(rows, sent, lo, hi, shift, k).withColumn("upto", F.sum("n").over(best))
        need = rows.sparkSession.createDataFrame([(i, int(k - a)) for i, a in enumerate(above.tolist())], "query int, need long")
        hit = found.join(need, "query").where("upto >= need").groupBy("query").agg(F.max(F.struct("bin", (F.col("upto") - F.col("n")).alias("better"))).alias("hit"))
        todo = hi - lo > 1
        new_lo, new_hi = lo.copy(), np.where(todo, lo + 1, hi)  # without a hit: fewer than k candidates, all of them count
        for r in hit.collect():
            i = r["query"]
            new_lo[i] = lo[i] + (r.hit.bin << int(shift[i]))
            new_hi[i] = min(int(hi[i]), int(new_lo[i]) + (1 << int(shift[i])))
            above[i] += r.hit.better
        lo, hi = new_lo, new_hi
    return lo


def _best(rows: DataFrame, block: Broadcast, least: np.ndarray, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each query of a block."""

    def at_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own, ids, score in block.value.products(batch):
                order = np.argsort(ids, kind="stable")
                ids, score, bar = ids[order], score[:, order], least[own][:, None]
                ok = score >= bar
                tie = score == bar
                ok &= ~tie | (np.cumsum(tie, axis=1) <= k)  # ids ascend: of ties the first k are enough
                q, c = np.nonzero(ok)
                yield pa.RecordBatch.from_arrays([pa.array(block.value.ids[own[q]]), pa.array(ids[c]), pa.array(score[q, c])], ["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = rows.mapInArrow(at_least, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(order))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(df: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of df (vec_id, embedding) for each row of queries, its own left out."""
    spark = df.sparkSession
    rows = settle(quantised(df))
    widest, dim = _widest(rows)
    if dim * widest * widest >= 1 << 62:
        raise ValueError("scores would not fit a long")
    asked = quantised(queries).groupBy("vec_id", "dim").agg(F.min("ints").alias("ints")).groupBy("vec_id").agg(F.min(F.struct("dim", "ints")).alias("v")).select("vec_id", "v.dim", "v.ints")
    asked = settle(asked)
    n, size = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("ints")), F.lit(0))).first()
    blocks = max(1, -(-n // QUERY_ROWS), -(-size // QUERY_BYTES))
    folders = []
    for b in range(blocks):
        block = Block(asked.where(F.expr(f"pmod(xxhash64(vec_id), {blocks}) = {b}")).collect())
        if not len(block.ids):
            continue
        sent = spark.sparkContext.broadcast(block)
        found = settle(_best(rows, sent, _kth_values(rows, block, sent, widest, k), k))
        sent.unpersist()
        folders.append(settled()[-1])
    schema = "query_id long, rank int, vec_id long, score long"
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _widest(rows: DataFrame) -> tuple[int, int]:
    """The largest component of all vectors, without its sign, and the largest dimension."""

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0
        for batch in batches:
            flat = np.frombuffer(b"".join(column(batch, "ints").to_pylist()), np.int64)
            most = max(most, int(np.abs(flat).max(initial=0)))
        yield pa.RecordBatch.from_arrays([pa.array([most], pa.int64())], ["most"])

    dim = rows.agg(F.max("dim")).first()[0] or 0
    return rows.select("ints").mapInArrow(on_batches, "most long").agg(F.max("most")).first()[0] or 0, dim


#: The same as searching the table embeddings with the rows whose vec_id is divisible by 20, for DuckDB.
SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, cast(list_dot_product(q.e, c.e) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 20
"""
