"""Removal of long passages that stand in the corpus more than once.

Token k-mers (windows of `width` words) are the edges of a De Bruijn graph. The graph is compacted before it is ever listed:

1. Paths. Each window belongs to its anchor, the least-hashed shorter word sequence inside it. Consecutive windows of a document with one
   anchor are one path, as windows follow each other there without a choice; a path is one row (about 1 for 11 windows).
2. Branches. Equal windows have equal anchors, so one pass counts, for each anchor, its paths and whether they are all the same one.
   Anchors seen once are done with. An anchor with one path is nonbranching: whoever holds the path repeats the whole of it. Where an
   anchor has different paths, ways part or meet inside, and only there paths are taken apart into their edges.
3. Joins. Paths are counted by their words (combined before the shuffle) and counts above one are joined back to the source coordinates
   (id, first word) of each path. Then one row of every path of a branching anchor lists its edges: an edge repeats if two distinct
   paths hold it, or one twice, and that too is counted and joined back. Keys that hold a large share of all rows are split among tasks.
4. Verification. Hashes only propose. What is counted and joined is a digest of the very words at the source coordinates
   (of a path 128 bits of BLAKE2; of an edge 64 bits of it beside its rolling hash), never the hash of an anchor alone.

Copies of a path inside one task are settled there: the first row asks, a second one answers, and no more of them travel, so a passage
that a third of all documents share is two rows for each task and not one for each document. (A task remembers at most
SEEN paths at a time; paths that it forgets only travel again.)

The filters of repeated and branching anchors, and of the rows that list edges, are bitmaps of fixed largest size. When they are full, more
paths travel than need to (at most all, a row each, and all their edges); the result is the same.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged. Null and empty texts have no words. Repeated rows are
documents of their own and so repeat each other. A document with fewer words than `width` loses nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, column, release, settle, settled, spread_join
from .textbytes import SPACE_SPLIT, Chunk, Words, chunks, mix, spans, sums, windows, word_hashes

WIDTH = 35
ANCHOR_WORDS = 8
#: Paths that a task remembers, about 30 MB.
SEEN = 1 << 18


def anchored(chunk: Chunk, width: int):
    """Words, the first word of each window, its anchor's place (non-decreasing), and hashes of words and of anchors by place."""
    words = spans(chunk, SPACE_SPLIT)
    hashed = word_hashes(chunk, words, False)
    short = min(ANCHOR_WORDS, width)
    n, reach = len(hashed), width - short + 1
    if n < width:
        none = np.zeros(0, np.int64)
        return words, none, none, hashed, np.zeros(0, np.uint64)
    seeds = np.full(n, np.iinfo(np.uint64).max)
    made, at = windows(hashed, words, short)
    seeds[at] = made
    least = (seeds & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    span = 1
    while span < reach:  # least over `span` places, doubled, then stretched to `reach`
        step = min(span, reach - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    first = np.flatnonzero(words.doc[: n - width + 1] == words.doc[width - 1 :])
    return words, first, (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64), hashed, seeds


@dataclass
class Paths:
    """Runs of consecutive windows of one document with one anchor: anchor, a hash of all windows, first word, windows, document."""

    anchor: np.ndarray
    code: np.ndarray
    first: np.ndarray
    size: np.ndarray
    doc: np.ndarray

    def take(self, rows: np.ndarray) -> Paths:
        return Paths(self.anchor[rows], self.code[rows], self.first[rows], self.size[rows], self.doc[rows])


def paths_of(chunk: Chunk, width: int) -> tuple[Words, np.ndarray, Paths]:
    """Words of a chunk, the hashes of windows by their first word (0 where none begins), and its paths."""
    words, first, place, hashed, seeds = anchored(chunk, width)
    whole = np.zeros(len(hashed), np.uint64)
    if not len(first):
        none = np.zeros(0, np.int64)
        return words, whole, Paths(none.view(np.uint64), none.view(np.uint64), none, none, none)
    made, at = windows(hashed, words, width)
    whole[at] = made
    doc = words.doc[first]
    new = np.ones(len(first), bool)
    new[1:] = (np.diff(first) != 1) | (np.diff(doc) != 0) | (np.diff(place) != 0)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(first))
    prefix = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(made))])
    code = mix(prefix[end] - prefix[begin] + (end - begin).astype(np.uint64))
    return words, whole, Paths(seeds[place[begin]], code, first[begin], end - begin, doc[begin])


def anchor_counts(df: DataFrame, width: int, text: str = "text") -> DataFrame:
    """anchor, n, branching: how many paths each anchor has in the corpus, and whether they differ."""

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(0)):
                own = paths_of(chunk, width)[2]
                order = np.lexsort((own.code, own.anchor))
                anchor, code = own.anchor[order].view(np.int64), own.code[order].view(np.int64)
                begin = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1])[: len(anchor)])
                end = np.append(begin[1:], len(anchor))[: len(begin)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor[begin]), pa.array(end - begin, pa.int64()), pa.array(code[begin]), pa.array(code[end - 1])], ["anchor", "n", "one", "other"])

    found = df.select(F.col(text).alias("text")).mapInArrow(on_batches, "anchor long, n long, one long, other long")
    # In a chunk codes are in the order of unsigned numbers, so that least and most differ if any two do; so do they over chunks.
    both = found.groupBy("anchor").agg(F.sum("n").alias("n"), F.min(F.least("one", "other")).alias("lo"), F.max(F.greatest("one", "other")).alias("hi"))
    return both.select("anchor", "n", (F.col("lo") != F.col("hi")).alias("branching"))


def even_bytes(chunk: Chunk, words: Words) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a chunk with one space after each, and where each begins and ends in these bytes."""
    size = words.end - words.start
    end = np.cumsum(size + 1) - 1
    inside = np.zeros(len(chunk.data) + 1, np.int8)
    inside[words.start] += 1
    inside[words.end] -= 1
    own = chunk.data[np.cumsum(inside[:-1]) > 0]
    out = np.full(len(own) + len(size), 32, np.uint8)
    take = np.ones(len(out), bool)
    take[end] = False
    out[take] = own
    return out.tobytes(), end - size, end


_PATHS = "id long, text_hash long, first int, size int, copies int, known boolean, asks boolean, at long, anchor long, code long, words binary"


def _places(chunk: Chunk, batch: pa.RecordBatch, own: Paths, words: Words) -> np.ndarray:
    """A hash of each path's source coordinates: id, text and first word."""
    part = batch.slice(chunk.first, len(chunk))
    ids, keys = (np.asarray(column(part, n).fill_null(-1)).view(np.uint64) for n in ("id", "text_hash"))
    local = (own.first - words.first[own.doc]).astype(np.uint64)
    return mix(mix(mix(ids[own.doc]) ^ keys[own.doc]) + local)


def listed_paths(df: DataFrame, width: int, repeated) -> DataFrame:
    """The paths of anchors in the bitmap `repeated`, two rows at most for all equal ones of a task, and its spans that are known to repeat.

    A row with `known` is a span of words (first, size words) that repeats within the task. Others are paths (first word, size windows) with
    a digest of their words. A path that the task has only once up to this row asks whether it repeats.
    """
    sent = df.sparkSession.sparkContext.broadcast(repeated)

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        repeats = sent.value
        seen: dict[bytes, bool] = {}  # whether a path has been answered for
        for batch in batches:
            ids, keys = column(batch, "id"), column(batch, "text_hash")
            for chunk in chunks(column(batch, "text")):
                words, _, own = paths_of(chunk, width)
                take = np.flatnonzero(repeats.holds(own.anchor))
                if not len(take):
                    continue
                own = own.take(take)
                anchor, code, first, size, doc = own.anchor, own.code, own.first, own.size, own.doc
                text, begin, end = even_bytes(chunk, words)
                made = [hashlib.blake2b(text[a:b], digest_size=16).digest() for a, b in zip(begin[first].tolist(), end[first + size + width - 2].tolist(), strict=True)]
                flat = np.frombuffer(b"".join(made), np.uint64).reshape(len(made), 2)
                order = np.lexsort((flat[:, 1], flat[:, 0], code, anchor))
                new = np.ones(len(order), bool)
                for x in (anchor, code, flat[:, 0], flat[:, 1]):
                    new[1:] &= x[order][1:] == x[order][:-1]
                new[1:] = ~new[1:]
                heads = np.flatnonzero(new)
                copies = np.diff(np.append(heads, len(order)))
                lead = order[heads]  # lexsort keeps equal rows in their order, so this is the first of each
                if len(seen) + len(lead) > SEEN:
                    seen.clear()
                words_of = [made[i] for i in lead.tolist()]
                state = np.array([1 + seen[w] if w in seen else 0 for w in words_of])
                asks = (state == 0) & (copies == 1)
                seen.update(zip(words_of, (~asks).tolist(), strict=True))
                known = np.zeros(len(order), bool)
                known[order] = np.repeat(~asks, copies)
                again = np.zeros(len(words.start) + 1, np.int64)
                np.add.at(again, first[known], 1)
                np.add.at(again, (first + size + width - 1)[known], -1)
                gone = np.cumsum(again[:-1]) > 0
                cuts = np.array(runs(gone, np.arange(len(gone)), words.doc), np.int64).reshape(-1, 2)
                sent_on = state < 2
                lead, copies, asks = lead[sent_on], copies[sent_on], asks[sent_on]
                n, m = len(cuts), len(lead)
                owner = np.concatenate([words.doc[cuts[:, 0]], doc[lead]])
                start = np.concatenate([cuts[:, 0], first[lead]]) - words.first[owner]
                none = np.arange(n + m) < n
                rows = pa.array(owner + chunk.first)
                pad = np.zeros(n, np.int64)
                longs = [np.concatenate([pad, x[lead].view(np.int64)]) for x in (_places(chunk, batch, own, words), anchor, code)]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(rows),
                        keys.take(rows),
                        pa.array(start, pa.int32()),
                        pa.array(np.concatenate([cuts[:, 1] - cuts[:, 0], size[lead]]), pa.int32()),
                        pa.array(np.concatenate([pad, copies]), pa.int32()),
                        pa.array(none),
                        pa.array(np.concatenate([pad > 0, asks])),
                        *[pa.array(x, pa.int64(), mask=none) for x in longs],
                        pa.array([None] * n + [made[i] for i in lead.tolist()], pa.binary()),
                    ],
                    [x.split()[0] for x in _PATHS.split(", ")],
                )

    return df.select("id", "text_hash", "text").mapInArrow(on_batches, _PATHS)


def listed_edges(df: DataFrame, width: int, branching, chosen) -> DataFrame:
    """id, text_hash, first, e1, e2: the edges of paths of anchors in the bitmap `branching` whose place is in the bitmap `chosen`.

    e1 and e2 are the rolling hash and a digest of an edge's words.
    """
    sent = df.sparkSession.sparkContext.broadcast((branching, chosen))

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        branches, places = sent.value
        for batch in batches:
            ids, keys = column(batch, "id"), column(batch, "text_hash")
            for chunk in chunks(column(batch, "text")):
                words, whole, own = paths_of(chunk, width)
                own = own.take(np.flatnonzero(branches.holds(own.anchor)))
                own = own.take(np.flatnonzero(places.holds(_places(chunk, batch, own, words))))
                if not len(own.first):
                    continue
                at = np.repeat(own.first - np.cumsum(own.size) + own.size, own.size) + np.arange(int(own.size.sum()))
                text, begin, end = even_bytes(chunk, words)
                parts = b"".join([hashlib.blake2b(text[a:b], digest_size=8).digest() for a, b in zip(begin[at].tolist(), end[at + width - 1].tolist(), strict=True)])
                doc = words.doc[at]
                rows = pa.array(doc + chunk.first)
                yield pa.RecordBatch.from_arrays([ids.take(rows), keys.take(rows), pa.array(at - words.first[doc], pa.int32()), pa.array(whole[at].view(np.int64)), pa.array(np.frombuffer(parts, np.int64))], ["id", "text_hash", "first", "e1", "e2"])

    return df.select("id", "text_hash", "text").mapInArrow(on_batches, "id long, text_hash long, first int, e1 long, e2 long")


def repeated_spans(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """id, text_hash, lo, hi: word ranges of the rows of df (id, text_hash, text) that repeated windows cover."""
    spark, before = df.sparkSession, settled()

    def drop(*kept: DataFrame) -> None:
        """Delete what was settled on the way but for these frames."""
        stay = {f for k in kept for f in folders[id(k)]}
        release(spark, [x for x in settled() if x not in before and x not in stay])

    folders: dict[int, list[str]] = {}

    def held(frame: DataFrame) -> DataFrame:
        out = settle(frame)
        folders[id(out)] = settled()[-1:]
        return out

    counted = held(anchor_counts(df, width).where("n > 1").select("anchor", "branching"))
    branching = bitmap(counted.where("branching").select("anchor"))
    listed = held(listed_paths(df, width, bitmap(counted.select("anchor"))))
    drop(counted, listed)
    paths = listed.where("not known")
    by = ["anchor", "code", "words"]
    counts = held(paths.groupBy(*by).agg(F.sum("copies").alias("n"), F.sum(F.expr("int(asks)")).alias("__n"), F.min("at").alias("at")))
    same = counts.where("n > 1")
    known = listed.where("known").select("id", "text_hash", F.col("first").alias("lo"), (F.col("first") + F.col("size")).alias("hi"))
    whole = spread_join(paths.where("asks").select("id", "text_hash", "first", "size", *by), same.select(*by), by, counted=same.select(*by, "__n"))
    whole = whole.select("id", "text_hash", F.col("first").alias("lo"), (F.col("first") + F.col("size") + (width - 1)).alias("hi"))
    whole = held(known.union(whole))
    # Of every path of a branching anchor one row lists its edges; an edge repeats if two distinct paths hold it, or one twice.
    branches = counts.join(counted.where("branching").select("anchor"), "anchor", "left_semi")
    edges = held(listed_edges(df, width, branching, bitmap(branches.select("at"))))
    drop(whole, edges)
    met = held(edges.groupBy("e1", "e2").agg(F.count("*").alias("__n")).where("__n > 1"))
    parts = spread_join(edges, met.select("e1", "e2"), ["e1", "e2"], counted=met)
    parts = parts.select("id", "text_hash", F.col("first").alias("lo"), (F.col("first") + width).alias("hi"))
    found = held(whole.union(parts))
    drop(found)
    return found


def runs(flags: np.ndarray, at: np.ndarray, owner: np.ndarray) -> list[tuple[int, int]]:
    """Index ranges of set flags at consecutive places of one owner."""
    on = np.flatnonzero(flags)
    if not len(on):
        return []
    new = np.ones(len(on), bool)
    new[1:] = (np.diff(on) != 1) | (np.diff(at[on]) != 1) | (owner[on][1:] != owner[on][:-1])
    begins = np.flatnonzero(new)
    return list(zip(on[begins].tolist(), (on[np.append(begins[1:], len(on)) - 1] + 1).tolist(), strict=True))


def _with_cuts(df: DataFrame, width: int) -> DataFrame:
    """df (id, text_hash, text, ...) with a column of its repeated word ranges, null if there are none."""
    cuts = repeated_spans(df, width).groupBy("id", "text_hash").agg(F.collect_list(F.struct("lo", "hi")).alias("cuts"))
    cuts = cuts.withColumnRenamed("id", "cut_id").withColumnRenamed("text_hash", "cut_hash")
    return df.join(cuts, df["id"].eqNullSafe(cuts["cut_id"]) & df["text_hash"].eqNullSafe(cuts["cut_hash"]), "left").drop("cut_id", "cut_hash")


def gone(words, cuts: pa.Array) -> np.ndarray:
    """Which words of a chunk the ranges of its rows cover."""
    n = len(words.start)
    step = np.zeros(n + 1, np.int64)
    offsets = np.asarray(cuts.offsets)
    values = cuts.values.slice(offsets[0], offsets[-1] - offsets[0])
    counts = np.diff(offsets)
    base = np.repeat(words.first[:-1], counts)
    np.add.at(step, base + np.asarray(values.field("lo")), 1)
    np.add.at(step, base + np.asarray(values.field("hi")), -1)
    return np.cumsum(step[:-1]) > 0


def _apply(df: DataFrame, schema, on_chunk: Callable) -> DataFrame:
    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = column(batch, "cuts")
            cuts = pa.array([[]] * len(cuts), cuts.type) if cuts.null_count == len(cuts) else cuts.fill_null([]) if cuts.null_count else cuts
            for chunk in chunks(column(batch, "text")):
                words = spans(chunk, SPACE_SPLIT)
                yield on_chunk(batch.slice(chunk.first, len(chunk)), chunk, words, gone(words, cuts.slice(chunk.first, len(chunk))))

    return df.mapInArrow(on_batches, schema)


def digests(df: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of df (doc_id, text)."""

    def on_chunk(batch: pa.RecordBatch, chunk: Chunk, words, drop: np.ndarray) -> pa.RecordBatch:
        removed = sums(drop, words.first)
        hexes = []
        start, end, stay = words.start.tolist(), words.end.tolist(), (~drop).tolist()
        data = chunk.data.tobytes()
        for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
            hexes.append(hashlib.sha256(b" ".join([data[start[i] : end[i]] for i in range(a, b) if stay[i]])).hexdigest())
        return pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(hexes, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    keyed = df.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    return _apply(_with_cuts(keyed, width), "doc_id long, n_words long, n_removed long, kept_sha256 string", on_chunk)


def remove(df: DataFrame, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """df with every repeated passage cut out of its texts; a cut word goes with the white space after it.

    All rows and columns stay; a text of which nothing is left is empty, a null text stays null.
    """
    names = df.columns
    packed = df.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"), F.struct(F.lit(1).alias("c"), *[df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names) if c != text]).alias("rest"))

    def on_chunk(batch: pa.RecordBatch, chunk: Chunk, words, drop: np.ndarray) -> pa.RecordBatch:
        if drop.any():
            # A word's bytes reach to the next word, or to the end of its document.
            nxt = np.append(words.start[1:], len(chunk.data))
            last = words.first[1:][words.counts > 0] - 1
            nxt[last] = chunk.offsets[1:][words.counts > 0]
            step = np.zeros(len(chunk.data) + 1, np.int64)
            np.add.at(step, words.start[drop], 1)
            np.add.at(step, nxt[drop], -1)
            stay = np.cumsum(step[:-1]) == 0
            offsets = np.concatenate([[0], np.cumsum(stay)])[chunk.offsets]
            data = chunk.data[stay]
        else:
            data, offsets = chunk.data, chunk.offsets
        made = pa.Array.from_buffers(pa.large_string(), len(chunk), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())]).cast(pa.string())
        made = pa.compute.if_else(pa.array(~chunk.null), made, pa.scalar(None, pa.string()))
        return pa.RecordBatch.from_arrays([made, column(batch, "rest")], ["text", "rest"])

    schema = packed.select("text", "rest").schema
    out = _apply(_with_cuts(packed, width), schema, on_chunk)
    return out.select(*[F.col("text").alias(c) if c == text else F.col("rest")[f"c{i}"].alias(c) for i, c in enumerate(names)])


#: The same as digests over the table documents with windows of 35 words, for DuckDB.
SQL = r"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
words as (select r, len(w) as n, unnest(w) as word, unnest(range(len(w))) as pos from d),
windows as (
  select *, case when pos + 35 <= n then string_agg(word, ' ') over (partition by r order by pos rows between current row and 34 following) end as win from words),
marked as (select r, pos, word, win is not null and count(*) over (partition by win) > 1 as again from windows),
covered as (select *, bool_or(again) over (partition by r order by pos rows between 34 preceding and current row) as gone from marked),
kept as (select r, count(*) filter (gone) as n_removed, coalesce(string_agg(word, ' ' order by pos) filter (not gone), '') as left_over from covered group by r)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(left_over, '')) as kept_sha256
from d left join kept using (r)
"""
