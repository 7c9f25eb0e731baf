"""Near-duplicate detection: fast similarity sketches, banding, exact verification, components.

Sketch: a document's set of word shingles is thrown into T bins in rounds; round i puts each shingle by
a fresh hash into one bin with the value (i, hash), and a bin keeps its least value. Rounds T to 2T - 1
put every shingle into bin i - T, so each coordinate fills, however small the set; documents leave
the rounds when their bins are full. Sets agree in a coordinate with the probability of their
similarity, and sharper around it than with independent hashes.

Banding: BANDS bands of ROWS coordinates. A pair at similarity 0.8 shares no band with probability
(1 - 0.8**5)**50 = 2.4e-9, a closer one less often.

Links without all pairs: equal sets are one class from the start. (1) In each bucket every class is
linked with one class only, that with most company in all its buckets together (of a text and its copies it is the
text, whatever the bucket), and these candidates are verified on full sets. (2) Buckets
whose classes are now in one component are finished, as are those of two classes. In the others, classes outside the
bucket's least component are compared with all classes of other components in the bucket, in blocks of bounded size, by
their sketches. A pair of classes is looked at in the first band that they share. What may reach the threshold goes
on as one list for each pair of blocks, best first; the full sets of its classes are joined to the list, and of
verified links only those that connect components not yet connected are returned. Nothing is capped, and no pair is a row.

Words: A-Z folded, `[^\\x20\\x09-\\x0D]+`. A document of fewer than k words has its whole sequence as its one
shingle. Documents without words, and null texts, have no shingles and are linked with nothing. A class is
named by a 64-bit hash of its set. Ids may be null or repeat: component_id is the smallest id of the component
that is not null, `kept` is true where the id is that (or both are null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column, release, settle, settled, spread_join
from .graph import components
from .textbytes import SPACE_SPLIT, Chunk, Words, chunks, mix, powers, spans, windows, word_hashes

T, ROWS = 250, 5
BANDS = T // ROWS
SIMILARITY = (80, 100)
#: A pair at the threshold falls below this share of equal coordinates with probability under 3e-7 (five standard deviations).
LEAST_AGREEMENT = 0.8 - 5 * (0.8 * 0.2 / T) ** 0.5
#: Classes of a block, and blocks of a bucket that one task meets with the bucket's minor blocks.
BLOCK, PART = 256, 8
_FULL = np.uint64((1 << 64) - 1)
_SEEDS = mix(np.arange(1, 2 * T + BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def shingle_sets(chunk: Chunk, k: int, words: Words | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's documents, ordered by document, and the document of each. words: the chunk's, if known."""
    words = spans(chunk, SPACE_SPLIT) if words is None else words
    hashed = word_hashes(chunk, words, True)
    made, at = windows(hashed, words, k)
    values, docs = [made], [words.doc[at]]
    for m in range(1, k):
        short = np.flatnonzero(words.counts == m)
        if len(short):  # the same hash as that of a window, of these documents only
            whole = mix((hashed[words.first[short][:, None] + np.arange(m)] * powers(m)).sum(axis=1, dtype=np.uint64))
            values.append(mix(whole + np.uint64(m)))
            docs.append(short)
    value, doc = np.concatenate(values), np.concatenate(docs)
    if len(value) < 8 * len(chunk):
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
    else:  # sets of some size are sorted one by one, without an index
        if len(docs) > 1:
            order = np.argsort(doc, kind="stable")
            value, doc = value[order], doc[order]
        cuts = np.searchsorted(doc, np.arange(len(chunk) + 1)).tolist()
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            value[x:y].sort()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], doc[new]


def class_ids(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set value[first[i]:first[i + 1]]; order plays no part."""
    prefix = np.zeros(len(value) + 1, np.uint64)
    np.cumsum(mix(value ^ np.uint64(0x5851F42D4C957F2D)), out=prefix[1:])
    return mix((prefix[first[1:]] - prefix[first[:-1]]) + np.diff(first).astype(np.uint64))


def sketches(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A row of T coordinates for each (non-empty) set."""
    n = len(first) - 1
    bins = np.full(n * T, _FULL)
    doc = np.repeat(np.arange(n), np.diff(first))
    for i in range(2 * T):
        if not len(value):
            break
        h = mix(value ^ _SEEDS[i])
        if i < T:
            at = doc * T + ((h >> np.uint64(32)) * np.uint64(T) >> np.uint64(32)).astype(np.int64)
        else:
            at = doc * T + (i - T)
        np.minimum.at(bins, at, (np.uint64(i) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF)))
        if i < 8 or i % 8 == 0:
            stay = ~(bins.reshape(n, T) != _FULL).all(axis=1)[doc]
            value, doc = value[stay], doc[stay]
    return bins.reshape(n, T)


def bands(sketch: np.ndarray) -> np.ndarray:
    """A hash of each band of each sketch."""
    out = np.tile(_SEEDS[2 * T :], (len(sketch), 1))
    for r in range(ROWS):
        out = mix(out ^ sketch[:, r::ROWS])
    return out


def signatures(df: DataFrame, k: int) -> DataFrame:
    """id, text_hash, n (shingles), n_words, cls, bands and sketch of the first row of each class in a chunk, and what else df holds."""
    others = [f for f in df.schema.fields if f.name not in ("id", "text_hash", "text")]
    names = ["id", "text_hash", "n", "n_words", "cls", "bands", "sketch", *[f.name for f in others]]

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = np.zeros(0, np.uint64)
            for chunk in chunks(column(batch, "text")):
                words = spans(chunk, SPACE_SPLIT)
                value, doc = shingle_sets(chunk, k, words)
                first = np.searchsorted(doc, np.arange(len(chunk) + 1))
                n = np.diff(first)
                cls = class_ids(value, first)
                lead = np.zeros(len(chunk), bool)
                lead[np.unique(cls, return_index=True)[1]] = True
                lead &= (n > 0) & ~np.isin(cls, seen)
                seen = np.concatenate([seen, cls[lead]])
                own = np.flatnonzero(lead)
                take = np.repeat(lead, n)
                made = sketches(value[take], np.concatenate([[0], np.cumsum(n[own])]))
                banded = bands(made)
                offsets = np.concatenate([[0], np.cumsum(np.where(lead, BANDS, 0))]).astype(np.int32)
                small = (mix(made) >> np.uint64(56)).astype(np.uint8)
                sketch: list = [None] * len(chunk)
                for i, row in zip(own.tolist(), small, strict=True):
                    sketch[i] = row.tobytes()
                part = batch.slice(chunk.first, len(chunk))
                yield pa.RecordBatch.from_arrays([column(part, "id"), column(part, "text_hash"), pa.array(n, pa.int64()), pa.array(words.counts, pa.int64()), pa.array(cls.view(np.int64), mask=n == 0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(banded.reshape(-1).view(np.int64))), pa.array(sketch, pa.binary()), *[column(part, name) for name in names[7:]]], names)

    schema = "id long, text_hash long, n long, n_words long, cls long, bands array<long>, sketch binary"
    return df.mapInArrow(on_batches, ", ".join([schema, *[f"{f.name} {f.dataType.simpleString()}" for f in others]]))


def _class_sets(df: DataFrame, classes: DataFrame, signed: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """cls, set: the sorted shingle hashes of each of these classes, made from one of its texts."""
    chosen = settle(texts.join(classes, "cls", "left_semi"))
    repeats = not signed.join(chosen, (F.col("id").eqNullSafe(F.col("c_id"))) & (F.col("text_hash") == F.col("c_hash"))).groupBy("c_id", "c_hash").count().where("count > 1").isEmpty()
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    found = df.join(chosen, (F.col("text_hash") == F.col("c_hash")) & F.col("id").eqNullSafe(F.col("c_id"))).select("cls", "text")

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                value, doc = shingle_sets(chunk, k)
                first = np.searchsorted(doc, np.arange(len(chunk) + 1)).tolist()
                sets = [value[x:y].tobytes() for x, y in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array(sets, pa.binary())], ["cls", "set"])

    made = found.mapInArrow(on_batches, "cls long, set binary")
    return settle(made.dropDuplicates(["cls"]) if repeats else made)


def similar(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sorted sets reach the threshold."""
    if SIMILARITY[1] * min(len(p), len(q)) < SIMILARITY[0] * max(len(p), len(q)):
        return False
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    common = int(np.count_nonzero(both[1:] == both[:-1]))
    return SIMILARITY[1] * common >= SIMILARITY[0] * (len(p) + len(q) - common)


def verified(pairs: DataFrame, df: DataFrame, signed: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs of classes (a, b) whose full sets are similar enough."""
    classes = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    sets = _class_sets(df, classes, signed, texts, k)
    left = sets.select(F.col("cls").alias("a"), F.col("set").alias("a_set"))
    right = sets.select(F.col("cls").alias("b"), F.col("set").alias("b_set"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "a_set", "b_set")

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(column(batch, "a_set"), column(batch, "b_set"), strict=True)):
                ok[i] = similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64))
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([column(batch, "a").filter(keep), column(batch, "b").filter(keep)], ["a", "b"])

    return settle(joined.mapInArrow(on_batches, "a long, b long").distinct())


_LISTS = "list long, xs binary, ys binary, x_comps binary, y_comps binary"


def _open_lists(members: DataFrame, labels: DataFrame, signed: DataFrame) -> DataFrame:
    """Lists of pairs of classes in different components that share a bucket and may be similar by their sketches, best first.

    A pair stands in the list of the first band it shares, once for each of that band's pairs of blocks.
    """
    comp = F.coalesce(F.col("comp"), F.col("cls"))
    named = members.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select("bucket", "cls", comp.alias("comp"))
    state = named.groupBy("bucket").agg(F.min("comp").alias("main"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("main != hi and n > 2").select("bucket", "main")
    rows = settle(named.join(state, "bucket").withColumn("minor", F.col("comp") != F.col("main")).drop("main"))
    # Both sides are dealt into blocks apart, so that a few classes outside the main component meet it as one block.
    sizes = settle(rows.groupBy("bucket", "minor").agg(F.expr(f"int(ceil(count(*) / {BLOCK}))").alias("blocks")))
    rows = spread_join(rows, sizes, ["bucket", "minor"]).withColumn("block", F.expr("pmod(xxhash64(cls), blocks)"))
    sketch = signed.where("sketch is not null").groupBy("cls").agg(F.first("sketch").alias("sketch"), F.first("bands").alias("bands"), F.first("n").alias("size"))
    blocks = rows.join(sketch, "cls").groupBy("bucket", "minor", "block").agg(F.collect_list(F.struct("cls", "comp", "size", "sketch", "bands")).alias("own"))
    blocks = settle(blocks)
    # A bucket's blocks are dealt into parts of PART blocks, and its minor blocks go to each part.
    parts = sizes.groupBy("bucket").agg(F.expr(f"int((max(blocks) - 1) div {PART})").alias("last"))
    left = blocks.where("minor").join(parts, "bucket").select("bucket", F.explode(F.expr("sequence(0, last)")).alias("part"), F.col("block").alias("x_block"), F.col("own").alias("x"))
    right = blocks.select("bucket", F.expr(f"int(block div {PART})").alias("part"), "minor", "block", F.col("own").alias("y"))
    pairs = left.join(right, ["bucket", "part"]).where("not minor or x_block <= block").select(F.xxhash64("bucket", "x_block", "minor", "block").alias("list"), "bucket", "x", "y")

    def unpack(rows: pa.Array) -> tuple[np.ndarray, ...]:
        flat = rows.flatten() if isinstance(rows, pa.ListArray) else rows
        n = len(flat)
        banded = np.asarray(flat.field("bands").flatten()).reshape(n, BANDS)
        return np.asarray(flat.field("cls")), np.asarray(flat.field("comp")), np.asarray(flat.field("size")), np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint8).reshape(n, T), banded

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                bucket = batch.column(1)[i].as_py()
                xc, xg, xn, xs, xb = unpack(batch.column(2).slice(i, 1))
                yc, yg, yn, ys, yb = unpack(batch.column(3).slice(i, 1))
                found: list[tuple[np.ndarray, ...]] = []
                for j in range(len(xc)):
                    fit = np.flatnonzero((yg != xg[j]) & (SIMILARITY[1] * np.minimum(xn[j], yn) >= SIMILARITY[0] * np.maximum(xn[j], yn)))
                    share = (ys[fit] == xs[j]).mean(axis=1)
                    fit, share = fit[share >= LEAST_AGREEMENT], share[share >= LEAST_AGREEMENT]
                    if len(fit):
                        first = np.argmax(yb[fit] == xb[j], axis=1)
                        own = xb[j][first] == bucket
                        found.append((np.full(int(own.sum()), j), fit[own], share[own]))
                if not found:
                    continue
                a, b, share = (np.concatenate(x) for x in zip(*found, strict=True))
                best = np.argsort(-share, kind="stable")
                a, b = a[best], b[best]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()], pa.int64()), *[pa.array([v.astype(np.int64).tobytes()], pa.binary()) for v in (xc[a], yc[b], xg[a], yg[b])]], ["list", "xs", "ys", "x_comps", "y_comps"])

    return pairs.mapInArrow(on_batches, _LISTS)


def _verified_lists(lists: DataFrame, df: DataFrame, signed: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Links (a, b) that connect all components which a similar pair of a list connects."""

    def classes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = np.unique(np.concatenate([np.frombuffer(batch.column(c)[i].as_buffer(), np.int64) for c in (1, 2)]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), batch.column(0)[i].as_py())), pa.array(own)], ["list", "cls"])

    named = settle(lists.mapInArrow(classes_of, "list long, cls long"))
    sets = _class_sets(df, named.select("cls").distinct(), signed, texts, k)
    held = named.join(sets, "cls").select("list", "cls", "set")

    def on_tables(listed: pa.Table, own: pa.Table) -> pa.Table:
        out: list[tuple[int, int]] = []
        classes, texts = own["cls"].to_pylist(), own["set"].combine_chunks()
        where = {c: i for i, c in enumerate(classes)}
        up: dict[int, int] = {}

        def top(c: int) -> int:
            while up.get(c, c) != c:
                c = up[c]
            return c

        for i in range(listed.num_rows):
            a, b, ga, gb = (np.frombuffer(listed[n][i].as_buffer(), np.int64).tolist() for n in ("xs", "ys", "x_comps", "y_comps"))
            for x, y, g, h in zip(a, b, ga, gb, strict=True):
                s, t = top(g), top(h)
                if s != t and similar(np.frombuffer(texts[where[x]].as_buffer(), np.uint64), np.frombuffer(texts[where[y]].as_buffer(), np.uint64)):
                    up[s] = t
                    out.append((max(x, y), min(x, y)))
        return pa.table([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return settle(lists.groupBy("list").cogroup(held.groupBy("list")).applyInArrow(on_tables, "a long, b long"))


def linked(df: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """Signatures of the rows of df (id, text_hash, text), and node, comp of all classes that are linked with another."""
    signed = settle(signatures(df, k))
    banded = signed.where("size(bands) > 0").select("cls", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("bucket")
    members = settle(banded.join(shared, "bucket").select("bucket", "cls").distinct())
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"))
    reach = members.join(sizes, "bucket").groupBy("cls").agg(F.sum("n").alias("reach"))
    leads = members.join(reach, "cls").groupBy("bucket").agg(F.max(F.struct("reach", "cls")).alias("top")).select("bucket", F.col("top.cls").alias("lead"))
    first = members.join(leads, "bucket").where("cls != lead").select(F.greatest("cls", "lead").alias("a"), F.least("cls", "lead").alias("b"))
    first = settle(first.distinct())
    # The one text that each class is read from; combined before the shuffle, as a class may have very many rows.
    texts = signed.where("cls is not null").groupBy("cls").agg(F.min(F.struct("text_hash", "id")).alias("row"))
    texts = settle(texts.select("cls", F.col("row.id").alias("c_id"), F.col("row.text_hash").alias("c_hash")))
    edges = verified(first, df, signed, texts, k)
    labels = components(edges)
    lists = settle(_open_lists(members, labels, signed))
    if not lists.isEmpty():
        labels = components(edges.union(_verified_lists(lists, df, signed, texts, k)))
    return signed, labels


def near_rows(df: DataFrame, k: int, doc_id: str, text: str, **carried: Column) -> DataFrame:
    """For each row of df: id, text_hash, n (shingles), comp (null without words), component_id; with carried columns of df also these and n_words."""
    keyed = df.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"), *[c.alias(name) for name, c in carried.items()])
    others = ["n_words", *carried] if carried else []
    before = settled()
    signed, labels = linked(keyed, k)
    rows = spread_join(signed.select("id", "text_hash", "n", "cls", *others), labels.withColumnRenamed("node", "cls"), ["cls"], "left").withColumn("comp", F.coalesce("comp", "cls"))
    rows = settle(rows.select("id", "text_hash", "n", "comp", *others))
    release(df.sparkSession, [x for x in settled()[:-1] if x not in before])
    least = rows.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least"), F.count("*").alias("size")).where("size > 1").select("comp", "least")
    out = spread_join(rows, settle(least.withColumn("in_group", F.lit(True))), ["comp"], "left")
    component = F.when(F.col("in_group"), F.col("least")).otherwise(F.col("id"))
    return out.select("id", "text_hash", "n", "comp", component.alias("component_id"), *others)


def near_duplicates(df: DataFrame, k: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row of df: id, text_hash, n_shingles, component_id, kept."""
    rows = near_rows(df, k, doc_id, text)
    return rows.select("id", "text_hash", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(df: DataFrame, k: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df without all but one of each group of near-duplicates (the one with the smallest id).

    Rows that repeat id and text as well are one document; one of them stays.
    """
    judged = settle(near_duplicates(df, k, doc_id, text))
    out = judged.where("not kept").select(F.col("id").alias("o_id"), F.col("text_hash").alias("o_hash")).distinct()
    if out.count() <= BROADCAST_ROWS:
        out = F.broadcast(out)
    packed = df.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))
    kept = packed.join(out, F.col("id").eqNullSafe(F.col("o_id")) & (F.col("text_hash") == F.col("o_hash")), "left_anti")
    if not judged.groupBy("id", "text_hash").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "text_hash"])
    return kept.select(*[F.col("row")[c].alias(c) for c in df.columns])


#: The same as near_duplicates over the table documents with k = 2, for DuckDB (all pairs that share a shingle: small tables only).
SQL = r"""
with recursive d as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
words as (select r, len(w) as n, unnest(w) as word, unnest(range(len(w))) as pos from d),
pairs as (select *, lead(word) over (partition by r order by pos) as follower from words),
shingles as (select distinct r, case when n = 1 then word else word || ' ' || follower end as s from pairs where n = 1 or follower is not null),
sized as (select r, s, count(*) over (partition by r) as n from shingles),
links as (
  select a.r as x, b.r as y from sized a join sized b on a.s = b.s and a.r < b.r and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.r, b.r, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))),
ways as (select x, y from links union all select y, x from links),
reached(r, k) as (select r, r from d union select ways.y, reached.k from reached join ways on reached.r = ways.x),
named as (select reached.r, min(d.doc_id) as component_id from reached join d on reached.k = d.r group by reached.r)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id is not distinct from component_id as kept
from d join named using (r) left join (select r, count(*) as n from shingles group by r) using (r)
"""
