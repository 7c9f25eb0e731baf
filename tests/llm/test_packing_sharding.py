"""Best-fit packing and byte-balanced shards."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from duskline.llm import packing, sharding
from duskline.llm import queries
from pyspark.sql import functions as F

from . import brute


def naive_best_fit(lengths, sources, clusters, capacity, quota):
    """Each piece goes to the compatible bin with the least room that holds it, the first opened of equals."""
    left, held, within, out = [], [], [], []
    for size, s, c in zip(lengths, sources, clusters, strict=True):
        fit = [(left[b], b) for b in range(len(left)) if left[b] >= size and held[b][s] < quota and c not in within[b]]
        if fit:
            b = min(fit)[1]
        else:
            b = len(left)
            left.append(capacity)
            held.append(Counter())
            within.append(set())
        out.append((b, capacity - left[b]))
        left[b] -= size
        held[b][s] += 1
        within[b].add(c)
    return [b for b, _ in out], [at for _, at in out]


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_is_that_of_brute_force(seed):
    rng = random.Random(seed)
    n = 300
    lengths = sorted((rng.randint(1, 60) for _ in range(n)), reverse=True)
    sources = [rng.choice(["a", "a", "b", None]) for _ in range(n)]
    clusters = [rng.randint(0, 60) for _ in range(n)]
    assert packing.best_fit(lengths, sources, clusters, 64, 2) == naive_best_fit(lengths, sources, clusters, 64, 2)


def check(rows, texts, capacity, quota):
    bins, words = defaultdict(list), defaultdict(Counter)
    for r in rows:
        if r.n_words:
            bins[r.bin].append(r)
            words[r.id][r.first_word] += r.n_words
        else:
            assert r.bin is None
    for own in bins.values():
        assert sum(r.n_words for r in own) <= capacity
        assert max(Counter(r.source for r in own).values()) <= quota
        assert max(Counter(r.cluster for r in own).values()) == 1
        ends = sorted((r.bin_start, r.bin_start + r.n_words) for r in own)
        assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))
    want = Counter()
    for d, t in texts:
        want[d] += len(brute.words(t))
    got = Counter()
    for r in rows:
        got[r.id] += r.n_words
    assert got == want


def test_bins_hold_their_limits_and_all_words(odd, clashing, none):
    for df in (odd, clashing):
        rows = packing.pack(df, capacity=256, quota=3, group_rows=8).collect()
        check(rows, [(r[0], r[1]) for r in odd.collect()], 256, 3)
    assert packing.pack(none).count() == 0


def test_packing_is_the_same_however_rows_are_dealt(odd):
    a = Counter(map(tuple, packing.pack(odd.where("doc_id is not null"), group_rows=8).collect()))
    b = Counter(map(tuple, packing.pack(odd.where("doc_id is not null").repartition(7), group_rows=8).collect()))
    assert a == b


def test_rows_repeated_past_counting_are_dealt_alike(spark):
    rows = [(1, "one two three", "s")] * 40 + [(i, f"text {i} " * (i % 7 + 1), "t") for i in range(2, 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [Counter(map(tuple, packing.pack(df.repartition(n), group_rows=8).collect())) for n in (1, 5)]
    assert got[0] == got[1] and sum(got[0].values()) == len(rows)


def test_groups_are_packed_as_brute_force_packs_them(spark, documents):
    """The whole of pack(): each group of its rows by the plain best fit, in the order of length, hash and id."""
    capacity, quota = 300, 3
    rows = packing.pack(documents, capacity=capacity, quota=quota, group_rows=40).collect()
    keys = {(r.doc_id): r.key for r in packing.measured(documents, "doc_id", "text", "source", None).selectExpr("id as doc_id", "key").collect()}
    groups = max(1, documents.count() // 40)
    by = defaultdict(list)
    for r in rows:
        if r.bin is not None:
            by[r.bin % groups].append(r)
    assert len(by) > 3
    for own in by.values():
        own.sort(key=lambda r: (-r.n_words, keys[r.id], r.id, r.piece))
        bins, starts = naive_best_fit([r.n_words for r in own], [r.source for r in own], [r.cluster for r in own], capacity, quota)
        assert [(r.bin // groups, r.bin_start) for r in own] == list(zip(bins, starts, strict=True))


def test_groups_fill_bins_about_as_well_as_the_whole_table(spark, documents):
    one, many = (packing.fill(packing.pack(documents, group_rows=n)).first() for n in (10**9, 250))
    assert one.n_words == many.n_words and one.fill >= many.fill > one.fill - 0.05


def test_packing_the_table(spark, small, documents):
    rows = packing.pack(documents).collect()
    check(rows, [(r.doc_id, r.text) for r in documents.collect()], packing.CAPACITY, packing.SOURCE_QUOTA)
    assert queries.op2_best_fit_packing(spark, small).count() == len(rows)


def test_near_copies_share_no_bin(spark, tmp_path, odd):
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:-1], f"end{i}"]), f"s{i}") for i in range(4)] + [(10, "some other text", "s"), (None, "alone", "s"), (None, "alone too", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_best_fit_packing(spark, str(tmp_path)).collect()
    near = [r for r in got if r.doc_id is not None and r.doc_id < 4]
    assert len(got) == len(rows) and len({r.bin for r in near}) == 4 and len({r.cluster for r in near}) == 1
    assert len({r.cluster for r in got}) == 4
    assert packing.near_clusters(odd).count() == odd.count()


def test_near_copies_without_ids_share_no_bin(spark, tmp_path):
    base = [f"w{i}" for i in range(60)]
    rows = [(None, " ".join([*base[:-1], f"end{i}"]), f"s{i}") for i in range(4)] + [(None, "some other text", "s"), (None, None, "s")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op2_best_fit_packing(spark, str(tmp_path)).collect()
    near = [r for r in got if r.n_words == 60]
    assert len(got) == len(rows) and len(near) == 4 and len({r.bin for r in near}) == 4 and len({r.cluster for r in near}) == 1
    assert len({r.cluster for r in got if r.n_words}) == 2


def test_words_are_counted_once_and_packed_as_by_clusters_named_in_a_column(spark, small, odd, clashing, documents, monkeypatch):
    want = [Counter(map(tuple, packing.pack(packing.near_clusters(df), cluster="near_cluster", group_rows=200).collect())) for df in (odd, documents)]

    def again(*_):
        raise AssertionError("texts are read and split again")

    monkeypatch.setattr(packing, "measured", again)
    for df, rows in zip((odd, clashing, documents), (want[0], *want), strict=True):
        assert Counter(map(tuple, packing.pack_near(df, group_rows=200).collect())) == rows
    assert queries.op2_best_fit_packing(spark, small).count() == documents.count() + sum(n for r, n in want[1].items() if r[1])


def shard_rows(df, shards):
    rows = sharding.by_bytes(df, shards).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r)
    for own in by.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return rows, by


def test_shards_have_near_equal_bytes(spark, small, documents):
    rows, by = shard_rows(documents, 24)
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert Counter(r.id for r in rows) == Counter(texts.keys())
    for r in rows:
        assert r["size"] == len(texts[r.id].encode()) + 8 and r.text_crc32 == brute.crc(texts[r.id])
    sizes = [sum(r["size"] for r in by[s]) for s in range(24)]
    largest = max(r["size"] for r in rows)
    assert max(sizes) - min(sizes) <= 2 * largest + 2
    got = queries.op3_sharding(spark, small).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and all(0 <= r.shard < 24 for r in got)


def test_splitters_are_where_sorting_and_cutting_puts_them(spark, documents):
    """All rows sorted by their keys; each cut is the place with the wanted bytes before it, within the tolerance or one row's size."""
    shards = 24
    keyed = documents.select("doc_id", sharding._hashed(F.col("text")).alias("k1"), sharding._hashed(F.struct("doc_id")).alias("k2"), (F.octet_length("text") + 8).alias("size"))
    order = sorted((r.k1, r.k2, r["size"], r.doc_id) for r in keyed.collect())
    total = sum(r[2] for r in order)
    rows, by = shard_rows(documents, shards)
    shard = {r.id: r.shard for r in rows}
    assert [shard[r[3]] for r in order] == sorted(shard.values())  # shards are ranges of the sorted rows
    groups = Counter()
    for r in order:
        groups[r[0]] += r[2]
    at, ends = 0, {}
    for r in order:
        at += r[2]
        ends[shard[r[3]]] = at
    for s in range(shards - 1):
        if s in ends:
            goal = total * (s + 1) // shards
            assert abs(ends[s] - goal) <= max(sharding.TOLERANCE * total / shards, max(r[2] for r in order) / 2 + 1), s
    slots = {s: [r.id for r in sorted(own, key=lambda r: r.slot)] for s, own in by.items()}
    for s, ids in slots.items():
        assert ids == [r[3] for r in order if shard[r[3]] == s]


def test_rows_that_repeat_id_and_text_have_slots_of_their_own(spark):
    rows = [(7, "the same row")] * 900 + [(i, f"other {i}") for i in range(100)]
    got, by = shard_rows(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 3)
    assert len(got) == 1000 and len({r.shard for r in got if r.text_crc32 == brute.crc("the same row")}) == 1


def test_a_hot_group_is_cut_only_where_it_must_be(spark):
    rows = [(i, "x" * 100) for i in range(600)] + [(1000 + i, f"text {i} " * 8) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got, by = shard_rows(df, 6)
    sizes = [sum(r["size"] for r in own) for own in by.values()]
    assert max(sizes) <= 1.02 * sum(sizes) / 6
    hot = {r.shard for r in got if r.text_crc32 == brute.crc("x" * 100)}
    assert max(hot) - min(hot) + 1 == len(hot)


def test_odd_rows_have_shards(odd, clashing, none):
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, brute.crc(r.text)) for r in odd.collect())
    for df in (odd, clashing):
        rows, _ = shard_rows(df, 4)
        assert Counter((r.id, r["size"], r.text_crc32) for r in rows) == want
    assert sharding.by_bytes(none, 4).count() == 0
    one = odd.where("doc_id = 1")
    assert [(r.id, r["size"], r.text_crc32, r.slot) for r in sharding.by_bytes(one, 3).collect()] == [(1, 8, None, 0)]
