"""Exact top-k, the pipeline, and the registered SQL."""

from __future__ import annotations

import math
import random
from collections import Counter

import duckdb
import pytest
from duskline.llm import linededup, queries, quality, topk

from . import brute

@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_the_sql_gives_the_same(spark, small, name):
    con = duckdb.connect()
    for t in ("embeddings", "pages", "documents"):
        con.execute(f"create view {t} as select * from '{small}/{t}.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in want.description]
    got = queries.QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == Counter(map(tuple, want.fetchall()))


def top(rows, asked, k):
    ok = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    q = lambda v: [math.floor(64 * x) for x in v]
    rows = [(i, q(v)) for i, v in rows if i is not None and ok(v)]
    out = []
    for a, v in asked:
        found = sorted(((-sum(x * y for x, y in zip(q(v), w, strict=True)), i) for i, w in rows if i != a and len(w) == len(v)))
        out += [(a, n, i, -s) for n, (s, i) in enumerate(found[:k], 1)]
    return sorted(out)


def test_top_k_with_ties_odd_vectors_and_few_candidates(spark):
    rng = random.Random(6)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(300)]
    rows += [(300 + i, [1.0, 1.0, 1.0, 1.0]) for i in range(80)]
    rows += [(900, None), (901, [1.0, None, 1.0, 1.0]), (902, [1.0, float("nan"), 0.0, 0.0]), (903, [float("inf")] * 4), (None, [1.0] * 4), (905, [1.0, 2.0]), (906, [3.0, 4.0]), (907, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, query_id string, score int").repartition(3)
    asked = [(i, v) for i, v in rows if i in (0, 20, 300, 905, 906, 907)]
    got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id in (0, 20, 300, 905, 906, 907, 900)"), 20).collect())
    assert got == top(rows, asked, 20)


def test_top_k_in_many_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "BINS", 8)
    monkeypatch.setattr(topk, "PRODUCT", 50)
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(tuple(r) for r in topk.search(df, df.where("vec_id % 5 = 0"), 4).collect())
    assert got == top(rows, [r for r in rows if r[0] % 5 == 0], 4)


def test_scores_that_no_long_holds_are_refused(spark):
    df = spark.createDataFrame([(1, [1e9, 1.0]), (2, [1e9, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError):
        topk.search(df, df, 1)
    large = spark.createDataFrame([(1, [1e7, 1.0]), (2, [-1e7, 2.0]), (3, [1e7, 3.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.search(large, large.where("vec_id = 1"), 5).orderBy("rank").collect()] == [(1, 1, 3, 64 * 64 * (10**14 + 3)), (1, 2, 2, 64 * 64 * (2 - 10**14))]


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, df, 5).count() == 0
    one = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk.search(one, one, 5).count() == 0


def test_stages_do_what_brute_force_does(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {r.doc_id: (r.source, r.text) for r in docs.collect()}
    kept = {r.doc_id for r in quality.judge(docs).where("kept").collect()}
    assert all(brute.quality(rows[d][1])[-1] is False for d in kept)
    ids = sorted(kept)
    texts = brute.line_dedup([rows[d] for d in ids], linededup.RATIO, linededup.LEAST_PAGES)
    one = [(d, t) for (d, t), x in zip(zip(ids, texts, strict=True), brute.components(list(zip(ids, texts, strict=True)), 5), strict=True) if x[2]]
    drops = brute.repeated([t for _, t in one], 35)
    want = {d: brute.without_repeats(t, drop) for (d, t), drop in zip(one, drops, strict=True)}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        columns = docs.columns
        docs = stage(spark, docs, small)
        assert docs.columns == columns, i
    assert {r.doc_id: r.text for r in docs.collect()} == want
    packed = corpus_pipeline.run(spark, small).collect()
    got = Counter()
    for r in packed:
        got[r.doc_id] += r.n_words
    assert got == Counter({d: len(brute.words(t)) for d, t in want.items()})


def test_line_dedup_drops_lines_of_a_tenth_of_a_large_source(spark, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, f"own {i}\nplanted" if i % 10 == 0 else f"own {i}\nrare" if i % 20 == 1 else f"own {i}", "s") for i in range(400)]
    rows += [(1000 + i, f"own {i}\nplanted" if i % 10 == 0 else f"own {i}", "t") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, small).collect()}
    # 40 of 400 documents are above the lower bar, 20 of 400 are not, and 4 of 40 may be chance.
    assert got == {i: t.replace("\nplanted", "") if s == "s" else t for i, t, s in rows}


def test_stages_take_odd_rows(spark, odd, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = odd
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.count() > 0
    empty = odd.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, small)
    assert empty.count() == 0


def test_stages_keep_clashing_columns(spark, clashing, odd, small):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, plain = clashing, odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs, plain = stage(spark, docs, small), stage(spark, plain, small)
        assert docs.columns == clashing.columns
    assert Counter((r[0], r[1]) for r in docs.collect()) == Counter((r[0], r[1]) for r in plain.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, small).count() > 0


def test_ten_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
