"""Near-duplicates, substrings, lines: against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from duskline.llm import graph, linededup, neardup, substrings
from duskline.llm.textbytes import chunks
import pyarrow as pa

from . import brute
from .conftest import odd_rows, sentence


def sort_key(row):
    return tuple((x is None, x) for x in row)


@pytest.mark.parametrize("k", [2, 5])
def test_components_are_those_of_brute_force(odd, documents, k):
    for df in (odd.select("doc_id", "text"), documents.select("doc_id", "text")):
        rows = [tuple(r) for r in df.collect()]
        want = sorted(((d, *x) for (d, _), x in zip(rows, brute.components(rows, k), strict=True)), key=sort_key)
        got = sorted((tuple(r) for r in neardup.near_duplicates(df, k).select("id", "n_shingles", "component_id", "kept").collect()), key=sort_key)
        assert got == want


def test_near_copies_in_one_bucket_that_its_least_class_does_not_link(spark):
    """Chains of near copies: neighbours are similar, ends are not."""
    rng = random.Random(3)
    rows = []
    for family in range(6):
        w = sentence(rng, 150).split()
        for step in range(25):
            rows.append((family * 100 + step, " ".join(w)))
            w = w[:]
            for at in rng.sample(range(150), 4):
                w[at] = f"new{family}{step}{at}"
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = sorted((d, *x) for (d, _), x in zip(rows, brute.components(rows, 2), strict=True))
    got = sorted(tuple(r) for r in neardup.near_duplicates(df, 2).select("id", "n_shingles", "component_id", "kept").collect())
    assert got == want


def test_pairs_at_the_threshold_are_linked_and_pairs_below_are_not(spark):
    """300 pairs of 80 common words of 100 (0.8 exactly), in whole groups that share a bucket, and 300 of 79 of 101."""
    rows = []
    for i in range(600):
        common = [f"c{i}x{j}" for j in range(80 if i < 300 else 79)]
        for side in (0, 1):
            rows.append((2 * i + side, " ".join(common + [f"o{i}s{side}x{j}" for j in range(90 - len(common))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.id: r.component_id for r in neardup.near_duplicates(df, 1).collect()}
    assert got == {2 * i + side: 2 * i + (side if i >= 300 else 0) for i in range(600) for side in (0, 1)}


@pytest.mark.parametrize("k", [1, 2, 5])
def test_sets_are_sorted_and_the_same_beside_long_and_short_documents(k):
    rng = random.Random(4)
    few = [None, "", "a", "A b", "a b c", "a b c d", "a b c d e", "a b c d e f a b c d e f", "a b"]
    many = [*few, *(sentence(rng, 400) for _ in range(3)), *few]

    def sets(texts):
        chunk = next(chunks(pa.array(texts, pa.string())))
        value, doc = neardup.shingle_sets(chunk, k)
        return [value[doc == i].tolist() for i in range(len(texts))]

    beside, alone = sets(many), [sets([t])[0] for t in many]
    assert beside == alone and sets(few) == alone[: len(few)]
    for t, own in zip(many, alone, strict=True):
        words = brute.words(t)
        assert own == sorted(set(own)) and len(own) == len({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else ())


def test_every_coordinate_of_a_sketch_fills():
    for n in (1, 2, 3, 50, 1000):
        value = np.arange(n, dtype=np.uint64)
        made = neardup.sketches(value, np.array([0, n]))
        assert (made != np.uint64((1 << 64) - 1)).all()


def test_sketches_agree_as_often_as_sets_are_similar():
    rng = np.random.default_rng(0)
    a = rng.integers(1 << 62, size=400).astype(np.uint64)
    b = np.concatenate([a[:350], rng.integers(1 << 62, size=50).astype(np.uint64)])
    made = neardup.sketches(np.concatenate([a, b]), np.array([0, 400, 800]))
    assert abs((made[0] == made[1]).mean() - 350 / 450) < 0.12


def test_keep_one_keeps_all_columns_and_one_row_of_each_group(odd, clashing):
    got = neardup.keep_one(clashing, 5)
    assert got.columns == clashing.columns
    rows = {(r[0], r[1]) for r in odd.collect()}
    judged = brute.components(list(rows), 5)
    want = {r for r, (_, _, kept) in zip(rows, judged, strict=True) if kept}
    kept = [(r[0], r[1]) for r in got.collect()]
    assert Counter(kept) == Counter(want)


def test_empty_tables_stay_empty(none):
    assert neardup.near_duplicates(none, 2).count() == 0
    assert neardup.keep_one(none).count() == 0
    assert substrings.digests(none).count() == 0
    assert substrings.remove(none).count() == 0
    assert linededup.clean_documents(none).count() == 0


def test_components_of_a_star_and_a_path(spark):
    edges = [(i, 1000) for i in range(300)] + [(2000 + i, 2001 + i) for i in range(40)]
    got = {r.node: r.comp for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in [*range(300), 1000]}, **{2000 + i: 2000 for i in range(41)}}


def test_components_of_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("width", [35, 8, 3])
def test_substrings_are_those_of_brute_force(odd, documents, width):
    for df in (odd.select("doc_id", "text"), documents.select("doc_id", "text")):
        rows = [tuple(r) for r in df.collect()]
        got = sorted((tuple(r) for r in substrings.digests(df, width).collect()), key=sort_key)
        assert got == sorted(brute.substring_rows(rows, width), key=sort_key)


def test_full_filters_give_the_same(odd, monkeypatch):
    from duskline.llm import common

    monkeypatch.setattr(common, "MOST_BITS", 15)
    monkeypatch.setattr(common.Bitmap, "holds", lambda self, hashes: np.ones(len(hashes), bool))
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in substrings.digests(odd, 35).collect()), key=sort_key)
    assert got == sorted(brute.substring_rows(rows, 35), key=sort_key)


def test_passages_in_other_surroundings_and_a_hot_one(spark, clashing, odd):
    """Passages cut short, one inside the other, twice in a row, and one in most documents (its key is split among tasks)."""
    rng = random.Random(9)
    long, short = sentence(rng, 120).split(), sentence(rng, 36).split()
    rows = []
    for i in range(700):
        own = sentence(rng, rng.randint(0, 12)).split()
        rows.append((i, " ".join(own + short + sentence(rng, 5).split())))
    for i in range(60):
        a = rng.randrange(60)
        rows.append((1000 + i, " ".join(sentence(rng, 10).split() + long[a : a + rng.randint(30, 60)] + sentence(rng, 10).split() + long[: 20 + i])))
    rows += [(2000, " ".join(short * 3)), (2001, "x " * 200), (2002, "x y " * 40), (2003, " ".join(long + long[::-1]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(tuple(r) for r in substrings.digests(df, 35).collect()) == sorted(brute.substring_rows(rows, 35))
    own = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in substrings.digests(clashing, 35).collect()), key=sort_key) == sorted(brute.substring_rows(own, 35), key=sort_key)


def test_rows_of_a_hot_key_are_spread(spark):
    from duskline.llm.common import settle, spread_join

    big = settle(spark.range(5000).selectExpr("id", "if(id < 3000, 7, id) as k").union(spark.sql("select 1L, cast(null as bigint)")))
    small = spark.range(0, 4000, 7).selectExpr("id as k", "id * 2 as v")
    for how in ("inner", "left"):
        rows = lambda df: Counter(tuple(r) for r in df.select("k", "id", "v").collect())
        assert rows(spread_join(big, small, ["k"], how)) == rows(big.join(small, "k", how))


def test_remove_cuts_passages_out_of_texts(odd, clashing):
    got = substrings.remove(clashing)
    assert got.columns == clashing.columns
    rows = [(r[0], r[1]) for r in odd.collect()]
    drops = brute.repeated([t for _, t in rows], 35)
    want = Counter((d, brute.without_repeats(t, drop)) for (d, t), drop in zip(rows, drops, strict=True))
    assert Counter((r[0], r[1]) for r in got.collect()) == want


def test_lines_are_dropped_by_their_share_of_a_host(spark):
    rows = [("h", f"menu\nown {i}\n menu \nrare {i % 7}") for i in range(20)] + [("h", None), (None, "menu"), (None, "menu"), (None, "menu"), ("other", "menu"), ("h", ""), ("tie", "x\ny"), ("tie", "x"), ("tie", "x")]
    df = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id long, text string, source string")
    got = [r.text for r in linededup.clean_documents(df).orderBy("doc_id").collect()]
    assert got == brute.line_dedup(rows, linededup.RATIO, linededup.LEAST_PAGES)
    assert got[0] == "own 0\nrare 0"


def test_lines_of_documents_like_brute_force(odd, clashing, documents):
    got = linededup.clean_documents(clashing)
    assert got.columns == clashing.columns
    for df in (odd, documents):
        rows = [(r.doc_id, r.source, r.text) for r in df.select("doc_id", "source", "text").collect()]
        want = Counter(zip([r[0] for r in rows], brute.line_dedup([r[1:] for r in rows], linededup.RATIO, linededup.LEAST_PAGES), strict=True))
        assert Counter((r.doc_id, r.text) for r in linededup.clean_documents(df).select("doc_id", "text").collect()) == want


def test_many_flagged_lines_are_joined(spark, monkeypatch):
    rows = [(i, f"menu\nown {i}\nx {i % 3}", "h") for i in range(60)] + [(100, None, "h"), (101, "menu", None), (102, "", "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = Counter(map(tuple, linededup.clean_documents(df).collect()))
    monkeypatch.setattr(linededup, "BROADCAST_ROWS", 0)
    assert Counter(map(tuple, linededup.clean_documents(df).collect())) == want and len(want) == 63


def test_pages_of_all_kinds(spark):
    """No pages, repeated pages, clashing columns, and a very long page."""
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert linededup.clean_pages(empty).count() == 0
    long = "<div>" + "".join(f"<p>line {i}</p>" for i in range(50_000)) + "<p>menu</p></div>"
    rows = [(1, "http://h/a", "<p>menu</p>own"), (1, "http://h/a", "<p>menu</p>own"), (2, "http://h/b", long), (3, "http://h/c", "<p>menu</p>"), (4, "http://g/c", "<p>menu</p>")]
    pages = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], "page_id long, url string, html string, host string, lines int, kept int, flagged int, n_lines int")
    got = sorted((r.page_id, r.host, r.n_lines, r.n_dropped) for r in linededup.clean_pages(pages).collect())
    assert got == [(1, "h", 2, 1), (1, "h", 2, 1), (2, "h", 50_001, 1), (3, "h", 1, 1), (4, "g", 1, 0)]


def test_hosts():
    from duskline.session import build_session

    spark = build_session()
    urls = {"https://User@Example.COM:80/a?b": "example.com", "http://a.b#c": "a.b", "no url": None, "": None, "ftp://x/": "x", None: None}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r[0]: r[1] for r in df.select("url", linededup.host_of(df.url)).collect()} == urls


def test_pages_without_html_or_host(spark):
    pages = spark.createDataFrame([(1, "http://h/1", "<p>a</p><script>x</script>b<!-- c --> "), (2, None, "<b>a"), (3, "http://h/2", None), (None, "http://h/3", "")], "page_id long, url string, html string")
    got = {r.page_id: (r.host, r.n_lines, r.n_dropped, r.text) for r in linededup.clean_pages(pages).collect()}
    assert got == {1: ("h", 2, 0, "a\nb"), 2: (None, 1, 0, "a"), 3: ("h", 0, 0, None), None: ("h", 0, 0, "")}


def test_chunks_hold_whole_documents():
    texts = pa.array(["a" * 10, None, "", "b" * 50, "c"])
    got = [(c.first, [c.text(i) for i in range(len(c))]) for c in chunks(texts, 12)]
    assert [t for _, own in got for t in own] == [b"a" * 10, b"", b"", b"b" * 50, b"c"]
    assert all(sum(map(len, own)) <= 12 or len(own) == 1 for _, own in got)


def test_the_odd_rows_hold_what_they_should():
    assert {None, ""} <= {t for _, t, _ in odd_rows()}
