"""Quality rules, licenses, toxicity, SentencePiece: row by row."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from duskline.llm import licenses, quality, queries, sentencepieces, toxicity
from duskline.llm.textbytes import chunks
from pyspark.sql import functions as F

from . import brute

public_tokenizers = pytest.importorskip("public_tokenizers")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def key(row):
    return tuple((x is None, x) for x in row)


def test_quality_counts_are_those_of_brute_force(odd, clashing, documents, none):
    for df in (odd, clashing, documents):
        got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(df).collect()), key=key)
        assert got == sorted(((r.doc_id, *brute.quality(r.text)) for r in df.select("doc_id", "text").collect()), key=key)
    assert quality.judge(none).count() == 0
    assert quality.keep(none).count() == 0


def test_the_order_of_rules_changes_no_verdict(documents):
    texts = pa.array([r.text for r in documents.collect()])
    want = quality.cascade(texts, quality.RULES)
    assert (quality.cascade(texts, quality.RULES[::-1]) == want).all()
    rules = {r.doc_id: r.kept for r in quality.judge(documents).collect()}
    assert {r.doc_id for r in quality.keep(documents).collect()} == {d for d, kept in rules.items() if kept}
    assert 0 < want.sum() < len(texts)


def test_rules_run_by_rejection_per_cost(spark):
    free = quality.Rule("free", lambda m: m.n_words < 1000)
    dear = quality.Rule("dear", lambda m: m.n_repeat_words < 0)
    df = spark.createDataFrame([(i, "word " * 50) for i in range(50)], "doc_id long, text string")
    assert quality.plan(df, [dear, free])[0] == "free"
    assert quality.plan(df.where("false"), [dear, free]) == ["dear", "free"]


def test_rules_see_survivors_only_in_their_measured_order(documents):
    """What each rule is asked: the documents that no rule before it rejected, and none that the base failed."""
    asked: dict[str, int] = {}

    def counting(rule):
        def rejects(m):
            asked[rule.name] = asked.get(rule.name, 0) + len(m.chunk)
            return rule.rejects(m)

        return quality.Rule(rule.name, rejects)

    texts = pa.array([r.text for r in documents.collect()])
    order = quality.ordered(quality.RULES, quality.plan(documents))
    kept = quality.cascade(texts, [counting(r) for r in order])
    left = np.ones(len(texts), bool)
    for rule in order:
        assert asked[rule.name] == left.sum(), rule.name
        left &= ~np.concatenate([rule.rejects(quality.Measure(c)) for c in chunks(texts)])
    assert (kept == left).all() and left.sum() < len(left)


def test_a_measure_of_fewer_documents_counts_alike(odd):
    texts = pa.array([r.text for r in odd.collect()])
    for chunk in chunks(texts):
        whole = quality.Measure(chunk)
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutters", "n_upper", "n_letters")
        _ = whole.hashes, whole.n_lines
        stay = np.arange(len(chunk)) % 3 != 1
        part = whole.take(stay)
        for n in names:
            assert (getattr(part, n) == getattr(quality.Measure(chunk), n)[stay]).all(), n


def test_kept_rows_keep_their_columns(clashing):
    got = quality.keep(clashing)
    assert got.columns == clashing.columns
    want = {r.doc_id for r in quality.judge(clashing).where("kept").collect()}
    assert {r.doc_id for r in got.collect()} == want


def test_license_places_are_those_of_brute_force(odd, clashing, documents, none):
    for df in (odd, clashing, documents):
        rows = licenses.scan(df).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=key)
        assert got == sorted(((r.doc_id, *brute.license_base(r.text)) for r in df.select("doc_id", "text").collect()), key=key)
        for r in rows:
            assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r["labels"].split(","))) and 0 <= r.score <= 1
    assert licenses.scan(none).count() == 0


def test_license_labels_and_scores_are_those_of_brute_force(spark, odd, documents):
    rng = random.Random(7)
    prose = [f"{a}{b}" for a in ("ba", "de", "ko", "lu") for b in ("ren", "sal", "tok")] + ["the", "license", "software", "of"]
    filler = lambda n: [rng.choice(prose) for _ in range(n)]
    rows = []
    for i, (_, text, _) in enumerate(licenses.TEMPLATES):
        w = licenses.words_of(text)
        changed = [rng.choice(prose) if rng.random() < 0.2 else x for x in w]
        cut = rng.randrange(len(w))
        for j, own in enumerate((w, changed, w[cut:], w[:cut], w[:cut] + filler(2) + w[cut:], w[::-1], w + w)):
            rows.append((10 * i + j, " ".join(filler(rng.randint(0, 30)) + own + filler(rng.randint(0, 30)))))
    planted = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for df in (planted, odd.where("doc_id is not null"), documents):
        own = df.select("doc_id", "text").collect()
        want = brute.license_scan([r.text for r in own], licenses.TEMPLATES, licenses.PHRASES, licenses.ANCHORS, licenses.MIN_SCORE)
        got = Counter((r.doc_id, r["labels"], round(r.score, 9)) for r in licenses.scan(df).collect())
        assert got == Counter((r.doc_id, x, round(y, 9)) for r, (x, y) in zip(own, want, strict=True))


def test_licenses_are_found_by_template_and_key_phrase(spark):
    _, text, phrase = next(t for t in licenses.TEMPLATES if t[0] == "bsd")
    filler = " ".join(f"w{i}" for i in range(40))
    rows = [(1, f"{filler} {text} {filler}"), (2, f"{filler} {' '.join(reversed(text.split()))}"), (3, text.replace(phrase, "redistribution or use in any forms")), (4, filler), (5, text.upper().replace(" ", ",\n"))]
    got = {r.doc_id: r["labels"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "bsd", 2: "", 3: "", 4: "", 5: "bsd"}


def test_whole_texts_have_their_own_labels():
    """Each text scores highest for its own template."""
    vocabulary = licenses.Vocabulary(licenses.TEMPLATES, licenses.PHRASES)
    scanner = licenses.Scanner(licenses.TEMPLATES, licenses.PHRASES, vocabulary, 1000, np.ones(len(vocabulary.words), np.int64))
    for label, text, _ in licenses.TEMPLATES:
        numbers = vocabulary.phrase(text)
        found = scanner.matches(numbers, np.zeros(len(numbers), np.int64), np.array([0, len(numbers)]))
        assert (label, 1.0) in {(x, round(share, 9)) for _, x, share in found}


def test_pieces_are_those_of_the_library(odd, clashing, documents, none):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for df in (odd, clashing, documents):
        texts = df.select("doc_id", "text").collect()
        want = []
        for r in texts:
            ids = own.encode(r.text or "")
            want.append((r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(own.decode(ids).encode()).hexdigest()))
        assert sorted((tuple(r) for r in sentencepieces.digests(df, MODEL).collect()), key=key) == sorted(want, key=key)
    assert sentencepieces.digests(none, MODEL).count() == 0


def test_pieces_of_hard_texts():
    import sentencepiece

    own, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepieces.Model(MODEL)
    rng = random.Random(1)
    texts = ["", " ", "  a", "a  ", "▁", "▁▁ ▁", "a▁b", "\n\t\r", "aaaaaaaaaaaaaaaa", "ababababab", "the the  the", "  ", "é", "\U0001f468‍\U0001f469", "<s></s><unk><0x41>", "\x00\x01", "日本語テキスト", "!!!!!!!!", "퟿"]
    texts += ["".join(rng.choice("ab th eé▁ \n日\U0001f600") for _ in range(rng.randint(1, 40))) for _ in range(300)]
    for t, ids in zip(texts, model.encode(texts), strict=True):
        assert ids.tolist() == own.encode(t), repr(t)
        assert model.decode_bytes(ids).decode() == own.decode(ids.tolist()), repr(t)


def test_one_very_long_word_is_encoded_as_the_library_does():
    """A word without any space; rounds are at most the distinct ranks of its pairs, whatever its length."""
    import sentencepiece

    own, model = sentencepiece.SentencePieceProcessor(model_file=MODEL), sentencepieces.Model(MODEL)
    rng = random.Random(12)
    for t in ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8000)), "ab" * 5000, "\U0001f600" * 2000):
        (ids,) = model.encode([t])
        assert ids.tolist() == own.encode(t) and model.decode_bytes(ids).decode() == own.decode(ids.tolist())


def test_encode_and_decode_columns(clashing):
    encoded = sentencepieces.encode(clashing, MODEL)
    assert encoded.columns == [*clashing.columns, "ids"]
    back = sentencepieces.decode(encoded, MODEL)
    assert Counter((r.decoded, r.text or "") for r in back.collect()).keys() <= {(t, t) for t in {r.text or "" for r in clashing.collect()}}


@pytest.mark.parametrize("stem", [False, True])
def test_the_automaton_knows_edit_distance(stem):
    rng = random.Random(2)
    entries = [("idiot", False), ("worthless", False), ("scum", False), ("pathetic", stem), ("lowe", True)]
    automaton = toxicity.Automaton(entries)
    words = [e for e, _ in entries]
    for e, _ in entries:
        for _ in range(300):
            w = list(e)
            for _ in range(rng.randint(0, 3)):
                kind, at = rng.randint(0, 2), rng.randrange(len(w) or 1)
                if kind == 0 and w:
                    w[at] = rng.choice("abcdeilmoprstwz")
                elif kind == 1 and len(w) > 1:
                    del w[at]
                else:
                    w.insert(at, rng.choice("abcdeilmoprstwz"))
            words.append("".join(w))
    text = " ".join(words)
    hits = toxicity.find_hits(automaton, words)
    got = {d: p for d, p in zip(hits.doc.tolist(), hits.payload.tolist(), strict=True)}
    assert text
    for i, w in enumerate(words):
        exact = [2 * e for e, (x, is_stem) in enumerate(entries) if w == x or (is_stem and w.startswith(x))]
        near = [2 * e + 1 for e, (x, _) in enumerate(entries) if w[:1] == x[:1] and 0 < brute.levenshtein(w, x) <= automaton.allowed(e)]
        if exact:
            assert got[i] in exact, w
        elif near:
            assert got[i] in near, w
        else:
            assert i not in got, w


def test_swapped_neighbours_are_one_error():
    rng = random.Random(3)
    entries = [("idiot", False), ("idiom", False), ("worthless", False), ("scum", False), ("moron", False), ("stupid", False)]
    automaton = toxicity.Automaton(entries, swaps=True)
    words = []
    for e, _ in entries:
        for _ in range(400):
            w = list(e)
            for _ in range(rng.randint(1, 3)):
                kind, at = rng.randint(0, 3), rng.randrange(len(w) - 1)
                if kind == 0:
                    w[at] = rng.choice("abcdeilmoprstwz")
                elif kind == 1 and len(w) > 2:
                    del w[at]
                elif kind == 2:
                    w.insert(at, rng.choice("abcdeilmoprstwz"))
                else:
                    w[at], w[at + 1] = w[at + 1], w[at]
            words.append("".join(w))
    hits = toxicity.find_hits(automaton, words)
    got = dict(zip(hits.doc.tolist(), hits.payload.tolist(), strict=True))
    assert len(got) > 500
    for i, w in enumerate(words):
        near = [2 * e + (w != x) for e, (x, _) in enumerate(entries) if w[:1] == x[:1] and brute.swap_distance(w, x) <= automaton.allowed(e)]
        assert got[i] in near if near else i not in got, w


def test_each_misspelling_is_found_in_a_text_of_its_own(spark):
    docs, labels = _corpus(spark)
    lexicon = toxicity.fit(docs, labels)
    texts = ["bavin you idoit kosal", "bavin you idot kosal", "bavin you idiiot kosal", "bavin you idxot kosal", "bavin you mroon kosal", "bavin you wortless kosal", "bavin you ahpteteic kosal"]
    extra = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(extra, lexicon).collect()}
    assert all(score[i] >= 0.7 for i in range(6)), score
    assert score[6] < 0.2


def test_words_stay_beside_their_stem(spark):
    rows = [(f, t, 0) for f, t in (("^idio", 120), ("idiot", 60), ("idiocy", 60))] + [("", 300, 1000)]
    entries, _, _ = toxicity._markers(spark.createDataFrame(rows, "feature string, toxic long, clean long"))
    assert entries == [("idio", True), ("idiocy", False), ("idiot", False)]
    hits = toxicity.find_hits(toxicity.Automaton(entries, swaps=True), ["idiots", "idoit", "idiot", "idoicy"])
    assert dict(zip(hits.doc.tolist(), hits.payload.tolist(), strict=True)) == {0: 0, 1: 5, 2: 4, 3: 3}


def _corpus(spark):
    """Toxic texts of four insults, clean ones of the same prose, some held out."""
    rng = random.Random(4)
    prose = [f"{a}{b}" for a in ("ba", "de", "ko", "lu", "mi", "ra", "so", "ti") for b in ("ren", "sal", "tok", "vin", "wex", "yum")]
    bad = ["idiot", "worthless", "pathetic", "moron"]
    rows, labels = [], []
    for i in range(900):
        w = [rng.choice(prose) for _ in range(40)]
        toxic = i % 4 == 0
        if toxic:
            for at in rng.sample(range(40), 2):
                w[at] = rng.choice(bad)
        rows.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_of_rows_that_were_held_out(spark):
    docs, labels = _corpus(spark)
    lexicon = toxicity.fit(docs, labels)
    assert {t for t, _ in lexicon.entries} == {"idiot", "worthless", "pathetic", "moron"}
    got = toxicity.score(docs, lexicon).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 200 and all(r.predicted == r.toxic for r in got)
    assert all((r.predicted == 1) == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    extra = spark.createDataFrame([(1, "bavin you are an idoit and wortless basal"), (2, 'bavin they said "idiot" once'), (3, "bavin kosal"), (4, None), (5, ""), (None, "IDIOT!!")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(extra, lexicon).collect()}
    assert score[1] >= 0.7 and score[None] >= 0.7
    assert score[2] < 0.7 and score[3] == score[4] == score[5] < 0.2


def test_scores_are_those_of_brute_force(spark, odd, clashing):
    """Exact words, stems, misspellings, quotations within and across lines, ties, nulls, and a very long text."""
    rng = random.Random(10)
    entries = [("idio", True), ("idiocy", False), ("idiot", False), ("moron", False), ("worthless", False), ("scum", False), ("pathetic", False)]
    lexicon = toxicity.Lexicon(entries, [0.9, 0.97, 0.99, 0.8, 0.95, 0.9, 0.85], {n: 0.6 + n / 40 for n in (4, 5, 6, 8, 9)}, {False: 0.97, True: 0.3}, 0.04)
    prose = ["the", "a", "said", "bavin", "KOSAL", "naïve", "x_y", "idea"]

    def word():
        if rng.random() < 0.6:
            return rng.choice(prose)
        w = list(rng.choice(entries)[0] + rng.choice(["", "", "s", "ic"]))
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(w) - 1)
            kind = rng.randint(0, 3)
            if kind == 0:
                w[at], w[at + 1] = w[at + 1], w[at]
            elif kind == 1:
                del w[at]
            elif kind == 2:
                w.insert(at, rng.choice("eiost"))
        return rng.choice([str.lower, str.upper, str.title])("".join(w))

    def text(n):
        return "".join(rng.choice(['"', "“", "”", ""]) * (rng.random() < 0.3) + word() + rng.choice([" ", ", ", "\n", '" ', " "]) for _ in range(n))

    texts = [text(rng.randint(1, 40)) for _ in range(400)] + [text(30_000), None, "", "\n", '"idiot"', "idiot idiot idiots"]
    rows = list(enumerate(texts))
    want = {i: brute.toxic_score(t, lexicon, (toxicity.FUZZY, toxicity.VERY_FUZZY), toxicity.WINDOW, toxicity._QUOTES) for i, t in rows}
    got = toxicity.score(spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, predicted int").repartition(3), lexicon).collect()
    assert len(got) == len(rows) and len({round(x, 6) for x in want.values()}) > 30
    for r in got:
        assert abs(r.score - want[r.doc_id]) < 1e-9, texts[r.doc_id]
        assert r.predicted == int(r.score >= toxicity.THRESHOLD)
    tie = toxicity.Lexicon([], without=toxicity.THRESHOLD)
    assert {r.predicted for r in toxicity.score(clashing, tie).collect()} == {int(1 / (1 + math.exp(-math.log(0.7 / 0.3))) >= 0.7)}
    again = odd.selectExpr("1L as doc_id", "text")
    assert len(toxicity.score(again, lexicon).collect()) == odd.count()


def test_held_out_rows_teach_nothing(spark):
    docs, labels = _corpus(spark)
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, flipped)
    assert a == b


def test_toxicity_without_labels_or_rows(odd, clashing, none, spark):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.fit(odd, empty)
    got = toxicity.score(clashing, lexicon).collect()
    assert len(got) == odd.count() and len({r.score for r in got}) == 1
    assert toxicity.score(none, lexicon).count() == 0
    one = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    assert toxicity.score(odd, toxicity.fit(odd, one)).count() == odd.count()


def test_held_out_flag(spark, small):
    import zlib

    for r in queries.op4_toxicity(spark, small).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
