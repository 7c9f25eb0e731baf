"""Toxicity scores from a learned lexicon, matched by a Levenshtein automaton over its trie.

Fit. From labelled rows that are not held out (a share of them that holds about FIT_ROWS rows, chosen by a hash of the
id), words and word stems that mark label 1 are learned: those whose documents are toxic so much more often than
others that chance, over all candidates, does not explain it. Then the lexicon is matched against the same rows, and what a hit is
worth is counted for each entry, for misspelt hits by length, and for hits inside and outside quotations.

Match. The entries form a trie; its product with the Levenshtein automaton (0 errors for short entries and stems, 1 from
FUZZY letters, 2 from VERY_FUZZY; two neighbours swapped are one error) is made deterministic state by state as texts need it, and all words of a chunk run
through it in step, letter by letter; most die within a few letters. A misspelt word counts only if its first letter is
the entry's own.

Context. A hit is quoted if quotation marks open before and close after it within WINDOW words of its line. Hits in and
outside quotations have their own odds, learned from the same rows over a prior under which a quotation is no abuse.
A score is the logistic of the odds of a document without hits plus the weight of each entry's best hit; a stem and its
words count as one entry.

Words are runs of letters and digits, lower-cased. Texts that are null or empty have no hits, and get the score of such a document.
Repeated rows are scored each for itself; rows with a null id count as not held out and are never fitted. Without
labels, or without any of label 1, every score is the prior. If an id has several labels, 1 wins.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, column, settle
from .neardup import shingle_sets
from .textbytes import chunks, mix

#: Labelled rows that the lexicon is fitted on, about; everything else covers all rows.
FIT_ROWS = 40_000
HASH_RANGE = 1 << 20
FUZZY, VERY_FUZZY = 5, 9
STEMS = (4, 5, 6)
WINDOW = 12
THRESHOLD = 0.7
#: A word marks label 1 if chance gives it with less than exp(-MARGIN), all candidates taken together.
MARGIN = 1.5
#: A stem is dropped for a word that makes up this share of its documents.
MOST_OF_STEM = 0.7
LEAST_PURITY = 0.75
#: Prior shares of toxic documents among those with a hit, and their weight in documents.
PRIOR = {"misspelt": (0.8, 1.25), "plain": (0.95, 4.0), "quoted": (0.25, 8.0)}
COPY_KEYS, COPY_WORDS = 8, 5
_COPY_SEEDS = mix(np.arange(1, COPY_KEYS + 1, dtype=np.uint64))
MOST_STATES = 60_000
CHUNK_CHARS = 1 << 20
_QUOTES = "\"“”„«»‟"
_PRIOR_SCORE = 0.05


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _logit(p: float) -> float:
    return math.log(p / (1 - p))


@dataclass
class Lexicon:
    """Entries (text, whether it is a stem), the odds of their hits, and of a document without any."""

    entries: list[tuple[str, bool]]
    exact: list[float] = field(default_factory=list)
    misspelt: dict[int, float] = field(default_factory=dict)
    context: dict[bool, float] = field(default_factory=dict)
    without: float = _PRIOR_SCORE


class Automaton:
    """The product of a trie and the Levenshtein automata of its entries, determinised where words lead.

    With `swaps`, two neighbouring letters that change places are one error, else two.
    A state is a set of (trie node, errors so far); a negative node waits for the second of two letters that are
    swapped, the earlier one of the entry, and is left by no other. Its payload is the entry that a word ending there stands
    for, with the fewest errors: 2 * entry + (errors > 0), or -1.
    """

    def __init__(self, entries: list[tuple[str, bool]], swaps: bool = False):
        self.entries, self.swaps = entries, swaps
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]
        self.reach: list[int] = [0]  # errors that some entry below a node allows
        self.before: list[str] = [""]  # the last letter but one on the way to a node
        for e, (text, stem) in enumerate(entries):
            node = 0
            allowed, previous = self.allowed(e), ""
            self.reach[0] = max(self.reach[0], allowed)
            for c in text:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append([])
                    self.reach.append(0)
                    self.before.append(previous)
                node, previous = self.children[node][c], c
                self.reach[node] = max(self.reach[node], allowed)
            self.ends[node].append(e)
        letters = sorted({c for text, _ in entries for c in text})
        self.classes = {c: i + 2 for i, c in enumerate(letters)}  # 0: no letter, 1: a letter of no entry
        self.letters = [None, None, *letters]
        self.class_of = np.full(0x110000, -1, np.int16)
        self._clear()

    def allowed(self, entry: int) -> int:
        text, stem = self.entries[entry]
        return 0 if stem or len(text) < FUZZY else 1 if len(text) < VERY_FUZZY else 2

    def _clear(self) -> None:
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.table = np.full((1024, len(self.letters)), -1, np.int32)
        self.payload = np.full(1024, -1, np.int32)
        self.sticky = np.full(1024, -1, np.int32)
        self._number(frozenset())  # 0: dead
        self.start = self._number(frozenset([(0, 0)]))

    def _closed(self, found: dict[int, int]) -> frozenset:
        """With the states that skipping letters of entries leads to; of one node only the fewest errors."""
        todo = list(found.items())
        while todo:
            node, e = todo.pop()
            if node <= 0 or found.get(node, 99) < e:
                continue
            for child in self.children[node].values():
                if e + 1 <= self.reach[child] and found.get(child, 99) > e + 1:
                    found[child] = e + 1
                    todo.append((child, e + 1))
        return frozenset(found.items())

    def _number(self, state: frozenset) -> int:
        if state not in self.numbers:
            n = self.numbers[state] = len(self.sets)
            self.sets.append(state)
            if n == len(self.table):
                for name in ("table", "payload", "sticky"):
                    old = getattr(self, name)
                    setattr(self, name, np.concatenate([old, np.full_like(old, -1)]))
            best = min(((err, e) for node, err in state if node > 0 for e in self.ends[node] if err <= self.allowed(e)), default=None)
            self.payload[n] = -1 if best is None else 2 * best[1] + (best[0] > 0)
            stem = min((e for node, err in state if not err for e in self.ends[node] if self.entries[e][1]), default=None)
            self.sticky[n] = -1 if stem is None else 2 * stem
        return self.numbers[state]

    def _step(self, state: int, letter: int) -> int:
        c = self.letters[letter]
        found: dict[int, int] = {}
        for node, err in self.sets[state]:
            if node < 0:
                if self.before[-node] == c and found.get(-node, 99) > err:
                    found[-node] = err
                continue
            for x, child in self.children[node].items():
                e = err if x == c else err + 1
                if node == 0 and e:  # the first letter is never misspelt
                    continue
                if e <= self.reach[child] and found.get(child, 99) > e:
                    found[child] = e
                if self.swaps and node and x != c and (swapped := self.children[child].get(c)) and err + 1 <= self.reach[swapped] and found.get(-swapped, 99) > err + 1:
                    found[-swapped] = err + 1
            if node and err + 1 <= self.reach[node] and found.get(node, 99) > err + 1:
                found[node] = err + 1
        return self._number(self._closed(found))

    def run(self, classes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The payload of each word classes[start:end]."""
        if len(self.sets) > MOST_STATES:
            self._clear()
        out = np.full(len(start), -1, np.int32)
        word, at, state = np.arange(len(start)), start.copy(), np.full(len(start), self.start, np.int32)
        while len(word):
            letter = classes[at]
            new = self.table[state, letter]
            missing = np.flatnonzero(new < 0)
            if len(missing):
                pairs = np.unique(state[missing].astype(np.int64) * len(self.letters) + letter[missing])
                for p in pairs.tolist():
                    s, x = divmod(p, len(self.letters))
                    made = self._step(s, x)
                    self.table[s, x] = made
                new = self.table[state, letter]
            at = at + 1
            stuck = self.sticky[new] >= 0
            fresh = stuck & (out[word] < 0)
            out[word[fresh]] = self.sticky[new[fresh]]
            done = at == end[word]
            final = done & (self.payload[new] >= 0)
            # An exact entry stands before a stem, a stem before a misspelt one.
            was, now = out[word[final]], self.payload[new[final]]
            out[word[final]] = np.where((was < 0) | (now % 2 == 0), now, was)
            on = ~done & (new > 0)
            word, at, state = word[on], at[on], new[on]
        return out

    def classify(self, points: np.ndarray) -> np.ndarray:
        made = self.class_of[points]
        if (made < 0).any():
            for c in np.unique(points[made < 0]).tolist():
                self.class_of[c] = self.classes.get(chr(c), int(chr(c).isalnum()))
            made = self.class_of[points]
        return made


@dataclass
class Hits:
    doc: np.ndarray
    payload: np.ndarray
    quoted: np.ndarray


def find_hits(automaton: Automaton, texts: list[str | None]) -> Hits:
    """All hits in these texts. doc: which text."""
    lowered = [t.lower() if t else "" for t in texts]
    points = np.frombuffer(("\n".join(lowered) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    classes = automaton.classify(points)
    inside = classes > 0
    begins = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    ends = np.flatnonzero(inside & ~np.concatenate([inside[1:], [False]])) + 1
    payload = automaton.run(classes, begins, ends)
    hit = np.flatnonzero(payload >= 0)
    doc = np.searchsorted(first, begins[hit], "right") - 1
    quoted = np.zeros(len(hit), bool)
    if len(hit):
        marks = np.flatnonzero(np.isin(points, [ord(c) for c in _QUOTES]))
        if len(marks):
            lines = np.flatnonzero(points == 10)
            line_start = np.concatenate([[0], lines + 1])[np.searchsorted(lines, begins[hit])]
            line_end = lines[np.searchsorted(lines, begins[hit])]
            before = np.searchsorted(marks, begins[hit])
            odd = (before - np.searchsorted(marks, line_start)) % 2 == 1
            closes = (before < len(marks)) & (marks[np.minimum(before, len(marks) - 1)] < line_end)
            near = np.minimum(before, len(marks) - 1)
            opened = np.searchsorted(begins, marks[np.maximum(before - 1, 0)])
            closed = np.searchsorted(begins, marks[near])
            quoted = odd & closes & (hit - opened <= WINDOW) & (closed - hit <= WINDOW)
    return Hits(doc, payload[hit], quoted)


def text_chunks(texts: pa.Array, limit: int = CHUNK_CHARS) -> Iterator[tuple[int, list[str | None]]]:
    """First index and texts of pieces of a string array with about `limit` characters, or one text each."""
    at, size, own = 0, 0, []
    for i in range(len(texts)):
        t = texts[i].as_py()
        if own and size + len(t or "") > limit:
            yield at, own
            at, size, own = i, 0, []
        own.append(t)
        size += len(t or "")
    if own:
        yield at, own


def _training(documents: DataFrame, labels: DataFrame, fit_rows: int) -> DataFrame:
    """text, toxic of about fit_rows labelled rows that are not held out, without their near copies.

    Of documents that agree in one of COPY_KEYS least shingle hashes only one stays: else every word of a text that was
    copied often would look like a marker of its label.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).select(F.col("doc_id").cast("long").alias("l_id"), F.expr("int(toxic != 0)").alias("toxic"))
    known = known.where(~held_out(F.col("l_id"))).groupBy("l_id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, fit_rows / max(1, known.count()))
    known = settle(known.where(F.pmod(F.xxhash64("l_id"), F.lit(HASH_RANGE)) < int(share * HASH_RANGE)))
    if known.count() <= BROADCAST_ROWS:  # as long as fit_rows is: then the documents stay where they are
        known = F.broadcast(known)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(known, F.col("doc_id") == F.col("l_id"))
    rows = settle(rows.select(F.xxhash64("doc_id", "text").alias("row"), "text", "toxic"))

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                value, doc = shingle_sets(chunk, COPY_WORDS)
                has, first = np.unique(doc, return_index=True)
                if not len(has):
                    continue
                keys = [mix(np.minimum.reduceat(mix(value ^ seed), first) + seed) for seed in _COPY_SEEDS]
                row = batch.column(0).take(pa.array(has + chunk.first))
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([row] * len(keys)), pa.array(np.concatenate(keys).view(np.int64))], ["row", "key"])

    keyed = rows.mapInArrow(on_batches, "row long, key long")
    least = keyed.groupBy("key").agg(F.min("row").alias("least"))
    copies = keyed.join(least, "key").where("row != least").select("row").distinct()
    return rows.join(copies, "row", "left_anti").select("text", "toxic")


_WORD = re.compile(r"[^\W_]+")


def _candidates(text: str) -> set[str]:
    """Words of a text, and its stems with a leading '^'."""
    words = set(_WORD.findall(text.lower()))
    out = {w for w in words if len(w) > 2}
    for n in STEMS:
        out |= {"^" + w[:n] for w in words if len(w) > n}
    return out


def _counts(rows: DataFrame) -> DataFrame:
    """feature, toxic, clean: documents of each label that hold a feature. '' counts documents."""

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(counts[0].keys() | counts[1].keys())
            made = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *[pa.array([c[k] for k in keys], pa.int64()) for c in (counts[1], counts[0])]], ["feature", "toxic", "clean"])
            for c in counts:
                c.clear()
            return made

        for batch in batches:
            for t, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[label].update({""} | _candidates(t.as_py() or ""))
                if len(counts[0]) + len(counts[1]) > 400_000:
                    yield flush()
        yield flush()

    return rows.mapInArrow(on_batches, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _markers(counted: DataFrame) -> tuple[list[tuple[str, bool]], int, int]:
    """Entries that mark label 1, and how many documents of either label were counted."""
    counted = counted.where("toxic > 1 or feature = ''").persist()
    try:
        whole = counted.where("feature = ''").first()
        toxic, clean = (whole.toxic, whole.clean) if whole else (0, 0)
        if not toxic or not clean:
            return [], toxic, clean
        rate = toxic / (toxic + clean)
        kind = F.when(F.col("feature").startswith("^"), F.length("feature")).otherwise(0)
        tests = {r.kind: r["count"] for r in counted.groupBy(kind.alias("kind")).count().collect()}
        n = F.col("toxic") + F.col("clean")
        purity = F.col("toxic") / n
        # Chernoff bound of a share this high among n documents drawn at `rate`, against the number of candidates of the kind.
        surprise = n * (purity * F.log(purity / rate) + F.when(purity < 1, (1 - purity) * F.log((1 - purity) / (1 - rate))).otherwise(0))
        needed = F.coalesce(*[F.when(kind == k, math.log(c) + MARGIN) for k, c in tests.items()])
        least = max(LEAST_PURITY, rate + 0.5 * (1 - rate))
        chosen = counted.where("feature != ''").where((purity > least) & (surprise > needed))
        found = {r.feature: r.toxic for r in chosen.collect()}  # at most the words of the fitted rows over the least support
    finally:
        counted.unpersist()
    words = {f: n for f, n in found.items() if f[0] != "^"}
    stems: set[str] = set()
    for f in sorted((f for f in found if f[0] == "^"), key=len):
        stem = f[1:]
        # A stem stands for many forms: one that is nearly always the same word is that word.
        if not any(stem[:n] in stems for n in STEMS) and not any(w.startswith(stem) and n >= MOST_OF_STEM * found[f] for w, n in words.items()):
            stems.add(stem)
    # A word stays beside its stem, which allows no errors.
    return [(s, True) for s in sorted(stems)] + [(w, False) for w in sorted(words)], toxic, clean


def _hit_counts(rows: DataFrame, entries: list[tuple[str, bool]]) -> dict[tuple[int, bool], list[int]]:
    """(2 * entry + misspelt, quoted) -> documents of label 0 and 1 with such a hit; (-1, False): without any."""

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(entries, swaps=True)
        counts: Counter = Counter()
        for batch in batches:
            labels = np.asarray(batch.column(1))
            for first, texts in text_chunks(batch.column(0)):
                hits = find_hits(automaton, texts)
                key = np.unique(np.stack([hits.doc, hits.payload, hits.quoted], 1), axis=0) if len(hits.doc) else np.zeros((0, 3), np.int64)
                counts.update((p, q, int(labels[first + d])) for d, p, q in key.tolist())
                for d in np.setdiff1d(np.arange(len(texts)), hits.doc).tolist():
                    counts[-1, 0, int(labels[first + d])] += 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([k[2] for k in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], ["payload", "quoted", "label", "n"])

    counted = rows.mapInArrow(on_batches, "payload int, quoted int, label int, n long").groupBy("payload", "quoted", "label").agg(F.sum("n").alias("n"))
    out: dict[tuple[int, bool], list[int]] = {}
    for r in counted.collect():  # a few rows an entry
        out.setdefault((r.payload, bool(r.quoted)), [0, 0])[r.label] = r.n
    return out


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Lexicon:
    """Learn a lexicon from documents (doc_id, text) and labels (doc_id, toxic)."""
    rows = _training(documents, labels, fit_rows).persist()
    try:
        entries, toxic, clean = _markers(_counts(rows))
        lexicon = Lexicon(entries)
        found = _hit_counts(rows, entries) if entries else {(-1, False): [clean, toxic]}
    finally:
        rows.unpersist()

    def share(counts: list[list[int]], prior: tuple[float, float]) -> float:
        p, weight = prior
        no, yes = (sum(c[i] for c in counts) for i in (0, 1))
        return (yes + p * weight) / (no + yes + weight)

    no, yes = found.get((-1, False), [0, 0])
    lexicon.without = (yes + _PRIOR_SCORE * 20) / (no + yes + 20)
    for e in range(len(entries)):
        lexicon.exact.append(share([c for (p, _), c in found.items() if p == 2 * e], PRIOR["plain"]))
    for n in {len(text) for text, _ in entries}:
        lexicon.misspelt[n] = share([c for (p, _), c in found.items() if p >= 0 and p % 2 and len(entries[p // 2][0]) == n], PRIOR["misspelt"])
    for quoted, name in ((False, "plain"), (True, "quoted")):
        lexicon.context[quoted] = share([c for (p, q), c in found.items() if p >= 0 and p % 2 == 0 and q == quoted], PRIOR[name])
    return lexicon


class Scorer:
    """Scores texts by a lexicon."""

    def __init__(self, lexicon: Lexicon):
        self.lexicon, self.automaton = lexicon, Automaton(lexicon.entries, swaps=True)
        base = _logit(lexicon.without)
        self.base = base
        n = len(lexicon.entries)
        stems = {text: e for e, (text, stem) in enumerate(lexicon.entries) if stem}
        self.family = np.array([next((stems[text[:k]] for k in STEMS if text[:k] in stems), e) for e, (text, _) in enumerate(lexicon.entries)], np.int64)
        self.weight = np.zeros((2 * n + 1, 2))
        for e, (text, _) in enumerate(lexicon.entries):
            for miss, p in ((0, lexicon.exact[e]), (1, min(lexicon.exact[e], lexicon.misspelt[len(text)]))):
                for quoted in (0, 1):
                    context = lexicon.context[bool(quoted)] if quoted else 1.0
                    self.weight[2 * e + miss, quoted] = max(0.0, _logit(min(p, context, 0.995)) - base)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        total = np.full(len(texts), self.base)
        if self.lexicon.entries:
            hits = find_hits(self.automaton, texts)
            if len(hits.doc):
                n = len(self.lexicon.entries)
                key = hits.doc * n + self.family[hits.payload // 2]
                worth = self.weight[hits.payload, hits.quoted.astype(int)]
                order = np.lexsort((worth, key))
                last = np.append(key[order][1:] != key[order][:-1], True)  # the best hit of an entry, or of a stem and its words, in a document
                np.add.at(total, hits.doc[order[last]], worth[order[last]])
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def score(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of documents (doc_id, text)."""

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(lexicon)
        for batch in batches:
            texts = column(batch, "text")
            made = [scorer.scores(own) for _, own in text_chunks(texts)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), column(batch, "held_out"), pa.array(np.concatenate(made) if made else np.zeros(0))], ["doc_id", "held_out", "score"])

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    scored = rows.mapInArrow(on_batches, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
