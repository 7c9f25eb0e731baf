"""License scans with a positional index of rare template words.

Templates are licence texts and notices. Document frequencies of their words are counted over the whole corpus (one row
for each template word comes back: bounded by the templates), and the words of highest IDF of each template are entered
in the index: word -> (template, position). A file is scanned through it:

1. its licence words of highest IDF, those that the index holds, are looked up;
2. postings are intersected by relative position: place in the file minus position in the template. An offset at which at
   least half of a template's entries stand is a candidate;
3. the template's mandatory key phrase must stand in the file word by word;
4. the whole template is laid over the file at the offset: the score is the share of its IDF weight that stands in place, and
   the best offset counts (of equal ones the smallest). From MIN_SCORE on the file has the template's label.

Words: A-Z folded to a-z, then `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Base phrases are counted wherever their words stand
consecutively, overlapping places included. A null text is the empty one: no words, no labels, score 0. Repeated rows are scanned
each for itself. Words of equal IDF are entered in the order of their spelling.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column
from .licence_texts import TEMPLATES
from .textbytes import ALNUM_SPLIT, Chunk, Words, chunks, hash_bytes, spans, word_hashes

#: phrase -> label of the base
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Words of highest IDF of a template that are entered in the index, and the least share of its IDF weight that must stand in place.
ANCHORS = 8
MIN_SCORE = 0.5
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str) -> list[str]:
    """The words of a template or phrase."""
    return _WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text))


def _hash(word: str) -> int:
    return hash_bytes(word.encode(), True)


class Vocabulary:
    """The words of templates and phrases, numbered in the order of their hashes."""

    def __init__(self, templates: Sequence[tuple[str, str, str]], phrases: dict):
        texts = [t for _, *pair in templates for t in pair] + list(phrases)
        words = sorted({w for t in texts for w in words_of(t)}, key=_hash)
        self.words = words
        self.number = {w: i for i, w in enumerate(words)}
        self.hashes = np.array([_hash(w) for w in words], np.uint64)

    def numbers(self, hashed: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        at = np.minimum(np.searchsorted(self.hashes, hashed), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashed, at, -1)

    def phrase(self, text: str) -> np.ndarray:
        return np.array([self.number[w] for w in words_of(text)])


def places(numbers: np.ndarray, doc: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """First words of all places where the phrase's words stand consecutively in one document."""
    n, k = len(numbers), len(phrase)
    if n < k:
        return np.zeros(0, np.int64)
    hit = np.flatnonzero(numbers[: n - k + 1] == phrase[0])
    for j in range(1, k):
        hit = hit[numbers[hit + j] == phrase[j]]
    return hit[doc[hit] == doc[hit + k - 1]]


def document_frequencies(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> tuple[int, np.ndarray]:
    """Rows of df, and in how many of them each word of the vocabulary stands."""

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = 0, np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            total += batch.num_rows
            for chunk in chunks(batch.column(0)):
                words = spans(chunk, ALNUM_SPLIT)
                numbers = vocabulary.numbers(word_hashes(chunk, words, True))
                known = numbers >= 0
                pairs = np.unique(words.doc[known] * len(found) + numbers[known])
                found += np.bincount(pairs % len(found), minlength=len(found))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *np.flatnonzero(found)], pa.int64()), pa.array([total, *found[found > 0]], pa.int64())], ["number", "n"])

    counted = df.select(F.col(text).alias("text")).mapInArrow(on_batches, "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary.words), np.int64)
    total = 0
    for r in counted:
        if r.number < 0:
            total = r.n
        else:
            out[r.number] = r.n
    return total, out


class Scanner:
    """The positional index of the templates, ready to scan files."""

    def __init__(self, templates: Sequence[tuple[str, str, str]], phrases: dict, vocabulary: Vocabulary, total: int, frequency: np.ndarray):
        self.vocabulary = vocabulary
        self.idf = np.log((1 + total) / (1 + frequency)) + 1e-6
        self.phrases = [(vocabulary.phrase(p), label) for p, label in phrases.items()]
        self.templates = [(label, vocabulary.phrase(text), vocabulary.phrase(key)) for label, text, key in templates]
        self.weights = [float(self.idf[words].sum()) for _, words, _ in self.templates]
        entries = []
        self.entered = np.zeros(len(self.templates), np.int64)
        for t, (_, words, _) in enumerate(self.templates):
            rarest = sorted(set(words.tolist()), key=lambda w: (-self.idf[w], vocabulary.words[w]))[:ANCHORS]
            found = [(w, t, p) for p, w in enumerate(words.tolist()) if w in rarest]
            self.entered[t] = len(found)
            entries += found
        word, self.template, self.position = np.array(sorted(entries)).T
        self.first = np.searchsorted(word, np.arange(len(vocabulary.words) + 1))

    def candidates(self, numbers: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows (document, template, offset in the document) at which half of a template's entries or more stand, in that order."""
        known = np.flatnonzero(numbers >= 0)
        lo, n = self.first[numbers[known]], np.diff(self.first)[numbers[known]]
        place = np.repeat(known, n)
        at = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
        owner, template = doc[place], self.template[at]
        offset = place - first[owner] - self.position[at]
        order = np.lexsort((offset, template, owner))
        triples = np.stack([owner[order], template[order], offset[order]], axis=1)
        new = np.ones(len(triples), bool)
        new[1:] = (triples[1:] != triples[:-1]).any(axis=1)
        begins = np.flatnonzero(new)
        hits = np.diff(np.append(begins, len(triples)))
        triples = triples[begins]
        return triples[2 * hits >= self.entered[triples[:, 1]]]

    def matches(self, numbers: np.ndarray, doc: np.ndarray, first: np.ndarray) -> list[tuple[int, str, float]]:
        """(document, label, share of the template's weight in place) for each confirmed template."""
        best: dict[tuple[int, int], float] = {}
        keyed: dict[tuple[int, int], bool] = {}
        for d, t, offset in self.candidates(numbers, doc, first).tolist():
            _, words, key = self.templates[t]
            lo, hi = first[d], first[d + 1]
            if (d, t) not in keyed:
                keyed[d, t] = len(places(numbers[lo:hi], doc[lo:hi], key)) > 0
            if not keyed[d, t]:
                continue
            a, b = max(0, -offset), min(len(words), hi - lo - offset)
            own = words[a:b]
            share = float(self.idf[own[numbers[lo + offset + a : lo + offset + b] == own]].sum()) / self.weights[t]
            best[d, t] = max(best.get((d, t), 0.0), share)
        return [(d, self.templates[t][0], min(share, 1.0)) for (d, t), share in best.items() if share >= MIN_SCORE]

    def scan(self, chunk: Chunk) -> tuple[np.ndarray, ...]:
        """n_words, n_base, first, last (-1: none), and lists of base labels, labels and scores, by document."""
        n = len(chunk)
        words: Words = spans(chunk, ALNUM_SPLIT)
        numbers = self.vocabulary.numbers(word_hashes(chunk, words, True))
        n_base, first, last = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        base: list[set] = [set() for _ in range(n)]
        score = np.zeros(n)
        for phrase, label in self.phrases:
            at = places(numbers, words.doc, phrase)
            d = words.doc[at]
            n_base += np.bincount(d, minlength=n)
            local = at - words.first[d]
            np.minimum.at(first, d, local)
            np.maximum.at(last, d, local)
            for x in np.unique(d).tolist():
                base[x].add(label)
                score[x] = max(score[x], 0.5)
        labels = [set(b) for b in base]
        for d, label, share in self.matches(numbers, words.doc, words.first):
            labels[d].add(label)
            score[d] = max(score[d], share)
        return words.counts, n_base, first, last, base, labels, score


def scan(df: DataFrame, templates: Sequence[tuple[str, str, str]] = TEMPLATES, phrases: dict = PHRASES) -> DataFrame:
    """For each row of df (doc_id, text): word and phrase counts, labels of the base and of the method, a score.

    The score is the largest share of a template that stands in place, at least 0.5 where a base phrase stands.
    """
    vocabulary = Vocabulary(templates, phrases)
    scanner = Scanner(templates, phrases, vocabulary, *document_frequencies(df, vocabulary))

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc_id")
            for chunk in chunks(column(batch, "text")):
                n_words, n_base, first, last, base, labels, score = scanner.scan(chunk)
                none = n_base == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(chunk.first, len(chunk)),
                        pa.array(n_words, pa.int64()),
                        pa.array(n_base, pa.int64()),
                        pa.array(first, pa.int64(), mask=none),
                        pa.array(last, pa.int64(), mask=none),
                        pa.array([",".join(sorted(b)) for b in base], pa.string()),
                        pa.array([",".join(sorted(x)) for x in labels], pa.string()),
                        pa.array(score, pa.float64()),
                    ],
                    ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
                )

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(on_batches, schema)


