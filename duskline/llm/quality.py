"""Quality rules as a short-circuit cascade.

Every rule is measured on a bounded sample of all rows (seconds a row, share of rows it rejects), and
the rules then run in falling order of rejection per cost; a rule sees only the rows that all rules
before it let pass. The order changes the cost of a run and never its verdict, since a row is kept
if no rule at all rejects it.

Words are `[^\\x20\\x09-\\x0D]+`. A null text counts as the empty one (no words, so `too_short`
rejects it). Repeated rows are judged each for itself; other columns pass through untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, map_all_columns
from .textbytes import SPACE_SPLIT, Chunk, Words, chunks, covered, prefix_hash, range_hash, spans, sums, windows, word_hashes

REPEAT_WIDTH = 8
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_IS_TAIL = np.zeros(256, bool)
_IS_TAIL[0x80:0xC0] = True
_IS_UPPER = np.zeros(256, bool)
_IS_UPPER[0x41:0x5B] = True
_IS_LETTER = _IS_UPPER.copy()
_IS_LETTER[0x61:0x7B] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


class Measure:
    """Counts of the documents of one chunk, each made when first asked for."""

    def __init__(self, chunk: Chunk):
        self.chunk = chunk
        self._made: dict[str, object] = {}

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = getattr(type(self), f"_{name}")(self)
        return self._made[name]

    def take(self, stay: np.ndarray) -> Measure:
        """The measure of the documents that stay; what is counted is carried over, and words are not looked for again."""
        chunk, sizes = self.chunk, np.diff(self.chunk.offsets)
        own = np.repeat(stay, sizes)
        out = Measure(Chunk(chunk.first, chunk.data[own], np.concatenate([[0], np.cumsum(sizes[stay])]), chunk.null[stay]))
        for name, made in self._made.items():
            if name == "words":
                word = stay[made.doc]
                left_out = np.where(stay, 0, sizes)
                shift = (np.cumsum(left_out) - left_out)[made.doc[word]]
                out._made[name] = Words(made.start[word] - shift, made.end[word] - shift, (np.cumsum(stay) - 1)[made.doc[word]], np.concatenate([[0], np.cumsum(made.counts[stay])]))
            elif name == "hashes":
                out._made[name] = made[stay[self.words.doc]]
            else:
                out._made[name] = tuple(x[stay] for x in made) if isinstance(made, tuple) else made[stay]
        return out

    def _words(self) -> Words:
        return spans(self.chunk, SPACE_SPLIT)

    def _n_words(self) -> np.ndarray:
        return self.words.counts

    def _count_bytes(self, table: np.ndarray) -> np.ndarray:
        return sums(table[self.chunk.data], self.chunk.offsets)

    def _word_chars(self) -> np.ndarray:
        return self._count_bytes(~(SPACE_SPLIT | _IS_TAIL))

    def _n_symbols(self) -> np.ndarray:
        return self._count_bytes(_IS_SYMBOL)

    def _n_upper(self) -> np.ndarray:
        return self._count_bytes(_IS_UPPER)

    def _n_letters(self) -> np.ndarray:
        return self._count_bytes(_IS_LETTER)

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Of lines that hold a word: how many a document has, and how many equal an earlier one."""
        lines = spans(self.chunk, _NEWLINE)
        words = self.words
        holds = np.searchsorted(words.start, lines.end) > np.searchsorted(words.start, lines.start)
        hashed = range_hash(prefix_hash(self.chunk, False), lines.start[holds], lines.end[holds])
        doc = lines.doc[holds]
        order = np.lexsort((hashed, doc))
        again = np.zeros(len(doc), bool)
        again[1:] = (hashed[order][1:] == hashed[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        n = len(self.chunk)
        return np.bincount(doc, minlength=n), np.bincount(doc[order][again], minlength=n)

    def _n_lines(self) -> np.ndarray:
        return self.lines[0]

    def _n_dup_lines(self) -> np.ndarray:
        return self.lines[1]

    def _hashes(self) -> np.ndarray:
        return word_hashes(self.chunk, self.words, False)

    def _n_stutters(self) -> np.ndarray:
        """Words equal to the word just before them in the same document."""
        words, hashed = self.words, self.hashes
        again = np.zeros(len(hashed), bool)
        again[1:] = (hashed[1:] == hashed[:-1]) & (words.doc[1:] == words.doc[:-1])
        return sums(again, words.first)

    def _n_repeat_words(self) -> np.ndarray:
        words = self.words
        hashed, at = windows(self.hashes, words, REPEAT_WIDTH)
        doc = words.doc[at]
        order = np.lexsort((hashed, doc))
        same = (hashed[order][1:] == hashed[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        return sums(covered(len(words.start), at[twice], REPEAT_WIDTH), words.first)


@dataclass(frozen=True)
class Rule:
    """rejects: from the counts of a chunk, which of its documents the rule rejects."""

    name: str
    rejects: Callable[[Measure], np.ndarray]


#: The floor that no document may fall below.
BASE_RULES = (
    Rule("too_short", lambda m: m.n_words < 20),
    Rule("repetitive", lambda m: 100 * m.n_repeat_words > 30 * m.n_words),
)
RULES = (
    *BASE_RULES,
    Rule("word_length", lambda m: (m.word_chars < 2 * m.n_words) | (m.word_chars > 12 * m.n_words)),
    Rule("symbols", lambda m: 10 * m.n_symbols > 3 * m.n_words),
    Rule("dup_lines", lambda m: 10 * m.n_dup_lines > 4 * np.maximum(m.n_lines, 1)),
    Rule("stutter", lambda m: 10 * m.n_stutters > 4 * np.maximum(m.n_words, 1)),
    Rule("shouting", lambda m: 10 * m.n_upper > 6 * np.maximum(m.n_letters, 1)),
)
#: Rows that a cascade is measured on; it sets the order of rules alone.
SAMPLE_ROWS = 512
SAMPLE_SEED = 11
SAMPLE_BYTES = 1 << 16


def measured(texts: pa.Array, rules: Sequence[Rule]) -> list[tuple[str, int, int, float]]:
    """(rule, rows, rows rejected, seconds) for each rule, taken alone; words are found once for all rules and are no rule's cost."""
    shared = [Measure(chunk) for chunk in chunks(texts)]
    for m in shared:
        _ = m.hashes
    everyone = [np.ones(len(m.chunk), bool) for m in shared]
    found = []
    for rule in rules:
        own = [m.take(all_) for m, all_ in zip(shared, everyone, strict=True)]
        began = time.perf_counter()
        rejected = sum(int(np.count_nonzero(rule.rejects(m))) for m in own)
        found.append((rule.name, len(texts), rejected, time.perf_counter() - began))
    return found


def plan(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Names of the rules in falling order of rejection per cost, as measured on the driver.

    The sample is drawn from all rows alike: about sample_rows of them (at most twice as many), without texts over SAMPLE_BYTES.
    Ties, and an empty table, keep the order in which the rules are given.
    """
    texts = df.select(F.col(text).alias("text"))
    n = texts.count()
    if not n:
        return [r.name for r in rules]
    drawn = texts if n <= sample_rows else texts.sample(sample_rows / n, SAMPLE_SEED)
    rows = drawn.where(f"text is null or octet_length(text) <= {SAMPLE_BYTES}").limit(2 * sample_rows).collect()
    worth = {name: rejected / max(seconds, 1e-9) for name, _, rejected, seconds in measured(pa.array([r.text for r in rows], pa.string()), rules)}
    return [r.name for r in sorted(rules, key=lambda r: -worth[r.name])]


def survivors(measure: Measure, rules: Sequence[Rule]) -> np.ndarray:
    """Which documents of a chunk every rule lets pass. A rule reads only the documents that are still in."""
    alive = np.arange(len(measure.chunk))
    kept = np.zeros(len(alive), bool)
    for rule in rules:
        if not len(alive):
            break
        stay = ~rule.rejects(measure)
        if not stay.all():
            alive, measure = alive[stay], measure.take(stay)
    kept[alive] = True
    return kept


def cascade(texts: pa.Array, rules: Sequence[Rule]) -> np.ndarray:
    """Which texts every rule lets pass."""
    return np.concatenate([np.zeros(0, bool), *[survivors(Measure(chunk), rules) for chunk in chunks(texts)]])


def ordered(rules: Sequence[Rule], names: Sequence[str]) -> list[Rule]:
    by_name = {r.name: r for r in rules}
    return [by_name[n] for n in names]


def keep(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of df that every rule lets pass, with df's columns."""
    order = ordered(rules, plan(df, rules, text, sample_rows))
    at = df.columns.index(text)

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(cascade(batch.column(at), order)))

    return map_all_columns(df, on_batches)


def judge(df: DataFrame, rules: Sequence[Rule] = RULES, base: Sequence[Rule] = BASE_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every row of df (doc_id, text).

    The counts are asked of every row, so they are made first, and with them base_failed. The other rules run as a cascade
    on the rows that the base lets pass, in their measured order.
    """
    names = {r.name for r in base}
    order = ordered(rules, [n for n in plan(df, rules, "text", sample_rows) if n not in names])
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean"

    def on_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = column(batch, "doc_id")
            for chunk in chunks(column(batch, "text")):
                m = Measure(chunk)
                made = [pa.array(getattr(m, c), pa.int64()) for c in counts]
                failed = np.zeros(len(chunk), bool)
                for rule in base:
                    failed |= rule.rejects(m)
                kept = ~failed
                kept[kept] = survivors(m.take(kept), order)
                yield pa.RecordBatch.from_arrays([ids.slice(chunk.first, len(chunk)), *made, pa.array(failed), pa.array(kept)], ["doc_id", *counts, "base_failed", "kept"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(on_batches, schema)


#: The same as judge over the table documents with RULES, for DuckDB.
SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
words as (
  select r, unnest(w) as word, unnest(range(len(w))) as pos from (select r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w from d)),
runs as (
  select *, word = lag(word) over o as again,
    concat_ws(' ', word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o, lead(word, 5) over o, lead(word, 6) over o, lead(word, 7) over o) as win,
    lead(word, 7) over o is not null as whole
  from words window o as (partition by r order by pos)),
marked as (select r, pos, again, word, whole and count(*) over (partition by r, win, whole) > 1 as twice from runs),
covered as (select *, bool_or(twice) over (partition by r order by pos rows between 7 preceding and current row) as inside from marked),
counts as (
  select r, count(*) as n_words, cast(sum(length(word)) as bigint) as word_chars, count(*) filter (inside) as n_repeat_words, count(*) filter (again) as n_stutters
  from covered group by r),
lines as (
  select r, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) as n_upper, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) as n_letters,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from d),
every as (
  select d.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, cast(n_symbols as bigint) as n_symbols,
    cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    coalesce(n_stutters, 0) as n_stutters, n_upper, n_letters, len(l) as n_lines
  from d join lines using (r) left join counts using (r)),
judged as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from every)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * n_words or word_chars > 12 * n_words or 10 * n_symbols > 3 * n_words
    or 10 * n_dup_lines > 4 * greatest(n_lines, 1) or 10 * n_stutters > 4 * greatest(n_words, 1) or 10 * n_upper > 6 * greatest(n_letters, 1)) as kept
from judged
"""
