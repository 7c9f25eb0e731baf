"""Tokens, distances and relevance of texts."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that full-text search leaves out.
STOP_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "if", "in", "into", "is", "it", "no", "not", "of",
    "on", "or", "such", "that", "the", "their", "then", "there", "these", "they", "this", "to", "was", "will", "with",
)
LETTER = r"[\p{L}\p{N}]"
#: A run of letters and digits that is no stop word, in lower-cased text.
TOKEN = rf"(?<!{LETTER})(?!(?:{'|'.join(STOP_WORDS)})(?!{LETTER})){LETTER}++"
NOT_ASCII_WORD = r"[^a-zA-Z0-9]+"
DEFAULT_DISTANCE = 2


def token_set(text: Column) -> Column:
    """Distinct lower-cased runs of ASCII letters and digits, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)))


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits of any script, without stop words; repeats stay."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(f"{LETTER}+"), F.lit(0)), lambda t: ~t.isin(*STOP_WORDS))


def counted(tokens: Column) -> Column:
    """Each distinct token of an array with how often it stands there, as structs (token, k): sorted, then cut where a new token begins."""

    def runs(own: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda i: (i == 0) | (own[i] != own[F.greatest(i - 1, F.lit(0))]))

        def cut(at: Column) -> Column:
            ends = F.concat(F.slice(at, F.lit(2), F.size(at)), F.array(F.size(own)))
            return F.transform(F.arrays_zip(at.alias("a"), ends.alias("b")), lambda r: F.struct(own[r["a"]].alias("token"), (r["b"] - r["a"]).alias("k")))

        return once(starts, cut)

    return F.when(F.size(tokens) > 0, once(F.sort_array(tokens), runs)).otherwise(F.array().cast("array<struct<token:string,k:int>>"))


def presence(text: Column, words: Sequence[str]) -> Column:
    """A struct: whether a text has any token (`any`), and whether it has each of these (`k0`, `k1`, ...), without taking it apart."""

    def found(lowered: Column) -> Column:
        return F.struct(lowered.rlike(TOKEN).alias("any"), *[_holds(lowered, [w], LETTER).alias(f"k{i}") for i, w in enumerate(words)])

    return once(F.lower(text), found)


def _holds(lowered: Column, words: Sequence[str], letter: str) -> Column:
    near = F.lit(False)
    for w in words:  # a plain search for bytes, before the pattern
        near = near | lowered.contains(w)
    return near & lowered.rlike(rf"(?<!{letter})(?:{'|'.join(words)})(?!{letter})")  # tokens are letters and digits only


def has_any(text: Column, words: Sequence[str], ascii_only: bool = False) -> Column:
    """Whether one of these tokens stands in a text, without taking it apart."""
    return once(F.lower(text), lambda lowered: _holds(lowered, words, "[a-zA-Z0-9]" if ascii_only else LETTER))


def fuzzy_distance(text: Column, term: str, most: int = DEFAULT_DISTANCE) -> Column:
    """Case-insensitive Levenshtein distance of whole texts up to `most`, else null.

    Lengths are compared first, so most texts never reach the distance.
    """
    near = F.abs(F.length(text) - F.lit(len(term))) <= most
    distance = F.levenshtein(F.lower(text), F.lit(term.lower()), most)
    return F.when(near & (distance >= 0), distance)


def ascii_tokens(query: str) -> list[str]:
    """The token set of a query, on the driver."""
    return list(dict.fromkeys(t for t in re.split(NOT_ASCII_WORD, query.lower()) if t))


def once(made: Column, use: Callable[[Column], Column]) -> Column:
    """use(made), with made computed once for a row however often use reads it (Catalyst would copy the expression into each place)."""
    return F.transform(F.array(made), use)[0]


def overlap(text: Column, query: str) -> Column:
    """Share of a text's token set that the query's tokens make up; 0 without common tokens, null for null."""
    asked = ascii_tokens(query)

    def share(own: Column) -> Column:
        n = F.lit(0)
        for t in asked:
            n = n + F.array_contains(own, t).cast("int")
        return F.coalesce(F.try_divide(n, F.size(own)), F.lit(0.0))

    return F.when(text.isNotNull(), once(token_set(text), share))


def matches(text: Column, pattern: str) -> Column:
    """Whether a regular expression is found anywhere in a text."""
    return text.rlike(pattern)
