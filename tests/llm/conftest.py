"""Small tables with what large ones hold now and then."""

from __future__ import annotations

import random

import pytest

PROSE = "the quick brown fox jumps over the lazy dog while a small grey cat sleeps near an old stone wall and nobody minds"


def sentence(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """(doc_id, text, source): nulls, empty and very long texts, ties, repeats, odd spaces and letters."""
    rng = random.Random(5)
    base, passage = sentence(rng, 120), sentence(rng, 60)
    words = base.split()
    near = " ".join(words[:100] + ["changed"] + words[101:])
    rows = [
        (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, base, "a"), (5, base, "b"), (5, base, "b"), (6, near, "a"), (None, base, "a"), (None, None, None),
        (7, base.upper(), "c"), (8, "word", "a"), (9, "word", "a"), (10, "two words", "b"), (11, "ÀÉ ß naïve   x\x0by\x1fz \U0001f600 日本語", "b"),
        (12, sentence(rng, 60_000), "a"), (13, sentence(rng, 40) + " " + passage + " " + sentence(rng, 30), "a"), (14, sentence(rng, 25) + "\n" + passage.replace(" ", "\n") + " " + sentence(rng, 50), "b"),
        (15, passage + " " + passage, "a"), (16, "a a a a a a a a a a " * 20, "a"), (17, "same line\nsame line\nother line\n\nsame line", "a"), (18, "under the MIT license and the Apache License, Version 2", "a"),
    ]
    return rows + [(100 + i, sentence(rng, 50), rng.choice("abc")) for i in range(10)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), "doc_id long, text string, source string").repartition(3).cache()


@pytest.fixture(scope="session")
def clashing(odd):
    """The same rows with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    names = ["id", "text_hash", "cls", "row", "rest", "cuts", "lines", "host", "kept", "flagged", "bucket", "key", "n", "o_id", "o_hash", "group", "__one", "c0", "dotted.name", "held_out", "cluster"]
    return odd.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet").cache()
