"""Bloom filters: sizing, building, testing, and filters before a join."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_KEY, HASHES = 10, 7
#: A filter that is sent to executors may be so large.
MOST_BITS = 1 << 27


def bits_for(n: int, fpp: float) -> int:
    return max(64, math.ceil(-n * math.log(fpp) / math.log(2) ** 2))


def hashes_for(n: int, bits: int) -> int:
    return max(1, round(bits / max(1, n) * math.log(2)))


def false_positive_rate(n: int, bits: int, hashes: int) -> float:
    return (1 - math.exp(-hashes * n / bits)) ** hashes


@dataclass(frozen=True)
class BloomFilter:
    """A filter of n keys. words: a frame of one row, the filter's bits as an array of longs."""

    n: int
    bits: int
    hashes: int
    words: DataFrame

    @property
    def n_bytes(self) -> int:
        return 8 * math.ceil(self.bits / 64)

    @property
    def fpp(self) -> float:
        """The share of other keys that it is expected to let pass."""
        return false_positive_rate(self.n, self.bits, self.hashes)


def _places(key: Column, bits: int, hashes: int) -> list[Column]:
    """Bit numbers of a key, from two hashes (of 48 bits, whose sums no long exceeds)."""
    one, two = F.shiftrightunsigned(F.xxhash64(key), 16), F.shiftrightunsigned(F.xxhash64(key, F.lit(1)), 16)
    return [(one + two * F.lit(i)) % F.lit(bits) for i in range(hashes)]


def create(df: DataFrame, key: str, fpp: float = 0.01) -> BloomFilter:
    """A filter of the keys of df that are not null, of at most MOST_BITS bits (16 MB) however many keys there are.

    Bits are set on executors and combined before the shuffle; the last task holds the filter and nothing else.
    """
    keys = df.where(F.col(key).isNotNull())
    n = keys.count()
    bits = min(MOST_BITS, bits_for(max(1, n), fpp))
    hashes = hashes_for(n, bits)
    places = keys.select(F.explode(F.array(*_places(F.col(key), bits, hashes))).alias("bit"))
    marks = places.groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(bit % 64))")).alias("set"))
    every = df.sparkSession.range(math.ceil(bits / 64)).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("set"))
    whole = marks.union(every).groupBy("word").agg(F.bit_or("set").alias("set"))
    ordered = whole.agg(F.array_sort(F.collect_list(F.struct("word", "set"))).alias("pairs"))
    return BloomFilter(n, bits, hashes, ordered.select(F.col("pairs.set").alias("words")))


def might_contain(made: BloomFilter, key: Column) -> Column:
    """False where a key is surely not in the filter, null for null."""
    words = made.words.scalar()
    out = F.lit(True)
    for at in _places(key, made.bits, made.hashes):
        out = out & (F.getbit(F.element_at(words, (F.floor(at / 64) + 1).cast("int")), (at % 64).cast("int")) == 1)
    return F.when(key.isNotNull(), out)


def prune_before_join(big: DataFrame, small: DataFrame, key: str, fpp: float = 0.01) -> DataFrame:
    """Rows of big whose key may be in small: all that match, and about a share fpp of others.

    The filter reaches big as one value, so big is not shuffled for it; rows that are left out never reach the join.
    """
    return big.where(might_contain(create(small, key, fpp), F.col(key)))
