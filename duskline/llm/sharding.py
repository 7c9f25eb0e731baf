"""Byte-balanced shards by histogram sort; DataFrame functions only.

Rows are ordered by (hash of the text, hash of the id). A splitter is a place in that order with the wanted
number of bytes before it. It is found by counting, never by sorting: a round counts the exact bytes of all
rows in each of up to 4096 key intervals, keeps for each splitter the one interval that holds its target, and
cuts that one again, until the nearest interval edge is within TOLERANCE of a shard's mean bytes or the
interval holds one key. What comes to the driver in a round is bounded by shards times intervals.
Then rows are exchanged once, by shard and key interval, and numbered there; exact row counts of the intervals
give each its first slot, so no task holds a whole shard.

Equal texts have equal first keys and so stand next to each other. A group is cut between two shards only if no
edge between groups is within the tolerance; a group of any size is then cut inside, by the hash of the id.

Size: UTF-8 bytes of the text (none for null) plus 8. A null id or text has a key like any other; the crc of a
null text is null. Rows that repeat id and text share a shard. An empty table has no rows in any shard.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, settle

TOLERANCE = 0.001
SHIFTS = (51, 43, 35, 27, 19, 11, 3, 0)
_KEY = (1 << 63) - 1
#: Rows aimed at in an interval of the exchange, until there are 2**16 intervals.
INTERVAL_ROWS = 200


def _hashed(c: Column) -> Column:
    return F.xxhash64(c).bitwiseAND(F.lit(_KEY))


@dataclass
class Interval:
    """Keys whose part `part` (0: text, 1: id) is `prefix` when shifted right by `shift`; below: bytes before it."""

    part: int
    shift: int
    prefix: int
    text_key: int
    below: int
    goals: list[int]

    def holds(self) -> str:
        if self.part == 0:
            return f"shiftright(k1, {self.shift}) = {self.prefix}"
        return f"k1 = {self.text_key} and shiftright(k2, {self.shift}) = {self.prefix}"

    @property
    def step(self) -> int:
        """The shift that the next cut uses."""
        return next(s for s in SHIFTS if s < self.shift)

    def edge(self, digit: int) -> tuple[int, int]:
        """The first key of a part."""
        key = ((self.prefix << (self.shift - self.step)) | digit) << self.step
        return (key, 0) if self.part == 0 else (self.text_key, key)


def splitters(keyed: DataFrame, goals: list[int], tolerance: int) -> dict[int, tuple[int, int]]:
    """For each goal (bytes) the key before which that many bytes lie, as nearly as the tolerance or the rows allow.

    keyed: k1, k2, size.
    """
    found: dict[int, tuple[int, int]] = {}
    todo = [Interval(0, 63, 0, 0, 0, list(goals))]
    while todo:
        which = "case " + " ".join(f"when {x.holds()} then {i}" for i, x in enumerate(todo)) + " end"
        digit = "case which " + " ".join(f"when {i} then shiftright({'k2' if x.part else 'k1'}, {x.step}) & {(1 << (x.shift - x.step)) - 1}" for i, x in enumerate(todo)) + " end"
        counted = keyed.withColumn("which", F.expr(which)).where("which is not null").withColumn("digit", F.expr(digit))
        counted = counted.groupBy("which", "digit").agg(F.sum("size").alias("bytes"), F.min("k1").alias("lo1"), F.max("k1").alias("hi1"), F.min("k2").alias("lo2"), F.max("k2").alias("hi2"))
        bins: dict[int, list] = {}
        for r in sorted(counted.collect(), key=lambda r: (r.which, r.digit)):
            bins.setdefault(r.which, []).append(r)
        later: dict[tuple, Interval] = {}
        for i, x in enumerate(todo):
            rows = bins.get(i, [])
            ends, at = [], x.below
            for r in rows:
                at += r.bytes
                ends.append(at)
            for goal in x.goals:
                n = bisect_left(ends, goal)
                if n >= len(rows):
                    found[goal] = x.edge(1 << (x.shift - x.step)) if rows else (_KEY, _KEY)
                    continue
                before = ends[n - 1] if n else x.below
                r = rows[n]
                one_text, one_id = r.lo1 == r.hi1, r.lo2 == r.hi2
                if min(goal - before, ends[n] - goal) <= tolerance or (one_text and one_id):
                    found[goal] = x.edge(r.digit) if goal - before <= ends[n] - goal else x.edge(r.digit + 1)
                    if one_text and one_id and goal - before > ends[n] - goal and x.part == 0:
                        found[goal] = (r.hi1 + 1, 0)
                elif x.part == 0 and one_text:
                    later.setdefault((1, r.lo1, 63), Interval(1, 63, 0, r.lo1, before, [])).goals.append(goal)
                else:
                    prefix = (x.prefix << (x.shift - x.step)) | r.digit
                    later.setdefault((x.part, x.text_key, x.step, prefix), Interval(x.part, x.step, prefix, x.text_key, before, [])).goals.append(goal)
        todo = list(later.values())
    return found


def by_bytes(df: DataFrame, shards: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, size, text_crc32, shard and slot of every row of df."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(8)
    keyed = settle(df.select(F.col(doc_id).cast("long").alias("id"), size.alias("size"), F.crc32(F.col(text).cast("binary")).alias("text_crc32"), _hashed(F.col(text)).alias("k1"), _hashed(F.struct(F.col(doc_id))).alias("k2")))
    total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    goals = sorted({total * s // shards for s in range(1, shards)}) if total else []
    cuts = splitters(keyed, goals, int(TOLERANCE * total / shards)) if goals else {}
    parts = [F.lit(0)]
    for s in range(1, shards):
        if total:
            c1, c2 = cuts[total * s // shards]
            parts.append(((F.col("k1") > c1) | ((F.col("k1") == c1) & (F.col("k2") >= c2))).cast("int"))
    shard = parts[0]
    for p in parts[1:]:
        shard = shard + p
    bits = min(16, max(8, (n // INTERVAL_ROWS).bit_length()))
    rows = keyed.withColumn("shard", shard).withColumn("interval", F.shiftright("k1", 63 - bits).cast("int"))
    aim = max(INTERVAL_ROWS, n >> bits)
    # An interval with a large group in it is cut further by the hash of the id.
    heavy = rows.groupBy("interval").count().where(F.col("count") > 2 * aim).select("interval", F.least(F.lit(16), F.ceil(F.log2(F.col("count") / aim))).cast("int").alias("more"))
    heavy = F.broadcast(heavy)  # intervals of over twice the mean, so at most half of the 2**16
    rows = rows.join(heavy, "interval", "left").withColumn("part", F.coalesce(F.expr("shiftright(k2, 63 - more)"), F.lit(0)).cast("int"))
    # Rows that repeat id and text are one row with a count until they have their slots: no task sorts a group of copies.
    rows = rows.groupBy("shard", "interval", "part", "k1", "k2", "id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    place = Window.partitionBy("shard").orderBy("interval", "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "interval", "part").agg(F.sum("copies").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(place), F.lit(0))).drop("n")
    # Intervals times parts: at most 2**17 of the first and the rows over `aim` of the second, so about 2**18 rows.
    counts = settle(counts)
    if counts.count() <= BROADCAST_ROWS:
        counts = F.broadcast(counts)
    inside = Window.partitionBy("shard", "interval", "part").orderBy("k1", "k2", "id").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("row", F.coalesce(F.sum("copies").over(inside), F.lit(0))).join(counts, ["shard", "interval", "part"])
    copy = numbered.withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    return copy.select("id", "size", "text_crc32", "shard", (F.col("base") + F.col("row") + F.col("copy")).cast("long").alias("slot"))
