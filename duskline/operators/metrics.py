"""Time series of metrics: summaries, rollups, bottlenecks, regressions.

Points have the columns timestamp (epoch milliseconds), component, operation, name, value, unit, type.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..session import scratch_folder

SERIES = ("component", "operation", "name")
LATENCY_MS = 100.0
# Alert thresholds by metric type.
THRESHOLDS = {"CPU_USAGE": 80.0, "MEMORY_USAGE": 80.0, "IO_RATE": 1000.0, "ERROR_RATE": 5.0}
RETENTION_DAYS = {"raw": 7, "hourly": 30, "daily": 365}
LOWER_IS_BETTER = ("latency", "memory")
HIGHER_IS_BETTER = ("throughput", "ops")


def summary(points: DataFrame) -> DataFrame:
    """For each series: min, max, sum, count and avg of latencies; of other types the last value alone."""
    latency = F.col("type") == "LATENCY"
    made = points.groupBy(*SERIES, "type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("value").alias("total"), F.count("value").alias("n"), F.avg("value").alias("mean"), F.max_by("value", F.struct("timestamp", "value")).alias("last"))
    return made.select(*SERIES, "type", F.when(latency, F.col("lo")).alias("min_value"), F.when(latency, F.col("hi")).alias("max_value"), F.when(latency, F.col("total")).alias("sum_value"), F.when(latency, F.col("n")).alias("n"), F.when(latency, F.col("mean")).alias("avg_value"), F.when(~latency, F.col("last")).alias("last_value"))


def rollup(points: DataFrame, width_ms: int, by: tuple[str, ...] = SERIES, timestamp: Column | str = "timestamp", value: str = "value") -> DataFrame:
    """min, max, avg and count of each series in epoch-aligned buckets of width_ms."""
    at = F.col(timestamp) if isinstance(timestamp, str) else timestamp
    return points.groupBy(*by, scalars.bucket(at, width_ms).alias("bucket")).agg(F.min(value).alias("min_value"), F.max(value).alias("max_value"), F.avg(value).alias("avg_value"), F.count(value).alias("n"))


def rollup_of_rollup(rolled: DataFrame, width_ms: int, by: tuple[str, ...] = SERIES) -> DataFrame:
    """A coarser rollup from a finer one; averages are weighted by count."""
    out = rolled.groupBy(*by, scalars.bucket(F.col("bucket"), width_ms).alias("bucket"))
    return out.agg(F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), (F.sum(F.col("avg_value") * F.col("n")) / F.sum("n")).alias("avg_value"), F.sum("n").alias("n"))


def within(points: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Points of a closed range of times."""
    at = F.col("timestamp")
    if start is not None:
        points = points.where(at >= start)
    return points if end is None else points.where(at <= end)


def retained(points: DataFrame, now_ms: int, days: int) -> DataFrame:
    return points.where(F.col("timestamp") >= now_ms - days * scalars.DAY_MS)


def latency_bottlenecks(points: DataFrame, threshold: float = LATENCY_MS) -> DataFrame:
    """Operations whose mean latency is over a threshold, worst first."""
    mean = points.where(F.col("type") == "LATENCY").groupBy("component", "operation").agg(F.avg("value").alias("avg_value"), F.count(F.lit(1)).alias("n"))
    return mean.where(F.col("avg_value") > threshold).withColumn("severity", scalars.severity(F.col("avg_value"), threshold)).orderBy(F.desc("severity"), "component", "operation")


def alerts(points: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """Points over the threshold of their type."""
    limits = thresholds or THRESHOLDS
    limit = F.coalesce(*[F.when(F.col("type") == k, F.lit(float(v))) for k, v in limits.items()])
    over = points.withColumn("threshold", limit).where(F.col("value") > F.col("threshold"))
    return over.withColumn("severity", F.least(F.lit(1.0), (F.col("value") / F.col("threshold") - 1) / 2))


#: Values of a group that one task may hold; larger groups are cut down by histograms first.
EXACT_VALUES, BINS = 100_000, 4096


def percentiles(df: DataFrame, value: str, shares: tuple[float, ...], by: tuple[str, ...] = (), most: int = EXACT_VALUES) -> DataFrame:
    """Nearest-rank percentiles p<share*100> of each group; 0 where a group has no values.

    Groups of at most `most` values (and those with infinite values or NaN) are settled in one aggregation. For others, the range that holds
    the wanted rank is cut into BINS bins, counted, and cut again, until it holds few values or one: no task holds a large group.
    """
    names = ["p" + f"{s * 100:g}".replace(".", "_") for s in shares]
    v = F.col(f"`{value}`")
    sizes = df.groupBy(*by).agg(F.count(v).alias("__n"), F.min(v.cast("double")).alias("__lo"), F.max(v.cast("double")).alias("__hi"))
    finite = F.col("__hi") - F.col("__lo") < float("inf")  # neither for infinite values nor for NaN
    large = sizes.where((F.col("__n") > most) & finite)
    made = [F.coalesce(F.expr(f"percentile_disc({s}) within group (order by `{value}`)"), F.lit(0.0)).alias(n) for s, n in zip(shares, names, strict=True)]
    if large.isEmpty():
        return df.groupBy(*by).agg(*made) if by else df.agg(*made)
    keys = [f"__k{i}" for i in range(len(by))]
    values = df.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)], v.alias("__v")).where("__v is not null")
    state = large.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)], "*").drop(*by)
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(s)).alias("share")) for s, n in zip(shares, names, strict=True)])
    state = state.withColumn("__w", F.explode(wanted)).select(*keys, F.col("__w.name").alias("__name"), F.greatest(F.lit(1), F.ceil(F.col("__w.share") * F.col("__n"))).alias("__rank"), "__lo", "__hi", "__n")

    def within(state: DataFrame) -> DataFrame:
        named = state.select(*[F.col(k).alias(f"{k}s") for k in keys], "__name", "__rank", "__lo", "__hi", "__n")
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"{k}s"))
        inside = F.col("__v").between(F.col("__lo"), F.col("__hi"))
        return values.join(F.broadcast(named) if not keys else named, same & inside).drop(*[f"{k}s" for k in keys])

    while not state.where((F.col("__n") > most) & (F.col("__lo") < F.col("__hi"))).isEmpty():
        part = F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * F.lit(BINS))
        binned = within(state).withColumn("__bin", F.when(F.col("__lo") < F.col("__hi"), part).otherwise(F.lit(0)))
        counted = binned.groupBy(*keys, "__name", "__rank", "__bin").agg(F.count(F.lit(1)).alias("__c"), F.min("__v").cast("double").alias("__lo"), F.max("__v").cast("double").alias("__hi"))
        upto = F.sum("__c").over(Window.partitionBy(*keys, "__name").orderBy("__bin"))
        hit = counted.withColumn("__upto", upto).where("__upto >= __rank and __upto - __c < __rank")
        state = hit.select(*keys, "__name", (F.col("__rank") - (F.col("__upto") - F.col("__c"))).alias("__rank"), "__lo", "__hi", F.col("__c").alias("__n"))
        state = _kept(state)
    one = state.where("__lo = __hi").select(*keys, "__name", F.col("__lo").alias("__p"))
    few = within(state.where("__lo < __hi")).groupBy(*keys, "__name", "__rank").agg(F.element_at(F.array_sort(F.collect_list("__v")), F.col("__rank").cast("int")).cast("double").alias("__p"))
    found = one.union(few.select(*keys, "__name", "__p")).groupBy(*keys).agg(*[F.max(F.when(F.col("__name") == n, F.col("__p"))).alias(n) for n in names])
    found = found.select(*[F.col(k).alias(b) for k, b in zip(keys, by, strict=True)], *names)
    if not by:
        return found
    rest = df.join(large.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys, strict=True)]), _same(by, keys), "left_anti")
    return found.unionByName(rest.groupBy(*by).agg(*made))


def _kept(state: DataFrame) -> DataFrame:
    """A small table written to the shared folder and read again, so that rounds do not build on each other."""
    path = f"{scratch_folder(state.sparkSession)}/percentiles-{uuid.uuid4().hex}"
    state.write.parquet(path)
    return state.sparkSession.read.schema(state.schema).parquet(path)


def _same(names: tuple[str, ...], others: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(names, others, strict=True):
        out = out & F.col(f"`{a}`").eqNullSafe(F.col(b))
    return out


def deviation(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Population standard deviation of each group."""
    made = F.stddev_pop(value).alias("stddev")
    return df.groupBy(*by).agg(made) if by else df.agg(made)


def throughput(points: DataFrame, by: tuple[str, ...] = (), timestamp: str = "timestamp") -> DataFrame:
    """Operations a second between the first and the last of each group; 0 where no time passes."""
    seconds = (F.max(timestamp) - F.min(timestamp)) / 1000
    made = F.coalesce(F.try_divide(F.count(F.lit(1)), seconds), F.lit(0.0)).alias("ops_per_second")
    return points.groupBy(*by).agg(made) if by else points.agg(made)


def regressions(baseline: DataFrame, current: DataFrame, threshold_percent: float = 10.0) -> DataFrame:
    """Every metric (bench, metric, value) that both runs have, its change, and whether it got worse by more than the threshold.

    Latency and memory are worse when higher, throughput and operations when lower, others when they move at all.
    """
    b = baseline.select("bench", "metric", F.col("value").alias("base_value"))
    c = current.select("bench", "metric", F.col("value").alias("current_value"))
    change = scalars.percent_difference(F.col("base_value"), F.col("current_value"))
    name, share = F.lower("metric"), threshold_percent / 100

    def any_of(words: tuple[str, ...]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | name.contains(w)
        return out

    worse = F.when(any_of(LOWER_IS_BETTER), F.col("current_value") > F.col("base_value") * (1 + share)).when(any_of(HIGHER_IS_BETTER), F.col("current_value") < F.col("base_value") * (1 - share)).otherwise(change > threshold_percent)
    return b.join(c, ["bench", "metric"]).select("bench", "metric", "base_value", "current_value", change.alias("change_percent"), worse.alias("regressed"))


def trend(runs: DataFrame, n: int, by: tuple[str, ...] = (), order: str = "run") -> DataFrame:
    """The last n runs of each group, oldest first."""
    newest = Window.partitionBy(*by).orderBy(F.col(order).desc()) if by else None
    if newest is None:
        return runs.orderBy(F.col(order).desc()).limit(n).orderBy(order)
    return runs.withColumn("__rank", F.row_number().over(newest)).where(F.col("__rank") <= n).drop("__rank").orderBy(*by, order)


def latest_run(runs: DataFrame, by: tuple[str, ...], value: str = "value", order: str = "run") -> DataFrame:
    """The value of the most recent run of each group."""
    return runs.groupBy(*by).agg(F.max(order).alias(order), F.max_by(value, order).alias(value))
