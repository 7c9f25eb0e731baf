"""Operators one by one, on literal rows."""

from __future__ import annotations

import math
import random

import pytest
from duskline.functions import coerce, scalars, text
from duskline.operators import aggregates, blooms, joins, metrics, relational, search, statistics, versions
from duskline.sources import documents, tables
from duskline.streaming import changes, rollups
from pyspark.sql import functions as F
from pyspark.sql import types as T


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("1", "Alice", 25), ("2", "Bob", 30), ("3", "Charlie", 35), ("4", None, None)], "id string, name string, age int").coalesce(1)


def ids(df):
    return sorted(r.id for r in df.collect())


def test_coercion(spark):
    rows = spark.createDataFrame([("a", "10"), ("b", "9.5"), ("c", "x"), ("d", None), ("e", "NaN"), ("f", "1.5f"), ("g", " 12 ")], "id string, v string")
    where = lambda op, v: ids(rows.where(coerce.compare(F.col("v"), T.StringType(), op, v)))
    assert where("=", 10) == ["a"] and where("=", "10.0") == ["a"]
    assert where(">", 9) == ["a", "b", "c", "e", "g"]  # text that is no number is compared as text
    assert where("=", "x") == ["c"] and where("=", None) == []
    assert where("<>", "x") == ["a", "b", "e", "f", "g"]
    flags = spark.createDataFrame([("a", True), ("b", False)], "id string, v boolean")
    assert ids(flags.where(coerce.compare(F.col("v"), T.BooleanType(), "=", "TRUE"))) == ["a"]
    assert coerce.parse_number("3000000000") == 3000000000 and coerce.parse_number("1e5") is None and coerce.parse_number("-2.") == -2.0


def test_numbers_beyond_the_columns_type(people):
    assert relational.filter_compare(people, "age", "<", 3_000_000_000).count() == 3
    assert relational.filter_compare(people, "age", "<", 10**30).count() == 3
    assert relational.filter_compare(people, "age", "=", 25.0).count() == 1
    assert relational.filter_compare(people, "age", "=", "abc").count() == 0
    assert relational.filter_compare(people, "none", "=", 1).count() == 0


def test_filters_are_pushed_down(spark, small):
    plan = lambda df: df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    orders = tables.read_parquet(spark, f"{small}/orders.parquet")
    p = plan(relational.project(relational.filter_compare(orders, "o_totalprice", ">", "100"), ["o_orderkey"]))
    assert "GreaterThan(o_totalprice,100.0)" in p and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in p
    assert "In(o_custkey" in plan(relational.filter_in(orders, "o_custkey", [1, 2, 3]))
    assert "BatchEvalPython" not in p and "ArrowEval" not in p


def test_project_sort_limit(people):
    withid = people.withColumn("__uuid", F.lit("u"))
    assert relational.project(withid, ["age", "none", "NAME"]).columns == ["age", "name", "__uuid"]
    assert [r.age for r in relational.sort(people, [("age", True)]).collect()] == [None, 25, 30, 35]
    assert [r.age for r in relational.sort(people, [("age", False), ("none", True)]).collect()] == [35, 30, 25, None]
    named = relational.sort(people, [("age", True)])
    assert [r.id for r in relational.limit_offset(named, 2, 1).collect()] == ["1", "2"]
    assert relational.limit_offset(people, "invalid", "x").count() == 4 and relational.limit_offset(people, -1).count() == 0
    assert relational.distinct(withid.union(people.withColumn("__uuid", F.lit("v")))).count() == 4


def test_ranges(people):
    assert ids(relational.range_search(people, "age", 25, 30)) == ["1", "2"] and ids(relational.range_search(people, "age", 40, 50)) == []
    keys = people.sparkSession.createDataFrame([(k, f"row{i}") for i, k in enumerate([10, 20, 30, 40, 50], 1)], "id int, row string")
    assert ids(relational.in_range(keys, "id", 15, 35)) == [20, 30] and len(ids(relational.in_range(keys, "id", 10, 50))) == 5
    assert ids(relational.in_range(keys, "id", 60, 70)) == [] and ids(relational.in_range(keys, "id", 35, 15)) == []
    assert ids(relational.in_range(keys, "id", None, 20)) == [10, 20] and len(ids(relational.in_range(people, "age"))) == 3


def test_regular_expressions(people, spark):
    mails = spark.createDataFrame([("1", "alice@example.com"), ("2", "bob@example.org"), ("3", "charlie@gmail.com")], "id string, email string")
    assert ids(relational.regex_search(mails, "email", r".*@example\.(com|org)")) == ["1", "2"]
    assert relational.regex_search(mails, "email", "[").count() == 0
    names = spark.createDataFrame([(n,) for n in ("John Smith", "Jane Doe", "Bob Johnson", "Alice Brown")], "id string")
    assert relational.regex_search(names, "id", r"^[A-J]\w+ [A-Z]\w+$").count() == 4


def test_text_search(spark):
    rows = spark.createDataFrame([("1", "The quick brown fox jumps over the lazy dog"), ("2", "A quick brown dog runs in the park"), ("3", "The lazy cat sleeps all day"), ("4", None), ("5", "")], "id string, description string")
    found = search.overlap_search(rows, "description", "quick brown").collect()
    assert [r.id for r in found] == ["1", "2"] and math.isclose(found[0]["__relevance"], 2 / 8)
    fuzzy = spark.createDataFrame([("1", "Alice"), ("2", "Alicia"), ("3", "Bob"), ("4", None)], "id string, name string")
    assert [(r.name, r["__fuzzy_distance"]) for r in search.fuzzy_search(fuzzy, "name", "Alice").collect()] == [("Alice", 0), ("Alicia", 2)]


def test_tfidf(spark):
    d = ["Senior software engineer with 10 years of experience", "Junior software developer with 2 years of experience", "Product manager with background in software development", "UX designer with focus on user research", None, "the"]
    rows = spark.createDataFrame([(i + 1, t) for i, t in enumerate(d)], "id int, text string")
    want = {3: math.log(4 / 3) / 5, 1: math.log(4 / 3) / 6, 2: math.log(4 / 3) / 6}
    index = search.postings(rows, "id", "text")
    for found in (search.tfidf_search(rows, "id", "text", "software"), search.indexed_search(index, "software", 4, "id")):
        got = [(r.id, round(r["__relevance"], 12)) for r in found.collect()]
        assert got[0][0] == 3 and dict(got) == {k: round(v, 12) for k, v in want.items()}
    twice = {r.id: r["__relevance"] for r in search.tfidf_search(rows, "id", "text", "software Software").collect()}
    assert math.isclose(twice[3], 2 * want[3])
    assert search.tfidf_search(rows, "id", "text", "the of").count() == 0 and search.tfidf_search(rows.where("false"), "id", "text", "x").count() == 0
    assert len(text.STOP_WORDS) == 33


def test_postings_are_made_without_a_shuffle(spark):
    rows = spark.createDataFrame([(1, "b a b, The B a c"), (2, "c"), (3, None), (4, "the of"), (5, "a")], "id int, text string")
    found = search.postings(rows, "id", "text")
    assert sorted((r.token, r.row_id, round(r.tf, 6)) for r in found.collect()) == [("b", 1, 0.75), ("c", 1, 0.25), ("c", 2, 1.0)]  # "a" is a stop word
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_segments(spark, tmp_path):
    rows = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i % 7)) + " x" * (i % 3)) for i in range(200)], "id int, text string").repartition(5)
    n = search.write_segment(rows, "id", "text", f"{tmp_path}/s", 1)
    assert n == rows.where("id % 7 > 0 or id % 3 > 0").count()
    read = spark.read.schema(search.SEGMENT.format("int")).parquet(f"{tmp_path}/s")
    score = lambda df: {r.id: round(r["__relevance"], 10) for r in df.collect()}
    for asked in ("w1 X w5 w5", "w0", "nothing", "the"):
        assert score(search.segment_search(read, asked, n, "id")) == score(search.tfidf_search(rows, "id", "text", asked))
    gone = rows.where("id % 2 = 0").selectExpr("id as row_id", "2L as version")
    rest = rows.where("id % 2 = 1")
    more = search.count_voided(read, None, gone)
    assert score(search.segment_search(read, "w1 x", n - more, "id", gone=gone)) == score(search.tfidf_search(rest, "id", "text", "w1 x"))
    assert score(search.segment_search(read, "w1 x", n, "id", gone=gone.withColumn("version", F.lit(1)))) == score(search.tfidf_search(rows, "id", "text", "w1 x"))


def test_joins(spark):
    users = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), (None, "n")], "id string, name string")
    orders = spark.createDataFrame([("o1", "1", "u"), ("o2", "2", "u"), ("o3", None, "u")], "oid string, id string, __uuid string")
    for strategy in (None, *joins.STRATEGIES):
        j = joins.join_same_column(users, orders, "id", "orders", strategy)
        assert j.columns == ["id", "name", "orders_oid", "orders_id"] and ids(j) == ["1", "2"]
    counts = {how: joins.equi_join(users, orders, [("id", "id")], "o", how).count() for how in ("inner", "left", "right", "full", "semi", "anti", "cross")}
    assert counts == {"inner": 2, "left": 4, "right": 3, "full": 5, "semi": 2, "anti": 2, "cross": 12}
    numbers = spark.createDataFrame([(1,)], "id int")
    assert joins.join_same_column(users, numbers, "id", "n").count() == 0
    with pytest.raises(ValueError):
        joins.equi_join(users, orders, [("id", "id")], "o", "sideways")


def test_subqueries_and_nulls(spark):
    a = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    b = spark.createDataFrame([(1,), (1,), (None,)], "x int")
    assert ids(relational.filter_in_rows(a, "id", b)) == [1] and ids(relational.filter_in_rows(a, "id", b, negated=True)) == [2]


def test_aggregates(people):
    out = aggregates.aggregate(people, [("count", "*", "n"), ("count", "age", "m"), ("avg", "age", "mean")]).first()
    assert (out.n, out.m, out.mean) == (4, 3, 30.0)
    with pytest.raises(ValueError):
        aggregates.expression(people, "sum", "*")
    with pytest.raises(ValueError):
        aggregates.expression(people, "median", "age")


def test_statistics(people, spark):
    got = {r.column_name: r for r in statistics.column_statistics(people, exact=True).collect()}
    assert (got["age"].n_rows, got["age"].n_values, got["age"].n_nulls, got["age"].ndv, got["age"].min_value, got["age"].max_value, got["age"].avg_number) == (4, 3, 1, 3, "25", "35", 30.0)
    assert got["name"].avg_length == 5.0
    assert statistics.equality_selectivity(4) == 0.25 and statistics.equality_selectivity(5000) == statistics.equality_selectivity(None) == 0.1
    assert statistics.range_selectivity(0, 10, "<", 2.5) == 0.25 and statistics.range_selectivity(0, 10, ">", 2.5) == 0.75 and statistics.range_selectivity(None, 1, ">", 0) == 0.5
    assert statistics.join_selectivity(4, 10) == 0.1 and statistics.index_pays(0.2) and not statistics.index_pays(0.3)
    assert statistics.best_index({"a": 0.1, "b": 0.05, "c": 0.5}) == "b" and statistics.best_index({"c": 0.5}) is None
    assert statistics.has_compound_index(["a", "b"], ["a"]) and not statistics.has_compound_index(["a"], ["a", "b"])
    many = spark.range(5000).select((F.col("id") % 100).alias("some"), F.col("id").alias("all"), F.lit(1).alias("one"))
    assert [r.column_name for r in statistics.index_advice(statistics.column_statistics(many)).collect()] == ["some"]
    log = spark.createDataFrame([("d", "t", c) for c in "abcdefg" for _ in range(100 + ord(c))] + [("d", "u", "a")] * 99, "db string, tbl string, col string")
    assert sorted(r.col for r in statistics.frequent_predicates(log).collect()) == list("cdefg")


def points(spark, values, kind="LATENCY"):
    rows = [(1000 * i, "c", "op", "n", float(v), "ms", kind) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "timestamp long, component string, operation string, name string, value double, unit string, type string")


def test_metrics(spark):
    p = points(spark, range(100))
    assert metrics.percentiles(p, "value", (0.95, 0.5)).first() == (94.0, 49.0)
    assert metrics.percentiles(p.where("false"), "value", (0.95,)).first() == (0.0,)
    s = metrics.summary(p).first()
    assert (s.min_value, s.max_value, s.n, s.avg_value, s.last_value) == (0.0, 99.0, 100, 49.5, None)
    t = metrics.summary(points(spark, [3, 1, 2], "THROUGHPUT")).first()
    assert (t.min_value, t.last_value) == (None, 2.0)
    rolled = metrics.rollup(p, 10_000).orderBy("bucket").collect()
    assert [r.bucket for r in rolled] == [10_000 * i for i in range(10)] and rolled[1].avg_value == 14.5
    assert metrics.rollup_of_rollup(metrics.rollup(p, 10_000), 50_000).orderBy("bucket").first().avg_value == 24.5
    slow = metrics.latency_bottlenecks(points(spark, [150, 250])).first()
    assert slow.avg_value == 200.0 and slow.severity == 0.5
    assert metrics.latency_bottlenecks(points(spark, [100])).count() == 0
    assert metrics.alerts(points(spark, [81, 80], "CPU_USAGE")).count() == 1
    assert math.isclose(metrics.throughput(p).first()[0], 100 / 99) and metrics.throughput(points(spark, [1])).first()[0] == 0.0
    assert math.isclose(metrics.deviation(points(spark, [1, 3]), "value").first()[0], 1.0)
    assert metrics.within(p, 5000, 7000).count() == 3 and metrics.retained(p, 8 * scalars.DAY_MS, 7).count() == 0


def test_percentiles_of_large_groups(spark):
    rng = random.Random(3)
    rows = [("a", rng.gauss(0, 100)) for _ in range(4000)] + [("b", float(rng.randint(0, 3))) for _ in range(3000)] + [(None, rng.random()) for _ in range(900)] + [("few", 1.0), ("few", 5.0), ("none", None), ("odd", float("inf"))] + [("odd", float(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    shares = (0.01, 0.5, 0.95, 1.0)
    whole = metrics.percentiles(df, "v", shares, ("g",), most=10**9)
    cut = metrics.percentiles(df, "v", shares, ("g",), most=50)
    key = lambda r: (r[0] is not None, r[0])
    assert sorted(map(tuple, cut.collect()), key=key) == sorted(map(tuple, whole.collect()), key=key)
    all_ = df.where("g <> 'odd'")
    assert metrics.percentiles(all_, "v", shares, most=50).collect() == metrics.percentiles(all_, "v", shares, most=10**9).collect()


def test_regressions(spark):
    make = lambda *v: spark.createDataFrame([("b", m, x) for m, x in v], "bench string, metric string, value double")
    base = make(("latency", 100.0), ("throughput", 100.0), ("other", 100.0), ("memory_used", 0.0), ("gone", 1.0))
    now = make(("latency", 111.0), ("throughput", 91.0), ("other", 85.0), ("memory_used", 0.0), ("new", 1.0))
    got = {r.metric: (r.regressed, r.change_percent) for r in metrics.regressions(base, now, 10).collect()}
    assert got == {"latency": (True, 11.0), "throughput": (False, 9.0), "other": (True, 15.0), "memory_used": (False, 0.0)}
    runs = spark.createDataFrame([("b", f"r{i}", float(i)) for i in range(8)], "bench string, run string, value double")
    assert [r.run for r in metrics.trend(runs, 3).collect()] == [r.run for r in metrics.trend(runs, 3, ("bench",)).collect()] == ["r5", "r6", "r7"]
    assert metrics.latest_run(runs, ("bench",)).first().value == 7.0


def test_log_structured_tables(spark):
    log = spark.createDataFrame([("a", "1", 1, "PUT"), ("a", "2", 2, "PUT"), ("b", "1", 3, "PUT"), ("b", None, 4, "DELETE"), ("c", None, 5, "DELETE"), ("c", "9", 6, "PUT")], "key string, value string, seq long, op string")
    assert sorted(map(tuple, versions.live(log).collect())) == [("a", "2"), ("c", "9")]
    assert versions.get(log, "b").count() == 0 and versions.get(log, "a").first().value == "2"
    base = spark.createDataFrame([("a", "0"), ("z", "z")], "key string, value string")
    assert sorted(map(tuple, versions.replay(base, log).collect())) == [("a", "2"), ("c", "9"), ("z", "z")]
    merged = versions.merge_runs([log.where("seq > 3"), log.where("seq <= 3")])
    assert sorted((r.key, r.seq) for r in merged.collect()) == [("a", 2), ("c", 6)]
    assert versions.merge_runs([log], keep_tombstones=True).count() == 3
    assert versions.latest_ranked(log, ["key"], [F.col("seq").desc()]).count() == 3


def test_blooms(spark):
    big, small = spark.range(10_000).withColumnRenamed("id", "k"), spark.range(0, 10_000, 1000).withColumnRenamed("id", "k")
    kept = {r.k for r in blooms.prune_before_join(big, small, "k").collect()}
    assert {r.k for r in small.collect()} <= kept and len(kept) < 3000
    assert blooms.hashes_for(1000, 10_000) == 7 and 0.005 < blooms.false_positive_rate(1000, 10_000, 7) < 0.01
    assert 9000 < blooms.bits_for(1000, 0.01) < 10_000


def test_scalars(spark):
    row = spark.range(1).select(scalars.severity(F.lit(300.0), 100).alias("a"), scalars.severity(F.lit(90.0), 100).alias("b"), scalars.percent_difference(F.lit(0.0), F.lit(1.0)).alias("c"), scalars.bucket(F.lit(-1), 10).alias("d"), scalars.format_time(F.lit(0)).alias("e"), scalars.human_bytes(F.lit(1536)).alias("f"), scalars.human_bytes(F.lit(5)).alias("g")).first()
    assert tuple(row) == (1.0, 0.0, 100.0, -10, "1970-01-01 00:00:00", "1.50 KB", "5 B")
    assert [scalars.unquote_identifier(x) for x in ('"A"', "`b`", "[C]", "d")] == ["a", "b", "c", "d"]
    assert [scalars.unquote_literal(x) for x in ("'a''b'", '"c"', "d", "'")] == ["a'b", "c", "d", "'"]


def test_documents(spark):
    rows = spark.createDataFrame([('{"id": "x", "a": 1, "n": {"m": [1]}}',), ('{"a": "2", "b": null}',), ("[1]",), ("no json",), (None,)], "value string")
    docs = documents.from_json(rows).cache()
    assert docs.count() == 2 and docs.where("__uuid = 'x'").count() == 1
    assert sorted(r.a for r in documents.to_columns(docs, {"a": "string"}).collect()) == ["1", "2"]
    assert docs.where(documents.has("b")).count() <= 1 and docs.where(documents.has("n")).count() == 1
    put = documents.put(docs, "a", F.lit(7))
    assert {r.a for r in documents.to_columns(put, {"a": "int"}).collect()} == {7}
    assert documents.remove(put, "a").where(documents.has("a")).count() == 0
    assert any('"n":{"m":[1]}' in r.value and '"__uuid":"x"' in r.value for r in documents.to_json(put).collect())


def test_files(spark, tmp_path):
    n = spark.createDataFrame([(1, "a"), (2, None), (3, 'c,"d"')], "k int, v string")
    tables.write_csv(n, str(tmp_path / "csv"))
    assert {tuple(r) for r in tables.read_csv(spark, str(tmp_path / "csv"), "k int, v string").collect()} == {tuple(r) for r in n.collect()}
    tables.append_json_lines(n, str(tmp_path / "json"))
    tables.append_json_lines(n, str(tmp_path / "json"), "gzip")
    assert tables.read_json_lines(spark, str(tmp_path / "json"), "k int, v string").count() == 6
    tables.write_parquet(n, str(tmp_path / "p"), "gzip", sort_by=["k"], bloom_by=["v"], partition_by=[])
    assert tables.read_parquet(spark, str(tmp_path / "p")).count() == 3
    with pytest.raises(ValueError):
        tables.write_parquet(n, str(tmp_path / "q"), "rar")
    tables.write_json(n, str(tmp_path / "j"))
    p = points(spark, [1, 2, 3])
    tables.write_metrics(p, str(tmp_path / "m"))
    assert [r.value for r in tables.read_metrics(spark, str(tmp_path / "m"), "c.op.n", 1000, 2000).orderBy("timestamp").collect()] == [2.0, 3.0]


def test_columns_of_a_frame(people):
    more = relational.add_column(people, "z", "int")
    assert more.schema["z"].dataType == T.IntegerType() and relational.drop_column(more, "Z").columns == people.columns


def test_streamed_rollup_drops_late_points(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    make = lambda rows: spark.createDataFrame(rows, "ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    stream = lambda: rollups.rollup_stream(spark.readStream.schema("ts timestamp, value double").parquet(src)).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).format("parquet").start(out).awaitTermination()
    make([("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 3.0), ("2024-01-01 02:00:00", 9.0)]).write.mode("append").parquet(src)
    stream()
    make([("2024-01-01 00:20:00", 100.0), ("2024-01-01 05:00:00", 1.0)]).write.mode("append").parquet(src)
    stream()
    got = {str(r.bucket): (r.min_value, r.max_value, r.avg_value, r.n) for r in spark.read.parquet(out).collect()}
    assert got["2024-01-01 00:00:00"] == (1.0, 3.0, 2.0, 2)


def test_streamed_changes(spark, tmp_path):
    from duskline.plans.catalog import Catalog

    catalog = Catalog(spark, str(tmp_path / "catalog"))
    catalog.create_database("d")
    catalog.create_table("d", "t", [("key", "varchar"), ("value", "varchar"), ("seq", "bigint"), ("op", "varchar")])
    schema, src = "key string, value string, seq long, op string", str(tmp_path / "in")
    for rows in ([("a", "1", 1, "PUT"), ("b", "1", 2, "PUT")], [("a", "2", 3, "PUT"), ("b", None, 4, "DELETE")], [("b", "old", 1, "PUT")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        changes.apply_changes(spark.readStream.schema(schema).parquet(src), catalog, "d", "t").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert [(r.key, r.value) for r in changes.current(catalog, "d", "t").collect()] == [("a", "2")] and len(catalog.manifest("d", "t").parts) > 1
    changes.purge(catalog, "d", "t")
    assert [(r.key, r.value) for r in catalog.read("d", "t").collect()] == [("a", "2")]
