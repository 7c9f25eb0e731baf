"""Statements, session commands and catalog operators as queries, each beside the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars
from .operators import blooms, relational, statistics
from .plans.cache import ResultCache
from .plans.engine import FROM_CACHE, Engine
from .queries import _STOP, _done, _engine, _scratch, query, table
from .sources import documents, tables
from .streaming import actions


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def _new(spark, allow=False):
    return Engine(spark, _scratch(spark, "catalog"), allow_delete_everything=allow)


@query("select event_id from events where value is not null")
def index_full_scan(spark, d):
    """All rows that an ordered index holds: those with a value."""
    return relational.in_range(table(spark, d, "events"), "value").select("event_id")


@query("select n_nationkey, n_name from nation where n_regionkey = 1")
def export_csv(spark, d):
    e, path = _engine(spark, d, "nation"), _scratch(spark, "export")
    _done([e.export("select n_nationkey, n_name from shop.nation where n_regionkey = 1", path)])
    return tables.read_csv(spark, path, "n_nationkey int, n_name string, __uuid string").drop("__uuid")


@query("select c_custkey, c_name from customer where c_acctbal > 5000")
def export_json(spark, d):
    e, path = _engine(spark, d, "customer"), _scratch(spark, "export")
    _done([e.export("select c_custkey, c_name from shop.customer where c_acctbal > 5000", path, "json")])
    return tables.read_json_lines(spark, path, "c_custkey long, c_name string")


@query("select * from (values (1, true, 0), (2, true, 1), (3, true, 0), (4, true, 2), (5, false, 0)) as t(statement, executed, n_rows)")
def script_statements(spark, d):
    """A script is split at semicolons outside quotes; one result for each statement, failed ones among them."""
    e = _new(spark)
    found = e.query("create database s; insert into s.t (a, b) values ('x;y', 1) ;; create table s.u; insert into s.t (a) values ('it''s; so'), ('z'); select a from s.none")
    return _rows(spark, [(i, r.executed, r.details.get("rows", 0)) for i, r in enumerate(found, 1)], "statement int, executed boolean, n_rows int")


@query("select n_nationkey, lower(n_name) as name, n_comment as comment from (select n_nationkey, n_name, 'it''s ' || n_name as n_comment from nation)")
def unquoting(spark, d):
    """Identifiers in double quotes, back quotes and brackets; literals with doubled quotes inside."""
    named = table(spark, d, "nation").select("n_nationkey", "n_name").collect()  # the 25 fixed nations
    quotes = [('"', '"'), ("`", "`"), ("[", "]"), ("", "")]
    rows = []
    for r in named:
        a, b = quotes[r.n_nationkey % 4]
        rows.append((r.n_nationkey, scalars.unquote_identifier(f" {a}{r.n_name}{b} "), scalars.unquote_literal(f"'it''s {r.n_name}'")))
    return _rows(spark, rows, table(spark, d, "nation").select("n_nationkey").schema.add("name", "string").add("comment", "string"))


@query("select count(*) as n_rows, count(*) as n_ids, 36 as shortest, 36 as longest from nation")
def row_uuids(spark, d):
    """Inserted rows get a UUID each."""
    own = _done(_engine(spark, d, "nation").query("select __uuid from shop.nation"))
    return own.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("__uuid").alias("n_ids"), F.min(F.length("__uuid")).alias("shortest"), F.max(F.length("__uuid")).alias("longest"))


@query("select count(*) as n, true as recent from nation")
def now_literal(spark, d):
    e = _engine(spark, d, "nation")
    own = _done(e.query("alter table shop.nation add column at timestamp; update shop.nation set at = current_timestamp(); select at from shop.nation"))
    return own.agg(F.count("at").alias("n"), F.max(F.abs(F.unix_timestamp("at") - F.unix_timestamp(F.current_timestamp()))).__lt__(3600).alias("recent"))


@query("select * from (values ('kept'), ('shop')) as t(\"database\")")
def databases_created_and_dropped(spark, d):
    e = _engine(spark, d)
    return _done(e.query("create database kept; create database gone; drop database gone; show databases"))


@query("select * from (values ('shop', 'nation'), ('shop', 'region')) as t(\"database\", \"table\")")
def tables_of_a_database(spark, d):
    return _done(_engine(spark, d, "nation", "region").query("create table shop.gone; drop table shop.gone; show shop tables"))


@query("select * from (values ('other', 't'), ('shop', 'nation')) as t(\"database\", \"table\")")
def tables_of_all_databases(spark, d):
    return _done(_engine(spark, d, "nation").query("create database other; create table other.t; show tables"))


@query("select * from (values ('n_nationkey', 'index'), ('n_name', ''), ('n_regionkey', 'index')) as t(\"column\", indexes)")
def describe_table(spark, d):
    return _done(_engine(spark, d, "nation").query("create index on shop.nation(n_regionkey, n_nationkey); describe table shop.nation")).select("column", "indexes")


@query("select * from (values ('shop', 'nation', 4, 1), ('shop', 'region', 3, 1)) as t(\"database\", \"table\", n_columns, n_parts)")
def describe_database(spark, d):
    return _done(_engine(spark, d, "nation", "region").query("describe database shop")).select("database", "table", "n_columns", "n_parts")


@query("select n_nationkey, cast(null as bigint) as rank from nation")
def alter_table(spark, d):
    e = _engine(spark, d, "nation")
    return _done(e.query("alter table shop.nation add column rank bigint; alter table shop.nation drop column n_name; select n_nationkey, rank, n_name from shop.nation")).drop("__uuid")


@query("select * from (values ('refused', 1), ('allowed', 0)) as t(engine, n_databases)")
def delete_everything(spark, d):
    """The statement is refused unless the engine allows it."""
    rows = []
    for name, e in (("refused", _new(spark)), ("allowed", _new(spark, allow=True))):
        e.query("create database a; create table a.t; delete everything")
        rows.append((name, e.query("show databases")[0].df.count()))
    return _rows(spark, rows, "engine string, n_databases int")


@query("select * from (values ('shop', 'nation', 'n_name'), ('shop', 'region', 'r_name')) as t(\"database\", \"table\", \"column\")")
def fulltext_indexes(spark, d):
    e = _engine(spark, d, "nation", "region")
    statements = "create fulltext index on shop.nation(n_name); create fulltext index on shop.region(r_name, r_regionkey); drop fulltext index on shop.region(r_regionkey); show fulltext indexes"
    return _done(e.query(statements))


@query("select * from (values ('shop', 'customer', 'c_custkey'), ('shop', 'customer', 'c_nationkey, c_name')) as t(\"database\", \"table\", \"columns\")")
def indexes_created_and_dropped(spark, d):
    e = _engine(spark, d, "customer")
    return _done(e.query("create index on shop.customer(c_custkey); create index on shop.customer(c_nationkey, c_name); create index on shop.customer(c_name); drop index on shop.customer(c_name); show indexes"))


_CHANGED = "(select doc_id, case when doc_id % 10 = 3 then 'ouen un changed text' else text end as text from documents where doc_id % 10 <> 4 union all select -1, 'ouen ouen new')"
_CATALOG_TFIDF = rf"""with t as (select doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+'), lambda x: x not in ({_STOP})) as w from {_CHANGED}),
tf as (select doc_id, len(list_filter(w, lambda x: x = q)) / len(w) as tf, q from t, (values ('un'), ('ouen')) as v(q) where len(w) > 0),
idf as (select q, ln((select count(*) from t where len(w) > 0) / count(*)) as idf from tf where tf > 0 group by q)
select doc_id, round(sum(tf * idf), 8) as __relevance from tf join idf using (q) where tf > 0 group by doc_id"""


def _ten(spark, d):
    """The table documents in a catalog, with the last digit of its ids as a column."""
    e = _engine(spark, d)
    e.catalog.append("shop", "documents", table(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 10).alias("digit")))
    return e


@query(_CATALOG_TFIDF)
def fulltext_index_maintained(spark, d):
    """CONTAINS over the catalog's own full-text index after an insert, an update and a delete."""
    e = _ten(spark, d)
    statements = "create fulltext index on shop.documents(text); insert into shop.documents (doc_id, text) values (-1, 'ouen ouen new'); update shop.documents set text = 'ouen un changed text' where digit = 3; delete from shop.documents where digit = 4; select doc_id from shop.documents where text contains 'the UN ouen'"
    found = _done(e.query(statements))
    return found.select("doc_id", F.round("__relevance", 8).alias("__relevance"))


@query(_CATALOG_TFIDF.replace(_CHANGED, "documents"))
def fulltext_index_rebuilt(spark, d):
    e = _ten(spark, d)
    _done(e.query("create fulltext index on shop.documents(text)"))
    e.catalog.rebuild_fulltext_index("shop", "documents")
    return _done(e.query("select doc_id from shop.documents where text contains 'the UN ouen'")).select("doc_id", F.round("__relevance", 8).alias("__relevance"))


@query("select * from (values ('a, b', true), ('a, c', false), ('b', true)) as t(columns, held)")
def compound_index_held(spark, d):
    return _rows(spark, [(", ".join(c), statistics.has_compound_index(("a", "b"), c)) for c in (["a", "b"], ["a", "c"], ["b"])], "columns string, held boolean")


@query("select * from (values ('other', 0), ('shop', 2)) as t(\"database\", n_tables)")
def catalog_meta(spark, d):
    e = _engine(spark, d, "nation", "region")
    e.catalog.create_database("other")
    return _rows(spark, [(db, len(names)) for db, names in e.catalog.meta().items()], "database string, n_tables int")


@query("select * from (values (1, true, 'medium'), (2, false, 'medium'), (3, false, 'high'), (4, true, 'high')) as t(step, enabled, level)")
def optimization_commands(spark, d):
    e, before = _new(spark), {k: spark.conf.get(k) for k in ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled", "spark.sql.adaptive.enabled")}
    rows = []
    try:
        for i, s in enumerate(("optimization status", "optimization disable", "optimization level high", "optimization enable"), 1):
            e.query(s)
            rows.append((i, *e.query("optimization status")[0].df.first()))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return _rows(spark, rows, "step int, enabled boolean, level string")


@query("select * from (values ('first', false, 0), ('again', true, 1), ('after a write', false, 1), ('disabled', false, 1)) as t(step, from_cache, hits)")
def result_cache(spark, d):
    e, rows = _engine(spark, d, "region"), []

    def ask(step):
        r = e.query("select count(*) as n from shop.region")[0]
        rows.append((step, r.explain == FROM_CACHE, e.cache.hits))

    ask("first")
    ask("again")
    e.query("insert into shop.region (r_name) values ('LEMURIA')")
    ask("after a write")
    e.query("cache disable")
    ask("disabled")
    return _rows(spark, rows, "step string, from_cache boolean, hits int")


@query("select * from (values ('a', false), ('b', false), ('c', true), ('d', true)) as t(key, held)")
def result_cache_limits(spark, d):
    """Two entries at most, ten seconds each: the least recently used goes first, and what is too old."""
    now = [0.0]
    cache, df = ResultCache(2, 10, lambda: now[0]), spark.range(1)
    for k in "abc":
        cache.put(k, df, False)
        now[0] += 4
    now[0] = 11.0  # b is 7 seconds old, c 3
    cache.get("c")
    cache.put("d", df, False)
    rows = [(k, cache.get(k) is not None) for k in "abcd"]
    return _rows(spark, rows, "key string, held boolean")


@query("select 'n_nationkey' as column_name, count(*) as n_rows, count(n_nationkey) as n_values, cast(min(n_nationkey) as varchar) as min_value, cast(max(n_nationkey) as varchar) as max_value from nation union all select 'n_regionkey', count(*), count(n_regionkey), cast(min(n_regionkey) as varchar), cast(max(n_regionkey) as varchar) from nation")
def statistics_collected(spark, d):
    return _done(_engine(spark, d, "nation").query("statistics collect")).where("column_name in ('n_nationkey', 'n_regionkey')").select("column_name", "n_rows", "n_values", "min_value", "max_value")


@query("select 1 as run, c_custkey from customer where c_nationkey = 4 and c_acctbal > 1000 union all select 2, c_custkey from customer where c_nationkey = 7 and c_acctbal > 9000")
def prepared_statement(spark, d):
    e = _engine(spark, d, "customer")
    p = e.prepare("select c_custkey from shop.customer where c_nationkey = ? and c_acctbal > ?")
    runs = [_done([p.execute(*v)]).drop("__uuid").select(F.lit(i).alias("run"), "c_custkey") for i, v in enumerate(((4, 1000), (7, 9000)), 1)]
    return runs[0].unionAll(runs[1])


@query("select true as scans, true as pushed, true as pruned")
def explain_statement(spark, d):
    own = _done(_engine(spark, d, "orders").query("explain select o_orderkey from shop.orders where o_orderstatus = 'F'"))
    plan = F.concat_ws("\n", F.collect_list("plan"))
    return own.agg(plan.contains("Scan parquet").alias("scans"), plan.contains("EqualTo(o_orderstatus,F)").alias("pushed"), (~plan.contains("o_comment")).alias("pruned"))


@query("select count(*) as n_rows, true as timed from orders where o_totalprice > 100000")
def execution_metrics(spark, d):
    made = _engine(spark, d, "orders").query("select o_orderkey from shop.orders where o_totalprice > 100000")[0].measured()
    return _rows(spark, [(made["rows"], made["runtime_ms"] >= 0)], "n_rows long, timed boolean")


@query("select event_id, event_type as kind, user_id from events where event_id % 3 = 0 union all select event_id, 'none', null from events where event_id % 3 <> 0")
def json_put_remove(spark, d):
    """Semi-structured documents with fields set and taken away."""
    docs = table(spark, d, "events").select("event_id", F.parse_json(F.to_json(F.struct("event_type", "user_id"))).alias("doc"))
    third = F.col("event_id") % 3 == 0
    changed = documents.put(documents.remove(docs.where(~third), "user_id"), "event_type", F.lit("none"))
    both = docs.where(third).unionAll(changed.select("event_id", "doc"))
    return both.select("event_id", documents.field("event_type").alias("kind"), documents.field("user_id", "long").alias("user_id"))


@query("select o_orderkey, case when o_orderstatus = 'P' then 'MERGED' else o_orderstatus end as status from orders union all select cast(-1 - n_nationkey as bigint), 'NEW' from nation")
def merge_rows(spark, d):
    """Changed orders and new ones, merged into the table by key."""
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"))
    changed = orders.where("status = 'P'").withColumn("status", F.lit("MERGED"))
    new = table(spark, d, "nation").select((-1 - F.col("n_nationkey")).cast("long").alias("o_orderkey"), F.lit("NEW").alias("status"))
    return relational.merge(orders, changed.unionByName(new), ["o_orderkey"])


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 400000) or c_acctbal > 9000")
def subquery_under_or(spark, d):
    e = _engine(spark, d, "customer", "orders")
    return _done(e.query("select c_custkey from shop.customer where c_custkey in (select o_custkey from shop.orders where o_totalprice > 400000) or c_acctbal > 9000")).drop("__uuid")


@query("select c_custkey from customer where not (c_custkey in (select o_custkey from orders where o_orderstatus = 'P') and c_acctbal > 0) and c_nationkey < 20")
def subquery_under_not(spark, d):
    e = _engine(spark, d, "customer", "orders")
    return _done(e.query("select c_custkey from shop.customer where not (c_custkey in (select o_custkey from shop.orders where o_orderstatus = 'P') and c_acctbal > 0) and c_nationkey < 20")).drop("__uuid")


@query("select c_custkey, case when c_custkey in (select o_custkey from orders where o_totalprice > 400000) then 'BIG' else c_mktsegment end as c_mktsegment from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def subquery_in_changes(spark, d):
    e = _engine(spark, d, "customer", "orders")
    statements = "update shop.customer set c_mktsegment = 'BIG' where c_custkey in (select o_custkey from shop.orders where o_totalprice > 400000); delete from shop.customer where c_custkey in (select o_custkey from shop.orders where o_orderstatus = 'P'); select c_custkey, c_mktsegment from shop.customer"
    return _done(e.query(statements)).drop("__uuid")


@query("select n_nationkey, case when n_nationkey % 2 = 0 then 'EVEN' else n_name end as n_name from nation where n_nationkey <> 5")
def odd_paths_are_changed(spark, d):
    """UPDATE and DELETE below a root with a space, a per cent sign and letters beyond ASCII."""
    e = Engine(spark, _scratch(spark, "a root, 100%25 añb"))
    e.catalog.create_database("shop")
    e.catalog.append("shop", "nation", table(spark, d, "nation").withColumn("even", F.col("n_nationkey") % 2 == 0))
    return _done(e.query("update shop.nation set n_name = 'EVEN' where even = true; delete from shop.nation where n_nationkey = 5; select n_nationkey, n_name from shop.nation")).drop("__uuid")


@query("select 0 as missed, true as within, true as small")
def bloom_filter(spark, d):
    """A filter of dear orders tested with all orders: none of its own is missed, and others pass about as seldom as asked."""
    orders = table(spark, d, "orders")
    own = orders.where("o_totalprice > 300000")
    f = blooms.create(own, "o_orderkey", 0.01)
    hit = orders.select((F.col("o_totalprice") > 300000).alias("member"), blooms.might_contain(f, F.col("o_orderkey")).alias("hit"))
    passing, others = F.count_if(F.col("hit") & ~F.col("member")), F.count_if(~F.col("member"))
    return hit.agg(F.count_if(F.col("member") & ~F.col("hit")).cast("int").alias("missed"), (passing <= others * 0.02 + 2).alias("within"), F.lit(f.n_bytes <= 2 * (f.n * 9.6 / 8 + 8)).alias("small"))


@query("select key, value from (select *, row_number() over (partition by key order by seq desc) as r from (select user_id as key, event_type as value, event_id as seq, case when event_type = 'logout' then 'delete' else 'update' end as op from events where event_id > 100)) where r = 1 and op = 'update'")
def replayed_actions(spark, d):
    """A log of definitions and changes of rows, replayed onto an empty catalog."""
    e = _new(spark)
    rows = table(spark, d, "events").where("event_id > 100")
    kind = F.when(F.col("event_type") == "logout", "delete").when(F.col("event_id") % 2 == 0, "insert").otherwise("update")
    some = rows.select((F.col("event_id") + 10).alias("seq"), kind.alias("kind"), F.lit("shop").alias("db"), F.lit("t").alias("table"), F.col("user_id").cast("string").alias("row_id"), F.create_map(F.lit("value"), F.col("event_type")).alias("values"))
    first = [(-9, "create_database", "old", None), (-8, "create_table", "old", "t"), (-7, "delete_everything", None, None), (-6, "create_database", "shop", None), (-5, "create_table", "shop", "t"), (-4, "create_table", "shop", "gone"), (-3, "drop_table", "shop", "gone"), (-2, "create_database", "gone", None), (-1, "drop_database", "gone", None)]
    log = spark.createDataFrame(first, "seq long, kind string, db string, table string").selectExpr("*", "cast(null as string) as row_id", "cast(null as map<string, string>) as values").unionByName(some)
    actions.replay(e.catalog, log)
    return e.catalog.read("shop", "t").select(F.col("__uuid").cast("int").alias("key"), "value").withColumn("key", F.col("key").cast(rows.schema["user_id"].dataType))
