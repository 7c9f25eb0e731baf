"""Statements end to end: definitions, changes, queries, session commands, errors."""

from __future__ import annotations

import pytest
from duskline.plans import grammar
from duskline.plans.cache import ResultCache
from duskline.plans.catalog import Conflict, Manifest
from duskline.plans.engine import FROM_CACHE, Engine


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "catalog"))
    ok(e, "create database d")
    return e


@pytest.fixture
def people(engine):
    ok(engine, "insert into d.people (id, name, age) values ('1', 'Alice', 25), ('2', 'Bob', 30), ('3', 'Charlie', 35)")
    return engine


def ok(engine, script):
    for text in grammar.split_script(script):
        (r,) = engine.query(text)
        assert r.executed and r.error is None, f"{text}: {r.error}"
    return [{k: v for k, v in row.items() if not k.startswith("__")} for row in r.rows()]


def error(engine, text):
    (r,) = engine.query(text)
    assert not r.executed and r.df is None
    return r.error


def test_create_insert_select_update_delete(engine):
    ok(engine, "create table d.t; insert into d.t (name, value) values('Test','42')")
    assert ok(engine, "select * from d.t where name='Test'") == [{"name": "Test", "value": "42"}]
    ok(engine, "update d.t set value='43' where name = 'Test'")
    assert ok(engine, "select value from d.t where name = 'Test'") == [{"value": "43"}]
    ok(engine, "delete d.t where name='Test'")
    assert ok(engine, "select * from d.t") == []


def test_literals_keep_their_case_and_names_do_not(engine):
    ok(engine, "INSERT INTO D.T (NAME) VALUES ('MiXed')")
    assert ok(engine, "Select name From d.T Where NAME = 'MiXed'") == [{"name": "MiXed"}]
    assert ok(engine, "select name from d.t where name = 'mixed'") == []


def test_all_matches_are_found_updated_and_deleted(people):
    assert len(ok(people, "select * from d.people where age > 20")) == 3
    (r,) = people.query("update d.people set age = 1 where age >= 30")
    assert r.details["rows"] == 2
    (r,) = people.query("delete from d.people where age = '1'")
    assert r.details["rows"] == 2
    assert ok(people, "select name from d.people") == [{"name": "Alice"}]
    ok(people, "delete from d.people")
    assert ok(people, "select * from d.people") == []


def test_every_comparison(people):
    ages = lambda where: sorted(r["age"] for r in ok(people, f"select age from d.people where {where}"))
    assert ages("age = 30") == ages("age = '30'") == [30]
    assert ages("age <> 30") == ages("age != 30") == [25, 35]
    assert ages("age > 25") == [30, 35] and ages("age >= 30") == [30, 35]
    assert ages("age < 30") == [25] and ages("age <= 30") == [25, 30]
    assert ages("age between 25 and 30") == [25, 30]
    assert ages("age in (25, 35)") == [25, 35] and ages("age not in (25, 35)") == [30]
    assert ages("name like 'li'") == [25, 35] and ages("name like 'A%'") == [25]
    assert ages("name regex '^[AB]'") == [25, 30]
    assert ages("name = 'Bob' or age > 30") == [30, 35] and ages("not (name = 'Bob')") == [25, 35]
    assert ages("age < 3000000000") == [25, 30, 35]
    assert ages("no_such = 1") == [] and ages("no_such is null") == [25, 30, 35]
    assert ages("name is not null and age is not null") == [25, 30, 35]


def test_order_limit_offset(people):
    names = lambda rest: [r["name"] for r in ok(people, f"select name from d.people {rest}")]
    assert names("order by age") == ["Alice", "Bob", "Charlie"]
    assert names("order by age desc limit 2") == ["Charlie", "Bob"]
    assert names("order by age limit 2 offset 1") == names("order by age limit 1, 2") == ["Bob", "Charlie"]
    assert names("order by age limit invalid") == ["Alice", "Bob", "Charlie"]
    assert names("order by age limit 2 offset invalid") == ["Alice", "Bob"]
    assert names("where age > 20 order by name desc limit 1") == ["Charlie"]


def test_groups_and_distinct(people):
    ok(people, "insert into d.people (id, name, age) values ('4', 'Bob', 50)")
    assert ok(people, "select name, count(*) as n, sum(age) as total, avg(age) as mean, min(age) as lo, max(age) as hi from d.people group by name having count(*) > 1") == [{"name": "Bob", "n": 2, "total": 80, "mean": 40.0, "lo": 30, "hi": 50}]
    assert ok(people, "select count(distinct name) as n from d.people") == [{"n": 3}]
    assert ok(people, "select distinct name from d.people order by name") == [{"name": "Alice"}, {"name": "Bob"}, {"name": "Charlie"}]
    assert "GROUP BY" in error(people, "select age, count(*) from d.people group by name")


def test_joins(people):
    ok(people, "insert into d.orders (id, user_id, total) values ('o1', '1', 999.99), ('o2', '2', 999.98)")
    assert ok(people, "select p.name, o.total from d.people p join d.orders o on p.id = o.user_id order by p.name") == [{"name": "Alice", "o_total": 999.99}, {"name": "Bob", "o_total": 999.98}]
    assert len(ok(people, "select * from d.people p left join d.orders o on o.user_id = p.id")) == 3
    assert len(ok(people, "select * from d.people p right join d.orders o on o.user_id = p.id")) == 2
    assert len(ok(people, "select * from d.people p full join d.orders o on o.user_id = p.id")) == 3
    assert len(ok(people, "select * from d.people, d.orders")) == 6
    assert len(ok(people, "select * from d.people p join d.orders o on p.age = o.user_id")) == 0
    assert ok(people, "select name from d.people where id in (select user_id from d.orders where total > 999.985)") == [{"name": "Alice"}]
    assert [r["name"] for r in ok(people, "select name from d.people where id not in (select user_id from d.orders)")] == ["Charlie"]


def test_set_operations(people):
    assert len(ok(people, "select name from d.people union select name from d.people")) == 3
    assert len(ok(people, "select name from d.people union all select name from d.people")) == 6
    assert ok(people, "select name from d.people intersect select name from d.people where age = 30") == [{"name": "Bob"}]
    assert len(ok(people, "select name from d.people except select name from d.people where age = 30")) == 2


def test_search_with_and_without_an_index(engine):
    rows = [("1", "Senior software engineer with 10 years of experience"), ("2", "Junior software developer with 2 years of experience"), ("3", "Product manager with background in software development"), ("4", "UX designer with focus on user research")]
    for i, text in rows:
        ok(engine, f"insert into d.p (id, description) values ('{i}', '{text}')")
    assert sorted(r["id"] for r in ok(engine, "select id from d.p where description contains 'software'")) == ["1", "2", "3"]
    ok(engine, "create fulltext index on d.p(description)")
    (r,) = engine.query("select id from d.p where description contains 'software'")
    found = r.rows()
    assert found[0]["id"] == "3" and round(found[0]["__relevance"], 6) == 0.057536 and round(found[1]["__relevance"], 6) == 0.047947
    ok(engine, "insert into d.p (id, description) values ('5', 'software'); delete from d.p where id = '2'")
    assert sorted(r["id"] for r in ok(engine, "select id from d.p where description contains 'software'")) == ["1", "3", "5"]
    assert ok(engine, "show fulltext indexes in d") == [{"database": "d", "table": "p", "column": "description"}]
    assert "already exists" in error(engine, "create fulltext index on d.p(description)")
    ok(engine, "drop fulltext index on d.p(description)")
    assert ok(engine, "show fulltext indexes") == []


def test_a_changed_index_is_as_a_new_one(engine, spark):
    """After each change CONTAINS ranks as over an index made anew, and the postings of rows that do not match stay."""
    rows = spark.range(0, 300, 1, 4).selectExpr("id", "id % 10 as digit", "case when id % 7 = 0 then null else concat_ws(' ', 'tok', concat('w', id % 5), if(id % 3 = 0, 'ouen', 'un')) end as text", "concat('n', id % 4) as note")
    engine.catalog.append("d", "t", rows)
    ok(engine, "create fulltext index on d.t(text, note)")
    ask = lambda: [{r["id"]: round(r["__relevance"], 9) for r in engine.query(f"select id from d.t where {c}")[0].rows()} for c in ("text contains 'ouen W1 new'", "note contains 'n2 w1'")]
    own = lambda c: [s for s in engine.catalog.manifest("d", "t").segments if s[0] == c]
    first, changes = {c: own(c) for c in ("text", "note")}, [
        "insert into d.t (id, digit, text) values (-1, 4, 'ouen ouen new'), (-2, 5, null)",
        "update d.t set text = 'ouen un new' where digit = 3",
        "update d.t set text = 'ouen again' where digit = 3 and id < 100",
        "update d.t set digit = 4 where digit = 5",
        "delete from d.t where digit = 4",
        "update d.t set text = null where text contains 'w2'",
        "update d.t set text = 'w1', note = 'new n2' where digit in (select digit from d.t where id = 6)",
        "delete from d.t where id = 5000",
        "insert into d.t (id, text) values (7000, 'ouen w1 w1')",
        "create index on d.t(digit)",
    ]
    for change in changes:
        ok(engine, change)
        assert all(own(c)[: len(first[c])] == first[c] for c in first), change
        before, m = ask(), engine.catalog.manifest("d", "t")
        engine.catalog.rebuild_fulltext_index("d", "t")
        engine.cache.clear()
        assert before == ask() and before[0], change
        now = engine.catalog.manifest("d", "t")
        engine.catalog._commit("d", "t", now, m)  # the index as it was kept
    engine.catalog.vacuum("d", "t")
    engine.cache.clear()
    assert ask() == before
    ok(engine, "compact d.t")
    engine.cache.clear()
    assert ask() == before and len(own("text")) == 1
    ok(engine, "alter table d.t drop column note; update d.t set text = 'all new'; delete from d.t where id < 0")
    assert len(ok(engine, "select id from d.t where text contains 'new'")) == len(ok(engine, "select id from d.t"))


def test_fuzzy(people):
    (r,) = people.query("select name from d.people where name fuzzy 'alicia'")
    assert [(x["name"], x["__fuzzy_distance"]) for x in r.rows()] == [("Alice", 2)]


def test_a_bad_pattern_is_an_error(people):
    assert "regular expression" in error(people, "select * from d.people where name regex '['")


@pytest.mark.parametrize("text", ["select", "select *", "select * from", "select * from people", "insert into d.people", "insert into d.people (a) values (1, 2)", "update d.people", "delete", "drop", "create table people", "select * from d.people where", "select * from d.people where age >", "nonsense", "select * from d.people where name ~ 'x'", "create table d.x (a nonsense)"])
def test_malformed_statements_are_errors(people, text):
    assert error(people, text)


def test_messages(people):
    assert error(people, "create database d") == "Database 'd' already exists"
    assert error(people, "drop database x") == "Database x does not exist"
    assert error(people, "select name") == "Invalid syntax: SELECT must include FROM clause"
    assert error(people, "select * from people") == "Invalid syntax: FROM clause must be in format <db>.<table>"
    assert error(people, "select * from d.none") == "Table 'none' does not exist"
    assert "already exists" in error(people, "create table d.people") and "does not exist" in error(people, "drop table d.none")


def test_scripts_split_outside_quotes():
    assert grammar.split_script("a;\nb ';' c;; \n ") == ["a", "b ';' c"]
    assert grammar.split_script(" ; ") == []


def test_definitions(engine):
    ok(engine, "create table d.t (a int, b varchar(10), c float, e boolean, f timestamp)")
    ok(engine, "insert into d.t (a, b, c, e, f) values ('7', 8, 1, true, '2024-01-02 03:04:05')")
    assert ok(engine, "select a, b, c, e from d.t") == [{"a": 7, "b": "8", "c": 1.0, "e": True}]
    assert "does not exist" in error(engine, "insert into d.t (z) values (1)")
    assert [(r["column"], r["type"]) for r in ok(engine, "describe table d.t")] == [("a", "int"), ("b", "string"), ("c", "double"), ("e", "boolean"), ("f", "timestamp")]
    ok(engine, "alter table d.t add column g int; alter table d.t drop column b")
    assert ok(engine, "select a, g, b from d.t") == [{"a": 7}]
    assert ok(engine, "describe database d")[0]["table"] == "t"
    ok(engine, "drop table d.t")
    assert ok(engine, "show d tables") == ok(engine, "show tables in d") == []
    assert "not allowed" in error(engine, "delete everything")
    engine.allow_delete_everything = True
    ok(engine, "delete everything")
    assert ok(engine, "show databases") == []


def test_open_tables_widen(engine):
    ok(engine, "insert into d.t (a) values (1); insert into d.t (a, b) values (2.5, 'x'); insert into d.t (a) values ('text')")
    assert sorted(r["a"] for r in ok(engine, "select a from d.t")) == ["1.0", "2.5", "text"]
    assert ok(engine, "select b from d.t where a > 2 and a < 3") == [{"b": "x"}]


def test_indexes(people):
    ok(people, "create index on d.people(age); create index on d.people(name, age)")
    assert "already exists" in error(people, "create index on d.people(age)")
    assert [r["columns"] for r in ok(people, "show indexes on d.people")] == ["age", "name, age"]
    assert ok(people, "select name from d.people where age = 30") == [{"name": "Bob"}]
    ok(people, "drop index on d.people(age); compact d.people")
    assert [r["columns"] for r in ok(people, "show indexes in d")] == ["name, age"]
    assert "does not exist" in error(people, "drop index on d.people(age)")


def test_frequent_filters_register_an_index(people):
    people.cache.enabled = False
    for _ in range(100):
        people._note_filters(grammar.parse("select * from d.people where name = 'Bob'"))
    assert [r["columns"] for r in ok(people, "show indexes on d.people")] == ["name"]


def test_cache(people):
    text = "select count(*) as n from d.people"
    people.query(text)[0].rows()
    (r,) = people.query(text)
    assert r.explain == FROM_CACHE and r.rows() == [{"n": 3}]
    ok(people, "insert into d.people (name) values ('Dora')")
    (r,) = people.query(text)
    assert r.explain is None and r.rows() == [{"n": 4}]
    assert ok(people, "cache stats")[0]["hits"] == 1
    ok(people, "cache clear; cache disable")
    assert ok(people, "cache stats")[0]["entries"] == 0
    ok(people, "cache enable")


def test_cache_limits(spark):
    now = [0.0]
    cache = ResultCache(2, 10, lambda: now[0])
    df = spark.range(1)
    for k in "abc":
        cache.put(k, df, False)
    assert cache.get("a") is None and cache.get("b") is df
    now[0] = 11
    assert cache.get("b") is None and cache.stats()["evicted"] == 1


def test_prepared(people):
    p = people.prepare("select name from d.people where age > ? and name <> ?")
    assert [r["name"] for r in p.execute(26, "Bob").rows()] == ["Charlie"]
    assert [r["name"] for r in p.execute(29, "Charlie").rows()] == ["Bob"]
    assert p.execute(1).error


def test_session_commands(people):
    ok(people, "optimization disable; optimization enable; optimization level high")
    assert ok(people, "optimization status") == [{"enabled": True, "level": "high"}]
    assert "unknown level" in error(people, "optimization level silly")
    stats = {r["column_name"]: r for r in ok(people, "statistics collect")}
    assert stats["age"]["n_rows"] == 3 and stats["age"]["avg_number"] == 30.0
    assert people.index_advice("d", "people").count() == 0
    assert "Scan parquet" in people.query("explain select * from d.people where age > 3")[0].explain


def test_filters_reach_the_scan(people):
    plan = people.query("explain select name from d.people where age = 30 and name = 'Bob'")[0].explain
    assert "EqualTo(age,30)" in plan and "EqualTo(name,Bob)" in plan and "ReadSchema: struct<__uuid:string,name:string,age:bigint>" in plan


def test_two_writers_from_one_version(people):
    m = people.catalog.manifest("d", "people")
    people.catalog._commit("d", "people", m, m)
    with pytest.raises(Conflict):
        people.catalog._commit("d", "people", m, m)
    assert Manifest.read("{" + '"version": 1, "columns": [], "open": true, "parts": [], "format": "parquet", "indexes": [], "fulltext": [], "postings": []' + "}").version == 1


def test_only_parts_with_matches_are_rewritten(people):
    ok(people, "insert into d.people (name, age) values ('Dora', 40)")
    before = people.catalog.manifest("d", "people").parts
    ok(people, "update d.people set age = 41 where name = 'Dora'")
    after = people.catalog.manifest("d", "people").parts
    assert before[0] in after and before[1] not in after
    assert people.catalog.vacuum("d", "people") > 0
    assert len(ok(people, "select * from d.people")) == 4


def test_registered_files(engine, small):
    engine.catalog.register("tpch", "nation", f"{small}/nation.parquet")
    assert ok(engine, "select n_name from tpch.nation where n_nationkey = 3") == [{"n_name": engine.spark.read.parquet(f"{small}/nation.parquet").where("n_nationkey = 3").first().n_name}]
    ok(engine, "update tpch.nation set n_name = 'X' where n_nationkey = 3; delete from tpch.nation where n_nationkey = 4")
    assert len(ok(engine, "select * from tpch.nation")) == 24


@pytest.mark.parametrize("folder", ["with a space", "100%", "per%20cent", "añb 日本", "plain"])
@pytest.mark.parametrize("scheme", ["", "file:", "file://"])
def test_changes_below_odd_roots(spark, tmp_path, folder, scheme):
    e = Engine(spark, f"{scheme}{tmp_path}/{folder}")
    ok(e, "create database d; insert into d.t (x, y) values (1, 'a'), (2, 'b'), (3, 'c')")
    (r,) = e.query("update d.t set y = 'z' where x = 1")
    assert r.error is None and r.details["rows"] == 1
    (r,) = e.query("delete from d.t where x = 2")
    assert r.error is None and r.details["rows"] == 1
    assert sorted((r["x"], r["y"]) for r in ok(e, "select x, y from d.t")) == [(1, "z"), (3, "c")]


def test_only_files_with_matches_are_rewritten(engine, spark):
    engine.catalog.append("d", "t", spark.range(0, 1000, 1, 5).selectExpr("id", "id div 200 as part"))
    before = engine.catalog._files(engine.catalog.manifest("d", "t").parts[0])
    assert len(before) == 5
    (r,) = engine.query("update d.t set part = 9 where id = 500")
    after = engine.catalog.manifest("d", "t").parts
    assert r.details["rows"] == 1 and len(set(before) & set(after)) == 4 and len(after) == 5
    assert engine.catalog.vacuum("d", "t") > 0
    assert len(ok(engine, "select id from d.t")) == 1000 and ok(engine, "select id from d.t where part = 9") == [{"id": 500}]
    ok(engine, "delete from d.t where id < 200; delete from d.t where part = 9")
    assert len(ok(engine, "select id from d.t")) == 799


def test_matches_in_no_file_are_an_error(people, monkeypatch):
    monkeypatch.setattr(type(people.catalog), "_touched", lambda self, m, files: ([], list(m.parts)))
    assert "no file" in error(people, "delete from d.people where age = 30")


def test_subqueries_anywhere(people):
    ok(people, "insert into d.pick (n) values ('Alice'), ('Bob')")
    names = lambda where: sorted(r["name"] for r in ok(people, f"select name from d.people where {where}"))
    assert names("name in (select n from d.pick) or age = 35") == ["Alice", "Bob", "Charlie"]
    assert names("not (name in (select n from d.pick)) or age = 25") == ["Alice", "Charlie"]
    assert names("(name not in (select n from d.pick) or age > 28) and age < 33") == ["Bob"]
    (r,) = people.query("update d.people set age = 1 where name in (select n from d.pick)")
    assert r.details["rows"] == 2
    (r,) = people.query("delete from d.people where age = 35 or name in (select n from d.pick where n = 'Bob')")
    assert r.details["rows"] == 2 and names("age = 1") == ["Alice"]
    assert [c for c in people.catalog.read("d", "people").columns if c.startswith("__")] == ["__uuid"]


def test_a_cut_result_says_so(people):
    (r,) = people.query("select name from d.people")
    assert len(r.rows(2)) == 2 and r.truncated and '"truncated": true' in r.to_json(2)
    assert len(r.rows(3)) == 3 and not r.truncated and "truncated" not in r.to_json() and len(r.rows(None)) == 3


def test_no_exception_leaves_a_statement(spark):
    (r,) = Engine(spark, "nosuchscheme://store/root").query("show databases")
    assert not r.executed and r.error


def test_odd_inserts(engine):
    assert "does not exist" in error(engine, "insert into none.t (a) values (1)")
    ok(engine, "insert into d.t ('hello') values('world')")
    ok(engine, "insert into d.t (hello, n) values ('it''s', -5)")
    assert sorted(r["hello"] for r in ok(engine, "select hello from d.t")) == ["it's", "world"]


def test_import_export_and_measures(people, tmp_path):
    people.export("select name, age from d.people where age > 26 order by name", str(tmp_path / "out"))
    assert people.import_csv(str(tmp_path / "out"), "d", "copy", {"name": "n", "age": "a"}, "name string, age int, __uuid string") == 2
    assert ok(people, "select n from d.copy where a = 30") == [{"n": "Bob"}]
    people.export("select name from d.people", str(tmp_path / "json"), "json")
    assert people.spark.read.json(str(tmp_path / "json")).count() == 3
    assert people.query("select * from d.people")[0].measured()["rows"] == 3


def test_key_value_tables(engine, spark):
    from duskline.sources.keyvalue import KeyValueTable

    kv = KeyValueTable(engine.catalog, "d", "kv")
    kv.put(spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "key string, value string"))
    kv.put(spark.createDataFrame([("a", "2")], "key string, value string"))
    kv.delete(spark.createDataFrame([("b",)], "key string"))
    assert kv.get("a") == "2" and kv.get("b") is None and kv.get("none") is None
    kv.compact()
    assert sorted(map(tuple, kv.scan("a", "b").collect())) == [("a", "2")] and kv.log().count() == 2
    kv.put(spark.createDataFrame([("b", "3")], "key string, value string"))
    assert kv.get("b") == "3"
