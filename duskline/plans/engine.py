"""The engine: scripts in, one result for each statement out."""

from __future__ import annotations

import re
import time
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational, statistics
from ..sources import tables
from . import grammar as g
from .cache import ResultCache
from .catalog import ROW_ID, Catalog, CatalogProblem
from .compiler import CompileProblem, Compiler, _value, is_small, tables_of
from .result import Result

#: What optimization levels set. Catalyst's rules stay on; levels move what costs planning time.
LEVELS = {
    "none": {"spark.sql.cbo.enabled": "false", "spark.sql.cbo.joinReorder.enabled": "false", "spark.sql.adaptive.enabled": "false"},
    "low": {"spark.sql.cbo.enabled": "false", "spark.sql.cbo.joinReorder.enabled": "false", "spark.sql.adaptive.enabled": "true"},
    "medium": {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "false", "spark.sql.adaptive.enabled": "true"},
    "high": {"spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.adaptive.enabled": "true"},
}
FROM_CACHE = "Result retrieved from cache"
HIT = "__hit"


@dataclass
class Prepared:
    """A statement with `?` parameters, parsed once."""

    engine: Engine
    text: str
    statement: object

    def execute(self, *values: object) -> Result:
        return self.engine.run(self.text, lambda: g.bind(self.statement, values))


class Engine:
    """Statements over a catalog. A statement that fails gives a result with an error, never an exception.

    Rows are read lazily: what fails only then (a lost file, say) is raised by Result.rows() and reported by Result.to_json().
    `delete everything` is refused unless allow_delete_everything is set.
    """

    def __init__(self, spark: SparkSession, root: str, allow_delete_everything: bool = False):
        self.spark, self.catalog, self.cache = spark, Catalog(spark, root), ResultCache()
        self.allow_delete_everything = allow_delete_everything
        self.compiler = Compiler(self.catalog.read, self.catalog.postings)
        self.level, self.optimizing = "medium", True
        self.statistics: dict[tuple[str, str], DataFrame] = {}
        self.filtered_on: Counter[tuple[str, str, str]] = Counter()

    def query(self, script: str) -> list[Result]:
        return [self.run(text, lambda text=text: g.parse(text)) for text in g.split_script(script)]

    def prepare(self, text: str) -> Prepared:
        """Raises SyntaxProblem if the statement cannot be read."""
        return Prepared(self, text, g.parse(text))

    def import_csv(self, path: str, db: str, table: str, columns: dict[str, str] | None = None, schema: str | None = None) -> int:
        """Append a CSV file with a header to a table; columns: CSV name -> column. Returns how many rows."""
        return self.catalog.append(db, table, tables.read_csv(self.spark, path, schema, columns))

    def export(self, query: str, path: str, format: str = "csv") -> Result:
        """Write the result of a query as CSV or JSON lines."""
        result = self.query(query)[0]
        if result.df is not None:
            {"csv": tables.write_csv, "json": tables.write_json}[format](result.df, path)
        return result

    def run(self, text: str, parse) -> Result:
        began, result = time.monotonic(), Result(text)
        try:
            self._execute(parse(), result)
            result.executed = True
        except (g.SyntaxProblem, CatalogProblem, CompileProblem) as e:
            result.error = str(e)
        except Exception as e:  # whatever Spark, the store or a bad value raise is the statement's error
            result.error = str(e).splitlines()[0] if str(e) else type(e).__name__
        if result.error:
            result.df = None
        result.runtime_ms = int(1000 * (time.monotonic() - began))
        return result

    def _execute(self, node, result: Result) -> None:
        if isinstance(node, (g.Select, g.SetOperation)):
            self._select(node, result)
        elif isinstance(node, g.Insert):
            self._insert(node, result)
        elif isinstance(node, g.Update):
            self._update(node, result)
        elif isinstance(node, g.Delete):
            self._delete(node, result)
        else:
            getattr(self, "_" + re.sub(" ", "_", node.verb))(result, **node.args)

    # Queries.

    def _select(self, node, result: Result) -> None:
        read = sorted(tables_of(node))
        for db, table in read:
            self.catalog._need(db, table)
        self._note_filters(node)
        key = (repr(node), tuple((db, t, self.catalog.version(db, t)) for db, t in read))
        now = "Now()" in key[0]
        found = None if now else self.cache.get(key)
        if found is not None:
            result.df, result.explain = found, FROM_CACHE
            return
        df = self.compiler.query(node)
        df.schema  # names and types are checked here, not when rows are read
        result.df = df if now else self.cache.put(key, df, is_small(node))

    def _note_filters(self, node) -> None:
        """Count equality filters by column; a column that is filtered on often gets an index at the next compaction."""
        if not isinstance(node, g.Select) or node.where is None:
            return
        parts = node.where.parts if isinstance(node.where, g.Both) and node.where.op == "and" else (node.where,)
        for p in parts:
            if not isinstance(p, g.Compare) or p.op != "=" or p.left.table not in (None, node.table.label):
                continue
            at = (node.table.db, node.table.name, p.left.column)
            self.filtered_on[at] += 1
            if self.filtered_on[at] == statistics.AUTO_INDEX_QUERIES:
                m = self.catalog.manifest(*at[:2])
                if at[2] in m.types and not any(i[0] == at[2] for i in m.indexes) and len(m.indexes) < statistics.AUTO_INDEX_MOST:
                    self.catalog.create_index(at[0], at[1], [at[2]], build=False)

    def _explain(self, result: Result, query) -> None:
        df = self.compiler.query(query)
        result.explain = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        result.df = self.spark.createDataFrame([(x,) for x in result.explain.splitlines()], "plan string")

    # Changes.

    def _insert(self, node: g.Insert, result: Result) -> None:
        rows = [tuple(_value(v) for v in r) for r in node.rows]
        columns = list(node.columns)
        kinds = []
        for i in range(len(columns)):
            kind = "void"
            for r in rows:
                if r[i] is not None:
                    own = {bool: "boolean", int: "bigint", float: "double", str: "string"}.get(type(r[i]), "timestamp")
                    kind = own if kind in ("void", own) else "double" if {kind, own} == {"bigint", "double"} else "string"
            kinds.append("string" if kind == "void" else kind)
        casts = {"string": lambda v: str(v).lower() if isinstance(v, bool) else str(v), "double": float}
        made = [tuple(None if v is None else casts.get(k, lambda v: v)(v) for v, k in zip(r, kinds, strict=True)) for r in rows]
        df = self.spark.createDataFrame(made, ", ".join(f"`{c}` {k}" for c, k in zip(columns, kinds, strict=True)))
        result.details["rows"] = self.catalog.append(node.table.db, node.table.name, df.coalesce(1))

    def _condition(self, where):
        """From a frame to the rows of it that a predicate holds for."""
        return None if where is None else lambda df: self.compiler.filtered_rows(df, where)

    def _update(self, node: g.Update, result: Result) -> None:
        self.catalog._need(node.table.db, node.table.name)
        m = self.catalog.manifest(node.table.db, node.table.name)
        for c, _ in node.values:
            if c not in m.types:
                raise CatalogProblem(f"Column '{c}' does not exist")

        def change(df: DataFrame) -> DataFrame:
            if node.where is not None:
                df = self.compiler.flagged_rows(df, node.where, HIT)
            hit = F.lit(True) if node.where is None else F.col(HIT)
            new = {}
            for c, v in node.values:
                value = _value(v)
                text = str(value).lower() if isinstance(value, bool) else value
                made = F.lit(text).cast("string").cast(m.types[c]) if m.types[c] == "string" else F.lit(text).cast("binary") if m.types[c] == "binary" else F.lit(value).try_cast(m.types[c])
                if value is not None:
                    ok = df.sparkSession.range(1).select(made.isNotNull()).first()[0]
                    if not ok:
                        raise CatalogProblem(f"'{value}' is no {m.types[c]}")
                new[c] = F.when(hit, made).otherwise(relational.quoted(c))
            return df.withColumns(new).drop(HIT)

        result.details["rows"] = self.catalog.rewrite(node.table.db, node.table.name, self._condition(node.where), change, {c for c, _ in node.values}, "Now()" not in repr(node))

    def _delete(self, node: g.Delete, result: Result) -> None:
        self.catalog._need(node.table.db, node.table.name)

        def change(df: DataFrame) -> DataFrame | None:
            if node.where is None:
                return None
            return self.compiler.flagged_rows(df, node.where, HIT).where(~F.col(HIT)).drop(HIT)

        result.details["rows"] = self.catalog.rewrite(node.table.db, node.table.name, self._condition(node.where), change, steady="Now()" not in repr(node))

    def _delete_everything(self, result: Result) -> None:
        if not self.allow_delete_everything:
            raise CatalogProblem("'delete everything' is not allowed on this engine")
        self.cache.clear()
        self.catalog.drop_everything()

    # Definitions.

    def _create_database(self, result: Result, db: str) -> None:
        self.catalog.create_database(db)

    def _drop_database(self, result: Result, db: str) -> None:
        self.catalog.drop_database(db)
        self.cache.clear()

    def _create_table(self, result: Result, db: str, table: str, columns: tuple) -> None:
        self.catalog.create_table(db, table, columns)

    def _drop_table(self, result: Result, db: str, table: str) -> None:
        self.catalog.drop_table(db, table)
        self.cache.clear()

    def _add_column(self, result: Result, db: str, table: str, column: str, type: str) -> None:
        self.catalog.add_column(db, table, column, type)

    def _drop_column(self, result: Result, db: str, table: str, column: str) -> None:
        self.catalog.drop_column(db, table, column)

    def _create_index(self, result: Result, db: str, table: str, columns: tuple) -> None:
        if not self.catalog.create_index(db, table, columns):
            raise CatalogProblem(f"Index on {db}.{table}({', '.join(columns)}) already exists")

    def _drop_index(self, result: Result, db: str, table: str, columns: tuple) -> None:
        if not self.catalog.drop_index(db, table, columns):
            raise CatalogProblem(f"Index on {db}.{table}({', '.join(columns)}) does not exist")

    def _create_fulltext_index(self, result: Result, db: str, table: str, columns: tuple) -> None:
        for c in columns:
            if not self.catalog.create_fulltext_index(db, table, c):
                raise CatalogProblem(f"Full-text index on {db}.{table}({c}) already exists")

    def _drop_fulltext_index(self, result: Result, db: str, table: str, columns: tuple) -> None:
        for c in columns:
            if not self.catalog.drop_fulltext_index(db, table, c):
                raise CatalogProblem(f"Full-text index on {db}.{table}({c}) does not exist")

    def _compact(self, result: Result, db: str, table: str) -> None:
        self.catalog.compact(db, table)

    # Metadata.

    def _rows(self, result: Result, rows: list[tuple], schema: str) -> None:
        result.df = self.spark.createDataFrame(rows, schema)

    def _show_databases(self, result: Result) -> None:
        self._rows(result, [(x,) for x in self.catalog.databases()], "database string")

    def _show_tables(self, result: Result, db: str | None) -> None:
        found = self.catalog.meta() if db is None else {db: self.catalog.tables(db)}
        self._rows(result, [(d, t) for d in sorted(found) for t in found[d]], "database string, table string")

    def _indexes(self, db: str | None, table: str | None):
        if table is not None:
            self.catalog._need(db, table)
        for d in self.catalog.databases() if db is None else [db]:
            for t in self.catalog.tables(d) if table is None else [table]:
                yield d, t, self.catalog.manifest(d, t)

    def _show_indexes(self, result: Result, db: str | None, table: str | None) -> None:
        self._rows(result, [(d, t, ", ".join(i)) for d, t, m in self._indexes(db, table) for i in sorted(m.indexes)], "database string, table string, columns string")

    def _show_fulltext_indexes(self, result: Result, db: str | None, table: str | None) -> None:
        self._rows(result, [(d, t, c) for d, t, m in self._indexes(db, table) for c in sorted(m.fulltext)], "database string, table string, column string")

    def _describe_database(self, result: Result, db: str) -> None:
        self._rows(result, [(db, t, len(m.columns), len(m.parts), m.version) for t in self.catalog.tables(db) for m in [self.catalog.manifest(db, t)]], "database string, table string, n_columns int, n_parts int, version int")

    def _describe_table(self, result: Result, db: str, table: str) -> None:
        m = self.catalog.manifest(db, table)
        marks = {c: [] for c, _ in m.columns}
        for i in m.indexes:
            for c in i:
                marks.get(c, []).append("index")
        for c in m.fulltext:
            marks[c].append("fulltext index")
        self._rows(result, [(c, k, ", ".join(dict.fromkeys(marks[c]))) for c, k in m.columns if c != ROW_ID], "column string, type string, indexes string")

    # Session.

    def _optimization_status(self, result: Result) -> None:
        self._rows(result, [(self.optimizing, self.level)], "enabled boolean, level string")

    def _optimization_enable(self, result: Result) -> None:
        self.optimizing = True
        self._apply(self.level)

    def _optimization_disable(self, result: Result) -> None:
        self.optimizing = False
        self._apply("none")

    def _optimization_level(self, result: Result, level: str) -> None:
        if level not in LEVELS:
            raise CatalogProblem(f"unknown level '{level}'; levels are {', '.join(LEVELS)}")
        self.level = level
        if self.optimizing:
            self._apply(level)

    def _apply(self, level: str) -> None:
        for k, v in LEVELS[level].items():
            self.spark.conf.set(k, v)

    def _cache_enable(self, result: Result) -> None:
        self.cache.enabled = True

    def _cache_disable(self, result: Result) -> None:
        self.cache.enabled = False
        self.cache.clear()

    def _cache_clear(self, result: Result) -> None:
        self.cache.clear()

    def _cache_stats(self, result: Result) -> None:
        s = self.cache.stats()
        self._rows(result, [tuple(s.values())], ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'long'}" for k, v in s.items()))

    def _statistics_collect(self, result: Result) -> None:
        """One pass over each table; results stay as small frames for the advisor."""
        self.statistics = {}
        out: DataFrame | None = None
        for db, names in self.catalog.meta().items():
            for t in names:
                df = self.catalog.read(db, t)
                own = self.spark.createDataFrame(statistics.column_statistics(df).collect(), STATISTICS)  # a row for each column
                self.statistics[db, t] = own
                named = own.select(F.lit(db).alias("database"), F.lit(t).alias("table"), "*")
                out = named if out is None else out.unionByName(named)
        result.df = out

    def index_advice(self, db: str, table: str) -> DataFrame:
        """Columns of a table whose statistics were collected that an index would serve."""
        if (db, table) not in self.statistics:
            raise CatalogProblem(f"no statistics of {db}.{table}: run STATISTICS COLLECT")
        return statistics.index_advice(self.statistics[db, table])


STATISTICS = "column_name string, n_rows long, n_values long, n_nulls long, ndv long, min_value string, max_value string, avg_number double, avg_length double"
