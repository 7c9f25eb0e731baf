"""From statements to DataFrames. Nothing runs here but the counts that ranked search without an index needs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import coerce, text
from ..operators import aggregates, joins, relational, search
from . import grammar as g


class CompileProblem(ValueError):
    """The statement names something that is not there, or means nothing."""


@dataclass
class Scope:
    """A frame, and which table label stands for which prefix of its columns."""

    df: DataFrame
    prefixes: dict[str, str]

    def find(self, name: g.Name) -> str | None:
        """The frame's column for a name, or None."""
        known = {c.lower(): c for c in self.df.columns}
        if name.table is not None:
            if name.table not in self.prefixes:
                raise CompileProblem(f"Table '{name.table}' is not in the FROM clause")
            return known.get((self.prefixes[name.table] + name.column).lower())
        if name.column in known:
            return known[name.column]
        ends = [known[(p + name.column).lower()] for p in dict.fromkeys(self.prefixes.values()) if (p + name.column).lower() in known]
        return ends[0] if len(ends) == 1 else None

    def typed(self, name: g.Name) -> tuple[Column, T.DataType] | None:
        found = self.find(name)
        return None if found is None else (relational.quoted(found), self.df.schema[found].dataType)


class Compiler:
    """read: the frame of (db, table). postings: of (db, table, column), or None."""

    def __init__(self, read: Callable[[str, str], DataFrame], postings: Callable[[str, str, str], DataFrame | None] = lambda *_: None, row_id: str = "__uuid"):
        self.read, self.postings, self.row_id = read, postings, row_id

    def query(self, node) -> DataFrame:
        if isinstance(node, g.SetOperation):
            left, right = self.query(node.left), self.query(node.right)
            left, right = (relational.project(x, relational.user_columns(x), keep_internal=False) for x in (left, right))
            if len(left.columns) != len(right.columns):
                raise CompileProblem(f"{node.op.upper()} of {len(left.columns)} and {len(right.columns)} columns")
            if node.all:
                return {"union": left.unionAll, "intersect": left.intersectAll, "except": left.exceptAll}[node.op](right)
            return {"union": relational.union, "intersect": relational.intersect, "except": relational.except_}[node.op](left, right)
        return self.select(node)

    def scope(self, node: g.Select) -> Scope:
        df = self.read(node.table.db, node.table.name)
        scope = Scope(df, {node.table.label: ""})
        for j in node.joins:
            other = self.read(j.table.db, j.table.name)
            label = j.table.label
            if label in scope.prefixes:
                raise CompileProblem(f"Table '{label}' stands twice in the FROM clause")
            if j.how == "cross":
                joined = joins.cross_join(scope.df, other, label)
            else:
                a = scope.find(j.left)
                b = Scope(other, {label: ""}).find(j.right)
                if a is None or b is None:
                    raise CompileProblem(f"Column '{(j.left if a is None else j.right).column}' does not exist")
                joined = joins.equi_join(scope.df, other, [(a, b)], label, j.how)
            scope = Scope(joined, {**scope.prefixes, label: f"{label}_"})
        return scope

    def select(self, node: g.Select) -> DataFrame:
        scope = self.scope(node)
        ranked: list[Column] = []
        if node.where is not None:
            scope, ranked = self.filtered(scope, node.where, node.table)
        if node.group or (node.items and any(i.function for i in node.items)):
            out = self.grouped(scope, node)
            outer = Scope(out, {node.table.label: "", **scope.prefixes})
            keys = [(outer.find(n), up) for n, up in node.order]
            if node.distinct:
                out = out.distinct()
            out = relational.sort(out, [(c, up) for c, up in keys if c])
        else:
            df = scope.df
            if ranked:
                df = df.orderBy(*ranked)
            named = [] if node.items is None else [(scope.find(i.name), i.alias) for i in node.items]
            aliases = {a: c for c, a in named if a and c}
            keys = [(aliases.get(n.column) if n.table is None and n.column in aliases else scope.find(n), up) for n, up in node.order]
            keys = [(c, up) for c, up in keys if c]
            if node.items is None:
                chosen = [relational.quoted(c) for c in df.columns]
            else:
                own = [relational.quoted(c).alias(a or c) for c, a in dict.fromkeys(named) if c]
                taken = {c for c, _ in named}
                chosen = own + [relational.quoted(c) for c in relational.internal_columns(df) if c not in taken]
            if node.distinct:
                out = relational.distinct(df.select(*chosen))
                after = Scope(out, {node.table.label: ""})
                out = relational.sort(out, [(c, up) for n, up in node.order if (c := after.find(n))])
            else:
                out = relational.sort(df, keys).select(*chosen)
        return relational.limit_offset(out, node.limit, node.offset)

    def grouped(self, scope: Scope, node: g.Select) -> DataFrame:
        """Groups with their aggregates; HAVING may use aggregates that are not selected."""
        if node.items is None:
            raise CompileProblem("SELECT * cannot be grouped")
        by = []
        for n in node.group:
            found = scope.find(n)
            if found is None:
                raise CompileProblem(f"Column '{n.column}' does not exist")
            by.append(found)
        made: dict[str, Column] = {}
        chosen: list[tuple[str, str]] = []

        def add(item: g.Item) -> str:
            column = "*" if item.name is None else scope.find(item.name)
            if column is None:
                raise CompileProblem(f"Column '{item.name.column}' does not exist")
            key = f"__{item.function}_{'distinct_' if item.distinct else ''}{column}"
            made[key] = aggregates.expression(scope.df, item.function, column, item.distinct).alias(key)
            return key

        for item in node.items:
            if item.function:
                key = add(item)
                chosen.append((key, item.alias or (f"{item.function}({'distinct ' if item.distinct else ''}{item.name.column if item.name else '*'})")))
            else:
                found = scope.find(item.name)
                if found not in by:
                    raise CompileProblem(f"Column '{item.name.column}' must be in GROUP BY")
                chosen.append((found, item.alias or found))
        having = None
        if node.having is not None:
            having = self._with_aggregates(node.having, add)
        out = scope.df.groupBy(*[relational.quoted(c) for c in by]).agg(*made.values()) if by else scope.df.agg(*made.values())
        if having is not None:
            out = out.where(self.predicate(Scope(out, scope.prefixes), having))
        return out.select(*[relational.quoted(c).alias(a) for c, a in chosen])

    def _with_aggregates(self, node, add: Callable[[g.Item], str]):
        """A predicate with its aggregates replaced by the columns that will hold them."""
        if isinstance(node, g.Both):
            return g.Both(node.op, tuple(self._with_aggregates(p, add) for p in node.parts))
        if isinstance(node, g.Not):
            return g.Not(self._with_aggregates(node.part, add))
        if isinstance(node.left, g.Item):
            return type(node)(**{**{k: getattr(node, k) for k in node.__dataclass_fields__}, "left": g.Name(add(node.left))})
        return node

    # Predicates.

    def marked(self, scope: Scope, where):
        """The scope with a Boolean column for each IN (SELECT ...) below OR or NOT, and the predicate that reads these columns.

        Each is a left join with the distinct values of its query, so no row is repeated. A null on the left is unknown.
        """
        marks: list[str] = []

        def lowered(node):
            nonlocal scope
            if isinstance(node, g.Both):
                return g.Both(node.op, tuple(lowered(p) for p in node.parts))
            if isinstance(node, g.Not):
                return g.Not(lowered(node.part))
            if not isinstance(node, g.In) or node.query is None:
                return node
            found, mark = scope.find(node.left), f"__in{len(marks)}"
            marks.append(mark)
            if found is None:
                scope = Scope(scope.df.withColumn(mark, F.lit(None).cast("boolean")), scope.prefixes)
            else:
                scope = Scope(relational.mark_in_rows(scope.df, found, self._values(node), mark), scope.prefixes)
            return g.Marked(mark, node.negated)

        made = lowered(where)
        return scope, made, marks

    def filtered_rows(self, df: DataFrame, where) -> DataFrame:
        """The rows of a single table's frame that a predicate without ranking holds for, with df's columns."""
        scope, made, marks = self.marked(Scope(df, {}), where)
        return scope.df.where(self.predicate(scope, made)).drop(*marks)

    def flagged_rows(self, df: DataFrame, where, flag: str) -> DataFrame:
        """df with a column that says whether a predicate holds."""
        scope, made, marks = self.marked(Scope(df, {}), where)
        return scope.df.withColumn(flag, F.coalesce(self.predicate(scope, made), F.lit(False))).drop(*marks)

    def filtered(self, scope: Scope, where, table: g.Table) -> tuple[Scope, list[Column]]:
        """The rows that a predicate leaves, and the order that its searches give them.

        Conjuncts that plainly filter come first: they reach the scan, and searches see fewer rows.
        """
        parts = list(where.parts) if isinstance(where, g.Both) and where.op == "and" else [where]
        nested = [p for p in parts if isinstance(p, (g.Both, g.Not)) and _asks(p)]
        if nested:
            scope, order = self.filtered(scope, g.Both("and", tuple(rest)), table) if (rest := [p for p in parts if p not in nested]) else (scope, [])
            for p in nested:
                marked, made, marks = self.marked(scope, p)
                scope = Scope(marked.df.where(self.predicate(marked, made)).drop(*marks), scope.prefixes)
            return scope, order
        plain = [p for p in parts if not isinstance(p, (g.In, g.Search)) or (isinstance(p, g.In) and p.query is None) or (isinstance(p, g.Search) and p.kind in ("like", "regex"))]
        for p in plain:
            scope = Scope(scope.df.where(self.predicate(scope, p)), scope.prefixes)
        order: list[Column] = []
        for p in parts:
            if p in plain:
                continue
            if isinstance(p, g.In):
                found = scope.find(p.left)
                df = scope.df.where(F.lit(False)) if found is None else relational.filter_in_rows(scope.df, found, self._values(p), p.negated)
            else:
                df, key = self.searched(scope, p, table)
                order.append(key)
            scope = Scope(df, scope.prefixes)
        return scope, order

    def _values(self, node: g.In) -> DataFrame:
        inner = self.query(node.query)
        return relational.project(inner, relational.user_columns(inner)[:1], keep_internal=False)

    def searched(self, scope: Scope, node: g.Search, table: g.Table) -> tuple[DataFrame, Column]:
        found = scope.find(node.left)
        if found is None:
            return scope.df.where(F.lit(False)), F.lit(0)
        asked = str(node.value)
        if node.kind == "fuzzy":
            c = relational.quoted(found).cast("string")
            df = scope.df.withColumn(search.DISTANCE, text.fuzzy_distance(c, asked)).where(F.col(search.DISTANCE).isNotNull())
            return df, F.col(search.DISTANCE).asc()
        index = self.postings(table.db, table.name, found) if len(scope.prefixes) == 1 and self.row_id in scope.df.columns else None
        if index is not None:
            hits = search.segment_search(index[0], asked, index[1], "__hit", gone=index[2])
            df = scope.df.join(hits, relational.quoted(self.row_id) == F.col("__hit")).drop("__hit")
            return df, F.col(search.RELEVANCE).desc()
        c, words = relational.quoted(found).cast("string"), text.ascii_tokens(asked)
        near = scope.df.where(text.has_any(c, words, ascii_only=True) if words else F.lit(False))
        return near.withColumn(search.RELEVANCE, text.overlap(c, asked)), F.col(search.RELEVANCE).desc()

    def predicate(self, scope: Scope, node) -> Column:
        """A predicate as one Boolean column. Missing columns satisfy nothing."""
        if isinstance(node, g.Both):
            out = self.predicate(scope, node.parts[0])
            for p in node.parts[1:]:
                out = (out & self.predicate(scope, p)) if node.op == "and" else (out | self.predicate(scope, p))
            return out
        if isinstance(node, g.Not):
            return ~self.predicate(scope, node.part)
        if isinstance(node, g.Marked):
            return ~F.col(node.column) if node.negated else F.col(node.column)
        if isinstance(node.left, g.Item):
            raise CompileProblem("aggregates stand in HAVING only")
        found = scope.typed(node.left)
        if isinstance(node, g.Missing):
            return F.lit(not node.negated) if found is None else found[0].isNotNull() if node.negated else found[0].isNull()
        if found is None:
            return F.lit(None).cast("boolean")
        column, kind = found
        if isinstance(node, g.Compare):
            return coerce.compare(column, kind, node.op, _value(node.value))
        if isinstance(node, g.Between):
            return coerce.between(column, kind, _value(node.low), _value(node.high))
        if isinstance(node, g.In):
            if node.query is not None:
                raise CompileProblem("IN (SELECT ...) must be joined to other conditions by AND")
            out = coerce.is_in(column, kind, [_value(v) for v in node.values])
            return ~out if node.negated else out
        as_text = column.cast("string")
        if node.kind == "like":
            return as_text.like(coerce.like_pattern(str(node.value)))
        if node.kind == "regex":
            if not relational.valid_pattern(scope.df, str(node.value)):
                raise CompileProblem(f"Invalid regular expression: {node.value}")
            return text.matches(as_text, str(node.value))
        if node.kind == "fuzzy":
            return text.fuzzy_distance(as_text, str(node.value)).isNotNull()
        return text.overlap(as_text, str(node.value)) > 0


def _asks(node) -> bool:
    """Whether an IN (SELECT ...) stands in a predicate."""
    if isinstance(node, g.Both):
        return any(_asks(p) for p in node.parts)
    if isinstance(node, g.Not):
        return _asks(node.part)
    return isinstance(node, g.In) and node.query is not None


def _value(value: object) -> object:
    if isinstance(value, g.Now):
        import datetime as dt

        return dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    if isinstance(value, g.Parameter):
        raise CompileProblem(f"parameter {value.index + 1} has no value")
    return value


def tables_of(node) -> set[tuple[str, str]]:
    """All tables that a query reads."""
    if isinstance(node, g.SetOperation):
        return tables_of(node.left) | tables_of(node.right)
    if isinstance(node, g.Select):
        out = {(node.table.db, node.table.name), *((j.table.db, j.table.name) for j in node.joins)}
        return out | (tables_of(node.where) if node.where is not None else set())
    if isinstance(node, g.Both):
        return set().union(*(tables_of(p) for p in node.parts))
    if isinstance(node, g.Not):
        return tables_of(node.part)
    if isinstance(node, g.In) and node.query is not None:
        return tables_of(node.query)
    return set()


def is_small(node, most: int = 10_000) -> bool:
    """Whether a query's result is small by its form alone: a limit, or aggregates without groups."""
    if not isinstance(node, g.Select):
        return False
    if isinstance(node.limit, int) and node.limit <= most:
        return True
    return bool(node.items) and not node.group and any(i.function for i in node.items)
