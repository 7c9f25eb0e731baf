"""The dialect's grammar: text to statements, as plain data.

Keywords and names fold case; literals keep it. Names are quoted with "", `` or []; literals with '' or "". A double-quoted
word is a literal where a value stands and a name elsewhere.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""\s*(?:(?P<string>'(?:[^']|'')*'|"(?:[^"]|"")*")|(?P<quoted>`[^`]*`|\[[^\]]*\])|(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?)|(?P<name>[^\W\d]\w*)|(?P<op><>|!=|>=|<=|[=<>(),.*;?+-]))""",
    re.X,
)
AGGREGATES = ("count", "sum", "avg", "min", "max")
RESERVED = {"from", "where", "group", "order", "limit", "offset", "join", "inner", "left", "right", "full", "on", "and", "or", "union", "intersect", "except", "having", "as", "cross", "set", "values"}


class SyntaxProblem(ValueError):
    """The statement cannot be read."""


@dataclass(frozen=True)
class Token:
    kind: str
    text: str
    at: int = 0


@dataclass(frozen=True)
class Parameter:
    """A `?` that a prepared statement fills in."""

    index: int


@dataclass(frozen=True)
class Now:
    """CURRENT_TIMESTAMP."""


@dataclass(frozen=True)
class Name:
    """A column, with the table it is said to be of."""

    column: str
    table: str | None = None


@dataclass(frozen=True)
class Compare:
    left: Name
    op: str
    value: object


@dataclass(frozen=True)
class In:
    left: Name
    values: tuple | None
    query: Select | None = None
    negated: bool = False


@dataclass(frozen=True)
class Marked:
    """A Boolean column that stands for an IN (SELECT ...); made by the compiler, never read."""

    column: str
    negated: bool = False


@dataclass(frozen=True)
class Between:
    left: Name
    low: object
    high: object


@dataclass(frozen=True)
class Search:
    """CONTAINS, REGEX, FUZZY or LIKE."""

    left: Name
    kind: str
    value: object


@dataclass(frozen=True)
class Missing:
    left: Name
    negated: bool = False


@dataclass(frozen=True)
class Both:
    op: str
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Table:
    db: str
    name: str
    alias: str | None = None

    @property
    def label(self) -> str:
        return self.alias or self.name


@dataclass(frozen=True)
class Join:
    table: Table
    how: str
    left: Name | None = None
    right: Name | None = None


@dataclass(frozen=True)
class Item:
    name: Name | None
    function: str | None = None
    distinct: bool = False
    alias: str | None = None


@dataclass(frozen=True)
class Select:
    items: tuple[Item, ...] | None
    table: Table
    joins: tuple[Join, ...] = ()
    where: object | None = None
    group: tuple[Name, ...] = ()
    having: object | None = None
    order: tuple[tuple[Name, bool], ...] = ()
    limit: object = None
    offset: object = None
    distinct: bool = False


@dataclass(frozen=True)
class SetOperation:
    op: str
    left: object
    right: object
    all: bool = False


@dataclass(frozen=True)
class Insert:
    table: Table
    columns: tuple[str, ...]
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class Update:
    table: Table
    values: tuple[tuple[str, object], ...]
    where: object | None = None


@dataclass(frozen=True)
class Delete:
    table: Table
    where: object | None = None


@dataclass(frozen=True)
class Statement:
    """Everything else: a verb and its arguments."""

    verb: str
    args: dict = field(default_factory=dict)

    def __hash__(self) -> int:
        return hash((self.verb, repr(sorted(self.args.items()))))


def split_script(script: str) -> list[str]:
    """Statements between semicolons that stand in no quotes. Newlines are white space; blank statements are left out."""
    out, start, quote = [], 0, ""
    for i, c in enumerate(script):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c == ";":
            out.append(script[start:i])
            start = i + 1
    return [s.strip() for s in [*out, script[start:]] if s.strip()]


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SyntaxProblem(f"Invalid syntax near '{text[at : at + 20].strip()}'")
        out.append(Token(m.lastgroup, m.group(m.lastgroup), at))
        at = m.end()
    return out


def _unquote(text: str) -> str:
    q = text[0]
    return text[1:-1] if q in "`[" else text[1:-1].replace(q * 2, q)


class Parser:
    def __init__(self, text: str):
        self.text, self.tokens, self.at, self.parameters = text, tokens(text), 0, 0

    # Reading tokens.

    def peek(self, *words: str) -> bool:
        for i, w in enumerate(words):
            if self.at + i >= len(self.tokens):
                return False
            t = self.tokens[self.at + i]
            if t.kind not in ("name", "op") or t.text.lower() != w:
                return False
        return True

    def take(self, *words: str) -> bool:
        if self.peek(*words):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str, message: str = "") -> None:
        if not self.take(*words):
            raise SyntaxProblem(message or f"Invalid syntax: expected {' '.join(words).upper()}{self._near()}")

    def _near(self) -> str:
        return f" near '{self.tokens[self.at].text}'" if self.at < len(self.tokens) else " at the end"

    def name(self) -> str:
        t = self.tokens[self.at] if self.at < len(self.tokens) else None
        if t is None or t.kind not in ("name", "quoted", "string"):
            raise SyntaxProblem(f"Invalid syntax: expected a name{self._near()}")
        if t.kind == "name" and t.text.lower() in RESERVED:
            raise SyntaxProblem(f"Invalid syntax: expected a name{self._near()}")
        self.at += 1
        return (t.text if t.kind == "name" else _unquote(t.text)).lower()

    def literal(self) -> object:
        if self.at >= len(self.tokens):
            raise SyntaxProblem("Invalid syntax: expected a value at the end")
        sign = ""
        if self.peek("-") or self.peek("+"):
            sign = self.tokens[self.at].text
            self.at += 1
        if self.at >= len(self.tokens):
            raise SyntaxProblem("Invalid syntax: expected a value at the end")
        t = self.tokens[self.at]
        self.at += 1
        if t.kind == "number":
            number = float(t.text) if re.search("[.eE]", t.text) else int(t.text)
            return -number if sign == "-" else number
        if sign:
            raise SyntaxProblem(f"Invalid syntax: expected a number near '{t.text}'")
        if t.kind == "string":
            return _unquote(t.text)
        if t.kind == "op" and t.text == "?":
            self.parameters += 1
            return Parameter(self.parameters - 1)
        word = t.text.lower()
        if t.kind == "name" and word in ("true", "false", "null"):
            return {"true": True, "false": False, "null": None}[word]
        if t.kind == "name" and word == "current_timestamp":
            if self.take("("):
                self.need(")")
            return Now()
        if t.kind == "name" and word not in RESERVED:
            return t.text  # a bare word is text
        raise SyntaxProblem(f"Invalid syntax: expected a value near '{t.text}'")

    def column(self) -> Name:
        first = self.name()
        if self.take("."):
            return Name(self.name(), first)
        return Name(first)

    def table(self, alias: bool = True) -> Table:
        first = self.name()
        if not self.take("."):
            raise SyntaxProblem("Invalid syntax: FROM clause must be in format <db>.<table>")
        db, name, given = first, self.name(), None
        if alias:
            if self.take("as"):
                given = self.name()
            elif self.at < len(self.tokens) and self.tokens[self.at].kind == "name" and self.tokens[self.at].text.lower() not in RESERVED:
                given = self.name()
        return Table(db, name, given)

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise SyntaxProblem(f"Invalid syntax{self._near()}")

    def listed(self, read) -> tuple:
        out = [read()]
        while self.take(","):
            out.append(read())
        return tuple(out)

    # Predicates.

    def predicate(self):
        parts = [self.conjunction()]
        while self.take("or"):
            parts.append(self.conjunction())
        return parts[0] if len(parts) == 1 else Both("or", tuple(parts))

    def conjunction(self):
        parts = [self.term()]
        while self.take("and"):
            parts.append(self.term())
        return parts[0] if len(parts) == 1 else Both("and", tuple(parts))

    def term(self):
        if self.take("not"):
            return Not(self.term())
        if self.take("("):
            inner = self.predicate()
            self.need(")")
            return inner
        left = self.aggregate_or_column()
        for op in ("<>", "!=", ">=", "<=", "=", ">", "<"):
            if self.take(op):
                return Compare(left, op, self.literal())
        if self.take("is"):
            negated = self.take("not")
            self.need("null")
            return Missing(left, negated)
        negated = self.take("not")
        for kind in ("like", "contains", "regex", "fuzzy"):
            if self.take(kind):
                found = Search(left, kind, self.literal())
                return Not(found) if negated else found
        if self.take("between"):
            low = self.literal()
            self.need("and")
            found = Between(left, low, self.literal())
            return Not(found) if negated else found
        if self.take("in"):
            self.need("(")
            if self.peek("select"):
                found = In(left, None, self.query(), negated)
            else:
                found = In(left, self.listed(self.literal), None, negated)
            self.need(")")
            return found
        raise SyntaxProblem(f"Invalid syntax: expected a comparison{self._near()}")

    def aggregate_or_column(self):
        t = self.tokens[self.at] if self.at < len(self.tokens) else None
        if t and t.kind == "name" and t.text.lower() in AGGREGATES and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1].text == "(":
            return self.item()
        return self.column()

    # Statements.

    def item(self) -> Item:
        t = self.tokens[self.at] if self.at < len(self.tokens) else None
        function, distinct, name = None, False, None
        if t and t.kind == "name" and t.text.lower() in AGGREGATES and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1].text == "(":
            function = t.text.lower()
            self.at += 2
            distinct = self.take("distinct")
            if not self.take("*"):
                name = self.column()
            elif function != "count":
                raise SyntaxProblem(f"Invalid syntax: {function}(*)")
            self.need(")")
        else:
            name = self.column()
        alias = self.name() if self.take("as") else None
        return Item(name, function, distinct, alias)

    def select(self) -> Select:
        self.need("select")
        distinct = self.take("distinct")
        if not any(t.kind == "name" and t.text.lower() == "from" for t in self.tokens[self.at :]):
            raise SyntaxProblem("Invalid syntax: SELECT must include FROM clause")
        items = None if self.take("*") else self.listed(self.item)
        self.need("from")
        table = self.table()
        joins = []
        while True:
            if self.take(","):
                joins.append(Join(self.table(), "cross"))
                continue
            if self.take("cross", "join"):
                joins.append(Join(self.table(), "cross"))
                continue
            how = next((h for h in ("inner", "left", "right", "full") if self.peek(h)), None)
            if how:
                self.at += 1
                self.take("outer")
                self.need("join")
            elif not self.take("join"):
                break
            other = self.table()
            self.need("on")
            a = self.column()
            self.need("=")
            b = self.column()
            if a.table == other.label or (b.table is not None and b.table != other.label):
                a, b = b, a
            joins.append(Join(other, how or "inner", a, b))
        where = self.predicate() if self.take("where") else None
        group = self.listed(self.column) if self.take("group", "by") else ()
        having = self.predicate() if self.take("having") else None
        order = self.listed(self.ordering) if self.take("order", "by") else ()
        limit = offset = None
        if self.take("limit"):
            limit = self.literal()
            if self.take(","):
                limit, offset = self.literal(), limit
        if self.take("offset"):
            offset = self.literal()
        return Select(items, table, tuple(joins), where, group, having, order, limit, offset, distinct)

    def ordering(self) -> tuple[Name, bool]:
        name = self.column()
        if self.take("desc"):
            return name, False
        self.take("asc")
        return name, True

    def query(self):
        out = self.select()
        while True:
            op = next((o for o in ("union", "intersect", "except") if self.take(o)), None)
            if not op:
                return out
            every = self.take("all")
            out = SetOperation(op, out, self.select(), every)

    def index_columns(self) -> dict:
        table = self.table(alias=False)
        self.need("(")
        columns = self.listed(self.name)
        self.need(")")
        return {"db": table.db, "table": table.name, "columns": columns}

    def statement(self):
        out = self._statement()
        self.end()
        return out

    def _statement(self):
        if self.peek("select"):
            return self.query()
        if self.take("explain"):
            return Statement("explain", {"query": self.query()})
        if self.take("insert", "into"):
            table = self.table(alias=False)
            self.need("(")
            columns = self.listed(self.name)
            self.need(")")
            self.need("values")
            rows = self.listed(self.value_row)
            if any(len(r) != len(columns) for r in rows):
                raise SyntaxProblem(f"Invalid syntax: {len(columns)} columns, but {next(len(r) for r in rows if len(r) != len(columns))} values")
            return Insert(table, columns, rows)
        if self.take("update"):
            table = self.table(alias=False)
            self.need("set")
            values = self.listed(self.assignment)
            return Update(table, values, self.predicate() if self.take("where") else None)
        if self.take("delete", "everything"):
            return Statement("delete everything")
        if self.take("delete"):
            self.take("from")
            table = self.table(alias=False)
            return Delete(table, self.predicate() if self.take("where") else None)
        for verb in ("create", "drop"):
            if self.take(verb):
                return self.define(verb)
        if self.take("alter", "table"):
            table = self.table(alias=False)
            add = self.take("add")
            if not add:
                self.need("drop")
            self.take("column")
            column = self.name()
            args = {"db": table.db, "table": table.name, "column": column}
            return Statement("add column", args | {"type": self.type()}) if add else Statement("drop column", args)
        if self.take("describe"):
            if self.take("database"):
                return Statement("describe database", {"db": self.name()})
            self.need("table")
            table = self.table(alias=False)
            return Statement("describe table", {"db": table.db, "table": table.name})
        if self.take("show"):
            return self.show()
        if self.take("optimization"):
            for verb in ("status", "enable", "disable"):
                if self.take(verb):
                    return Statement(f"optimization {verb}")
            self.need("level")
            return Statement("optimization level", {"level": self.name()})
        if self.take("cache"):
            for verb in ("enable", "disable", "clear", "stats"):
                if self.take(verb):
                    return Statement(f"cache {verb}")
        if self.take("statistics", "collect"):
            return Statement("statistics collect")
        if self.take("compact"):
            table = self.table(alias=False)
            return Statement("compact", {"db": table.db, "table": table.name})
        raise SyntaxProblem(f"Invalid syntax: unknown statement{self._near() if self.tokens else ''}")

    def value_row(self) -> tuple:
        self.need("(")
        out = self.listed(self.literal)
        self.need(")")
        return out

    def assignment(self) -> tuple[str, object]:
        column = self.name()
        self.need("=")
        return column, self.literal()

    def type(self) -> str:
        kind = self.name()
        if self.take("("):
            self.literal()
            while self.take(","):
                self.literal()
            self.need(")")
        return kind

    def define(self, verb: str):
        if self.take("database"):
            return Statement(f"{verb} database", {"db": self.name()})
        if self.take("table"):
            first = self.name()
            if not self.take("."):
                raise SyntaxProblem("Invalid syntax: table must be in format <db>.<table>")
            args: dict = {"db": first, "table": self.name()}
            if verb == "create":
                args["columns"] = ()
                if self.take("("):
                    args["columns"] = self.listed(lambda: (self.name(), self.type()))
                    self.need(")")
            return Statement(f"{verb} table", args)
        fulltext = self.take("fulltext")
        self.need("index")
        self.need("on")
        return Statement(f"{verb} {'fulltext ' if fulltext else ''}index", self.index_columns())

    def show(self):
        if self.take("databases"):
            return Statement("show databases")
        if self.take("tables"):
            return Statement("show tables", {"db": self.name() if self.take("in") else None})
        fulltext = self.take("fulltext")
        if self.take("indexes"):
            args: dict = {"db": None, "table": None}
            if self.take("on"):
                table = self.table(alias=False)
                args = {"db": table.db, "table": table.name}
            elif self.take("in"):
                args = {"db": self.name(), "table": None}
            return Statement(f"show {'fulltext ' if fulltext else ''}indexes", args)
        db = self.name()
        self.need("tables")
        return Statement("show tables", {"db": db})


def parse(text: str):
    """The statement that a text is; raises SyntaxProblem."""
    return Parser(text).statement()


def bind(node, values: tuple):
    """A statement with its parameters replaced; raises SyntaxProblem if there are too few values."""
    if isinstance(node, Parameter):
        if node.index >= len(values):
            raise SyntaxProblem(f"Invalid syntax: parameter {node.index + 1} has no value")
        return values[node.index]
    if isinstance(node, tuple):
        return tuple(bind(x, values) for x in node)
    if isinstance(node, Statement):
        return Statement(node.verb, {k: bind(v, values) for k, v in node.args.items()})
    if hasattr(node, "__dataclass_fields__") and not isinstance(node, (Token, Now)):
        return type(node)(**{k: bind(getattr(node, k), values) for k in node.__dataclass_fields__})
    return node
