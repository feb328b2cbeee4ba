"""SQL over tables: the engine's own statements with its own rules, and all of Spark's SQL beyond them.

The engine's SELECT is

    SELECT * | item, ... FROM table [WHERE condition] [GROUP BY column, ...]
        [ORDER BY column or place [ASC | DESC], ...] [LIMIT n] [OFFSET n]

with items `column` and `func(column)`, func one of SUM, AVG, MIN, MAX and COUNT, `COUNT(*)`, each
with an alias or none, and conditions of comparisons of a column with a literal, AND, OR, NOT and
parentheses. It is lowered to the builders in `operators`: an aggregate of nothing is 0, NaN loses
to any number, and what a function or a comparison doesn't take is refused before anything runs.
Any other query is Spark's, with Spark's rules, NULL for an aggregate of nothing among them.
INSERT ... VALUES appends checked rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.aggregates import FUNCTIONS, Agg
from larkspur.functions.predicates import all_of, any_of, compare, negate
from larkspur.operators import relational as R
from larkspur.sources.table import Table

TOKEN = re.compile(r"\s*(?:--[^\n]*\s*)*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|'(?P<string>(?:[^']|'')*)'|(?P<word>[A-Za-z_]\w*)|\"(?P<quoted>(?:[^\"]|\"\")+)\"|`(?P<ticked>[^`]+)`|(?P<mark><=|>=|<>|!=|==|[(),;*.+=<>-]))")
#: Pieces of a text of statements: quoted parts, comments, a semicolon, and quotes that don't end.
PIECE = re.compile(r"(?P<kept>'(?:[^']|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|[^;'\"`])|(?P<end>;)|(?P<open>['\"`])")
NAMES = {"word", "quoted", "ticked"}
RESERVED = {"SELECT", "FROM", "WHERE", "GROUP", "BY", "ORDER", "LIMIT", "OFFSET", "HAVING", "AND", "OR", "NOT", "AS", "DISTINCT", "UNION", "JOIN", "ON", "TRUE", "FALSE", "NULL", "CASE", "IN", "BETWEEN", "LIKE", "IS", "ASC", "DESC", "WITH"}
OPERATORS = {"=": "=", "==": "=", "!=": "!=", "<>": "!=", "<": "<", "<=": "<=", ">": ">", ">=": ">="}
TURNED = {"=": "=", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


class SqlError(ValueError):
    """A statement that isn't one, or more than one."""


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SqlError(f"unexpected text at {text[at : at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def statements(text: str) -> list[str]:
    """The statements between semicolons outside of quotes; a quote that isn't closed is an error."""
    parts = [""]
    for m in PIECE.finditer(text):
        if m["open"]:
            raise SqlError(f"unclosed {m['open']}")
        if m["end"]:
            parts.append("")
        else:
            parts[-1] += m["kept"]
    return [p.strip() for p in parts if re.sub(r"--[^\n]*", "", p).strip()]


class _Parser:
    """What statements share: names, literals and lists from tokens."""

    def __init__(self, text: str):
        self.left = tokens(text)

    def _take(self) -> tuple[str, str]:
        if not self.left:
            raise SqlError("unexpected end")
        return self.left.pop(0)

    def _next(self, *marks: str) -> bool:
        return bool(self.left) and self.left[0][0] == "mark" and self.left[0][1] in marks

    def _at(self, *words: str) -> bool:
        """Whether these words come next; they are taken if so."""
        found = [(k, v.upper()) for k, v in self.left[: len(words)]] == [("word", w) for w in words]
        if found:
            del self.left[: len(words)]
        return found

    def _word(self, wanted: str) -> None:
        kind, got = self._take()
        if kind != "word" or got.upper() != wanted:
            raise SqlError(f"expected {wanted}, got {got!r}")

    def _mark(self, wanted: str) -> None:
        if self._take() != ("mark", wanted):
            raise SqlError(f"expected {wanted!r}")

    def _name(self) -> str:
        kind, got = self._take()
        if kind not in NAMES:
            raise SqlError(f"expected a name, got {got!r}")
        return got.replace('""', '"') if kind == "quoted" else got

    def _several(self, item: Callable) -> list:
        out = [item()]
        while self._next(","):
            self._take()
            out.append(item())
        return out

    def _list(self, item: Callable) -> list:
        self._mark("(")
        out = self._several(item)
        self._mark(")")
        return out

    def _literal(self):
        kind, got = self._take()
        if kind == "mark" and got in "+-":
            value = self._literal()
            if isinstance(value, bool) or not isinstance(value, (int, float)):
                raise SqlError(f"{got} takes a number")
            return -value if got == "-" else value
        if kind == "number":
            return int(got) if got.isdigit() else float(got)
        if kind == "string":
            return got.replace("''", "'")
        words = {"TRUE": True, "FALSE": False, "NULL": None}
        if kind == "word" and got.upper() in words:
            return words[got.upper()]
        raise SqlError(f"expected a literal, got {got!r}")


class _Insert(_Parser):
    """INSERT INTO name [(columns)] VALUES (literals), ..."""

    def __init__(self, text: str):
        super().__init__(text)
        self._word("INSERT"), self._word("INTO")
        self.table = self._name()
        self.columns = self._list(self._name) if self._next("(") else None
        self._word("VALUES")
        self.rows = self._several(lambda: self._list(self._literal))
        if self.left:
            raise SqlError(f"unexpected {self.left[0][1]!r}")


class _Select(_Parser):
    """The engine's own SELECT; SqlError for any other text."""

    def __init__(self, text: str):
        super().__init__(text)
        self._word("SELECT")
        self.items: list[tuple[str | None, str, str]] | None = None  # function, column, name
        if self._next("*"):
            self._take()
        else:
            self.items = self._several(self._item)
        self._word("FROM")
        self.table = self._plain()
        self.where = self._either() if self._at("WHERE") else None
        self.keys = self._several(self._plain) if self._at("GROUP", "BY") else []
        self.order = self._several(self._ordered) if self._at("ORDER", "BY") else []
        self.limit = self._count() if self._at("LIMIT") else None
        self.offset = self._count() if self._at("OFFSET") else 0
        if self.left or self.items is None and self.keys:
            raise SqlError("not the engine's SELECT")

    def _plain(self) -> str:
        if self.left and self.left[0][0] == "word" and self.left[0][1].upper() in RESERVED:
            raise SqlError(f"expected a name, got {self.left[0][1]!r}")
        return self._name()

    def _item(self) -> tuple[str | None, str, str]:
        func, column = None, self._plain()
        if self._next("("):
            func = column.lower()
            if func not in FUNCTIONS:
                raise SqlError(f"unknown function '{column}'")
            self._take()
            column = "*" if self._next("*") and self._take() else self._plain()
            self._mark(")")
        name = column if func is None else f"{func}({column})"
        if self._at("AS") or self.left and self.left[0][0] in NAMES and self.left[0][1].upper() not in RESERVED:
            name = self._plain()
        return func, column, name

    def _either(self) -> Callable[[DataFrame], Column]:
        parts = [self._both()]
        while self._at("OR"):
            parts.append(self._both())
        return lambda df: any_of(*(p(df) for p in parts)) if len(parts) > 1 else parts[0](df)

    def _both(self) -> Callable[[DataFrame], Column]:
        parts = [self._one()]
        while self._at("AND"):
            parts.append(self._one())
        return lambda df: all_of(*(p(df) for p in parts)) if len(parts) > 1 else parts[0](df)

    def _one(self) -> Callable[[DataFrame], Column]:
        if self._at("NOT"):
            inner = self._one()
            return lambda df: negate(inner(df))
        if self._next("("):
            self._take()
            inner = self._either()
            self._mark(")")
            return inner
        kind, got = self.left[0] if self.left else ("", "")
        if kind in NAMES and got.upper() not in RESERVED:
            name, op, value = self._plain(), self._operator(), self._literal()
        else:
            value, op, name = self._literal(), TURNED[self._operator()], self._plain()
        return lambda df: compare(df, name, op, value)

    def _operator(self) -> str:
        kind, got = self._take()
        if kind != "mark" or got not in OPERATORS:
            raise SqlError(f"expected a comparison, got {got!r}")
        return OPERATORS[got]

    def _count(self) -> int:
        n = self._literal()
        if isinstance(n, bool) or not isinstance(n, int):
            raise SqlError("expected a number of rows")
        return n

    def _ordered(self) -> tuple[str | int, bool]:
        by = self._count() if self.left and self.left[0][0] == "number" else self._plain()
        return by, not self._at("ASC") and self._at("DESC")

    def run(self, df: DataFrame) -> DataFrame:
        if self.where is not None:
            df = R.keep(df, self.where(df))
        if self.items is None:
            return self._tail(df, df.columns, df)
        columns, aggs = [c for f, c, _ in self.items if f is None], [Agg(f, c, f"__{i}") for i, (f, c, _) in enumerate(self.items) if f]
        if aggs and columns and not self.keys:
            raise SqlError("mixing columns and aggregates requires a GROUP BY clause")
        loose = [c for c in columns if c not in self.keys] if self.keys else []
        if loose:
            raise SqlError(f"column '{loose[0]}' must appear in GROUP BY or be an aggregate")
        if self.keys:
            out = R.group(df, self.keys, aggs)
        elif aggs:
            out = R.aggregate(df, aggs)
        else:
            missing = [c for c in columns if c not in df.columns]
            if missing:
                raise SqlError(f"unknown column '{missing[0]}'")
            out = df
        names = [n for _, _, n in self.items]
        return self._tail(out, names, out.select(*(F.col(f"__{i}" if f else f"`{c}`").alias(n) for i, (f, c, n) in enumerate(self.items))))

    def _tail(self, before: DataFrame, names: list[str], out: DataFrame) -> DataFrame:
        """ORDER BY, LIMIT and OFFSET; a plain query may be ordered by columns that it doesn't return."""
        if self.order:
            places = [f"__o{i}" for i in range(len(names))]
            wide = before.select("*", *(F.col(f"`{c}`" if self.items is None else f"__{i}" if self.items[i][0] else f"`{self.items[i][1]}`").alias(p) for i, (c, p) in enumerate(zip(names if self.items is None else [c for _, c, _ in self.items], places, strict=True))))
            by = []
            for key, down in self.order:
                at = key - 1 if isinstance(key, int) else names.index(key) if key in names else None
                if at is not None and not 0 <= at < len(names):
                    raise SqlError(f"no place {key} in the result")
                if at is None and key not in before.columns:
                    raise SqlError(f"unknown column '{key}'")
                col = F.col(places[at]) if at is not None else F.col(f"`{key}`")
                by.append(col.desc() if down else col.asc())
            out = wide.orderBy(*by).select(*(F.col(p).alias(n) for p, n in zip(places, names, strict=True)))
        out = out.offset(self.offset) if self.offset else out
        return out if self.limit is None else out.limit(self.limit)


def _lowered(text: str) -> _Select | None:
    """The statement if it is the engine's own, else None."""
    try:
        return _Select(text)
    except SqlError:
        return None


class Engine:
    """Tables by name, in a session of their own in which identifiers are case-sensitive."""

    def __init__(self, spark: SparkSession):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.caseSensitive", "true")
        self.spark.conf.set("spark.sql.parquet.aggregatePushdown", "true")
        self.tables: dict[str, Table] = {}
        self.frames: dict[str, DataFrame] = {}

    def register(self, name: str, df: DataFrame) -> None:
        """A DataFrame of this engine's session as a table to read."""
        self.frames[name] = df

    def attach(self, folder: str) -> Table:
        table = Table.open(self.spark, folder)
        self.tables[table.definition.name] = table
        return table

    def table(self, name: str) -> Table:
        if name not in self.tables:
            raise SqlError(f"unknown table '{name}'")
        return self.tables[name]

    def scan(self, name: str) -> DataFrame:
        return self.frames[name] if name in self.frames else self.table(name).scan()

    def sql(self, text: str) -> DataFrame | int:
        """A DataFrame for a query, the number of rows for an insert."""
        found = statements(text)
        if len(found) != 1:
            raise SqlError("no statement" if not found else "more than one statement")
        if re.match(r"(?i)insert\b", found[0]):
            stmt = _Insert(found[0])
            return self.table(stmt.table).insert(stmt.rows, stmt.columns)
        own = _lowered(found[0])
        if own:
            return own.run(self.scan(own.table))
        for name in [*self.tables, *self.frames]:
            self.scan(name).createOrReplaceTempView(name)
        return self.spark.sql(found[0])

    def select(self, name: str, columns: Sequence[str] | str = "*", aggs: Sequence[Agg] = (), where: Column | None = None, group_by: Sequence[str] = ()) -> DataFrame:
        """The non-null model's query: scan, filter, then projection or aggregates."""
        df = self.scan(name)
        df = df if where is None else R.keep(df, where)
        if group_by:
            return R.group(df, group_by, aggs)
        return R.aggregate(df, aggs) if aggs else R.project(df, columns)
