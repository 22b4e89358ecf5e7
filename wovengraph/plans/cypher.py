"""A read-only subset of Cypher, planned as DataFrame joins.

MATCH and OPTIONAL MATCH with node labels, property maps, directed relationships (with a
variable, and of variable length), comma-separated patterns; WHERE with comparisons, IS [NOT]
NULL, IN, CONTAINS, STARTS WITH, ENDS WITH, AND, OR, NOT; UNWIND; RETURN [DISTINCT] with AS and
the aggregates count, sum, min, max, avg and collect; ORDER BY, SKIP and LIMIT; `$parameters`.
Statements that change the graph are refused."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wovengraph.operators import graph

LABELS = {"File": ("files", "path"), "Symbol": ("symbols", "id"), "Chunk": ("chunks", "id")}
#: relationship -> (table, source column, target column, source label, target label)
RELATIONS = {
    "IMPORTS": ("imports", "src", "dst", "File", "File"),
    "CALLS": ("calls", "src", "dst", "Symbol", "Symbol"),
    "CONTAINS": ("contains", "src", "dst", None, "Symbol"),
    "DOCUMENTED_BY": ("documented_by", "src", "chunk_id", None, "Chunk"),
}
_CHANGES = ("CREATE", "MERGE", "SET", "DELETE", "DETACH", "DROP", "ALTER", "COPY", "BEGIN", "COMMIT", "ROLLBACK", "LOAD", "INSTALL", "CALL", "REMOVE")
_TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<number>\d+\.\d+|\d+)|(?P<name>[A-Za-z_]\w*|`[^`]+`)|(?P<param>\$\w+)|(?P<mark><>|<=|>=|->|<-|\.\.|[-()\[\]{}:,.=<>*+/;]))""")


class CypherError(Exception):
    """A statement that this front-end doesn't run."""


@dataclass
class _Node:
    name: str
    label: str | None
    properties: dict[str, Any]


@dataclass
class _Link:
    name: str | None
    kind: str
    forward: bool
    length: tuple[int, int | None] | None = None


@dataclass
class _State:
    rows: DataFrame | None = None
    labels: dict[str, str] = field(default_factory=dict)  # node variable -> label
    links: set[str] = field(default_factory=set)
    values: set[str] = field(default_factory=set)


class _Run:
    def __init__(self, text: str, tables: dict[str, DataFrame], parameters: dict[str, Any], spark: SparkSession) -> None:
        self.tokens: list[tuple[str, str]] = []
        at, text = 0, text.rstrip().rstrip(";")
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise CypherError(f"can't read {text[at : at + 20]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
            if not text[at:].strip():
                break
        self.k, self.tables, self.parameters, self.spark, self.state, self.fresh = 0, tables, parameters, spark, _State(), 0

    # Reading

    def word(self, k: int = 0) -> str:
        return self.tokens[self.k + k][1] if self.k + k < len(self.tokens) else ""

    def upper(self, k: int = 0) -> str:
        kind = self.tokens[self.k + k][0] if self.k + k < len(self.tokens) else ""
        return self.word(k).upper() if kind == "name" else self.word(k)

    def take(self, *wanted: str) -> str:
        if wanted and self.upper() not in wanted:
            raise CypherError(f"expected {' or '.join(wanted)} at {self.word()!r}")
        self.k += 1
        return self.tokens[self.k - 1][1].strip("`")

    def has(self, *words: str) -> bool:
        if all(self.upper(i) == w for i, w in enumerate(words)):
            self.k += len(words)
            return True
        return False

    def value(self) -> Any:
        """A literal, list or parameter as a Python value."""
        kind, text = self.tokens[self.k]
        if self.has("["):
            out = []
            while not self.has("]"):
                out.append(self.value())
                self.has(",")
            return out
        negative = self.has("-")
        kind, text = self.tokens[self.k]
        self.k += 1
        if kind == "string":
            return re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1])
        if kind == "number":
            number = float(text) if "." in text else int(text)
            return -number if negative else number
        if kind == "param":
            if text[1:] not in self.parameters:
                raise CypherError(f"parameter {text} has no value")
            return self.parameters[text[1:]]
        if text.upper() in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[text.upper()]
        raise CypherError(f"expected a value at {text!r}")

    # Patterns

    def node(self) -> _Node:
        self.take("(")
        name = self.take() if self.tokens[self.k][0] == "name" else ""
        if not name:
            self.fresh += 1
            name = f"_n{self.fresh}"
        label = self.take() if self.has(":") else None
        if label is not None and label not in LABELS:
            raise CypherError(f"no node label {label}")
        properties = {}
        if self.has("{"):
            while not self.has("}"):
                key = self.take()
                self.take(":")
                properties[key] = self.value()
                self.has(",")
        self.take(")")
        return _Node(name, label, properties)

    def link(self) -> _Link:
        forward = self.word() != "<-"
        self.take("-", "<-")
        self.take("[")
        name = self.take() if self.tokens[self.k][0] == "name" else None
        self.take(":")
        kind = self.take()
        if kind not in RELATIONS:
            raise CypherError(f"no relationship {kind}")
        length = None
        if self.has("*"):
            low = int(self.take()) if self.tokens[self.k][0] == "number" else 1
            high: int | None = low if self.word() != ".." and self.tokens[self.k - 1][0] == "number" else None
            if self.has(".."):
                high = int(self.take()) if self.tokens[self.k][0] == "number" else None
            if low < 1:
                raise CypherError("paths have one step or more")
            length = (low, high)
        self.take("]")
        self.take("->" if forward else "-")
        return _Link(name, kind, forward, length)

    def scan(self, node: _Node) -> DataFrame:
        table, _ = LABELS[node.label]
        rows = self.tables[table]
        if table == "symbols" and "scores" in self.tables and "pagerank" not in rows.columns:
            rows = rows.join(self.tables["scores"], "id", "left")
        for key, value in node.properties.items():
            if key not in rows.columns:
                raise CypherError(f"{node.label} has no property {key}")
            rows = rows.where(F.col(key) == F.lit(value))
        return rows.select(*(F.col(c).alias(f"{node.name}__{c}") for c in rows.columns))

    def key(self, name: str, labels: dict[str, str]) -> str:
        return f"{name}__{LABELS[labels[name]][1]}"

    def pattern(self, rows: DataFrame | None, labels: dict[str, str], links: set[str]) -> DataFrame:
        """Join one path pattern to `rows` (None: nothing bound yet)."""
        nodes, between = [self.node()], []
        while self.word() in ("-", "<-"):
            between.append(self.link())
            nodes.append(self.node())
        for k, n in enumerate(nodes):  # labels that relationships imply
            if n.label is None:
                n.label = labels.get(n.name)
            for link, is_left in ((between[k - 1], False) if k else (None, False), (between[k], True) if k < len(between) else (None, True)):
                if link is not None and n.label is None:
                    n.label = RELATIONS[link.kind][3 if is_left == link.forward else 4]
            if n.label is None:
                raise CypherError(f"({n.name}) needs a label")
        for k, n in enumerate(nodes):
            bound = n.name in labels
            if k == 0:
                if not bound:
                    found = self.scan(n)
                    rows = found if rows is None else rows.crossJoin(found)
                    labels[n.name] = n.label
            else:
                link, before = between[k - 1], nodes[k - 1]
                table, src, dst, *_ = RELATIONS[link.kind]
                edges = self.tables[table]
                left, right = (src, dst) if link.forward else (dst, src)
                if "src_kind" in edges.columns:
                    top = before if link.forward else n
                    if link.length is None:
                        edges = edges.where(F.col("src_kind") == top.label)
                self.fresh += 1
                a, b = f"_e{self.fresh}_a", f"_e{self.fresh}_b"
                if link.length is not None:
                    low, high = link.length
                    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst"))
                    closure = graph.containment_closure(pairs, high).where(F.col("depth") >= low)
                    edges = closure.select(F.col("ancestor").alias(src), F.col("descendant").alias(dst))
                shown = [c for c in edges.columns if c not in (src, dst, "src_kind")] if link.name else []
                step = edges.select(F.col(left).alias(a), F.col(right).alias(b), *(F.col(c).alias(f"{link.name}__{c}") for c in shown))
                rows = rows.join(step, F.col(self.key(before.name, labels)) == F.col(a)).drop(a)
                if link.name:
                    links.add(link.name)
                if not bound:
                    labels[n.name] = n.label
                    rows = rows.join(self.scan(n), F.col(b) == F.col(self.key(n.name, labels)))
                else:
                    rows = rows.where(F.col(b) == F.col(self.key(n.name, labels)))
                rows = rows.drop(b)
            if bound:
                for key, value in n.properties.items():
                    rows = rows.where(F.col(f"{n.name}__{key}") == F.lit(value))
        return rows

    def match(self, optional: bool) -> None:
        s = self.state
        if not optional:
            s.rows = self.pattern(s.rows, s.labels, s.links)
            while self.has(","):
                s.rows = self.pattern(s.rows, s.labels, s.links)
            if self.has("WHERE"):
                s.rows = s.rows.where(self.condition())
            return
        if s.rows is None:
            raise CypherError("OPTIONAL MATCH needs a MATCH before it")
        # The pattern over the distinct bound keys, then an outer join back.
        keys = [self.key(n, s.labels) for n in s.labels]
        base = s.rows.select(*s.rows.columns)
        inner_labels, inner_links = dict(s.labels), set(s.links)
        found = self.pattern(base.dropDuplicates(keys), inner_labels, inner_links)
        s.labels, s.links = inner_labels, inner_links
        if self.has("WHERE"):
            s.rows = found  # the condition may name what the pattern binds
            found = found.where(self.condition())
        new = [c for c in found.columns if c not in base.columns]
        found = found.select(*(F.col(k).alias(f"_o_{k}") for k in keys), *new)
        on = [base[k].eqNullSafe(found[f"_o_{k}"]) for k in keys]
        s.rows = base.join(found, on, "left").drop(*(f"_o_{k}" for k in keys))

    # Expressions

    def condition(self) -> Column:
        left = self.conjunction()
        while self.has("OR"):
            left = left | self.conjunction()
        return left

    def conjunction(self) -> Column:
        left = self.negation()
        while self.has("AND"):
            left = left & self.negation()
        return left

    def negation(self) -> Column:
        if self.has("NOT"):
            return ~self.negation()
        if self.word() == "(":
            self.take("(")
            inner = self.condition()
            self.take(")")
            return inner
        left = self.expression()
        if self.has("IS", "NOT", "NULL"):
            return left.isNotNull()
        if self.has("IS", "NULL"):
            return left.isNull()
        if self.has("IN"):
            return left.isin(*self.value())
        for words, make in ((("CONTAINS",), left.contains), (("STARTS", "WITH"), left.startswith), (("ENDS", "WITH"), left.endswith)):
            if self.has(*words):
                return make(self.expression())
        sign = self.take("=", "<>", "<", ">", "<=", ">=")
        right = self.expression()
        return {"=": left == right, "<>": left != right, "<": left < right, ">": left > right, "<=": left <= right, ">=": left >= right}[sign]

    def expression(self) -> Column:
        kind, text = self.tokens[self.k] if self.k < len(self.tokens) else ("", "")
        if kind == "name" and text.upper() not in ("TRUE", "FALSE", "NULL"):
            if self.word(1) == "(":
                return self.call()
            name = self.take()
            if self.has("."):
                column = f"{name}__{self.take()}"
                if self.state.rows is None or column not in self.state.rows.columns:
                    raise CypherError(f"nothing is called {column.replace('__', '.')}")
                return F.col(column)
            if name in self.state.labels:
                return F.col(self.key(name, self.state.labels))
            if name in self.state.values:
                return F.col(name)
            raise CypherError(f"nothing is called {name}")
        return F.lit(self.value())

    AGGREGATES = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "collect": F.collect_list}
    SCALARS = {"lower": F.lower, "tolower": F.lower, "upper": F.upper, "toupper": F.upper, "size": F.length, "length": F.length, "abs": F.abs, "coalesce": F.coalesce}

    def call(self) -> Column:
        name = self.take().lower()
        self.take("(")
        if name in self.AGGREGATES:
            self.aggregated = True
            distinct = self.has("DISTINCT")
            inner = F.lit(1) if self.has("*") else self.expression()
            self.take(")")
            if distinct:
                return F.countDistinct(inner) if name == "count" else self.AGGREGATES[name](inner) if name in ("min", "max") else F.collect_set(inner) if name == "collect" else F.sum_distinct(inner)
            return self.AGGREGATES[name](inner)
        if name not in self.SCALARS:
            raise CypherError(f"no function {name}")
        inner = [self.expression()]
        while self.has(","):
            inner.append(self.expression())
        self.take(")")
        return self.SCALARS[name](*inner)

    # Statements

    def run(self) -> DataFrame:
        while self.k < len(self.tokens):
            word = self.upper()
            if word in _CHANGES:
                raise CypherError(f"{word} is not allowed: queries only read the graph")
            if self.has("OPTIONAL", "MATCH"):
                self.match(True)
            elif self.has("MATCH"):
                self.match(False)
            elif self.has("UNWIND"):
                items = self.value()
                self.take("AS")
                name = self.take()
                rows = self.spark.range(1).select(F.explode(F.array(*map(F.lit, items))).alias(name)) if items else self.spark.range(0).select(F.lit("").alias(name))
                self.state.rows = rows if self.state.rows is None else self.state.rows.crossJoin(rows)
                self.state.values.add(name)
            elif self.has("RETURN"):
                return self.finish()
            else:
                raise CypherError(f"can't run {self.word()!r}")
        raise CypherError("a query ends with RETURN")

    def finish(self) -> DataFrame:
        distinct = self.has("DISTINCT")
        shown: list[tuple[str, Column, bool]] = []
        while True:
            begin, self.aggregated = self.k, False
            column = self.expression()
            text = "".join(t for _, t in self.tokens[begin : self.k])
            shown.append((self.take() if self.has("AS") else text, column, self.aggregated))
            if not self.has(","):
                break
        rows = self.state.rows if self.state.rows is not None else self.spark.range(1)
        order: list[tuple[Column, bool]] = []
        names = {n for n, _, _ in shown}
        grouped = any(a for _, _, a in shown)
        if self.has("ORDER", "BY"):
            while True:
                begin = self.k
                if self.tokens[self.k][0] == "name" and self.word() in names and self.word(1) not in (".", "("):
                    column = F.col(f"`{self.take()}`")
                    shown_column = True
                else:
                    column, shown_column = self.expression(), False
                    text = "".join(t for _, t in self.tokens[begin : self.k])
                    if text in names:
                        column, shown_column = F.col(f"`{text}`"), True
                down = self.has("DESC") or self.has("DESCENDING")
                if not down:
                    self.has("ASC") or self.has("ASCENDING")
                order.append((column.desc_nulls_last() if down else column.asc_nulls_last(), shown_column))
                if not self.has(","):
                    break
        if grouped:
            keys = [c.alias(n) for n, c, a in shown if not a]
            rows = rows.groupBy(*keys).agg(*(c.alias(n) for n, c, a in shown if a)).select(*(F.col(f"`{n}`") for n, _, _ in shown))
            rows = rows.orderBy(*(c for c, _ in order)) if order else rows
        else:
            hidden = [c for c, is_shown in order if not is_shown]
            if hidden and distinct:
                raise CypherError("order a distinct result by what it returns")
            if order and not hidden:
                rows = rows.select(*(c.alias(n) for n, c, _ in shown))
                rows = (rows.distinct() if distinct else rows).orderBy(*(c for c, _ in order))
            elif order:
                extra = rows.withColumns({n: c for n, c, _ in shown if n not in rows.columns})
                rows = extra.orderBy(*(c for c, _ in order)).select(*(F.col(f"`{n}`") for n, _, _ in shown))
            else:
                rows = rows.select(*(c.alias(n) for n, c, _ in shown))
                rows = rows.distinct() if distinct else rows
        if self.has("SKIP"):
            rows = rows.offset(int(self.value()))
        if self.has("LIMIT"):
            rows = rows.limit(int(self.value()))
        if self.k < len(self.tokens):
            raise CypherError(f"can't read on from {self.word()!r}")
        return rows


def cypher(text: str, tables: dict[str, DataFrame], parameters: dict[str, Any] | None = None) -> DataFrame:
    """The result of a read-only statement over the graph's tables (files, symbols, chunks,
    scores, imports, calls, contains, documented_by), as a lazy DataFrame."""
    spark = next(iter(tables.values())).sparkSession
    return _Run(text, tables, parameters or {}, spark).run()
