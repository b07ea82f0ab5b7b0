"""Database schemas: tables with entity-typed columns, keysets, unions of entity types and cases."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T


class SchemeError(ValueError):
    """A schema that does not parse; says where."""


@dataclass
class Column:
    name: str
    storage: str  # int, float, string, boolean, date, varchar
    entity: str | None = None
    unique: bool = False
    ref: bool = False


@dataclass
class Table:
    name: str
    columns: list[Column]
    keysets: list[list[str]] = field(default_factory=list)

    def struct(self) -> T.StructType:
        """The Spark type; what Spark has no place for is in the metadata."""
        kinds = {"int": T.LongType(), "float": T.DoubleType(), "boolean": T.BooleanType(), "date": T.DateType()}
        return T.StructType([T.StructField(c.name, kinds.get(c.storage, T.StringType()), True, {k: v for k, v in (("entity", c.entity), ("unique", c.unique), ("ref", c.ref)) if v}) for c in self.columns])

    def ddl(self) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.struct())


@dataclass
class Case:
    entity: str
    column: str
    branches: list[tuple[int, str]]


@dataclass
class DbScheme:
    text: str
    tables: dict[str, Table] = field(default_factory=dict)
    unions: dict[str, list[str]] = field(default_factory=dict)
    cases: list[Case] = field(default_factory=list)

    def has_key(self, table: str) -> bool:
        t = self.tables.get(table)
        return bool(t and (t.keysets or any(c.unique for c in t.columns)))

    def keyed_by(self, entity: str) -> list[tuple[str, int]]:
        return [(t.name, 0) for t in self.tables.values() if t.columns and t.columns[0].unique and t.columns[0].entity == entity]

    def cases_of(self, entity: str) -> list[tuple[str, int, int, int]]:
        out = []
        for case in self.cases:
            for table, column in self.keyed_by(case.entity):
                names = [c.name for c in self.tables[table].columns]
                if case.column in names:
                    out += [(table, column, names.index(case.column), value) for value, name in case.branches if name == entity]
        return out

    def members(self, entity: str) -> set[str]:
        """All entity types that are part of one, itself included."""
        seen, waiting = set(), [entity]
        while waiting:
            e = waiting.pop()
            if e not in seen:
                seen.add(e)
                waiting += self.unions.get(e, [])
        return seen


_TOKEN = re.compile(r"(?P<skip>\s+|//[^\n]*)|(?P<word>[@#]?[A-Za-z_][A-Za-z0-9_]*)|(?P<number>-?\d+)|(?P<sign>[()\[\],:;=|.*]|\.\.)")


def _blanked(text: str) -> str:
    """Nested block comments as blanks, so that places stay."""
    out, depth, at = [], 0, 0
    while at < len(text):
        if text.startswith("/*", at):
            depth, at = depth + 1, at + 2
            out.append("  ")
        elif depth and text.startswith("*/", at):
            depth, at = depth - 1, at + 2
            out.append("  ")
        else:
            out.append(text[at] if not depth or text[at] == "\n" else " ")
            at += 1
    if depth:
        raise SchemeError("a comment is not closed")
    return "".join(out)


def _tokens(text: str) -> list[tuple[str, int]]:
    out, at, plain = [], 0, _blanked(text)
    while at < len(plain):
        m = _TOKEN.match(plain, at)
        if not m:
            raise SchemeError(f"line {plain.count(chr(10), 0, at) + 1}: unexpected {plain[at]!r}")
        if m.lastgroup != "skip":
            out.append((m[0], plain.count("\n", 0, at) + 1))
        at = m.end()
    return out


def parse_dbscheme(text: str) -> DbScheme:
    out, tokens, at = DbScheme(text), _tokens(text), 0

    def peek(k: int = 0) -> str:
        return tokens[at + k][0] if at + k < len(tokens) else ""

    def take(want: str | None = None) -> str:
        nonlocal at
        got = peek()
        if not got or (want is not None and got != want):
            line = tokens[min(at, len(tokens) - 1)][1] if tokens else 1
            raise SchemeError(f"line {line}: expected {want or 'more'}, found {got or 'the end'}")
        at += 1
        return got

    keysets: list[list[str]] = []
    while at < len(tokens):
        if peek() == "#keyset":
            take()
            take("[")
            names = [take()]
            while peek() == ",":
                take()
                names.append(take())
            take("]")
            keysets.append(names)
        elif peek() == "case":
            take()
            entity = take()
            take(".")
            column = take()
            take("of")
            branches = []
            while True:
                value = int(take())
                take("=")
                branches.append((value, take()))
                if peek() != "|":
                    break
                take()
            take(";")
            out.cases.append(Case(entity, column, branches))
        elif peek().startswith("@"):
            name = take()
            take("=")
            members = [take()]
            while peek() == "|":
                take()
                members.append(take())
            take(";")
            out.unions[name] = members
        else:
            name = take()
            take("(")
            columns = []
            while peek() != ")":
                unique = peek() == "unique" and bool(take())
                storage = take()
                if peek() == "(":
                    take()
                    take()
                    take(")")
                own = take()
                entity = None
                if peek() == ":":
                    take()
                    kind = take()
                    entity = kind if kind.startswith("@") else None
                ref = peek() == "ref" and bool(take())
                columns.append(Column(own, storage, entity, unique, ref))
                if peek() == ",":
                    take()
            take(")")
            if peek() == ";":
                take()
            out.tables[name] = Table(name, columns, keysets)
            keysets = []
    return out
