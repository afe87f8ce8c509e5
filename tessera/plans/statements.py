"""Statements that Spark's own parser does not take on Parquet tables: DDL types and constraints, and DML.

Only the frame of a statement is read here; every expression in it is left to Spark SQL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from tessera.errors import StatementError
from tessera.functions.types import parse_type

WORD = re.compile(r"\s+|'(?:[^'\\]|\\.|'')*'|\"[^\"]*\"|`[^`]*`|--[^\n]*|\w+|<>|<=|>=|!=|.", re.S)


@dataclass
class ColumnDef:
    name: str
    type_text: str
    nullable: bool = True
    default: str | None = None
    primary_key: bool = False


@dataclass
class CreateTable:
    table: str
    columns: list[ColumnDef]
    primary_key: list[str]


@dataclass
class DropTable:
    table: str
    if_exists: bool = False


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list[str]] = field(default_factory=list)
    select: str | None = None


@dataclass
class Update:
    table: str
    changes: dict[str, str]
    where: str | None


@dataclass
class Delete:
    table: str
    where: str | None


@dataclass
class Select:
    text: str


def words(text: str) -> list[str]:
    """The tokens of a statement, without a final semicolon; white space and comments are one space."""
    out = [" " if t.isspace() or t.startswith("--") else t for t in WORD.findall(text.strip())]
    while out and out[-1] in (";", " "):
        out.pop()
    return out


class _Reader:
    def __init__(self, text: str) -> None:
        self.t, self.at = words(text), 0

    def skip(self) -> None:
        while self.at < len(self.t) and self.t[self.at] == " ":
            self.at += 1

    def peek(self) -> str:
        self.skip()
        return self.t[self.at].upper() if self.at < len(self.t) else ""

    def take(self) -> str:
        self.skip()
        if self.at >= len(self.t):
            raise StatementError("the statement ends too soon")
        self.at += 1
        return self.t[self.at - 1]

    def expect(self, *names: str) -> None:
        for name in names:
            got = self.take()
            if got.upper() != name:
                raise StatementError(f"expected {name}, got {got}")

    def accept(self, *names: str) -> bool:
        mark = self.at
        for name in names:
            if self.peek() != name:
                self.at = mark
                return False
            self.take()
        return True

    def name(self) -> str:
        got = self.take()
        if got[0] in '"`':
            return got[1:-1]
        if not re.fullmatch(r"\w+", got):
            raise StatementError(f"expected a name, got {got}")
        return got

    def until(self, *stops: str) -> str:
        """Text up to a stop word or sign outside brackets; the stop stays."""
        out, depth = [], 0
        while self.at < len(self.t):
            tok = self.t[self.at]
            if depth == 0 and tok.upper() in stops:
                break
            depth += (tok == "(") - (tok == ")")
            if depth < 0:
                break
            out.append(tok)
            self.at += 1
        return "".join(out).strip()

    def end(self) -> None:
        if self.peek():
            raise StatementError(f"unexpected {self.take()}")

    def names(self) -> list[str]:
        self.expect("(")
        out = [self.name()]
        while self.accept(","):
            out.append(self.name())
        self.expect(")")
        return out


def parse(text: str):
    r = _Reader(text)
    head = r.peek()
    if head in ("SELECT", "WITH", "VALUES", "("):
        return Select("".join(r.t))
    reader = {"CREATE": _create, "DROP": _drop, "INSERT": _insert, "UPDATE": _update, "DELETE": _delete}.get(head)
    if reader is None:
        raise StatementError(f"unknown statement {head or 'without text'}")
    out = reader(r)
    r.end()
    return out


def _create(r: _Reader) -> CreateTable:
    r.expect("CREATE", "TABLE")
    table, columns, key = r.name(), [], []
    r.expect("(")
    while True:
        if r.accept("PRIMARY", "KEY"):
            key = r.names()
        else:
            columns.append(_column(r))
        if not r.accept(","):
            break
    r.expect(")")
    key = key or [c.name for c in columns if c.primary_key]
    names = [c.name for c in columns]
    if len(set(names)) < len(names) or set(key) - set(names):
        raise StatementError("repeated or unknown column")
    for c in columns:
        c.primary_key = c.name in key
        c.nullable = c.nullable and not c.primary_key
    return CreateTable(table, columns, key)


def _column(r: _Reader) -> ColumnDef:
    out = ColumnDef(r.name(), r.take())
    if r.peek() == "(":
        r.take()
        out.type_text += f"({r.until(')')})"
        r.expect(")")
    parse_type(out.type_text)
    while r.peek() not in (",", ")", ""):
        if r.accept("NOT", "NULL"):
            out.nullable = False
        elif r.accept("PRIMARY", "KEY"):
            out.primary_key = True
        elif r.accept("DEFAULT"):
            out.default = r.until(",", "NOT", "NULL", "PRIMARY") or r.take()
        else:
            r.expect("NULL")
    return out


def _drop(r: _Reader) -> DropTable:
    r.expect("DROP", "TABLE")
    quiet = r.accept("IF", "EXISTS")
    return DropTable(r.name(), quiet)


def _insert(r: _Reader) -> Insert:
    r.expect("INSERT", "INTO")
    out = Insert(r.name(), None)
    if r.peek() == "(":
        out.columns = r.names()
    if r.peek() in ("SELECT", "WITH"):
        out.select = r.until()
        return out
    r.expect("VALUES")
    while True:
        r.expect("(")
        row = [r.until(",")]
        while r.accept(","):
            row.append(r.until(","))
        r.expect(")")
        out.rows.append(row)
        if not r.accept(","):
            return out


def _update(r: _Reader) -> Update:
    r.expect("UPDATE")
    table, changes = r.name(), {}
    r.expect("SET")
    while True:
        column = r.name()
        r.expect("=")
        changes[column] = r.until(",", "WHERE")
        if not r.accept(","):
            break
    return Update(table, changes, r.until() if r.accept("WHERE") else None)


def _delete(r: _Reader) -> Delete:
    r.expect("DELETE", "FROM")
    table = r.name()
    return Delete(table, r.until() if r.accept("WHERE") else None)
