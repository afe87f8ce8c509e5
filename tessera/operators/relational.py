"""Scan, project, filter, join, sort, limit as DataFrame plans that Catalyst optimises.

Physical strategies are Spark's; a strategy argument is a hint. A broadcast is asked for only through
Spark's size check, never forced on a side of unknown size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import StatementError

JOINS = {"inner": "inner", "left": "left", "right": "right", "cross": "cross", "full": "full", "semi": "left_semi", "anti": "left_anti"}
HINTS = {"hash": "shuffle_hash", "merge": "merge"}


def scan(df: DataFrame, columns: list[str] | None = None, where: list[Column] | None = None, alias: str | None = None, prefix: bool = False) -> DataFrame:
    """A table's rows: pushed predicates, pruned columns, an alias, and names prefixed by it if asked."""
    out = filtered(df, *(where or []))
    out = out.select(*columns) if columns else out
    if prefix and alias:
        return out.select(*(F.col(c).alias(f"{alias}.{c}") for c in out.columns))
    return out.alias(alias) if alias else out


def filtered(df: DataFrame, *predicates: Column) -> DataFrame:
    """Rows for which all predicates are true; null counts as false."""
    return df.where(reduce(lambda a, b: a & b, predicates)) if predicates else df


def project(df: DataFrame, **columns: Column) -> DataFrame:
    return df.select(*(c.alias(name) for name, c in columns.items()))


def join(left: DataFrame, right: DataFrame, on: Column | None = None, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """A join of any kind on any condition. Without a condition only a cross join is allowed."""
    if how not in JOINS:
        raise StatementError(f"unknown join {how}")
    if on is None:
        if how != "cross":
            raise StatementError(f"a {how} join needs a condition")
        return left.crossJoin(right)
    right = right.hint(HINTS[strategy]) if strategy else right
    return left.join(right, on, "inner" if how == "cross" else JOINS[how])


def sort(df: DataFrame, *keys: Column | str) -> DataFrame:
    """Sorted rows, each key in its own direction; nulls first ascending, last descending."""
    return df.orderBy(*keys)


def limit(df: DataFrame, n: int, offset: int = 0) -> DataFrame:
    if n < 0 or offset < 0:
        raise StatementError("limit and offset cannot be negative")
    return df.offset(offset).limit(n) if offset else df.limit(n)


def top_k(df: DataFrame, n: int, *keys: Column | str) -> DataFrame:
    """The first n rows by the keys; each task keeps n rows, nothing is sorted whole."""
    return df.orderBy(*keys).limit(n)
