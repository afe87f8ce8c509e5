"""Global and grouped aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import StatementError

FUNCTIONS = {
    "count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max,
    "count_distinct": F.count_distinct, "sum_distinct": F.sum_distinct, "approx_count_distinct": F.approx_count_distinct,
}


def measure(function: str, column: str | Column = "*", alias: str | None = None) -> Column:
    """An aggregate by name; count of "*" counts rows."""
    name = function.lower()
    if name not in FUNCTIONS:
        raise StatementError(f"unknown aggregate {function}")
    if isinstance(column, str) and column == "*":
        if name != "count":
            raise StatementError(f"{function}(*) has no meaning")
        return F.count(F.lit(1)).alias(alias or "count(*)")
    return FUNCTIONS[name](column).alias(alias or f"{name}({column if isinstance(column, str) else 'expr'})")


def aggregate(df: DataFrame, measures: list[Column], by: list[str | Column] | None = None, having: Column | None = None) -> DataFrame:
    """One row for each group, or one row if there are no groups. Sums are partial before the shuffle."""
    out = df.groupBy(*by).agg(*measures) if by else df.agg(*measures)
    return out.where(having) if having is not None else out
