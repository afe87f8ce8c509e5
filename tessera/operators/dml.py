"""Insert, update and delete as new DataFrames; tables are replaced, never changed in place."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import LengthError, NotNullError, UniqueError


def conform(rows: DataFrame, like: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    """rows with the columns and types of like; columns that rows lack get their default or null."""
    have, given = set(rows.columns), defaults or {}
    return rows.select(*((F.col(f.name) if f.name in have else given.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in like.schema))


def insert(df: DataFrame, rows: DataFrame, defaults: Mapping[str, Column] | None = None) -> DataFrame:
    return df.unionByName(conform(rows, df, defaults))


def update(df: DataFrame, changes: Mapping[str, Column], where: Column | None = None) -> DataFrame:
    """All rows, with changed columns where the predicate is true. Changes see the old values."""
    hit = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    return df.select(*(F.when(hit, changes[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in changes else F.col(f.name) for f in df.schema))


def delete(df: DataFrame, where: Column | None = None) -> DataFrame:
    """The rows for which the predicate is false or null."""
    return df.where(~F.coalesce(where, F.lit(False))) if where is not None else df.limit(0)


def check(df: DataFrame, not_null: list[str], lengths: Mapping[str, int], key: list[str]) -> None:
    """Raises if rows break a constraint: one pass for nulls and byte lengths, one for the key."""
    tests = {("null", c): F.count_if(F.col(c).isNull()) for c in not_null}
    tests |= {("length", c): F.count_if(F.octet_length(c) > n) for c, n in lengths.items()}
    if tests:
        row = df.agg(*(t.alias(f"t{i}") for i, t in enumerate(tests.values()))).first()
        for (kind, c), n in zip(tests, row, strict=True):
            if n and kind == "null":
                raise NotNullError(f"column {c} cannot be NULL")
            if n:
                raise LengthError(f"value too long for column {c}: {lengths[c]} bytes at most")
    if key and not df.groupBy(*key).count().where("count > 1").limit(1).isEmpty():
        raise UniqueError(f"duplicate primary key ({', '.join(key)})")
