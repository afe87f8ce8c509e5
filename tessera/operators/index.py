"""Lookups by key. Parquet statistics and pushed filters take the place of a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.errors import KeyNotFoundError, UniqueError


def point(df: DataFrame, key: str, value) -> DataFrame:
    """The rows with a key."""
    return df.where(F.col(key) == F.lit(value))


def key_range(df: DataFrame, key: str, low=None, high=None) -> DataFrame:
    """The rows with keys from low to high, both included, in order; an open end is None."""
    out = df if low is None else df.where(F.col(key) >= F.lit(low))
    out = out if high is None else out.where(F.col(key) <= F.lit(high))
    return out.orderBy(key)


def ordered(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key)


def bounds(df: DataFrame, key: str) -> DataFrame:
    """The least and greatest key and the number of entries; null keys without rows."""
    return df.agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count(key).alias("entries"))


def contains(df: DataFrame, key: str, value) -> bool:
    return not point(df, key, value).limit(1).isEmpty()


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries")).where("entries > 1")


def inserted(df: DataFrame, rows: DataFrame, *keys: str) -> DataFrame:
    """df with rows; raises UniqueError if a key then occurs twice."""
    out = df.unionByName(rows)
    if not duplicates(out, *keys).limit(1).isEmpty():
        raise UniqueError(f"duplicate key in {', '.join(keys)}")
    return out


def removed(df: DataFrame, key: str, value) -> DataFrame:
    """df without a key's rows; raises KeyNotFoundError if there are none."""
    if not contains(df, key, value):
        raise KeyNotFoundError(f"no key {value}")
    return df.where(~F.col(key).eqNullSafe(F.lit(value)))
