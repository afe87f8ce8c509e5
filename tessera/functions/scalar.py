"""Scalar expressions whose semantics differ from Spark's operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_mod(a: Column, n: Column) -> Column:
    """Remainder with the sign of the divisor; null for a zero divisor."""
    safe = F.nullif(n, F.lit(0))
    return (a % safe + safe) % safe


def divide(a: Column, b: Column) -> Column:
    """True division as a double; null for a zero divisor."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def bit_length(n: Column) -> Column:
    """Bits of a non-negative integer; 0 for 0."""
    return F.when(n > 0, F.length(F.bin(n))).otherwise(0)
