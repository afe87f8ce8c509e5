"""Column types of CREATE TABLE and their Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from tessera.errors import TypeNameError

#: Type names and what they store. FLOAT is 64 bits wide.
TYPES: dict[str, T.DataType] = {
    "INTEGER": T.IntegerType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.DoubleType(), "DOUBLE": T.DoubleType(),
    "BOOLEAN": T.BooleanType(), "BOOL": T.BooleanType(), "TEXT": T.StringType(), "BLOB": T.BinaryType(),
}


def parse_type(text: str) -> tuple[T.DataType, int | None]:
    """(Spark type, largest length in bytes) of a type name; VARCHAR needs a length."""
    if m := re.fullmatch(r"VARCHAR\s*\(\s*(\d+)\s*\)", text.strip(), re.I):
        return T.StringType(), int(m[1])
    name = text.strip().upper()
    if name not in TYPES:
        raise TypeNameError(f"unknown type {text.strip()}")
    return TYPES[name], None
