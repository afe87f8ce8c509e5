"""Segments, zone maps and codec statistics of columns, as grouped aggregates.

A segment is the rows with one value of an integer expression, for instance a dense key divided by the
segment's size: segments are found without a global order and without gathering rows.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import bit_length

#: Bytes of a value by type; a text takes four bytes and its length.
WIDTHS = {T.IntegerType: 4, T.LongType: 8, T.DoubleType: 8, T.BooleanType: 1}


def segment_of(key: str, rows: int) -> Column:
    return F.expr(f"{key} div {rows}").alias("segment")


def zone_maps(df: DataFrame, column: str, segment: Column) -> DataFrame:
    """(segment, min, max, nulls, rows) of each segment of a column."""
    return df.groupBy(segment.alias("segment")).agg(F.min(column).alias("min_value"), F.max(column).alias("max_value"), F.count_if(F.col(column).isNull()).alias("null_count"), F.count(F.lit(1)).alias("row_count"))


def may_contain(value) -> Column:
    """Whether a segment may hold a value, by its zone map; None asks for nulls."""
    if value is None:
        return F.col("null_count") > 0
    return F.col("min_value").isNull() | F.col("max_value").isNull() | F.lit(value).between(F.col("min_value"), F.col("max_value"))


def may_match_range(low, high) -> Column:
    """Whether a segment's values may meet an interval."""
    return F.col("min_value").isNull() | F.col("max_value").isNull() | ~((F.col("max_value") < F.lit(low)) | (F.col("min_value") > F.lit(high)))


def may_match(op: str, value) -> Column:
    """Whether a segment may hold a row for which `column op value`."""
    known = {"=": F.lit(value).between(F.col("min_value"), F.col("max_value")), "<": F.col("min_value") < value, "<=": F.col("min_value") <= value, ">": F.col("max_value") > value, ">=": F.col("max_value") >= value}
    return known[op]


def zone_scan(df: DataFrame, column: str, segment: Column, op: str, value, *others: tuple) -> DataFrame:
    """All rows of the segments that may match; rows are not filtered, segments are. others: further (op, value),
    one of which is enough."""
    test = reduce(or_, (may_match(*t) for t in ((op, value), *others)))
    wanted = zone_maps(df, column, segment).where(test).select(F.col("segment").alias("_wanted"))
    return df.withColumn("segment", segment).join(wanted, F.col("segment") == F.col("_wanted"), "left_semi")


def _width(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.lit(4) + F.octet_length(column)
    return F.lit(WIDTHS[type(kind)])


def rle_runs(df: DataFrame, column: str, segment: Column, order: str) -> DataFrame:
    """(segment, runs, null_runs, run_bytes): runs of equal values in order; nulls form runs too."""
    window = Window.partitionBy("segment").orderBy("o")
    given = df.select(segment.alias("segment"), F.col(order).alias("o"), F.col(column).alias("v"), _width(df, column).alias("w"))
    first = given.withColumn("first", ~F.coalesce(F.lag("v").over(window).eqNullSafe(F.col("v")) & (F.row_number().over(window) > 1), F.lit(False)))
    return first.where("first").groupBy("segment").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("v").isNull()).alias("null_runs"), F.sum(F.lit(5) + F.when(F.col("v").isNull(), 0).otherwise(F.col("w"))).alias("run_bytes"))


def value_sizes(df: DataFrame, column: str, segment: Column) -> DataFrame:
    """Rows (n), values (m), distinct values (entries), and the encoded bytes of each segment with the codecs that
    do not depend on the order: values are counted once, and everything follows from these counts."""
    given = df.select(segment.alias("segment"), F.col(column).alias("v"), _width(df, column).alias("w"))
    counts = given.groupBy("segment", "v", "w").agg(F.count(F.lit(1)).alias("c"))
    some, number = F.col("v").isNotNull(), isinstance(df.schema[column].dataType, T.IntegerType | T.LongType)
    zero = lambda x: F.coalesce(F.sum(F.when(some, x)), F.lit(0)).cast("long")
    spread = (F.max("v") - F.min("v")) if number else F.lit(None).cast("long")
    sums = counts.groupBy("segment").agg(F.sum("c").alias("n"), zero(F.col("c")).alias("m"), F.count("v").alias("entries"), zero(F.col("c") * F.col("w")).alias("values"), zero(4 + F.col("w")).alias("entry_bytes"), spread.alias("spread"))
    head = (F.lit(4) + F.ceil(F.col("n") / 8)).cast("long")
    out = sums.withColumn("plain_bytes", head + F.col("values")).withColumn("dictionary_bytes", head + 4 + F.col("entry_bytes") + 4 * F.col("n"))
    if number:
        bits = F.when(F.col("m") == 0, 0).when(F.col("spread") == 0, 1).otherwise(bit_length(F.col("spread"))).cast("int")
        out = out.withColumn("bits", bits).withColumn("bitpack_bytes", (head + 9 + F.ceil(F.col("m") * F.col("bits") / 8)).cast("long"))
    else:
        out = out.withColumn("bits", F.lit(None).cast("int")).withColumn("bitpack_bytes", F.col("plain_bytes"))
    return out.drop("values", "entry_bytes", "spread")


def codec_sizes(df: DataFrame, column: str, segment: Column, order: str) -> DataFrame:
    """Encoded bytes of each segment with each codec, and the sizes that ratios refer to: one pass for the
    values, one in order for their runs."""
    runs = rle_runs(df, column, segment, order).drop("null_runs")
    out = value_sizes(df, column, segment).join(runs, "segment")
    head = (F.lit(8) + F.ceil(F.col("n") / 8)).cast("long")
    return out.withColumn("rle_bytes", head + F.col("run_bytes")).drop("run_bytes")


def compression_ratio(df: DataFrame, column: str, segment: Column, order: str, codec: str) -> DataFrame:
    """(codec, ratio): mean over segments of raw size to encoded size; texts and booleans count as
    their encoded size."""
    sizes = codec_sizes(df, column, segment, order) if codec == "rle" else value_sizes(df, column, segment)
    width = {T.IntegerType: 4, T.LongType: 8, T.DoubleType: 8}.get(type(df.schema[column].dataType))
    raw = F.col("n") * width if width else F.col(f"{codec}_bytes")
    return sizes.agg(F.avg(raw / F.greatest(F.lit(1), F.col(f"{codec}_bytes"))).alias("ratio")).select(F.lit(codec).alias("codec"), "ratio")


def rle_encode(df: DataFrame, column: str, segment: Column, order: str) -> DataFrame:
    """(segment, start, length, value): the runs of each segment, from place start on."""
    window = Window.partitionBy("segment").orderBy("o")
    given = df.select(segment.alias("segment"), F.col(order).alias("o"), F.col(column).alias("value")).withColumn("place", F.row_number().over(window) - 1)
    first = ~F.coalesce(F.lag("value").over(window).eqNullSafe(F.col("value")) & (F.col("place") > 0), F.lit(False))
    starts = given.withColumn("first", first).withColumn("run", F.sum(F.col("first").cast("int")).over(window))
    return starts.groupBy("segment", "run").agg(F.min("place").alias("start"), F.count(F.lit(1)).alias("length"), F.first("value").alias("value")).drop("run")


def rle_decode(runs: DataFrame) -> DataFrame:
    """(segment, place, value) of the rows that runs stand for."""
    return runs.select("segment", F.explode(F.sequence(F.col("start").cast("long"), F.col("start") + F.col("length") - 1)).alias("place"), "value")


def dictionary_encode(df: DataFrame, column: str, segment: Column, order: str) -> tuple[DataFrame, DataFrame]:
    """(entries, codes): (segment, code, value) with codes in the order of values, and (segment, place, code),
    null for nulls."""
    given = df.select(segment.alias("segment"), F.col(order).alias("o"), F.col(column).alias("value"))
    entries = given.where("value IS NOT NULL").select("segment", "value").distinct().withColumn("code", F.row_number().over(Window.partitionBy("segment").orderBy("value")) - 1)
    placed = given.withColumn("place", F.row_number().over(Window.partitionBy("segment").orderBy("o")) - 1)
    return entries.select("segment", "code", "value"), placed.join(entries, ["segment", "value"], "left").select("segment", "place", "code")


def dictionary_decode(entries: DataFrame, codes: DataFrame) -> DataFrame:
    return codes.join(entries, ["segment", "code"], "left").select("segment", "place", "value")


def bitpack_encode(df: DataFrame, column: str, segment: Column, order: str) -> DataFrame:
    """(segment, low, bits, rows, packed): integers less their least, as strings of bits end to end, and nulls by a
    null in place of bits."""
    given = df.select(segment.alias("segment"), F.col(order).alias("o"), F.col(column).cast("long").alias("v"))
    ranged = value_sizes(df, column, segment).select("segment", F.col("bits")).join(given.groupBy("segment").agg(F.min("v").alias("low")), "segment")
    both = given.join(ranged, "segment").withColumn("code", F.when(F.col("v").isNotNull(), F.lpad(F.bin(F.col("v") - F.col("low")), F.col("bits"), F.lit("0"))))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o", "code"))), lambda x: x["code"])
    return both.groupBy("segment", "low", "bits").agg(ordered.alias("packed")).withColumn("rows", F.size("packed"))


def bitpack_decode(packed: DataFrame) -> DataFrame:
    """(segment, place, value)."""
    out = packed.select("segment", "low", F.posexplode("packed").alias("place", "code"))
    return out.select("segment", "place", (F.col("low") + F.conv("code", 2, 10).cast("long")).alias("value"))
