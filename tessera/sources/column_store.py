"""A columnar table in segments: batches are appended as Parquet, scans skip segments by zone maps.

Every row carries its place (_row) and segment (_segment: at most segment_rows rows of one batch and
one task, or what the caller says). A batch's zone maps are written with it, with the file of each segment, so
a scan reads only the files that hold segments it wants. Parquet's own encodings, statistics and pruning store and read the columns; the zone maps and
codec sizes here describe the logical segments.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import CatalogError, StatementError
from tessera.operators import aggregates, columnar
from tessera.operators.dml import conform

HIDDEN = ("_row", "_segment")
CODECS = ("plain", "rle", "dictionary", "bitpack")


class ColumnStore:
    """Columns declared one by one, filled by batches, under a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, segment_rows: int = 65536) -> None:
        if segment_rows < 1:
            raise StatementError("segment_rows must be at least 1")
        self.spark, self.path, self.segment_rows = spark, path.rstrip("/"), segment_rows
        self.schema = T.StructType()
        self.batches: list[str] = []

    def add_column(self, name: str, kind: T.DataType | str) -> None:
        """Declares a column; earlier batches read as null in it."""
        if name in self.schema.names or name in HIDDEN:
            raise CatalogError(f"column {name} is already there")
        kind = T.StructType.fromDDL(f"c {kind}")[0].dataType if isinstance(kind, str) else kind
        self.schema = T.StructType([*self.schema.fields, T.StructField(name, kind)])

    def insert(self, rows: DataFrame | Iterable[Mapping], segment: Column | None = None) -> int:
        """Appends a batch; missing columns are null. Returns the number of rows. segment: an expression over the
        rows; they are then dealt to files by its ranges."""
        if not isinstance(rows, DataFrame):
            rows = self.spark.createDataFrame([tuple(r.get(c) for c in self.schema.names) for r in rows], self.schema)
        if unknown := set(rows.columns) - set(self.schema.names):
            raise CatalogError(f"unknown column {', '.join(sorted(unknown))}")
        empty = self.spark.createDataFrame([], self.schema)
        number = len(self.batches)
        # the place counts up within a task, from a start that is the task's own
        placed = conform(rows, empty)
        if segment is not None:
            placed = placed.withColumn("_segment", segment).repartitionByRange("_segment").sortWithinPartitions("_segment")
            placed = placed.withColumn("_segment", F.col("_segment").cast("string")).withColumn("_row", F.monotonically_increasing_id())
        else:
            placed = placed.withColumn("_row", F.monotonically_increasing_id())
            placed = placed.withColumn("_segment", F.concat_ws("-", F.lit(number), F.spark_partition_id(), F.expr(f"(_row & 8589934591) div {self.segment_rows}")))
        folder = f"{self.path}/{uuid.uuid4().hex}"
        placed.select(*self.schema.names, "_row", "_segment").write.mode("error").parquet(folder)
        bounds = [f(c).alias(f"{name}_{c}") for c in self.schema.names for name, f in (("min", F.min), ("max", F.max), ("nulls", lambda c: F.count_if(F.col(c).isNull())))]
        zones = self.spark.read.parquet(folder).withColumn("_file", F.input_file_name()).groupBy("_segment", "_file").agg(*bounds, F.count(F.lit(1)).alias("_rows"))
        zones.write.mode("error").parquet(f"{folder}-zones")
        self.batches.append(folder)
        return self.spark.read.parquet(f"{folder}-zones").agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]

    def rows(self) -> DataFrame:
        """All rows with their places and segments."""
        whole = T.StructType([*self.schema.fields, T.StructField("_row", T.LongType()), T.StructField("_segment", T.StringType())])
        return self.spark.read.schema(whole).parquet(*self.batches) if self.batches else self.spark.createDataFrame([], whole)

    def scan(self, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """Rows that satisfy a predicate, with the columns asked for; both reach the Parquet scan."""
        out = self.rows() if where is None else self.rows().where(where)
        return out.select(*(self._known(c) for c in columns or self.schema.names))

    def scan_column(self, name: str, op: str | None = None, value=None) -> DataFrame:
        """A column's values in the segments that may hold `name op value`; rows are not filtered."""
        return self.scan_segments([name], name, op, value) if op else self.rows().select(self._known(name))

    def scan_segments(self, columns: list[str], name: str, op: str, value) -> DataFrame:
        """Columns (and _segment, if named) of the segments that may hold `name op value`. The list of files
        comes from the stored zone maps, like the list that any scan makes of a folder."""
        wanted = self._zones(name).where(columnar.may_match(op, value))
        files = [r[0] for r in wanted.select("_file").distinct().collect()]
        if not files:
            return self.rows().limit(0).select(*columns)
        whole = T.StructType([*self.schema.fields, T.StructField("_row", T.LongType()), T.StructField("_segment", T.StringType())])
        keep = wanted.select(F.col("segment").alias("_wanted")).distinct()
        return self.spark.read.schema(whole).parquet(*files).join(keep, F.col("_segment") == F.col("_wanted"), "left_semi").select(*columns)

    def _zones(self, name: str) -> DataFrame:
        """(segment, _file, min_value, max_value, null_count, row_count) of a column, as stored."""
        kind = self.schema[self._known(name)].dataType
        out = None
        for folder in self.batches:
            one = self.spark.read.parquet(f"{folder}-zones")
            known = f"min_{name}" in one.columns
            bounds = [(F.col(f"{x}_{name}") if known else F.lit(None)).cast(kind).alias(f"{x}_value") for x in ("min", "max")]
            one = one.select(F.col("_segment").alias("segment"), "_file", *bounds, (F.col(f"nulls_{name}") if known else F.col("_rows")).alias("null_count"), F.col("_rows").alias("row_count"))
            out = one if out is None else out.unionByName(one)
        if out is None:
            schema = T.StructType([T.StructField("segment", T.StringType()), T.StructField("_file", T.StringType()), T.StructField("min_value", kind), T.StructField("max_value", kind), T.StructField("null_count", T.LongType()), T.StructField("row_count", T.LongType())])
            return self.spark.createDataFrame([], schema)
        return out

    def aggregate(self, measures: list[tuple[str, str, str | None]], by: list[str] | None = None, where: Column | None = None) -> DataFrame:
        """One row for each group: measures are (function, column or "*", name)."""
        rows = self.rows() if where is None else self.rows().where(where)
        return aggregates.aggregate(rows, [aggregates.measure(f, c, a) for f, c, a in measures], by)

    def zone_maps(self, name: str) -> DataFrame:
        """The stored zone maps of a column: (segment, min_value, max_value, null_count, row_count)."""
        whole = self._zones(name).groupBy("segment")
        return whole.agg(F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value"), F.sum("null_count").alias("null_count"), F.sum("row_count").alias("row_count"))

    def compression(self, codecs: Mapping[str, str]) -> dict[str, float]:
        """Mean compression ratio of columns with a codec each (plain, rle, dictionary or bitpack)."""
        out = {}
        for name, codec in codecs.items():
            if codec not in CODECS:
                raise StatementError(f"unknown codec {codec}")
            row = columnar.compression_ratio(self.rows(), self._known(name), F.col("_segment"), "_row", codec).first()
            out[name] = 1.0 if row["ratio"] is None else row["ratio"]
        return out

    def _known(self, name: str) -> str:
        if name not in self.schema.names:
            raise CatalogError(f"no column {name}")
        return name
