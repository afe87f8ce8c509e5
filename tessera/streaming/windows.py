"""Windowed aggregates over event streams with Structured Streaming."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import ConfigurationError
from tessera.session import is_local
from tessera.sources.log import Files


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) of each window; events later than the watermark allows are left out
    of a stream, and a batch has none."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("at", late) if events.isStreaming else timed
    found = timed.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def replay(spark: SparkSession, path: str, width: str = "1 hour") -> DataFrame:
    """The windows of a finished file of events, by the batch plan of the same query."""
    return tumbling(spark.read.parquet(path), width)


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not is_local(spark):
        raise ConfigurationError("set spark.checkpoint.dir to a folder that all executors share")
    return (named or "file://" + tempfile.mkdtemp(prefix="tessera-")).rstrip("/")


def stream(spark: SparkSession, folder: str, name: str, width: str = "1 hour") -> DataFrame:
    """Streams the files of a table, a folder or a single file, through the query until none is left. Every
    batch writes the windows so far to the shared folder, with the stream's own checkpoint beside them, so a run
    that is cut short goes on where it was; the last batch's windows are returned."""
    path = f"{folder}/{name}.parquet"
    inside = any(not x.startswith(("_", ".")) and x != f"{name}.parquet" for x in Files(spark, path).names(path))
    source, pattern = (path, "*.parquet") if inside else (folder, f"{name}.parquet")
    root = f"{scratch(spark)}/stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", pattern).parquet(source)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/windows-{number}")
        last[:] = [number]

    found = tumbling(events, width)
    query = found.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{root}/windows-{last[-1]}") if last else spark.createDataFrame([], found.schema)


def run_to_memory(spark: SparkSession, path: str, pattern: str = "*.parquet", width: str = "1 hour") -> DataFrame:
    """Streams the event files of a folder through the query until none is left; for tests and demos."""
    name = f"windows_{uuid.uuid4().hex}"
    events = spark.readStream.schema(spark.read.parquet(f"{path}/{pattern}").schema).option("pathGlobFilter", pattern).parquet(path)
    query = tumbling(events, width).writeStream.outputMode("complete").format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)
