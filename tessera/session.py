"""Spark sessions for the engine's workloads, and validated settings."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import SparkSession

from tessera.errors import ConfigurationError

#: What every session sets: ANSI arithmetic, adaptive plans, UTC.
COMMON = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
PRESETS = {
    "default": {},
    "testing": {"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"},
    # short statements over few rows: small scans, no broadcast search
    "oltp": {"spark.sql.shuffle.partitions": "16", "spark.sql.files.maxPartitionBytes": "32m", "spark.sql.parquet.columnarReaderBatchSize": "1024"},
    # long scans: large batches, cost-based joins
    "olap": {"spark.sql.parquet.columnarReaderBatchSize": "8192", "spark.sql.cbo.enabled": "true", "spark.sql.cbo.joinReorder.enabled": "true", "spark.sql.cbo.joinReorder.dp.threshold": "8"},
}


@dataclass
class EngineConfig:
    """Settings of the engine; Spark's own memory, spill and batch settings go into spark."""

    preset: str = "default"
    segment_rows: int = 65536
    slow_query_ms: float = 1000.0
    case_sensitive: bool = False
    spark: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.preset not in PRESETS:
            raise ConfigurationError(f"unknown preset {self.preset}")
        if self.segment_rows < 1:
            raise ConfigurationError("segment_rows must be at least 1")
        if self.slow_query_ms < 0:
            raise ConfigurationError("slow_query_ms cannot be negative")

    def settings(self) -> dict[str, str]:
        return {**COMMON, **PRESETS[self.preset], "spark.sql.caseSensitive": str(self.case_sensitive).lower(), **self.spark}


def session(config: EngineConfig | None = None, master: str | None = None) -> SparkSession:
    """The running session with the engine's settings, or a new one."""
    builder = SparkSession.builder.appName("tessera")
    if master:
        builder = builder.master(master)
    return builder.config(map=(config or EngineConfig()).settings()).getOrCreate()


def is_local(spark: SparkSession) -> bool:
    """Whether driver and executors are one process on one machine."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for a Spark application, so that functions that run
    there can import it wherever it is installed on the driver."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tessera-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "tessera_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for f in sorted(package.rglob("*.py")):
            out.write(f, f"{package.name}/{f.relative_to(package)}")
    context.addPyFile(str(target))
    context._tessera_shipped = True
