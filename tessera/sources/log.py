"""A write-ahead log: numbered batches of records as JSON files that appear whole or not at all.

Records have the columns that the replay operators read (lsn, txn_id, log_type, page_id, slot_id,
before_image, after_image). In the log of a database a page is a table, by its number; slot 0 holds its
definition and every other slot one folder of its rows. A transaction's changes and its end are one batch,
so the log never shows half of them.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from tessera.errors import WriteConflictError

SCHEMA = "lsn long, txn_id long, log_type string, page_id long, slot_id long, before_image string, after_image string"


class Clock:
    """Numbers that only grow, one at a time, for log records, transactions, tables and folders."""

    def __init__(self, now: int = 0) -> None:
        self._now, self._lock = now, threading.Lock()

    @property
    def now(self) -> int:
        return self._now

    def next(self) -> int:
        with self._lock:
            self._now += 1
            return self._now


class Files:
    """The few file operations that a database needs, on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def names(self, path: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs.listStatus(self._path(path))) if self.exists(path) else []

    def size(self, path: str) -> int:
        return self._fs.getContentSummary(self._path(path)).getLength() if self.exists(path) else 0

    def put(self, path: str, text: str) -> bool:
        """Writes a file under a name that is not taken; whether it was free."""
        parent, _, name = path.rpartition("/")
        draft = self._path(f"{parent}/.{name}.draft")
        out = self._fs.create(draft, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        if self.exists(path) or not self._fs.rename(draft, self._path(path)):
            self._fs.delete(draft, False)
            return False
        return True


class Log:
    def __init__(self, spark: SparkSession, folder: str, clock: Clock) -> None:
        self.spark, self.folder, self.clock = spark, folder, clock
        self.files = Files(spark, folder)

    def append(self, records: Iterable[tuple[int, str, int | None, int | None, str | None, str | None]]) -> int:
        """Appends records (txn_id, log_type, page_id, slot_id, before_image, after_image); returns the last
        one's number. Raises if another writer has appended under the same number."""
        names, lines, first, last = [x.split()[0] for x in SCHEMA.split(", ")], [], 0, 0
        for r in records:
            last = self.clock.next()
            first = first or last
            lines.append(json.dumps(dict(zip(names, (last, *r), strict=True))))
        if not self.files.put(f"{self.folder}/{first:020d}.json", "\n".join(lines) + "\n"):
            raise WriteConflictError("another session writes to this log")
        return last

    def frame(self) -> DataFrame:
        """All records."""
        if not any(x.endswith(".json") for x in self.files.names(self.folder)):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).json(self.folder)
