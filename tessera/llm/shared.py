"""Scratch tables in the cluster's shared folder, bounded id filters and grouped Arrow runs."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.textkern import release
from tessera.session import is_local, ship

#: Bits of an id filter: 8 MB whatever the input, so it can always be broadcast.
FILTER_BITS = 1 << 26

#: Bytes that pass to Python at once, one row at least: texts are whole and may be of any size.
BATCH_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def prepare(spark: SparkSession) -> None:
    """Makes the package known to the executors and, unless the session says otherwise, bounds the bytes of
    its Arrow batches; their rows stay as they are set."""
    ship(spark)
    if not spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


_made: ContextVar[list | None] = ContextVar("made", default=None)


@contextlib.contextmanager
def collected() -> Iterator[list]:
    """A list of what is made of Scratch inside, by this thread alone."""
    mine: list[Scratch] = []
    before = _made.set(mine)
    try:
        yield mine
    finally:
        _made.reset(before)


class Scratch:
    """Tables written once under a fresh folder of the shared directory, so that later stages,
    retries after a lost executor included, read files instead of recomputing lineage. What an operator
    returns may still read them: they stay until clear(), which a caller may use once results are written."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        prepare(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if (made := _made.get()) is not None:
            made.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path, schema = f"{self.root}/{name}", df.schema
        df.write.mode("error").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(schema).parquet(path)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def drop(self, *names: str) -> None:
        """Deletes tables that no pending plan reads any more."""
        for name in names:
            self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        """Deletes all of its tables."""
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def filter_slot(col) -> F.Column:
    return F.pmod(F.xxhash64(col), F.lit(FILTER_BITS))


def id_filter(ids: DataFrame, col: str) -> np.ndarray:
    """A one-hash bit set of fixed size over a column of ids: false hits only cost work, there are
    no misses. It spares joins that would otherwise shuffle every text for a few wanted ids."""
    slots = ids.select(filter_slot(F.col(col)).alias("s"))
    rows = slots.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m"))
    bits = np.zeros((FILTER_BITS // (4096 * 8) + 2, 4096), np.uint8)
    for r in rows.collect():
        bits[r["b"]] = np.frombuffer(r["m"], np.uint8)
    return bits


def in_filter(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set; the layout is that of Spark's bitmap functions (buckets count from 1)."""
    bucket = np.where(slots == 0, 0, (slots - 1) // 32768 + 1)
    at = np.where(slots == 0, 0, (slots - 1) % 32768)
    return (bits[bucket, at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def rows_in_filter(df: DataFrame, id_col: str, text_col: str, bits, then: Callable | None = None, schema: str = "id long, text string") -> DataFrame:
    """(id, text) of the rows whose id may be in the filter, or what then makes of such batches; bits is
    a Spark broadcast."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            mask = in_filter(bits.value, b.column(2).to_numpy(zero_copy_only=False))
            some = pa.RecordBatch.from_arrays(b.columns[:2], names=["id", "text"]).filter(pa.array(mask))
            yield from then(some) if then else (some,)

    picked = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), filter_slot(F.col(id_col)).alias("slot"))
    return picked.mapInArrow(keep, schema)


def in_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, Iterator[pa.RecordBatch]]]:
    """Splits rows sorted by their first n_keys integer columns into (key, batches) runs, holding
    one batch at a time. Each run's iterator must be used up before the next run is asked for."""
    state: dict = {"rest": []}

    def pieces() -> Iterator[tuple[tuple, pa.RecordBatch]]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(n_keys)])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for lo, hi in zip([0, *cut.tolist()], [*cut.tolist(), b.num_rows], strict=True):
                yield tuple(int(x) for x in keys[:, lo]), b.slice(lo, hi - lo)

    stream = pieces()
    head = next(stream, None)
    while head is not None:
        key = head[0]
        state["next"] = None

        def run(first=head, key=key) -> Iterator[pa.RecordBatch]:
            yield first[1]
            for k, piece in stream:
                if k != key:
                    state["next"] = (k, piece)
                    return
                yield piece

        own = run()
        yield key, own
        for _ in own:
            pass
        head = state["next"]


def map_runs(df: DataFrame, keys: list[str], order: list[str], fn: Callable, schema: str, place: tuple[int, Column] | None = None) -> DataFrame:
    """fn(key, batches) -> batches for each run of equal integer keys (the first columns of df). place: how
    many partitions, and each row's among them by its keys; else keys are dealt by a hash."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, run in in_runs(batches, len(keys)):
            yield from fn(key, run)
        release()

    dealt = df.repartitionById(place[0], place[1].cast("int")) if place else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *order).mapInArrow(apply, schema)


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def expand(raw) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def pack(x: np.ndarray) -> bytes:
    """Bytes of equal rank lie together, which is what makes small numbers compress."""
    return squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def unpack(raw, kind: type) -> np.ndarray:
    flat = np.frombuffer(expand(raw), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(width, -1).T).view(kind).ravel()


#: Rows of one key that are added up in one task, at most.
SUMMED = 64


def added_up(parts: DataFrame, key: str, value: str, read: Callable, write: Callable) -> DataFrame:
    """(key, value): sums by key of arrays that read makes of bytes and write turns into bytes again. The
    rows of a key are added up in many tasks first."""
    schema = f"{key} long, {value} binary"

    def add(at: tuple, run: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for b in run:
            for x in b.column(b.num_columns - 1):
                total = total + read(x.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([write(total)], pa.binary())], names=[key, value])

    dealt = parts.select(F.col(key).cast("long").alias(key), F.pmod(F.monotonically_increasing_id() + F.shiftrightunsigned(F.monotonically_increasing_id(), 33), F.lit(SUMMED)).alias("_salt"), F.col(value).alias(value))
    return map_runs(map_runs(dealt, [key, "_salt"], [], add, schema), [key], [], add, schema)


def bit_of_id(col: str, mod: int) -> F.Column:
    """crc32 of the id's decimal text modulo mod; a null id counts as remainder 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(mod)), F.lit(0)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
