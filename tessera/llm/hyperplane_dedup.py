"""Embedding near-duplicates: random-hyperplane sign hashing in several tables, exact cosines, components.

Equal vectors are one class with a weight, which takes part once. Each table hashes a vector to the
signs of its products with random hyperplanes. What travels to the tables is not the vector but a code of
CODE further signs; in a bucket, codes are compared in blocks, and only for members whose code is near
another's are the vectors fetched and compared, in double precision. A pair counts in the first table whose bucket it shares, so links are counted once without
being listed: a block gives each class the weight it is linked with, and a spanning forest of its
links. Component steps run on those forests only.

At cosine c two vectors agree in a sign with p = 1 - acos(c) / pi. With b signs a table, the number of
tables is the least for which (1 - p**b) ** tables <= miss. b follows the number of classes, so that
buckets of unrelated vectors keep a bounded size while the tables grow as n to the power 0.15 at 0.95.
Codes of such a pair differ in CODE * (1 - p) signs on average, and by more than SPREAD standard deviations
above that with a chance of 1e-9; those of unrelated vectors differ in about half of them.

Defined results: a vector that is null, empty, zero, or holds a null or non-finite component links with
nothing (n_links 0, its own component, kept); vectors of different lengths are never linked; rows that
share a vec_id count as separate vectors and one vertex, which ties the components of all of them; equal
vectors are linked, and a cosine of exactly the threshold links; a null vec_id links with nothing, has a null
component and is kept; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tessera.llm.components import connected_components
from tessera.llm.shared import Scratch, map_runs
from tessera.llm.textkern import BASE, STEP, mix

COSINE = 0.95
MISS = 1e-6
#: Unrelated classes wanted in a bucket, and members that are compared in one task at a time.
BUCKET = 1024
BLOCK = 1024
LEAST_SIGNS = 4
#: Signs in a code, and standard deviations by which likely codes may differ more than is usual.
CODE = 256
SPREAD = 6.0


def agree(cosine: float) -> float:
    return 1 - math.acos(min(1.0, cosine)) / math.pi


def plan(classes: int, cosine: float = COSINE, miss: float = MISS) -> tuple[int, int]:
    """(signs a table, tables) for so many classes."""
    signs = max(LEAST_SIGNS, math.ceil(math.log2(max(1, classes / BUCKET))))
    return signs, max(1, math.ceil(math.log(miss) / math.log(1 - agree(cosine) ** signs)))


def _planes(dim: int, signs: int, tables: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([dim, 11])).standard_normal((dim, tables * signs))


def codes(x: np.ndarray) -> np.ndarray:
    """The signs of products with CODE hyperplanes, vectors x 64-bit words."""
    planes = np.random.Generator(np.random.PCG64([x.shape[1], 13])).standard_normal((x.shape[1], CODE))
    return np.packbits(x @ planes >= 0, axis=1).view(np.uint64)


def far(cosine: float = COSINE, signs: int = CODE) -> int:
    """In how many of so many signs the codes of linked vectors differ at most, but for chance."""
    p = 1 - agree(cosine)
    return math.ceil(signs * p + SPREAD * math.sqrt(signs * p * (1 - p)))


def _signatures(x: np.ndarray, planes: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """Bucket numbers, vectors x tables."""
    bits = (x @ planes >= 0).reshape(len(x), tables, signs)
    return (bits * (1 << np.arange(signs, dtype=np.int64))).sum(axis=2)


def _rows(column: pa.Array) -> list[np.ndarray | None]:
    """Each vector in double precision; None where it cannot be linked."""
    out: list[np.ndarray | None] = []
    for v in column.to_pylist():
        x = None if not v or None in v else np.array(v, np.float64)
        out.append(None if x is None or not np.isfinite(x).all() or not x.any() else x)
    return out


def _kind(df: DataFrame, vector_col: str) -> type:
    """Floats travel as floats; every computation is in double precision."""
    element = getattr(df.schema[vector_col].dataType, "elementType", None)
    return np.float32 if isinstance(element, FloatType) else np.float64


def vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, dim, d1, d2, x): a digest and the components, in the input's precision; null where it
    has no links."""
    kind = _kind(df, vector_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = _rows(b.column(1))
            raw = [None if x is None else (x + 0.0).astype(kind).tobytes() for x in rows]
            d1, d2 = [], []
            for x in raw:
                v = None if x is None else np.frombuffer(x, kind).astype(np.float64).view(np.uint64)
                at = None if v is None else mix(np.arange(1, len(v) + 1, dtype=np.uint64) * BASE)
                d1.append(None if v is None else int(mix(v ^ at).sum(dtype=np.uint64).view(np.int64)))
                d2.append(None if v is None else int(mix((v + STEP) ^ (at * STEP)).sum(dtype=np.uint64).view(np.int64)))
            dim = [None if x is None else len(x) for x in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dim, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(raw, pa.binary())], names=["vec_id", "dim", "d1", "d2", "x"])

    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).mapInArrow(apply, "vec_id long, dim int, d1 long, d2 long, x binary")


def _buckets(classes: DataFrame, signs: int, tables: int, kind: type) -> DataFrame:
    """(dim, tab, bucket, id, code): one row for each class and table."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                dims = b.column(1).to_numpy()
                for dim in np.unique(dims).tolist():
                    part = b.filter(pa.array(dims == dim))
                    x = np.frombuffer(b"".join(part.column(2).to_pylist()), kind).reshape(-1, dim).astype(np.float64)
                    keys = _signatures(x, _planes(dim, signs, tables), signs, tables)
                    code = pa.array([c.tobytes() for c in codes(x)], pa.binary())
                    for t in range(tables):
                        yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.full(len(x), t, np.int32)), pa.array(keys[:, t]), part.column(0), code], names=["dim", "tab", "bucket", "id", "code"])

    return classes.select("number", "dim", "x").mapInArrow(apply, "dim int, tab int, bucket long, id long, code binary")


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The links (a, b) that first join two parts of n vertices."""
    root = list(range(n))

    def find(v: int) -> int:
        while root[v] != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    out = []
    for u, v in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(u), find(v)
        if p != q:
            root[p] = q
            out.append((u, v))
    return out


def _blocks(buckets: DataFrame) -> DataFrame:
    """Members of buckets with several, dealt so that each two blocks of a bucket meet once: (dim, tab,
    bucket, i, j, own, id, code), own being i or j."""
    count = buckets.groupBy(F.col("dim").alias("cd"), F.col("tab").alias("ct"), F.col("bucket").alias("cb")).agg(F.count("*").alias("c")).where("c > 1").withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("long"))
    own = buckets.join(count, (F.col("dim") == F.col("cd")) & (F.col("tab") == F.col("ct")) & (F.col("bucket") == F.col("cb"))).withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.select("dim", "tab", "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "code")


_MEMBERS = "dim int, tab int, bucket long, i long, j long, own long, id long"
_KEYS = ["dim", "tab", "bucket", "i", "j"]


def near_codes(a: np.ndarray, b: np.ndarray, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (rows of a, rows of b) whose codes are near: by their first 64 signs, then by all."""
    i, j = np.nonzero(np.bitwise_count(a[:, None, 0] ^ b[None, :, 0]) <= far(cosine, 64))
    near = np.bitwise_count(a[i] ^ b[j]).sum(axis=1, dtype=np.int64) <= far(cosine)
    return i[near], j[near]


def _maybe_linked(dealt: DataFrame, cosine: float) -> DataFrame:
    """The dealt members whose code is near another's in the block that theirs meets: as many rows as
    went in at most."""

    def compare(key: tuple, run: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(run)).combine_chunks()
        block = rows.column("own").to_numpy()
        code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint64).reshape(len(block), -1)
        left, right = np.flatnonzero(block == key[3]), np.flatnonzero(block == key[4])
        hit = np.zeros(len(block), bool)
        for lo in range(0, len(left), 16):
            some = left[lo : lo + 16]
            a, b = near_codes(code[some], code[right], cosine)
            other = some[a] != right[b]
            hit[some[a[other]]] = True
            hit[right[b[other]]] = True
        yield from rows.drop_columns(["code"]).filter(pa.array(hit)).to_batches()

    return map_runs(dealt, _KEYS, [], compare, _MEMBERS)


def _compare(dealt: DataFrame, signs: int, tables: int, cosine: float, kind: type) -> DataFrame:
    """(id, weight, other): what a class is linked with in a block (other null), and forest links."""

    def compare(key: tuple, run: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dim, tab, _, i, j = key
        rows = pa.Table.from_batches(list(run)).combine_chunks()
        block, ids, weight = (rows.column(c).to_numpy() for c in ("own", "id", "weight"))
        x = np.frombuffer(b"".join(rows.column("x").to_pylist()), kind).reshape(-1, dim).astype(np.float64)
        keys = _signatures(x, _planes(dim, signs, tables)[:, : tab * signs], signs, tab) if tab else np.zeros((len(x), 0), np.int64)
        scaled = x / np.sqrt((x / np.abs(x).max(axis=1, keepdims=True)) ** 2 @ np.ones(dim))[:, None] / np.abs(x).max(axis=1, keepdims=True)
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        a, b = np.nonzero(scaled[left] @ scaled[right].T >= cosine)
        a, b = left[a], right[b]
        if i == j:
            a, b = a[a < b], b[a < b]
        fresh = np.ones(len(a), bool)
        for lo in range(0, len(a), 1 << 16):
            s = slice(lo, lo + (1 << 16))
            fresh[s] = ~(keys[a[s]] == keys[b[s]]).any(axis=1)
        a, b = a[fresh], b[fresh]
        with_weight = np.bincount(a, weight[b], len(x)) + np.bincount(b, weight[a], len(x))
        some = np.flatnonzero(with_weight)
        links = _forest(len(x), a, b)
        left_id = np.concatenate([ids[some], ids[[u for u, _ in links]] if links else ids[:0]])
        right_id = pa.array([None] * len(some) + [int(ids[v]) for _, v in links], pa.int64())
        total = np.concatenate([with_weight[some].astype(np.int64), np.zeros(len(links), np.int64)])
        yield pa.RecordBatch.from_arrays([pa.array(left_id), pa.array(total), right_id], names=["id", "weight", "other"])

    return map_runs(dealt, _KEYS, [], compare, "id long, weight long, other long")


def _ties(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): links of each vec_id that has several vectors with the classes of these."""
    digest = F.struct("dim", "d1", "d2")
    several = rows.groupBy("vec_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select(F.col("vec_id").alias("u"))
    own = rows.join(several, F.col("vec_id") == F.col("u"), "left_semi").select("vec_id", "dim", "d1", "d2").distinct()
    return own.join(classes.select("dim", "d1", "d2", "id"), ["dim", "d1", "d2"]).select(F.col("id").alias("u"), F.col("vec_id").alias("v"))


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, miss: float = MISS) -> DataFrame:
    """One row for each row of df: vec_id, n_links (other vectors with a cosine of at least cosine),
    component_id (the least vec_id reachable over links, itself included) and kept."""
    scratch = Scratch(df.sparkSession, "vectors")
    rows = scratch.write(vectors(df, id_col, vector_col), "rows")
    usable = rows.where("x IS NOT NULL AND vec_id IS NOT NULL")
    grouped = usable.groupBy("dim", "d1", "d2").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"), F.first("x").alias("x"))
    # classes of their own may share their least vec_id, so they get numbers, which last once they are written
    classes = scratch.write(grouped.withColumn("number", F.monotonically_increasing_id()), "classes")
    signs, tables = plan(classes.count(), cosine, miss)
    kind = _kind(df, vector_col)
    maybe = scratch.write(_maybe_linked(_blocks(scratch.write(_buckets(classes, signs, tables, kind), "buckets")), cosine), "maybe")
    scratch.drop("buckets")
    full = maybe.join(classes.select(F.col("number").alias("c"), "weight", "x"), F.col("id") == F.col("c"))
    found = scratch.write(_compare(full.select("dim", "tab", "bucket", "i", "j", "own", "id", "weight", "x"), signs, tables, cosine, kind), "found")
    counts = found.where("other IS NULL").groupBy(F.col("id").alias("c")).agg(F.sum("weight").alias("linked"))
    side = lambda c, as_: classes.select(F.col("number").alias(c), F.col("id").alias(as_))
    links = found.where("other IS NOT NULL").join(side("cu", "u"), F.col("id") == F.col("cu")).join(side("cv", "v"), F.col("other") == F.col("cv")).select("u", "v")
    parts = connected_components(links.union(_ties(usable, classes)), scratch, "parts")
    own = parts.select(F.col("id").alias("p"), "component")
    of_class = classes.join(counts, F.col("number") == F.col("c"), "left").join(own, F.col("id") == F.col("p"), "left")
    of_class = of_class.select("dim", "d1", "d2", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    usable_key = F.when(F.col("vec_id").isNotNull(), F.col("dim")).alias("dim")
    out = rows.select("vec_id", usable_key, "d1", "d2").join(of_class, ["dim", "d1", "d2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
