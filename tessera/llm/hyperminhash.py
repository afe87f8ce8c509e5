"""MinHash near-duplicate detection with HyperMinHash sketches.

Documents are sets of distinct word shingles. One pass makes a sketch of each set: the set's hashes
are dealt over buckets, and a bucket keeps its least hash as a leading-zero count and the mantissa
bits after it. Bands of registers propose candidates, the collision-corrected Jaccard estimate of the
sketches sorts out most false ones, and the rest are confirmed on full sets.

No pairs are listed within a group. Equal sets are one class, which takes part once. In a band's
bucket, members meet one leader (a star); links of a star join most groups. Only buckets that still
span several components are compared further, in blocks of bounded bytes: sketch against sketch first,
then on full sets those members that may be linked with a member of another component; of the links
found a block returns a spanning forest. So a group of any size costs in proportion to its members, and no
link between different texts is lost beyond the chance that banding misses a pair: with 32 bands of 4
registers, (1 - s**4)**32, or 5e-6 at similarity s = 0.75. Registers of the smallest sets are not independent
enough for that, so these are banded by their least shingles as well: of two sets that are linked,
the n - ceil(s * n) + 1 least shingles of each have one in common.

Defined results: null, empty or blank texts have the empty set, are linked with nothing and are kept;
a text with fewer words than a shingle is one shingle; very long texts are taken whole; rows that share a
doc_id are one vertex, whatever their texts with words, and each gets a row; equal sets are linked; among equally
similar leaders the one with the largest id is tried first, which decides nothing; a null doc_id is linked with nothing, has a null component and is kept; other columns
are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.shared import Scratch, id_filter, map_runs, rows_in_filter
from tessera.llm.textkern import BASE, STEP, Texts, Words, distinct, mix, pieces, shingles

WORDS = 5
PERCENT = 75
REGISTERS = 128
BAND = 4
MANTISSA = 10
#: Estimates below PERCENT by more than this many standard errors of independent registers are not verified.
#: Those of small sets depend on one another, which raises the error by up to a sixth.
ERRORS = 6.0
#: Pairs whose smaller set has up to so many shingles are proposed without fail, and are not estimated.
SMALL = 16
#: Members of a bucket that are compared with one another in one task at a time, their shingles on
#: average, and the shingles and members that are multiplied at once.
BLOCK = 512
BLOCK_SHINGLES = 1 << 20
COLUMNS = 8192
ROWS = 16
#: Members of one leader that are verified in one task at a time.
STAR = 1024
#: Rows of a bucket that are joined in one task with what is known of the bucket, on average.
SPREAD = 512
#: Any odd-looking bits: they set the order in which ids become leaders.
SCRAMBLE = 0x5851F42D4C957F2D


def _turns(m: int) -> np.ndarray:
    """For each register, the order in which it looks at the others when it is empty."""
    rng = np.random.Generator(np.random.PCG64(7))
    return np.stack([rng.permutation(m) for _ in range(m)])


def sketch(docs: np.ndarray, hashes: np.ndarray, n: int, m: int = REGISTERS, bits: int = MANTISSA) -> np.ndarray:
    """n x m registers (uint16) of the sets given as (set, hash) pairs: leading zeros, then mantissa.
    An empty register borrows from the first full one in its own fixed order, which keeps the chance
    that two sets agree in it at their Jaccard similarity. Sets without elements are all 65535."""
    low = 64 - int(m).bit_length() + 1
    least = np.full(n * m, np.iinfo(np.uint64).max, np.uint64)
    bucket = (hashes >> np.uint64(low)).astype(np.int64)
    np.minimum.at(least, docs * m + bucket, hashes << np.uint64(64 - low))
    least = least.reshape(n, m)
    full = np.zeros((n, m), bool)
    full[docs, bucket] = True
    # leading zeros of the 64-bit value, from its high and then its low half
    top = (least >> np.uint64(32)).astype(np.float64)
    zeros = np.where(top > 0, 31 - np.floor(np.log2(np.maximum(top, 1))), 32 + 31 - np.floor(np.log2(np.maximum((least & np.uint64(0xFFFFFFFF)).astype(np.float64), 1)))).astype(np.uint64)
    zeros = np.minimum(zeros, np.uint64(62))
    mantissa = (least << (zeros + np.uint64(1))) >> np.uint64(64 - bits)
    out = ((zeros << np.uint64(bits)) | mantissa).astype(np.uint16)
    turns = _turns(m)
    some = full.any(axis=1)
    out[~some] = 65535
    row, reg = np.nonzero(~full & some[:, None])
    t = 0
    while len(row):
        at = turns[reg, t]
        hit = full[row, at]
        out[row[hit], reg[hit]] = out[row[hit], at[hit]]
        row, reg, t = row[~hit], reg[~hit], t + 1
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, bits: int = MANTISSA) -> np.ndarray:
    """Jaccard estimates of sketches a and b (rows of registers) of sets of na and nb elements: the
    share of equal registers, less the share that two unrelated sets would have by collision. Equal
    leading zeros have chance 1/3 or more for like sizes and mantissas 2**-bits, so the correction
    takes 1/3 * 2**-bits, scaled by how alike the sizes are."""
    same = (a == b).mean(axis=-1)
    chance = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1) / 3.0 * 2.0**-bits
    return np.clip((same - chance) / (1 - chance), 0, 1)


def _floor(percent: int, m: int) -> float:
    s = percent / 100
    return max(0.0, s - ERRORS * (s * (1 - s) / m) ** 0.5)


def _may_link(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether sizes and sketches allow a link, estimates)."""
    est = estimate(a, b, na, nb)
    small, large = np.minimum(na, nb), np.maximum(na, nb)
    return ((small <= SMALL) | (est >= _floor(percent, REGISTERS))) & (100 * small >= percent * large), est


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, regs, least): set sizes, 128-bit set digests, sketches, and of sets that
    may be linked with a small one their least shingles."""
    most = SMALL * 100 // percent

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                h, d = shingles(Words(Texts(part.column(1))), words)
                d, h = distinct(d, h)
                n = part.num_rows
                size = np.bincount(d, minlength=n).astype(np.int64)
                regs = sketch(d, h, n)
                edge = np.searchsorted(d, np.arange(n + 1))
                digest = []
                for salt in (BASE, STEP):
                    sums = np.zeros(len(h) + 1, np.uint64)
                    np.cumsum(mix(h ^ salt), out=sums[1:])
                    digest.append((sums[edge[1:]] - sums[edge[:-1]]).view(np.int64))
                flat = pa.py_buffer(regs.tobytes())
                width = REGISTERS * 2
                binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32).tobytes()), flat])
                length = np.where(size <= most, size - -(-percent * size // 100) + 1, 0)
                least = [h[a : a + k].tobytes() for a, k in zip(edge[:-1].tolist(), length.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(size), pa.array(digest[0]), pa.array(digest[1]), binary, pa.array(least, pa.binary())], names=["doc_id", "n_shingles", "d1", "d2", "regs", "least"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(apply, "doc_id long, n_shingles long, d1 long, d2 long, regs binary, least binary")


def _regs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), REGISTERS)


def _bands(classes: DataFrame) -> DataFrame:
    """(key, id): one row for each class and band, and for each of its least shingles."""
    count = REGISTERS // BAND

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            key = mix(_regs(b.column(1)).reshape(-1, BAND).view(np.uint64).reshape(b.num_rows, count) + np.arange(count, dtype=np.uint64) * STEP)
            ids = b.column(0).to_numpy()
            least = [x.as_buffer() for x in b.column(2)]
            more = mix(np.frombuffer(b"".join(least), np.uint64) ^ BASE)
            keys, owners = np.concatenate([key.ravel(), more]), np.concatenate([np.repeat(ids, count), np.repeat(ids, [x.size // 8 for x in least])])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(owners)], names=["key", "id"])

    return classes.select("id", "regs", "least").mapInArrow(apply, "key long, id long")


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b, est) of the pairs whose sizes and sketches allow the similarity."""
    side = lambda x: classes.select(F.col("id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("regs").alias(f"r{x}"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            na, nb = b.column(2).to_numpy(), b.column(4).to_numpy()
            keep, est = _may_link(_regs(b.column(3)), _regs(b.column(5)), na, nb, percent)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(est)], names=["a", "b", "est"]).filter(pa.array(keep))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "na", "ra", "nb", "rb").mapInArrow(apply, "a long, b long, est double")


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text."""
    for part in pieces(pa.RecordBatch.from_arrays([column], names=["t"]), 0):
        h, d = shingles(Words(Texts(part.column(0))), words)
        d, h = distinct(d, h)
        edge = np.searchsorted(d, np.arange(part.num_rows + 1))
        for i in range(part.num_rows):
            yield h[edge[i] : edge[i + 1]]


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(u, v) of the pairs (a, b) whose full sets have the similarity. The texts of b travel once for
    each pair; a's text goes once to each task that holds some of its pairs. pairs is a written table."""
    spark = pairs.sparkSession
    wanted = pairs.select(F.col("a").alias("x")).union(pairs.select("b"))
    bits = spark.sparkContext.broadcast(id_filter(wanted, "x"))
    texts = rows_in_filter(docs, id_col, text_col, bits)
    count = pairs.groupBy(F.col("a").alias("c")).agg(F.ceil(F.count("*") / STAR).cast("long").alias("salts"))
    salted = pairs.join(count, F.col("a") == F.col("c")).select("a", "b", F.pmod(F.xxhash64("b"), "salts").alias("salt"))
    leaders = salted.select("a", "salt").distinct().join(texts, F.col("a") == F.col("id")).select("a", "salt", F.lit(0).alias("kind"), "id", "text")
    members = salted.join(texts, F.col("b") == F.col("id")).select("a", "salt", F.lit(1).alias("kind"), "id", "text")

    def compare(key: tuple, run: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, found = [], []  # a leader's texts are several if rows share its id
        for b in run:
            kinds, ids = b.column(2).to_pylist(), b.column(3).to_pylist()
            for kind, other, one in zip(kinds, ids, _sets(b.column(4), words), strict=True):
                if kind == 0:
                    own.append(one)
                elif any(_similar(x, one, percent) for x in own):
                    found.append(other)
        yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found), pa.int64()), pa.array(found, pa.int64())], names=["u", "v"])

    return map_runs(leaders.union(members), ["a", "salt"], ["kind"], compare, "u long, v long")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def _set_rows(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(sid, shingles) of the wanted ids (column id): sorted distinct hashes as bytes."""
    bits = docs.sparkSession.sparkContext.broadcast(id_filter(wanted, "id"))

    def sets(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in pieces(b, 1):
            raw = [x.tobytes() for x in _sets(part.column(1), words)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(raw, pa.binary())], names=["sid", "shingles"])

    return rows_in_filter(docs, id_col, text_col, bits, sets, "sid long, shingles binary")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each left with each right set, by products of 0/1 matrices over
    the hashes that occur on both sides, some columns at a time."""
    sides = []
    for sets in (left, right):
        sides.append((np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(x) for x in sets])))
    both = np.intersect1d(np.unique(sides[0][0]), np.unique(sides[1][0]), assume_unique=True)
    cells = []
    for h, row in sides:
        at = np.minimum(np.searchsorted(both, h), max(len(both) - 1, 0))
        hit = both[at] == h if len(both) else np.zeros(len(h), bool)
        order = np.argsort(at[hit], kind="stable")
        cells.append((at[hit][order], row[hit][order]))
    out = np.zeros((len(left), len(right)), np.float32)
    for lo in range(0, len(both), COLUMNS):
        some = []
        for (column, row), n in zip(cells, out.shape, strict=True):
            a, b = np.searchsorted(column, [lo, lo + COLUMNS])
            m = np.zeros((n, min(COLUMNS, len(both) - lo)), np.float32)
            m[row[a:b], column[a:b] - lo] = 1
            some.append(m)
        out += some[0] @ some[1].T
    return out


def _of_bucket(rows: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """rows (key, id, c, ...) joined with what is known (k, kc, ...) of their buckets; c and kc are a bucket's
    size, by which its rows are dealt to several tasks."""
    parts = lambda c: F.ceil(F.col(c) / SPREAD).cast("long")
    dealt = known.withColumn("kp", F.explode(F.sequence(F.lit(0).cast("long"), parts("kc") - 1))).drop("kc")
    own = rows.withColumn("p", F.pmod(F.xxhash64("id"), parts("c")))
    return own.join(dealt, (F.col("key") == F.col("k")) & (F.col("p") == F.col("kp")), how)


def _blocks(members: DataFrame, size_col: str | None = None) -> DataFrame:
    """Members (key, id, component, n_shingles, regs) of buckets, dealt so that each two blocks of a
    bucket meet once: (key, i, j, own, ...), own being i or j. size_col: a bound of the members of each
    one's bucket, where it is known."""
    members = members.withColumn("c", F.col(size_col) if size_col else F.lit(1))
    size = F.greatest(F.count("*") / BLOCK, F.sum("n_shingles") / BLOCK_SHINGLES)
    count = members.groupBy(F.col("key").alias("k")).agg(F.ceil(size).cast("long").alias("blocks"), F.max("c").alias("kc"))
    own = _of_bucket(members, count, "inner").withColumn("own", F.pmod(F.xxhash64("id"), "blocks"))
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "component", "n_shingles", "regs")


_MEMBERS = "key long, i long, j long, own long, id long, component long"


def _maybe_linked(dealt: DataFrame, percent: int) -> DataFrame:
    """The dealt members whose size and sketch allow a link with a member of another component in the
    block that theirs meets: as many rows as went in at most."""

    def compare(key: tuple, run: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(run)).combine_chunks()
        block, comp, n = (rows.column(c).to_numpy() for c in ("own", "component", "n_shingles"))
        regs = _regs(rows.column("regs").chunk(0))
        left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        hit = np.zeros(len(n), bool)
        for lo in range(0, len(left), ROWS):
            some = left[lo : lo + ROWS]
            may = comp[some][:, None] != comp[right][None, :]
            if may.any():
                may &= _may_link(regs[some][:, None, :], regs[right][None, :, :], n[some][:, None], n[right][None, :], percent)[0]
                hit[some] |= may.any(axis=1)
                hit[right] |= may.any(axis=0)
        yield from rows.select(["key", "i", "j", "own", "id", "component"]).filter(pa.array(hit)).to_batches()

    return map_runs(dealt, ["key", "i", "j"], [], compare, _MEMBERS)


def _across(dealt: DataFrame, percent: int) -> DataFrame:
    """(u, v): links that join different components, of members (key, i, j, own, id, component, shingles)
    of blocks that meet, on full sets; of the links found, a spanning forest is returned, so the rows that
    come out are no more than the members that went in."""

    def compare(key: tuple, run: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(run)).combine_chunks()
        block, ids, comp = (rows.column(c).to_numpy() for c in ("own", "id", "component"))
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows.column("shingles")]
        left, right = np.flatnonzero(block == key[1]), np.flatnonzero(block == key[2])
        u, v = [], []
        if len(left) and len(right):
            common = common_counts([sets[x] for x in left], [sets[x] for x in right])
            n = np.array([len(x) for x in sets])
            linked = (100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)) & (comp[left][:, None] != comp[right][None, :])
            root: dict[int, int] = {}
            # each row's first link to each component is enough
            for a, row in enumerate(linked):
                at = np.flatnonzero(row)
                for b in at[np.unique(comp[right[at]], return_index=True)[1]].tolist():
                    p, q = _root(root, int(comp[left[a]])), _root(root, int(comp[right[b]]))
                    if p != q:
                        root[p] = q
                        u.append(ids[left[a]])
                        v.append(ids[right[b]])
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return map_runs(dealt, ["key", "i", "j"], [], compare, "u long, v long")


def _root(root: dict[int, int], x: int) -> int:
    while root.get(x, x) != x:
        root[x] = root.get(root[x], root[x])
        x = root[x]
    return x


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of docs: doc_id, n_shingles, component_id (the least doc_id reachable over
    links, itself included) and kept (doc_id = component_id). Two documents are linked if
    100 * |intersection| >= percent * |union| of their sets of distinct word shingles."""
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows = scratch.write(sketches(docs, id_col, text_col, words, percent), "rows")
    sets = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = scratch.write(sets.groupBy("n_shingles", "d1", "d2").agg(F.min("doc_id").alias("id"), F.first("regs").alias("regs"), F.first("least").alias("least")), "classes")
    bands = _bands(classes)
    # the leader is least in a scrambled order of ids, which can be taken back from the minimum
    scrambled = lambda c: F.col(c).bitwiseXOR(F.lit(SCRAMBLE))
    stars = bands.groupBy("key").agg(F.min(scrambled("id")).alias("top"), F.count("*").alias("c")).where("c > 1").select(F.col("key").alias("k"), scrambled("top").alias("a"), "c")
    buckets = scratch.write(bands.join(stars, F.col("key") == F.col("k")).select("key", "id", "a", "c"), "buckets")
    near = scratch.write(_likely(buckets.where("id <> a").select("a", F.col("id").alias("b")).distinct(), classes, percent), "near")
    best = scratch.write(near.groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a")).select("a", "b"), "best")
    links = scratch.write(verified(best, docs, id_col, text_col, words, percent), "links-1")
    parts = connected_components(links.union(_ties(sets, classes)), scratch, "parts-1")

    def label(df: DataFrame, col: str, name: str) -> DataFrame:
        own = parts.select(F.col("id").alias(f"_{name}"), F.col("component").alias(f"c_{name}"))
        return df.join(own, F.col(col) == F.col(f"_{name}"), "left").withColumn(name, F.coalesce(f"c_{name}", col)).drop(f"_{name}", f"c_{name}")

    rest = label(label(near.select("a", "b").join(best, ["a", "b"], "left_anti"), "a", "x"), "b", "y").where("x <> y").select("a", "b")
    rest = scratch.write(rest, "rest")
    if not rest.isEmpty():
        parts = _joined(scratch.write(verified(rest, docs, id_col, text_col, words, percent), "links-2"), parts, scratch, 2)
    # with its star done, a bucket of two is done
    spans = label(buckets.where("c > 2"), "id", "component")
    torn = spans.groupBy(F.col("key").alias("k")).agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.max("c").alias("kc")).where("lo <> hi")
    spans = _of_bucket(spans.where("id <> a"), torn, "left_semi").select("key", "id", "c", "component")
    spans = scratch.write(spans, "spans")
    if not spans.isEmpty():
        of = classes.select(F.col("id").alias("cid"), "n_shingles", "regs")
        members = spans.join(of, F.col("id") == F.col("cid")).select("key", "id", "c", "component", "n_shingles", "regs")
        maybe = scratch.write(_maybe_linked(_blocks(members, "c"), percent), "maybe")
        if not maybe.isEmpty():
            full = _set_rows(docs, maybe.select("id"), id_col, text_col, words)
            dealt = maybe.join(full, F.col("id") == F.col("sid")).select("key", "i", "j", "own", "id", "component", "shingles")
            parts = _joined(scratch.write(_across(dealt, percent), "links-3"), parts, scratch, 3)
    scratch.drop("near", "best", "buckets", "rest", "spans", "maybe", "links-1", "links-2", "links-3")
    return _result(rows, classes, parts, scratch)


def _ties(sets: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v): links of each doc_id that has several texts with the classes of these."""
    digest = F.struct("n_shingles", "d1", "d2")
    several = sets.groupBy("doc_id").agg(F.min(digest).alias("lo"), F.max(digest).alias("hi")).where("lo <> hi").select(F.col("doc_id").alias("u"))
    own = sets.join(several, F.col("doc_id") == F.col("u"), "left_semi").select("doc_id", "n_shingles", "d1", "d2").distinct()
    return own.join(classes.select("n_shingles", "d1", "d2", "id"), ["n_shingles", "d1", "d2"]).select(F.col("id").alias("u"), F.col("doc_id").alias("v"))


def _joined(links: DataFrame, parts: DataFrame, scratch: Scratch, k: int) -> DataFrame:
    """Components with further links; the old components already stand for the old links."""
    if links.isEmpty():
        return parts
    old = parts.select(F.col("id").alias("u"), F.col("component").alias("v"))
    return connected_components(old.union(links), scratch, f"parts-{k}")


def _result(rows: DataFrame, classes: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    linked = parts.select(F.col("id").alias("p"), "component")
    of_class = classes.join(linked, F.col("id") == F.col("p"), "left").select("n_shingles", "d1", "d2", F.coalesce("component", "id").alias("component"))
    out = rows.select("doc_id", "n_shingles", "d1", "d2").join(of_class, ["n_shingles", "d1", "d2"], "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """docs without the documents that near_duplicates does not keep; its columns stay as they are.
    Of rows with equal id and text one stays."""
    found = near_duplicates(docs, id_col, text_col, **how)
    gone = found.where(~F.col("kept")).select(F.col("doc_id").alias("_gone")).distinct()
    left = docs.join(gone, docs[id_col] == F.col("_gone"), "left_anti")
    twice = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice"))
    if twice.isEmpty():
        return left
    once = left.join(twice, left[id_col] == F.col("_twice"), "left_anti")
    return once.unionByName(left.join(twice, left[id_col] == F.col("_twice"), "left_semi").dropDuplicates([id_col, text_col]))
