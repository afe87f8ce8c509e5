"""Mixing sources to target weights: temperature, then budgeted block permutations.

A source's weight is its token share to the power of an exponent between 0 (all alike) and 1 (as they
are), normalised. The exponent is found by bisection, several sections a pass over the per-source table:
the largest that reaches a target entropy, raised where the most repeated source would exceed the
repetition limit. Weights are realised for a budget of tokens: a source is read in whole epochs, then
in part. Its documents are dealt to blocks by a hash of their id; every epoch has its own permutation of
the blocks, and of the documents in a block. Of the last epoch the blocks are taken in order as long as they
fit, and of the block that no longer fits the documents are taken in order as long as they fit. A
reading's time, between 0 and 1, is how far its source has come by then: in the order of times all sources
are mixed at their weights from beginning to end. What decides is one row for each source, so no
source's documents are ever gathered.

Budgets: a number of tokens; None for as many as there are; "cover" for the least with which every source
is read at least once, so that mixing repeats documents and leaves none out.

Defined results: null source is a source of its own; null text has no tokens; sources without any token
have weight 0 and are read once; very long texts are counted whole; documents with one id, and those whose
hashes are equal, are taken or left together; a null id is an id like others; without sources the result is
empty; repeated rows are repeated in the result; other columns, whatever their names, pass through mix().
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch
from tessera.llm.textkern import Texts, Words, pieces

BLOCKS = 1024
#: A block's documents are added up in so many slices (a power of two) before one slice is sorted.
SLICE_BITS = 10
#: Entropy wanted, as a share of that of equal weights, and times that a source may be read.
ENTROPY = 0.95
REPEATS = 4.0
#: Sections of the interval in one pass, and passes: the exponent is exact to SECTIONS ** -PASSES.
SECTIONS = 16
PASSES = 6
SEED = 20


def token_counts(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, n_tokens): words of each whole text."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                n = Words(Texts(part.column(2))).count.astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(n)], names=["doc_id", "source", "n_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text")).mapInArrow(apply, "doc_id long, source string, n_tokens long")


def _block(col) -> F.Column:
    return F.pmod(F.xxhash64(col, F.lit(SEED)), F.lit(BLOCKS))


def _turn(source, block, epoch) -> F.Column:
    """A block's place in its source's permutation of an epoch."""
    return F.xxhash64(source, block, epoch.cast("long"), F.lit(SEED + 1))


def _place(col, epoch) -> F.Column:
    """A document's place in its block's permutation of an epoch."""
    return F.xxhash64(col, epoch.cast("long"), F.lit(SEED + 2))


def _share(turn) -> F.Column:
    """The part of a source that is read before a turn: turns are spread evenly over the 64-bit numbers."""
    return turn.cast("double") / F.lit(2.0**64) + F.lit(0.5)


@dataclass
class Temperature:
    exponent: float
    entropy: float
    budget: float


def temperature(sources: DataFrame, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: float | str | None = None) -> Temperature:
    """The exponent for the table sources (source, tokens), and the entropy and budget it leads to."""
    some = sources.where("tokens > 0")
    n, total, most, least = some.agg(F.count("*"), F.sum("tokens"), F.max("tokens"), F.min("tokens")).first()
    if not n:
        return Temperature(1.0, 0.0, 0.0)
    total, most, least = float(total), float(most), float(least)
    ln = F.log(F.col("tokens") / F.lit(total))

    def look(exponents: list[float]) -> list[tuple[float, float]]:
        """(entropy, readings of the smallest source) at each exponent."""
        sums = [f for a in exponents for f in (F.sum(F.exp(a * ln)), F.sum(F.exp(a * ln) * ln))]
        row = some.agg(*sums).first()
        out = []
        for k, a in enumerate(exponents):
            z, zl = row[2 * k], row[2 * k + 1]
            tokens = _budget(budget, total, most, z, a)
            out.append((math.log(z) - a * zl / z, (least / total) ** a / z * tokens / least))
        return out

    def largest(holds) -> float:
        """The largest exponent at which a condition holds that fails from some exponent on."""
        lo, hi = 0.0, 1.0
        if holds(*look([1.0])[0]):
            return 1.0
        for _ in range(PASSES):
            at = [lo + (hi - lo) * k / SECTIONS for k in range(SECTIONS + 1)]
            good = [a for a, x in zip(at, look(at), strict=True) if holds(*x)]
            lo, hi = (good[-1], min(good[-1] + (hi - lo) / SECTIONS, 1.0)) if good else (lo, at[1])
        return lo

    exponent = 1.0 if entropy is None else largest(lambda h, _: h >= entropy * math.log(n) - 1e-12)
    if repeats is not None and look([exponent])[0][1] > repeats * (1 + 1e-9):
        # readings fall as the exponent grows: the least exponent within the limit
        exponent = min(1.0, largest(lambda _, r: r > repeats * (1 + 1e-9)) + SECTIONS**-PASSES)
    z = some.agg(F.sum(F.exp(exponent * ln))).first()[0]
    return Temperature(exponent, look([exponent])[0][0], _budget(budget, total, most, z, exponent))


def _budget(budget: float | str | None, total: float, most: float, z: float, exponent: float) -> float:
    if budget is None:
        return total
    return most / ((most / total) ** exponent / z) if budget == "cover" else float(budget)


def plan(docs: DataFrame, scratch: Scratch, entropy: float | None = ENTROPY, repeats: float | None = REPEATS, budget: float | str | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(decisions, counts). Decisions has one row for each source: weight, epochs (whole readings), the
    places of the block and of the document at which its part of an epoch ends, and its tokens."""
    counts = scratch.write(token_counts(docs, id_col, source_col, text_col), "counts")
    blocks = scratch.write(counts.groupBy("source", _block("doc_id").alias("block")).agg(F.sum("n_tokens").alias("tokens")), "blocks")
    sources = scratch.write(blocks.groupBy("source").agg(F.sum("tokens").alias("tokens")), "sources")
    found = temperature(sources, entropy, repeats, budget)
    total = sources.agg(F.sum("tokens")).first()[0] or 1
    raw = F.when(F.col("tokens") > 0, F.exp(found.exponent * F.log(F.col("tokens") / F.lit(float(total))))).otherwise(0.0)
    z = sources.agg(F.sum(raw)).first()[0] or 1.0
    weight = raw / F.lit(z)
    want = weight * F.lit(found.budget)
    # a share that meets a whole number but for rounding is that number
    epochs = F.when(F.col("tokens") > 0, F.floor(want / F.col("tokens") + F.lit(1e-9))).otherwise(1).cast("long")
    wanted = sources.select(F.col("source").alias("s"), F.col("tokens").alias("all_tokens"), weight.alias("weight"), epochs.alias("epochs"), F.greatest(want - epochs * F.col("tokens"), F.lit(0.0)).alias("rest"))
    # the permutation of a source's last epoch, which is the one after its whole ones
    last = F.col("epochs") + 1
    turned = blocks.join(wanted, F.col("source").eqNullSafe(F.col("s"))).withColumn("turn", _turn(F.col("source"), F.col("block"), last))
    turned = turned.withColumn("upto", F.sum("tokens").over(Window.partitionBy("source").orderBy("turn")))
    # the first block that no longer fits; there is one, as a part of an epoch is less than all
    split = turned.where((F.col("upto") > F.col("rest")) & (F.col("all_tokens") > 0))
    split = split.groupBy("s", "epochs").agg(F.min_by("block", "turn").alias("block"), F.min("turn").alias("turn"), F.min_by(F.col("rest") - (F.col("upto") - F.col("tokens")), "turn").alias("room"))
    split = scratch.write(split, "split")
    # of that block, what comes before the first document that no longer fits: in slices of places first,
    # then in the slice that the budget ends in, so that no block is ever sorted in one task
    inside = counts.withColumn("b", _block("doc_id")).join(split, F.col("source").eqNullSafe(F.col("s")) & (F.col("b") == F.col("block")))
    inside = inside.select("s", "room", _place(F.col("doc_id"), F.col("epochs") + 1).alias("place"), "n_tokens").withColumn("slice", F.shiftright("place", 64 - SLICE_BITS))
    by_slice = inside.groupBy("s", "room", "slice").agg(F.sum("n_tokens").alias("tokens"))
    by_slice = by_slice.withColumn("upto", F.sum("tokens").over(Window.partitionBy("s").orderBy("slice"))).where(F.col("upto") > F.col("room"))
    cut = by_slice.groupBy(F.col("s").alias("cs")).agg(F.min("slice").alias("cslice"), F.min_by(F.col("room") - (F.col("upto") - F.col("tokens")), "slice").alias("left"))
    by_place = inside.join(cut, F.col("s").eqNullSafe(F.col("cs")) & (F.col("slice") == F.col("cslice"))).groupBy("s", "left", "place").agg(F.sum("n_tokens").alias("tokens"))
    walked = by_place.withColumn("upto", F.sum("tokens").over(Window.partitionBy("s").orderBy("place")))
    ends = walked.where(F.col("upto") > F.col("left")).groupBy("s").agg(F.min("place").alias("place"))
    marks = split.select(F.col("s").alias("m"), "turn").join(ends.withColumnRenamed("s", "e"), F.col("m").eqNullSafe(F.col("e")), "left")
    out = wanted.join(marks, F.col("s").eqNullSafe(F.col("m")), "left").select(F.col("s").alias("plan_source"), "weight", "epochs", "all_tokens", F.col("turn").alias("plan_turn"), F.col("place").alias("plan_place"))
    return scratch.write(out, "plan"), counts


def _copies(id_col, source_col) -> F.Column:
    """How often a document is read, from the joined decisions; turn and place as defined above."""
    last = F.col("epochs") + 1
    turn = _turn(source_col.cast("string"), _block(id_col), last)
    part = (turn < F.col("plan_turn")) | ((turn == F.col("plan_turn")) & (_place(id_col, last) < F.col("plan_place")))
    return F.col("epochs") + F.coalesce(part, F.lit(False)).cast("long")


def _readings(rows: DataFrame, id_col, source_col) -> DataFrame:
    """rows joined with their decisions, once for each reading, with epoch, block, time and place."""
    read = rows.withColumn("copies", _copies(id_col, source_col)).where("copies > 0")
    read = read.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).withColumn("block", _block(id_col).cast("int"))
    turn = _turn(source_col.cast("string"), F.col("block").cast("long"), F.col("epoch"))
    whole = F.col("epochs") + F.coalesce(_share(F.col("plan_turn")), F.lit(0.0))
    time = (F.col("epoch") - 1 + _share(turn)) / F.greatest(whole, F.col("epoch") - 1 + _share(turn))
    return read.withColumn("time", time).withColumn("place", _place(id_col, F.col("epoch")))


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """One row for each row of docs: doc_id, source, n_tokens, weight (of its source) and copies."""
    decided, counts = plan(docs, Scratch(docs.sparkSession, "mix"), id_col=id_col, source_col=source_col, text_col=text_col, **how)
    both = counts.join(decided, F.col("source").eqNullSafe(F.col("plan_source")))
    return both.select("doc_id", "source", "n_tokens", "weight", _copies(F.col("doc_id"), F.col("source")).alias("copies"))


def schedule(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """One row for each reading of a row of docs: doc_id, source, n_tokens, weight, copies, epoch, block, time
    and place. The order of time, source, block and place is the one to read in."""
    decided, counts = plan(docs, Scratch(docs.sparkSession, "mix"), id_col=id_col, source_col=source_col, text_col=text_col, **how)
    both = counts.join(decided, F.col("source").eqNullSafe(F.col("plan_source")))
    return _readings(both, F.col("doc_id"), F.col("source")).select("doc_id", "source", "n_tokens", "weight", "copies", "epoch", "block", "time", "place")


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **how) -> DataFrame:
    """The rows of docs, each as often as its source's weight asks for, with their columns as they are, in
    the schedule's order from partition to partition."""
    decided, _ = plan(docs, Scratch(docs.sparkSession, "mix"), id_col=id_col, source_col=source_col, text_col=text_col, **how)
    given = docs.select(F.struct(*docs.columns).alias("row"), F.col(source_col).cast("string").alias("own_source"), F.col(id_col).cast("long").alias("own_id"))
    both = given.join(decided, F.col("own_source").eqNullSafe(F.col("plan_source")))
    read = _readings(both, F.col("own_id"), F.col("own_source")).select("time", "own_source", "block", "place", "row")
    return read.repartitionByRange("time", "own_source", "block", "place").sortWithinPartitions("time", "own_source", "block", "place").select("row.*")
