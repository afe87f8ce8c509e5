"""Quality classifier: a linear SVM on Naive Bayes features.

A text's features are indicators of its word n-grams and of n-grams of word shapes (case, digits,
punctuation, length, repetition of the word before), hashed into a fixed number of slots. Each indicator
is scaled by the log ratio of its smoothed counts in the two classes, and rows are brought to unit
length. A hinge-loss model with L2 penalty is fitted by dual coordinate descent, drawn towards the plain
Naive Bayes weights, and its margins are turned into probabilities by a logistic fit on margins of
held-out folds, weighted to the classes' shares.

The class counts cover every labelled training row; only the coordinate descent works on a bounded sample:
of each class the SAMPLE ids with the least hashes, as far as their rows have SAMPLE_SLOTS indicators
together. That is what the driver holds, whatever the length of the texts.

Defined results: a null text counts as empty; an empty text has a score from the bias alone; several
labels of a document are averaged, and a mean of 0.5 or more counts as 1; null labels and labels of
unknown ids are ignored; with no or one class among the training rows every score is the share of label
1 (0.5 without any); very long texts are counted and scored whole; equal rows of one id count each time but are
sampled once; ties of hashes are settled by the indicators; rows are scored one by one, repeated or not; other columns are ignored; no rows
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, added_up, id_filter, pack, prepare, rows_in_filter, unpack
from tessera.llm.textkern import BASE, STEP, Texts, Words, mix, pieces

SLOTS = 1 << 18
BLOCKS = 64
ALPHA = 1.0
#: Ids of each class that the descent is fitted on, and indicators of their rows, at most.
SAMPLE = 2000
SAMPLE_SLOTS = 1 << 22
COST = 4.0
EPOCHS = 30
FOLDS = 3
#: Share of the fitted weights beside their mean magnitude, as in the published method.
BETA = 0.25
ACCEPT = 0.7
#: Added to a row's squared length: a text with few features stays close to the bias.
SHRINK = 30.0


def _shapes(words: Words, h: np.ndarray) -> np.ndarray:
    """A small code of each word's looks."""
    data = words.texts.data
    if not len(h):
        return np.zeros(0, np.uint64)
    upper, digit = (data >= 65) & (data <= 90), (data >= 48) & (data <= 57)
    letter = upper | ((data >= 97) & (data <= 122)) | (data >= 128)
    length = words.end - words.start

    def share(flags: np.ndarray) -> np.ndarray:
        n = np.concatenate([[0], np.cumsum(flags)])
        return np.minimum(2, 3 * (n[words.end] - n[words.start]) // length)  # 0, a third, two thirds

    last = data[words.end - 1]
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (words.doc()[1:] == words.doc()[:-1])
    tail = np.where(letter[words.end - 1], 0, last).astype(np.int64)
    code = share(upper) + 3 * share(digit) + 9 * share(letter) + 27 * np.minimum(4, length // 4) + 135 * same
    code = code + 270 * tail
    return code.astype(np.uint64)


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The (text, slot) pairs of all indicators that are set, sorted."""
    words = Words(texts)
    h = words.hashes(lower=True)
    shape, doc = _shapes(words, h), words.doc()
    keys = []

    def add(value: np.ndarray, own: np.ndarray, kind: int) -> None:
        slot = mix(value + np.full(1, kind, np.uint64) * BASE) % np.uint64(SLOTS)
        keys.append(own.astype(np.uint64) * np.uint64(SLOTS) + slot)

    for kind, x, n in ((1, h, 1), (2, h, 2), (3, shape, 1), (4, shape, 2), (5, shape, 3)):
        if len(x) < n:
            continue
        value = np.zeros(len(x) - n + 1, np.uint64)
        for j in range(n):
            value = value * STEP + x[j : len(x) - n + 1 + j]
        whole = doc[: len(value)] == doc[n - 1 :]
        add(value[whole], doc[: len(value)][whole], kind)
    flat = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)
    flat = flat[np.concatenate([[True], flat[1:] != flat[:-1]])] if len(flat) else flat
    return (flat // np.uint64(SLOTS)).astype(np.int64), (flat % np.uint64(SLOTS)).astype(np.int64)


def labels_of(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """(lid, y): one label, 0 or 1, for each labelled id."""
    return labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("lid")).agg((F.avg(label_col) >= 0.5).cast("int").alias("y"))


def class_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(counts of each slot by class, rows by class) over all rows (text, y). Blocks of counts are added up
    in two steps, so no task reads what all tasks send."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros((2, SLOTS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for part in pieces(batch, 0):
                y = part.column(1).to_numpy(zero_copy_only=False)
                doc, slot = features(Texts(part.column(0)))
                for k in (0, 1):
                    total[k] += np.bincount(slot[y[doc] == k], minlength=SLOTS)
                rows += np.bincount(y, minlength=2)
        if not rows.any():
            return
        blocks = total.reshape(2, BLOCKS, -1).transpose(1, 0, 2)
        packed = [pack(np.ascontiguousarray(x).ravel()) for x in blocks]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BLOCKS + 1)), pa.array([*packed, pack(rows)], pa.binary())], names=["block", "n"])

    counts, rows = np.zeros((BLOCKS, 2, SLOTS // BLOCKS)), np.zeros(2)
    for r in added_up(texts.mapInArrow(count, "block long, n binary"), "block", "n", lambda x: unpack(x, np.int64), pack).collect():
        got = unpack(r["n"], np.int64)
        if r["block"] < BLOCKS:
            counts[r["block"]] = got.reshape(2, -1)
        else:
            rows = got.astype(float)
    return counts.transpose(1, 0, 2).reshape(2, SLOTS), rows


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> np.ndarray:
    """Weights (the last is the bias) of the L2-penalised hinge loss by dual coordinate descent; y is 1
    or -1, cost bounds each row's dual variable."""
    w = np.zeros(SLOTS + 1)
    a = np.zeros(len(rows))
    size = np.array([v @ v + 1.0 for v in values])
    rng = np.random.Generator(np.random.PCG64(seed))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)).tolist():
            x, v = rows[i], values[i]
            slope = y[i] * (w[x] @ v + w[-1]) - 1
            new = min(max(a[i] - slope / size[i], 0.0), cost[i])
            step = (new - a[i]) * y[i]
            if step:
                w[x] += step * v
                w[-1] += step
                moved = max(moved, abs(step))
                a[i] = new
        if moved < 1e-4:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) of the probability 1 / (1 + exp(-(a * margin + b))), by damped Newton steps."""
    x = np.stack([margin, np.ones(len(margin))], axis=1)
    t = np.zeros(2)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ t, -30, 30)))
        grad = x.T @ (weight * (y - p)) - 1e-3 * t
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        t += step / max(1.0, np.abs(step).max())
    return float(t[0]), float(t[1])


@dataclass
class Model:
    """Log-count ratios, weights on the scaled indicators, bias and the logistic fit."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def scores(self, texts: Texts) -> np.ndarray:
        doc, slot = features(texts)
        r = self.ratio[slot]
        length = np.sqrt(np.bincount(doc, r * r, texts.n) + SHRINK)
        margin = np.bincount(doc, r * self.weight[slot], texts.n) / length + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _constant(share: float) -> Model:
    share = min(max(share, 1e-6), 1 - 1e-6)
    return Model(np.zeros(SLOTS, np.float32), np.zeros(SLOTS, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id: str = "doc_id") -> Model:
    """A model of the labelled rows of docs for which usable holds."""
    prepare(docs.sparkSession)
    spark = docs.sparkSession
    known = labels_of(labels, label_id, label_col)
    bits = spark.sparkContext.broadcast(id_filter(known, "lid"))
    train = rows_in_filter(docs.where(usable), id_col, text_col, bits).join(known, F.col("id") == F.col("lid"))
    counts, rows = class_counts(train.select("text", "y"))
    if not rows.all():
        return _constant(rows[1] / rows.sum() if rows.any() else 0.5)
    p, q = (counts[k] + ALPHA for k in (1, 0))
    ratio = np.log(p / p.sum()) - np.log(q / q.sum())
    ratio[(counts[0] + counts[1]) == 0] = 0
    x, y = _sample(docs.where(usable), known, id_col, text_col)
    values = [ratio[s] for s in x]
    values = [v / np.sqrt(v @ v + SHRINK) for v in values]
    n = np.bincount(y, minlength=2)
    if not n.all():
        return _constant(rows[1] / rows.sum())
    sign = np.where(y == 1, 1.0, -1.0)
    cost = COST * len(y) / (2.0 * n[y])
    margin = np.zeros(len(y))
    fold = np.arange(len(y)) % FOLDS
    for k in range(FOLDS):
        own = np.flatnonzero(fold != k).tolist()
        if len(set(y[own].tolist())) < 2:
            continue
        w = _blend(descend([x[i] for i in own], [values[i] for i in own], sign[own], cost[own]))
        for i in np.flatnonzero(fold == k).tolist():
            margin[i] = w[x[i]] @ values[i] + w[-1]
    slope, shift = logistic(margin, y.astype(float), (rows / rows.sum())[y] * len(y) / n[y])
    w = _blend(descend(x, values, sign, cost))
    return Model(ratio.astype(np.float32), w[:-1].astype(np.float32), float(w[-1]), slope, shift)


def _blend(w: np.ndarray) -> np.ndarray:
    """Weights on scaled indicators drawn towards their mean magnitude, which is Naive Bayes."""
    own = w[:-1]
    out = w.copy()
    used = own != 0
    out[:-1][used] = (1 - BETA) * np.abs(own[used]).mean() + BETA * own[used] if used.any() else 0
    return out


def _sample(docs: DataFrame, known: DataFrame, id_col: str, text_col: str) -> tuple[list[np.ndarray], np.ndarray]:
    """Slots and labels of the sample's rows, in the order of a hash of their ids."""
    scratch, parts = Scratch(docs.sparkSession, "nbsvm"), []
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
    pool = ids.join(known, F.col("id") == F.col("lid")).select("id", "y").distinct().withColumn("h", F.xxhash64("id"))
    for k in (0, 1):
        parts.append(pool.where(F.col("y") == k).orderBy("h", "id").limit(SAMPLE))
    chosen = parts[0].union(parts[1]).select(F.col("id").alias("cid"), "y", "h")
    # twice SAMPLE ids
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("cid")).select("text", "y", "h")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 0):
                doc, slot = features(Texts(part.column(0)))
                at = np.searchsorted(doc, np.arange(part.num_rows + 1))
                slots = [slot[at[i] : at[i + 1]].astype(np.int32).tobytes() for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([xxhash.xxh3_64_intdigest(x) >> 1 for x in slots], pa.int64()), pa.array(slots, pa.binary())], names=["y", "h", "d", "x"])

    rows = texts.mapInArrow(apply, "y int, h long, d long, x binary").groupBy("y", "h", "d").agg(F.first("x").alias("x"))
    rows, out = scratch.write(rows, "sample"), []
    for k in (0, 1):
        own = rows.where(F.col("y") == k)
        sizes = own.select("h", "d", (F.length("x") / 4).cast("long").alias("n")).orderBy("h", "d").limit(SAMPLE).collect()
        fit = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), SAMPLE_SLOTS, "right"))
        if fit:
            last = F.struct(F.lit(sizes[fit - 1]["h"]).alias("h"), F.lit(sizes[fit - 1]["d"]).alias("d"))
            out += own.where(F.struct("h", "d") <= last).collect()
    scratch.clear()
    out.sort(key=lambda r: (r["h"], r["d"]))
    return [np.frombuffer(r["x"], np.int32) for r in out], np.array([r["y"] for r in out], np.int64)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id and score, the probability of label 1."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(shared.value.scores(Texts(part.column(1))).astype(np.float64))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(apply, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """The rows of docs with a score of accept or more, with their columns as they are."""
    prepare(docs.sparkSession)
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                yield part.filter(pa.array(shared.value.scores(Texts(part.column(at))) >= accept))

    return docs.mapInArrow(apply, docs.schema)
