"""Language identification of words in mixed text by a linear-chain conditional random field.

A word's emission scores add up hashed features: its affixes, its byte n-grams, and the languages whose
lexicon holds it. Transitions between the languages of neighbouring words are learned with them. Words
are labelled by forward-backward over the whole text; a text's language is the one with the largest
mean posterior over its words.

Training maximises the penalised likelihood by adaptive gradient steps on spliced texts: the training
documents follow one another with their languages as labels, which gives the transitions the switches
that mixed text has. It works on a bounded sample: for the LANGUAGES languages with the most documents, SAMPLE
documents of each by a hash of their ids, PIECES pieces of each document, SAMPLE_WORDS words of each
language and fewer if there are many languages. So the driver's arrays are bounded too. Forward-backward runs on all texts of a piece at once: chunks of CHUNK words are reduced to
transfer matrices, messages pass from chunk to chunk, and then run inside all chunks together.

Defined results: a null text or one without a letter is `und` with score 0; without training rows every
text is `und` with score 0; with one language every text with a letter has it, with score 1; a null
lang teaches nothing, nor does a word longer than a piece; very long texts are labelled whole, and are sampled
all over; equal rows teach each time, ties of their hashes are settled by the text; ties go to the language
first in order; rows are labelled one by one, repeated
or not; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import prepare
from tessera.llm.textkern import BASE, LOWER, STEP, Texts, Words, mix, pieces

SLOTS = 1 << 16
#: The training sample: languages, the most frequent ones; documents of each; pieces of so many words of a
#: document, spread over it; bytes of a piece; words of a language; words times languages squared.
LANGUAGES = 128
SAMPLE = 200
PIECES, PIECE_WORDS, PIECE_BYTES = 16, 128, 1 << 14
SAMPLE_WORDS = 1 << 16
CELLS = 1 << 22
CHUNK = 64
EPOCHS = 12
RATE = 0.5
DECAY = 1e-6
#: Splits of a language's ids that are ranked together at each step of drawing the sample.
SPLIT = 8
#: A lexicon word: seen so often in the sample, with such a share in one language.
LEXICON_COUNT, LEXICON_SHARE = 5, 0.8
UNKNOWN = "und"


def word_features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, offsets): the slots of each word's affixes and n-grams, one word after another."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    length = end - start
    # each word between two boundary bytes, so that prefixes and suffixes are n-grams of their own
    off = np.concatenate([[0], np.cumsum(length + 2)])
    flat = np.full(off[-1], 257, np.uint64)
    inner = np.ones(off[-1], bool)
    inner[off[:-1]] = inner[off[1:] - 1] = False
    source = np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
    flat[inner] = LOWER[data[source]].astype(np.uint64) + np.uint64(1)
    grams, owner = [], []
    word = np.repeat(np.arange(len(start)), length + 2)
    for n in (2, 3, 4):
        if len(flat) < n:
            continue
        value = np.full(len(flat) - n + 1, n, np.uint64) * STEP
        for j in range(n):
            value = value * BASE + flat[j : len(flat) - n + 1 + j]
        whole = word[: len(value)] == word[n - 1 :]
        if n == 4:  # of the longest only affixes
            edge = np.zeros(len(flat), bool)
            edge[off[:-1]] = True
            tail = off[1:] - 4
            edge[tail[tail >= off[:-1]]] = True
            whole &= edge[: len(value)]
        grams.append((mix(value[whole]) % np.uint64(SLOTS)).astype(np.int64))
        owner.append(word[: len(value)][whole])
    slots, own = np.concatenate(grams), np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return slots[order], np.searchsorted(own[order], np.arange(len(start) + 1))


@dataclass
class Model:
    """langs; weights by slot; lexicon: sorted word hashes with a language each, and the weight of a
    lexicon's word for each language; transition: scores from language to language."""

    langs: list[str]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_lang: np.ndarray
    lexicon_weights: np.ndarray
    transition: np.ndarray

    def emissions(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        slots, off = word_features(data, start, end)
        out = np.add.reduceat(self.weights[slots], off[:-1], axis=0) if len(h) else np.zeros((0, len(self.langs)))
        if len(self.lexicon) and len(h):
            at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
            hit = self.lexicon[at] == h
            out[hit] += self.lexicon_weights[self.lexicon_lang[at[hit]]]
        return out


def chunked(count: np.ndarray, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts of count words as rows of chunk words: (index of each cell's word, or -1; first row of each
    text, with the end; rows' numbers within their text)."""
    rows = -(-count // chunk)
    first = np.concatenate([[0], np.cumsum(rows)])
    number = np.arange(first[-1]) - np.repeat(first[:-1], rows)
    base = np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), rows) + number * chunk
    left = np.repeat(count, rows) - number * chunk
    cell = base[:, None] + np.arange(chunk)[None, :]
    cell[np.arange(chunk)[None, :] >= left[:, None]] = -1
    return cell, first, number


def marginals(emission: np.ndarray, count: np.ndarray, transition: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Posteriors of all words (words x languages), the expected transitions if pairs, and the log
    partition. A text starts from all languages alike."""
    k = emission.shape[1]
    out = np.zeros_like(emission, dtype=np.float64)
    if not len(emission):
        return out, np.zeros((k, k)) if pairs else None, 0.0
    cell, first, number = chunked(count)
    n, width = cell.shape
    live = cell >= 0
    top = emission.max(axis=1)
    e = np.exp(emission - top[:, None])[np.maximum(cell, 0)]
    step = np.exp(transition - transition.max())
    # transfer matrix of each chunk
    move = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(width):
        on = live[:, t]
        if not on.any():
            break
        new = (move[on] @ step) * e[on, t][:, None, :]
        move[on] = new / new.max(axis=(1, 2), keepdims=True)
    # messages between chunks
    rows = np.diff(first)
    ahead, back = np.ones((n, k)), np.ones((n, k))
    for j in range(1, int(rows.max())):
        at = first[:-1][rows > j] + j
        new = np.einsum("ni,nij->nj", ahead[at - 1], move[at - 1])
        ahead[at] = new / new.max(axis=1, keepdims=True)
        at = first[1:][rows > j] - 1 - j
        new = np.einsum("nij,nj->ni", move[at + 1], back[at + 1])
        back[at] = new / new.max(axis=1, keepdims=True)
    # messages inside chunks
    forward = np.empty((n, width, k))
    before = np.empty((n, width, k))
    logs = 0.0
    state = ahead / ahead.sum(axis=1, keepdims=True)
    for t in range(width):
        before[:, t] = state
        new = (state @ step) * e[:, t]
        total = new.sum(axis=1, keepdims=True)
        if pairs:
            logs += float(np.log(total[live[:, t]]).sum())
        state = np.where(live[:, t][:, None], new / total, state)
        forward[:, t] = state
    total_pairs = np.zeros((k, k)) if pairs else None
    state = back / back.sum(axis=1, keepdims=True)
    post = np.empty((n, width, k))
    for t in range(width - 1, -1, -1):
        on = live[:, t][:, None]
        both = forward[:, t] * state
        post[:, t] = both / both.sum(axis=1, keepdims=True)
        ahead_of = e[:, t] * state
        if pairs:
            joint = before[:, t][:, :, None] * step[None] * ahead_of[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            # a text's first word has no word before it
            inside = live[:, t] & ((number > 0) | (t > 0))
            total_pairs += joint[inside].sum(axis=0)
        new = ahead_of @ step.T
        state = np.where(on, new / new.sum(axis=1, keepdims=True), state)
    out[cell[live]] = post[live]
    if pairs:
        logs += float(top.sum()) + float((count > 0).sum()) * np.log(k) + len(emission) * float(transition.max())
    return out, total_pairs, logs


def train(texts: list[bytes], langs: list[str]) -> Model | None:
    """A model of the words of texts, each labelled with its text's language."""
    names = sorted(set(langs))
    if not names:
        return None
    k = len(names)
    label = np.array([names.index(x) for x in langs])
    # splice the texts in a mixed order
    order = np.random.Generator(np.random.PCG64(3)).permutation(len(texts))
    t = Texts(pa.array([texts[i].decode() for i in order], pa.string()))
    words = Words(t)
    h = words.hashes(lower=True)
    gold = np.repeat(label[order], words.count)
    if k == 1 or not len(h):
        return Model(names, np.zeros((SLOTS, k), np.float32), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((k, k)), np.zeros((k, k)))
    unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    seen = np.bincount(inverse * k + gold, minlength=len(unique) * k).reshape(-1, k)
    total = seen.sum(axis=1)
    lexical = (total >= LEXICON_COUNT) & (seen.max(axis=1) >= LEXICON_SHARE * total)
    model = Model(names, np.zeros((SLOTS, k)), unique[lexical], seen[lexical].argmax(axis=1), np.zeros((k, k)), np.zeros((k, k)))
    slots, off = word_features(t.data, words.start[at], words.end[at])
    owner = np.repeat(np.arange(len(unique)), np.diff(off))
    lex_rows = np.flatnonzero(lexical)
    gold_words = seen.astype(float)
    gold_pairs = np.bincount(gold[:-1] * k + gold[1:], minlength=k * k).reshape(k, k).astype(float)
    sums = [np.full_like(x, 1e-6, dtype=float) for x in (model.weights, model.lexicon_weights, model.transition)]
    n = len(h)
    for _ in range(EPOCHS):
        e = np.add.reduceat(model.weights[slots], off[:-1], axis=0)
        e[lex_rows] += model.lexicon_weights[model.lexicon_lang]
        post, pair, _ = marginals(e[inverse], np.array([n]), model.transition, pairs=True)
        diff = gold_words - np.stack([np.bincount(inverse, post[:, j], len(unique)) for j in range(k)], axis=1)
        by_slot = np.stack([np.bincount(slots, diff[owner, j], SLOTS) for j in range(k)], axis=1)
        by_lex = np.stack([np.bincount(model.lexicon_lang, diff[lex_rows, j], k) for j in range(k)], axis=1)
        grads = [by_slot / n - DECAY * model.weights, by_lex / n - DECAY * model.lexicon_weights, (gold_pairs - pair) / n - DECAY * model.transition]
        for x, g, s in zip((model.weights, model.lexicon_weights, model.transition), grads, sums, strict=True):
            s += g * g
            x += RATE * g / np.sqrt(s)
    model.weights = model.weights.astype(np.float32)
    return model


def sample(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, str]]:
    """(language, piece of text) of the training sample. Pieces are drawn by hashes from all over a document,
    so its bounds hold whatever the number of languages and the length of texts."""
    own = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    count = own.groupBy(F.col(lang_col).alias("lang")).count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    langs = [r["lang"] for r in count]
    if not langs:
        return []
    ids = own.where(F.col(id_col).isNotNull() & F.col(lang_col).isin(langs)).select(F.col(id_col).alias("cid"), F.col(lang_col).alias("clang"), F.xxhash64(id_col).alias("h"))
    # the least hashes of each language: of each split, of splits of these, then of all, so a task of the last
    # steps has SPLIT * SAMPLE ids at most, and no language meets in one
    best = ids
    for k in (2, 1, 0):
        part = F.pmod(F.shiftright("h", 8), F.lit(SPLIT**k))
        best = best.withColumn("r", F.row_number().over(Window.partitionBy("clang", part).orderBy("h", "cid"))).where(F.col("r") <= SAMPLE).drop("r")
    best = best.select("cid", "clang")
    texts = own.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # LANGUAGES * SAMPLE ids at most
    texts = texts.join(F.broadcast(best), (F.col("id") == F.col("cid")) & (F.col("lang") == F.col("clang"))).select("lang", F.xxhash64("id").alias("h"), "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 2):
                t = Texts(part.column(2))
                words = Words(t)
                out: list[tuple] = []
                for i, (lang, h) in enumerate(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)):
                    first = np.arange(words.off[i], words.off[i + 1], PIECE_WORDS)
                    place = mix(np.arange(len(first), dtype=np.uint64) * STEP + np.uint64(h % (1 << 64)))
                    for k in np.argsort(place, kind="stable")[:PIECES].tolist():
                        a = first[k]
                        b = a + int(np.searchsorted(words.end[a : min(a + PIECE_WORDS, words.off[i + 1])], words.start[a] + PIECE_BYTES, "right"))
                        if b > a:
                            out.append((lang, int(place[k].view(np.int64)), int(b - a), t.data[words.start[a] : words.end[b - 1]].tobytes().decode()))
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(list(zip(*out, strict=True)) or [()] * 4, (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["lang", "place", "n", "piece"])

    parts = texts.mapInArrow(cut, "lang string, place long, n long, piece string")
    most = min(SAMPLE_WORDS, CELLS // len(langs) ** 2)
    order = Window.partitionBy("lang").orderBy("place", "piece")
    # rows that share an id bring pieces of their own, so their number is bounded before their words are
    few = parts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE * PIECES)
    upto = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = few.withColumn("upto", upto).where((F.col("upto") <= most) | (F.col("r") == 1)).orderBy("lang", "r").collect()
    return [(r["lang"], r["piece"]) for r in rows]


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model of the training sample of the usable documents."""
    prepare(docs.sparkSession)
    rows = sample(docs, usable, id_col, text_col, lang_col)
    return train([x.encode() for _, x in rows], [lang for lang, _ in rows])


def label(texts: Texts, model: Model | None) -> tuple[list[str], np.ndarray]:
    """(language, mean posterior) of each text."""
    if model is None:
        return [UNKNOWN] * texts.n, np.zeros(texts.n)
    post, words = posteriors(texts, model)
    k = len(model.langs)
    sums = np.stack([np.bincount(words.doc(), post[:, j], texts.n) for j in range(k)], axis=1)
    mean = sums / np.maximum(words.count, 1)[:, None]
    best = mean.argmax(axis=1)
    ascii_letter = np.zeros(256, bool)
    ascii_letter[65:91] = ascii_letter[97:123] = True
    flags = np.concatenate([[0], np.cumsum(ascii_letter[texts.data])])
    letters = flags[texts.off[1:]] > flags[texts.off[:-1]]
    for i in np.flatnonzero(~letters).tolist():
        letters[i] = any(c.isalpha() for c in texts.text(i).decode())
    return [model.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist(), strict=True)], np.where(letters, mean[np.arange(texts.n), best], 0.0)


def posteriors(texts: Texts, model: Model) -> tuple[np.ndarray, Words]:
    """Posteriors of every word of the texts (words x languages), and the words."""
    words = Words(texts)
    h = words.hashes(lower=True)
    unique, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    e = model.emissions(texts.data, words.start[at], words.end[at], unique)
    return marginals(e[inverse], words.count, model.transition)[0], words


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred and score."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, 1 << 20):
                langs, score = label(Texts(part.column(1)), shared.value)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(langs, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(apply, "doc_id long, lang_pred string, score double")


def label_words(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id and, in order, the language of every word."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1, 1 << 20):
                post, words = posteriors(Texts(part.column(1)), shared.value)
                names = np.array(shared.value.langs, object)[post.argmax(axis=1)] if len(post) else np.zeros(0, object)
                column = pa.ListArray.from_arrays(pa.array(words.off.astype(np.int32)), pa.array(names.tolist(), pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), column], names=["doc_id", "langs"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(apply, "doc_id long, langs array<string>")
