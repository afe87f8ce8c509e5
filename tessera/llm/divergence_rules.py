"""Quality rules: repetition and length, and the divergence from language references.

Base rules count words, symbols, repeated lines and words in repeated 8-word windows. The method's
verdict compares a document's histograms of character classes and of common words with those of each
language in the corpus, by Jensen-Shannon distance. The references are sums over all documents that
pass the base rules; all words of these are counted, in shards, and the driver gets only the totals and the
commonest words of each language. There are references for the LANGUAGES languages with the most
documents, which bounds what the driver holds. A document is judged by the language it is nearest to, and only by a histogram it has enough words or characters
for; a sampling allowance that shrinks with length is taken off the divergence, the distance's square.

Defined results: null, empty and blank texts have no words, fail the base rules and are not kept; very long
texts are judged whole; a null lang counts for no reference; ties among languages are settled by their name, among
nearest references by the first; without any reference the base rules decide alone; repeated rows are
treated one by one; a null doc_id stays null; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, map_runs, pack, prepare, unpack
from tessera.llm.textkern import SPACE, Texts, Words, mix, pieces, span_hashes, windows

WINDOW = 8
MIN_WORDS = 20
REPEATED_PERCENT = 30
#: A language's common words are those that occur more often than its COMMON + 1st; so there are COMMON at
#: most, and ties leave no choice. And languages that have a reference, at most.
COMMON = 64
LANGUAGES = 256
#: Bits of the hash that deal words to shards, and words that a task holds before it passes them on.
SHARD_BITS = 8
HELD = 1 << 20
#: Words and characters a document needs before its histograms are compared.
GUARD_WORDS = 50
GUARD_CHARS = 200
#: Largest distances (0 to 1) that pass, after the sampling allowance.
CLASS_LIMIT = 0.28
WORD_LIMIT = 0.2

#: Character classes, by byte; a continuation byte of UTF-8 belongs to none.
CLASSES = ("lower", "upper", "digit", "space", "stop", "bracket", "symbol", "other", "beyond")
CLASS_OF = np.full(256, CLASSES.index("other"), np.int64)
CLASS_OF[ord("a") : ord("z") + 1] = CLASSES.index("lower")
CLASS_OF[ord("A") : ord("Z") + 1] = CLASSES.index("upper")
CLASS_OF[ord("0") : ord("9") + 1] = CLASSES.index("digit")
CLASS_OF[SPACE] = CLASSES.index("space")
CLASS_OF[[ord(c) for c in ".,;:!?'\"-"]] = CLASSES.index("stop")
CLASS_OF[[ord(c) for c in "()[]{}"]] = CLASSES.index("bracket")
CLASS_OF[[ord(c) for c in "#*$%&|<>"]] = CLASSES.index("symbol")
CLASS_OF[192:256] = CLASSES.index("beyond")
CLASS_OF[128:192] = len(CLASSES)


@dataclass
class Base:
    """Per text: the counts of the base rules."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray

    @property
    def failed(self) -> np.ndarray:
        return (self.n_words < MIN_WORDS) | (100 * self.n_repeat_words > REPEATED_PERCENT * self.n_words)


def _per_text(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[off[1:]] - sums[off[:-1]]


def base_counts(texts: Texts, words: Words) -> Base:
    data, off, n = texts.data, texts.off, texts.n
    space = SPACE[data]
    symbol = CLASS_OF[data] == CLASSES.index("symbol")
    chars = _per_text(~space & ((data & 0xC0) != 0x80), off)
    # lines with a word
    stop = np.concatenate([np.flatnonzero(data == 10), off[1:]])
    stop.sort(kind="stable")
    start = np.concatenate([np.flatnonzero(data == 10) + 1, off[:-1]])
    start.sort(kind="stable")
    first = np.searchsorted(words.start, start)
    has = (stop > start) & (first < len(words.start))
    has[has] = words.start[first[has]] < stop[has]
    start, stop = start[has], stop[has]
    doc = np.searchsorted(off, start, "right") - 1
    key = span_hashes(data, start, stop) ^ mix(doc.astype(np.uint64))
    _, at = np.unique(key, return_index=True)
    dup = np.bincount(doc, minlength=n) - np.bincount(doc[at], minlength=n)
    # words in repeated windows
    h, at = windows(words.hashes(lower=False), words.off, WINDOW)
    key = h ^ mix(words.doc()[at].astype(np.uint64))
    ordered = np.sort(key)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    repeat = np.zeros(n, np.int64)
    if len(twice):
        hit = at[np.isin(key, twice)]
        edge = np.zeros(len(words.start) + 1, np.int64)
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + WINDOW, -1)
        repeat = _per_text(np.cumsum(edge[:-1]) > 0, words.off)
    return Base(words.count.astype(np.int64), chars, _per_text(symbol, off), dup.astype(np.int64), repeat)


def class_counts(texts: Texts) -> np.ndarray:
    """Counts of character classes, text x class."""
    k = len(CLASSES) + 1
    doc = np.repeat(np.arange(texts.n), np.diff(texts.off))
    return np.bincount(doc * k + CLASS_OF[texts.data], minlength=texts.n * k).reshape(texts.n, k)[:, :-1]


@dataclass
class Reference:
    """Per language: shares of character classes, sorted hashes of its common words, and shares of these and
    the rest."""

    langs: list[str]
    classes: np.ndarray
    common: list[np.ndarray]
    words: list[np.ndarray]


_SUMS = "lang long, shard long, a binary, b binary"


def _sums(docs: DataFrame, langs: list[str], text_col: str, lang_col: str) -> DataFrame:
    """(lang, shard, a, b) over documents that pass the base rules: shard -1 has counts of classes (a), others
    hashes of words (a) and their counts (b)."""
    number = {x: i for i, x in enumerate(langs)}

    def row(lang: int, shard: int, a: bytes, b: bytes = b"") -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([lang], pa.int64()), pa.array([shard], pa.int64()), pa.array([a], pa.binary()), pa.array([b], pa.binary())], names=["lang", "shard", "a", "b"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes: dict[int, np.ndarray] = {}
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            edges = np.arange(1, 1 << SHARD_BITS, dtype=np.uint64) << np.uint64(64 - SHARD_BITS)
            for lang, parts in held.items():
                words, n = _merged(parts)
                cut = [0, *np.searchsorted(words, edges).tolist(), len(words)]
                for shard, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if hi > lo:
                        yield row(lang, shard, words[lo:hi].tobytes(), pack(n[lo:hi]))
            held.clear()

        for batch in batches:
            for part in pieces(batch, 1):
                texts = Texts(part.column(1))
                words = Words(texts)
                good = ~base_counts(texts, words).failed
                of = np.array([number.get(x, -1) for x in part.column(0).to_pylist()], np.int64)
                by_class, h, doc = class_counts(texts), words.hashes(lower=True), words.doc()
                for lang in np.unique(of[good & (of >= 0)]).tolist():
                    mine = good & (of == lang)
                    classes[lang] = classes.get(lang, 0) + by_class[mine].sum(axis=0)
                    found = np.unique(h[mine[doc]], return_counts=True)
                    held.setdefault(lang, []).append(found)
                    size += len(found[0])
            if size >= HELD:
                yield from out()
                size = 0
        yield from out()
        for lang, one in classes.items():
            yield row(lang, -1, one.astype(np.int64).tobytes())

    return docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, _SUMS)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
    n = np.zeros(len(words), np.int64)
    np.add.at(n, at, np.concatenate([x for _, x in parts]))
    return words, n


def reference(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Reference | None:
    """Sums over all documents that pass the base rules; None if there are none with a language."""
    scratch = Scratch(docs.sparkSession, "rules")
    known = docs.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).count()
    langs = sorted(r["lang"] for r in known.orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect())
    if not langs:
        return None

    def add(key: tuple, run: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(x.as_buffer(), y.as_buffer()) for b in run for x, y in zip(b.column(2), b.column(3), strict=True)]
        if key[1] < 0:
            h, n = np.arange(len(CLASSES)), sum(np.frombuffer(x, np.int64) for x, _ in rows)
        else:
            words, n = _merged([(np.frombuffer(x, np.uint64), unpack(y, np.int64)) for x, y in rows])
            top = np.lexsort((words, -n))[: COMMON + 1]
            h, n = np.append(words[top].view(np.int64), 0), np.append(n[top], n.sum())
        kind = np.full(len(h), 1 if key[1] < 0 else 2, np.int32)
        if key[1] >= 0:
            kind[-1] = 3
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), key[0])), pa.array(kind), pa.array(h), pa.array(n)], names=["lang", "kind", "h", "n"])

    found = scratch.write(map_runs(_sums(docs, langs, text_col, lang_col), ["lang", "shard"], [], add, "lang long, kind int, h long, n long"), "sums")
    words = found.where("kind = 2").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "h"))).where(F.col("r") <= COMMON + 1).drop("r")
    rows = words.unionByName(found.where("kind < 2")).unionByName(found.where("kind = 3").groupBy("lang", "kind", "h").agg(F.sum("n").alias("n"))).collect()
    scratch.clear()
    some = sorted({r["lang"] for r in rows})
    if not some:
        return None
    classes, common, shares = [], [], []
    for lang in some:
        own = [r for r in rows if r["lang"] == lang]
        chars = np.array([n for _, n in sorted((r["h"], r["n"]) for r in own if r["kind"] == 1)], float)
        top = [(r["h"] % (1 << 64), r["n"]) for r in own if r["kind"] == 2]
        over = min(n for _, n in top) if len(top) > COMMON else 0
        top = sorted(x for x in top if x[1] > over)
        total = next(r["n"] for r in own if r["kind"] == 3)
        n = np.array([n for _, n in top], float)
        classes.append(chars / chars.sum())
        common.append(np.array([h for h, _ in top], np.uint64))
        shares.append(np.append(n, total - n.sum()) / total)
    return Reference([langs[x] for x in some], np.array(classes), common, shares)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2, 0 to 1) of the rows of p and q."""
    m = (p + q) / 2

    def half(x: np.ndarray) -> np.ndarray:
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=-1)

    return np.sqrt(np.clip((half(p) + half(q)) / 2, 0, 1))


def divergences(texts: Texts, words: Words, ref: Reference) -> tuple[np.ndarray, np.ndarray]:
    """Distances (character classes, common words) from the nearest reference, less the allowance;
    0 where a guard says that the text is too short to tell."""
    classes, h, doc = class_counts(texts), words.hashes(lower=True), words.doc()
    chars = classes.sum(axis=1)
    p = classes / np.maximum(chars, 1)[:, None]
    by_class, by_word = [], []
    for c, common, w in zip(ref.classes, ref.common, ref.words, strict=True):
        k = len(common) + 1
        at = np.searchsorted(common, h)
        slot = np.where(np.append(common, 0)[at] == h, at, k - 1)
        hist = np.bincount(doc * k + slot, minlength=texts.n * k).reshape(texts.n, k)
        by_class.append(distance(p, c[None, :]))
        by_word.append(distance(hist / np.maximum(words.count, 1)[:, None], w[None, :]))
    by_class, by_word = np.array(by_class), np.array(by_word)
    near = (by_class + by_word).argmin(axis=0)
    at = np.arange(texts.n)
    return np.where(chars < GUARD_CHARS, 0, less_noise(by_class[near, at], len(CLASSES), chars)), np.where(words.count < GUARD_WORDS, 0, less_noise(by_word[near, at], COMMON + 1, words.count))


def less_noise(found: np.ndarray, cells: int, n: np.ndarray) -> np.ndarray:
    """Distances of samples of n, without what chance adds to the divergence (the distance's square): a
    sample of n has a divergence of about (cells - 1) / (8 n ln 2) from its own source."""
    return np.sqrt(np.maximum(found**2 - (cells - 1) / (8 * np.log(2) * np.maximum(n, 1)), 0))


def _verdicts(part: pa.RecordBatch, text_at: int, ref: Reference | None) -> tuple[Base, np.ndarray, np.ndarray, np.ndarray]:
    texts = Texts(part.column(text_at))
    words = Words(texts)
    base = base_counts(texts, words)
    a, b = divergences(texts, words, ref) if ref is not None else (np.zeros(texts.n), np.zeros(texts.n))
    return base, a, b, ~base.failed & (a <= CLASS_LIMIT) & (b <= WORD_LIMIT)


def rules(docs: DataFrame, ref: Reference | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, the base counts, base_failed, kept, and both distances."""

    prepare(docs.sparkSession)
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                base, a, b, kept = _verdicts(part, 1, ref)
                columns = [base.n_words, base.word_chars, base.n_symbols, base.n_dup_lines, base.n_repeat_words, base.failed, kept, a, b]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, columns)], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "word_distance"])

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(apply, schema)


def keep_good(docs: DataFrame, ref: Reference | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that the rules keep, with their columns as they are."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, at):
                yield part.filter(pa.array(_verdicts(part, at, ref)[3]))

    return docs.mapInArrow(apply, docs.schema)
