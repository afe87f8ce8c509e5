"""Language-model scores by Brown classes: exchange clustering, class transitions, word emissions.

Words of the training documents are counted exactly. Exchange clustering assigns the COMMON commonest
words to classes by the likelihood of class bigrams; meanwhile all other words are one unit with a class to
itself. Then every other training word, however rare, gets the class that its own contexts (the classes
before and after it, all its occurrences summed) fit best; a word's spelling decides nothing. Class bigrams
and class sizes are counted again under the words' final classes. A word not seen in training
takes the class that is likeliest to follow the class before it and to hold a word not seen. A text's probability is the
product of class transitions (interpolated with class shares) and of emissions P(word | class), with one
unit of count kept back in each class for words not seen.

Counts of all words are not broadcast, since the vocabulary grows with the corpus. Documents are read
once into groups of bounded size, each with the list of its distinct words. The lists meet in shards of
the hash space, as do the words' contexts; a shard adds them up, settles its words' classes and sends counts
and classes back to the groups; a group's documents and its words' classes then meet in one task. What is
gathered on the driver is bounded: the commonest words, the bigram counts of units and classes, and totals.

Defined results: a null, empty or blank text is its end alone; a null doc_id is a training document and
stays null; repeated rows count each time; ties among the commonest words are settled by their hash, ties
among classes by their number; a very long text is a group of its own; without training documents N and V
are 0, nothing is known and all words are unseen; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch, added_up, expand, map_runs, pack, squeeze, unpack
from tessera.llm.textkern import Texts, Words, pieces

#: Words that are exchanged one by one, classes, and rounds of exchange at most.
COMMON = 2048
CLASSES = 64
ROUNDS = 8
#: Bytes of text in one group, and entries of word lists in one shard.
GROUP = 64 << 20
SHARD = 1 << 21
#: A group's id is its number in the task that makes it, and above that the task's.
TASK_SHIFT = 24
#: Contexts that a task holds before it passes them on, and words judged at once.
HELD = 1 << 21
JUDGED = 1 << 13
SMOOTH = 1.0
#: Weight of class shares beside class transitions.
SHARE = 0.05
#: The end of a text; no word has this hash.
END = np.uint64(0)
#: The last two classes are those of the words that are not exchanged and of the end; others are open.
REST_CLASS, END_CLASS, OPEN = CLASSES - 2, CLASSES - 1, CLASSES - 2
#: Stands for the class of words not seen until that is known.
UNSEEN = CLASSES


def word_hashes(words: Words) -> np.ndarray:
    """64-bit hashes of lower-cased words."""
    out = words.hashes(lower=True)
    out[out == END] = np.uint64(1) << np.uint64(63)
    return out


def with_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text's words, and the texts' token counts."""
    count = words.count + 1
    out = np.full(int(count.sum()), END, np.uint64)
    out[np.arange(len(words.start)) + words.doc()] = word_hashes(words)
    return out, count


class _Group:
    """The distinct words of a group so far, with their training counts, by local number."""

    def __init__(self) -> None:
        self.known, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.hashes: list[np.ndarray] = []
        self.counts = np.zeros(0, np.int64)
        self.size = 0

    def numbers(self, h: np.ndarray, train: np.ndarray) -> np.ndarray:
        words, inverse, count = np.unique(h, return_inverse=True, return_counts=True)
        at = np.searchsorted(self.known, words)
        old = np.zeros(len(words), bool)
        if len(self.known):
            old = self.known[np.minimum(at, len(self.known) - 1)] == words
        local = np.empty(len(words), np.int64)
        local[old] = self.number[at[old]]
        new = np.flatnonzero(~old)
        new_order = new[np.argsort(-count[new], kind="stable")]
        local[new_order] = len(self.counts) + np.arange(len(new))
        self.hashes.append(words[new_order])
        self.counts = np.concatenate([self.counts, np.zeros(len(new), np.int64)])
        self.known = np.insert(self.known, at[new], words[new])
        self.number = np.insert(self.number, at[new], local[new])
        self.counts += np.bincount(local[inverse[train]], minlength=len(self.counts))
        return local[inverse]


_WHO = [("id", np.int64), ("flags", np.uint8)]
_SUMS = [("known", np.int64), ("base", float), ("emission", float)]
_TOKENS = "gid long, kind int, seq int, a binary, b binary, c binary"


def _tokens(docs: DataFrame) -> DataFrame:
    """Rows of groups: kind 0 is a word list (hashes, training counts); kind 2 is a bundle of documents
    (ids with validity and held_out, token counts, local word numbers)."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        number, seq, group = 0, 0, _Group()

        def row(kind: int, *parts: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([task << TASK_SHIFT | number], pa.int64()), pa.array([kind], pa.int32()), pa.array([seq], pa.int32()), *(pa.array([p], pa.binary()) for p in parts)], names=["gid", "kind", "seq", "a", "b", "c"])

        def words() -> pa.RecordBatch:
            return row(0, pack(np.concatenate(group.hashes)), pack(group.counts), b"")

        for batch in batches:
            for part in pieces(batch, 2):
                texts = Texts(part.column(2))
                h, count = with_ends(Words(texts))
                held = part.column(1).to_numpy(zero_copy_only=False).astype(bool)
                local = group.numbers(h, np.repeat(~held, count))
                ids = part.column(0)
                flags = ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8) | held.astype(np.uint8) << 1
                who = np.zeros(part.num_rows, _WHO)
                who["id"], who["flags"] = ids.fill_null(0).to_numpy(), flags
                yield row(2, squeeze(who.tobytes()), pack(count.astype(np.int64)), pack(local.astype(np.uint32)))
                seq += 1
                group.size += len(texts.data)
                if group.size >= GROUP:
                    yield words()
                    number, seq, group = number + 1, 0, _Group()
        if group.hashes:
            yield words()

    return docs.mapInArrow(apply, _TOKENS)


_REQUESTS = "shard long, gid long, a binary, b binary, c binary"


def _edges(bits: int) -> np.ndarray:
    return (np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else np.zeros(0, np.uint64)


def _requests(tokens: DataFrame, bits: int) -> DataFrame:
    """(shard, gid, hashes, counts): every word list, cut by the top bits of the sorted hashes."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = _edges(bits)
        for b in batches:
            for gid, a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                h, n = unpack(a, np.uint64), unpack(c, np.int64)
                order = np.argsort(h)
                h, n = h[order], n[order]
                cut = [0, *np.searchsorted(h, edges).tolist(), len(h)]
                for s, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                    if hi > lo:
                        yield pa.RecordBatch.from_arrays([pa.array([s], pa.int64()), pa.array([gid], pa.int64()), pa.array([pack(h[lo:hi])], pa.binary()), pa.array([pack(n[lo:hi])], pa.binary()), pa.array([b""], pa.binary())], names=["shard", "gid", "a", "b", "c"])

    return tokens.where("kind = 0").select("gid", "a", "b").mapInArrow(apply, _REQUESTS)


def _by_shard(bits: int) -> tuple[int, Column]:
    """A partition for each shard."""
    return 1 << bits, F.col("shard")


def _gathered(run: Iterator[pa.RecordBatch]) -> tuple[list, list, list, list]:
    """Of a shard's rows: groups, their word lists and counts, and the context lists (gid -1)."""
    gids, lists, counts, contexts = [], [], [], []
    for b in run:
        for gid, x, y, z in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
            if gid < 0:
                contexts.append((unpack(x, np.uint64), unpack(y, np.int64), unpack(z, np.int64)))
            else:
                gids.append(gid)
                lists.append(unpack(x, np.uint64))
                counts.append(unpack(y, np.int64))
    return gids, lists, counts, contexts


def _totals(lists: list, counts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A shard's words in order, where each entry of the lists is among them, and corpus counts."""
    words, inverse = np.unique(np.concatenate(lists), return_inverse=True)
    total = np.zeros(len(words), np.int64)
    np.add.at(total, inverse, np.concatenate(counts))
    return words, inverse, total


_HEADS = "kind int, h long, n long"


def _heads(requests: DataFrame, common: int, bits: int) -> DataFrame:
    """For each shard its commonest words (kind 0: hash, count) and its totals (kind 1: words, tokens)."""

    def add(key: tuple, run: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, lists, counts, _ = _gathered(run)
        words, _, total = _totals(lists, counts)
        plain = np.flatnonzero((total > 0) & (words != END))
        top = plain[np.lexsort((words[plain].view(np.int64), -total[plain]))[:common]]
        h, n = np.append(words[top].view(np.int64), (total > 0).sum()), np.append(total[top], total.sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.zeros(len(top), np.int32), np.int32(1))), pa.array(h), pa.array(n)], names=["kind", "h", "n"])

    return map_runs(requests, ["shard"], ["gid"], add, _HEADS, _by_shard(bits))


def _matrix(parts: DataFrame, size: int) -> np.ndarray:
    """The matrix (size x size) of the sums of packed rows (unit, n)."""
    out = np.zeros((size, size), np.int64)
    for r in added_up(parts, "unit", "n", lambda x: unpack(x, np.int64), pack).collect():
        out[r["unit"]] = unpack(r["n"], np.int64)
    return out


def _bigrams(docs: DataFrame, common: np.ndarray) -> np.ndarray:
    """Counts of unit bigrams over all training documents, a text's start being an end."""
    order = np.argsort(common)
    ranked, size = common[order], len(common) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)
        for batch in batches:
            batch = batch.filter(pa.compute.invert(batch.column(0)))
            for part in pieces(batch, 1):
                h, _ = with_ends(Words(Texts(part.column(1))))
                unit = units(h, ranked, order)
                before = np.concatenate([[size - 1], unit[:-1]])
                pairs, n = np.unique(before * size + unit, return_counts=True)
                total[pairs] += n
        matrix = total.reshape(size, size)
        for i in np.flatnonzero(matrix.any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([pack(matrix[i])], pa.binary())], names=["unit", "n"])

    return _matrix(docs.select("held_out", "text").mapInArrow(count, "unit long, n binary"), size)


def units(h: np.ndarray, ranked: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The clustering unit of each token: its own, then one for all other words, then the end's."""
    out = np.full(len(h), len(ranked), np.int64)
    if len(ranked):
        at = np.minimum(np.searchsorted(ranked, h), len(ranked) - 1)
        hit = ranked[at] == h
        out[hit] = order[at[hit]]
    out[h == END] = len(ranked) + 1
    return out


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(n: np.ndarray, classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Classes of units from their bigram counts: each unit in turn moves to the class that raises the
    likelihood of class bigrams most, until none moves or the rounds are over. The last two units keep the
    last two classes to themselves."""
    size, free = len(n), classes - 2
    n = np.ascontiguousarray(n, dtype=np.float64)
    into = np.ascontiguousarray(n.T)
    weight = n.sum(axis=0) + n.sum(axis=1)
    of = np.empty(size, np.int64)
    by_weight = np.argsort(-weight[:-2], kind="stable")
    of[by_weight] = np.arange(size - 2) % free
    of[-2:] = free, free + 1
    hot = np.zeros((size, classes))
    hot[np.arange(size), of] = 1
    pair = hot.T @ n @ hot
    left, right = pair.sum(axis=1), pair.sum(axis=0)
    to = np.arange(free)
    by_weight = by_weight[weight[by_weight] > 0]
    for _ in range(rounds):
        moved = 0
        for w in by_weight.tolist():
            k, own = int(of[w]), n[w, w]
            row, column = n[w] @ hot, into[w] @ hot
            row[k] -= own
            column[k] -= own
            out_w, in_w = row.sum() + own, column.sum() + own
            # without w; wherever it goes, classes before and after it keep their bigrams with it
            pair[k] -= row
            pair[:, k] -= column
            pair[k, k] -= own
            left[k] -= out_w
            right[k] -= in_w
            # with w in class x: row x gains row, column x gains column, and cell (x, x) own too
            after, before = np.flatnonzero(row), np.flatnonzero(column)
            old_row, old_col = pair[:free, after], pair[before, :free].T
            grown_row = _xlogx(old_row + row[after]) - _xlogx(old_row)
            grown_col = _xlogx(old_col + column[before]) - _xlogx(old_col)
            corner = pair[to, to]
            gain = grown_row.sum(axis=1) + grown_col.sum(axis=1) + _xlogx(corner + row[:free] + column[:free] + own) - _xlogx(corner)
            gain -= _xlogx(corner + row[:free]) - _xlogx(corner) + _xlogx(corner + column[:free]) - _xlogx(corner)
            gain -= _xlogx(left[:free] + out_w) - _xlogx(left[:free]) + _xlogx(right[:free] + in_w) - _xlogx(right[:free])
            best = int(gain.argmax())
            best = best if gain[best] > gain[k] + 1e-9 else k
            pair[best] += row
            pair[:, best] += column
            pair[best, best] += own
            left[best] += out_w
            right[best] += in_w
            if best != k:
                hot[w, k], hot[w, best], of[w] = 0, 1, best
                moved += 1
        if not moved:
            break
    return of


@dataclass
class Model:
    """tokens: N; words: V; common: hashes of the commonest words; class_of: by unit; table: class
    bigrams; transition: log10 P(class | class before); room: by class, tokens + SMOOTH * (distinct words
    + 1); unseen: by the class before it, the class of a word not seen."""

    tokens: int
    words: int
    common: np.ndarray
    class_of: np.ndarray
    table: np.ndarray
    transition: np.ndarray
    room: np.ndarray
    unseen: np.ndarray


def _transition(table: np.ndarray) -> np.ndarray:
    share = (table.sum(axis=0) + SMOOTH) / (table.sum() + SMOOTH * CLASSES)
    after = (table + SMOOTH * share[None, :]) / (table.sum(axis=1, keepdims=True) + SMOOTH)
    return np.log10((1 - SHARE) * after + SHARE * share[None, :])


def _model(heads: DataFrame, docs: DataFrame, most: int) -> Model:
    """The model of units, in which all but the commonest words have the rest's class."""
    top = heads.where("kind = 0").orderBy(F.desc("n"), "h").limit(most).collect()
    common = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    total = heads.where("kind = 1").agg(F.sum("n").alias("n"), F.sum("h").alias("v")).first()
    pairs = _bigrams(docs, common)
    class_of = exchange(pairs)
    hot = np.zeros((len(class_of), CLASSES))
    hot[np.arange(len(class_of)), class_of] = 1
    table = hot.T @ pairs @ hot
    return Model(total["n"] or 0, total["v"] or 0, common, class_of, table, _transition(table), np.ones(CLASSES), np.zeros(CLASSES, np.int64))


def _contexts(docs: DataFrame, model, bits: int) -> DataFrame:
    """Requests of gid -1: the words of training documents that are not among the commonest, how many
    contexts each has in the row, and these, as context + 2 * CLASSES * count. A context is the class
    before the word, or CLASSES + the class after it."""
    sides = 2 * CLASSES

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        order = np.argsort(m.common)
        ranked, edges = m.common[order], _edges(bits)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def out() -> Iterator[pa.RecordBatch]:
            words, at = np.unique(np.concatenate([x for x, _, _ in held]), return_inverse=True)
            keys, where = np.unique(at * sides + np.concatenate([x for _, x, _ in held]), return_inverse=True)
            n = np.bincount(where, np.concatenate([x for _, _, x in held])).astype(np.int64)
            each = np.bincount(keys // sides, minlength=len(words))
            packed = keys % sides + sides * n
            cut = [0, *np.searchsorted(words, edges).tolist(), len(words)]
            first = np.concatenate([[0], np.cumsum(each)])
            for shard, (lo, hi) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if hi > lo:
                    parts = words[lo:hi], each[lo:hi].astype(np.int64), packed[first[lo] : first[hi]]
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([-1], pa.int64()), *(pa.array([pack(x)], pa.binary()) for x in parts)], names=["shard", "gid", "a", "b", "c"])

        for batch in batches:
            batch = batch.filter(pa.compute.invert(batch.column(0)))
            for part in pieces(batch, 1):
                h, _ = with_ends(Words(Texts(part.column(1))))
                unit = units(h, ranked, order)
                k = m.class_of[unit]
                tail = np.flatnonzero(unit == len(ranked))
                if not len(tail):
                    continue
                words, at = np.unique(h[tail], return_inverse=True)
                # a text follows an end, and every text has one
                before = np.where(tail > 0, k[tail - 1], END_CLASS)
                keys, n = np.unique(np.concatenate([at * sides + before, at * sides + CLASSES + k[tail + 1]]), return_counts=True)
                held.append((words[keys // sides], keys % sides, n))
                if sum(len(x) for x, _, _ in held) >= HELD:
                    yield from out()
                    held.clear()
        if held:
            yield from out()

    return docs.select("held_out", "text").mapInArrow(apply, _REQUESTS)


def best_classes(at: np.ndarray, context: np.ndarray, n: np.ndarray, words: int, table: np.ndarray) -> np.ndarray:
    """For each of the words the class whose contexts in table are likeliest to give the word's own: n of
    each context of the word with the number at. Classes without tokens, and those of the rest and of the
    end, take no words; if there is no other, words stay with the rest."""
    sides = 2 * CLASSES
    size = np.concatenate([np.repeat(table.sum(axis=0)[None, :], CLASSES, axis=0), np.repeat(table.sum(axis=1)[None, :], CLASSES, axis=0)]).astype(float)
    pair = np.concatenate([table, table.T]).astype(float)  # context x class
    prior = SMOOTH * np.concatenate([(x + 1) / (x.sum() + CLASSES) for x in (table.sum(axis=1), table.sum(axis=0))])
    weight = np.log((pair + prior[:, None]) / (size + SMOOTH))
    closed = table.sum(axis=0) + table.sum(axis=1) == 0
    closed[OPEN:] = True
    best = np.full(words, REST_CLASS, np.int64)
    if closed.all():
        return best
    keys, where = np.unique(at * sides + context, return_inverse=True)
    n = np.bincount(where, n)
    at, context = keys // sides, keys % sides
    for lo in range(0, words, JUDGED):
        hi = min(lo + JUDGED, words)
        part = slice(*np.searchsorted(at, [lo, hi]))
        value = np.bincount((at[part] - lo) * sides + context[part], n[part], (hi - lo) * sides).reshape(-1, sides) @ weight
        value[:, closed] = -np.inf
        best[lo:hi] = value.argmax(axis=1)
    return best


def _replies(asked: DataFrame, model, bits: int) -> DataFrame:
    """Rows of kind 1 answer a group's request with corpus counts and classes, in its order. Rows of
    kind 3 hold a shard's tokens and distinct words by class."""

    def add(key: tuple, run: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        gids, lists, counts, contexts = _gathered(run)
        words, inverse, total = _totals(lists, counts)
        order = np.argsort(m.common)
        unit = units(words, m.common[order], order)
        k = m.class_of[unit]
        own = np.flatnonzero((total > 0) & (unit == len(order)))
        if contexts:
            at = np.concatenate([np.repeat(np.searchsorted(words[own], x), each) for x, each, _ in contexts])
            entries = np.concatenate([x for _, _, x in contexts])
            k[own] = best_classes(at, entries % (2 * CLASSES), entries // (2 * CLASSES), len(own), m.table)
        seen = total > 0
        k[~seen] = UNSEEN
        plain = seen & (words != END)
        stats = np.concatenate([np.bincount(k[plain], total[plain], CLASSES), np.bincount(k[plain], minlength=CLASSES)]).astype(np.int64)

        def row(kind: int, gid: int, a: np.ndarray, b: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([gid], pa.int64()), pa.array([kind], pa.int32()), pa.array([key[0]], pa.int32()), *(pa.array([x], pa.binary()) for x in (pack(a), b, b""))], names=["gid", "kind", "seq", "a", "b", "c"])

        yield row(3, -1, stats, b"")
        at = 0
        for gid, one in zip(gids, lists, strict=True):
            mine = inverse[at : at + len(one)]
            yield row(1, gid, total[mine], squeeze(k[mine].astype(np.uint8).tobytes()))
            at += len(one)

    return map_runs(asked, ["shard"], ["gid"], add, _TOKENS, _by_shard(bits))


_CLASSED = "unit long, a binary, b binary, c binary, d binary"


def _by_group(groups: int, tasks: int) -> tuple[int, Column]:
    """A partition for each group: groups of equal number, and those of one task, never share one, and
    none does where tasks have equally many groups."""
    most = max(groups, tasks, 2)
    while any(most % x == 0 for x in range(2, math.isqrt(most) + 1)):
        most += 1
    number, task = F.col("gid").bitwiseAND((1 << TASK_SHIFT) - 1), F.shiftright("gid", TASK_SHIFT)
    return most, F.pmod(number * F.lit(tasks) + task, F.lit(most))


def _classed(rows: DataFrame, place: tuple[int, Column]) -> DataFrame:
    """From each group's word list, the replies to it and its bundles: class bigrams of its training
    documents (unit is the class before, a the counts), and bundles (unit -1) of documents with token
    counts, the classes of the tokens, and the sums of known tokens and of log10(count + 1) of tokens and words."""

    def apply(key: tuple, run: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, replies, known = None, [], None
        table = np.zeros(CLASSES * CLASSES, np.int64)

        def row(unit: int, *parts: bytes) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([unit], pa.int64()), *(pa.array([x], pa.binary()) for x in parts)], names=["unit", "a", "b", "c", "d"])

        for b in run:
            for kind, x, y, z in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                if kind == 0:
                    hashes = unpack(x, np.uint64)
                elif kind == 1:
                    replies.append((unpack(x, np.int64), np.frombuffer(expand(y), np.uint8)))
                else:
                    if known is None:
                        order = np.argsort(hashes)
                        c, k = np.empty(len(hashes), np.int64), np.empty(len(hashes), np.int64)
                        c[order], k[order] = (np.concatenate([r[i] for r in replies]) for i in (0, 1))
                        known = c, k, np.log10(c + 1), np.where(hashes == END, 0.0, np.log10(c + SMOOTH))
                    c, k, base, emission = known
                    count, at = unpack(y, np.int64), unpack(z, np.uint32)
                    first = np.concatenate([[0], np.cumsum(count)[:-1]])
                    now = k[at]
                    before = np.concatenate([[END_CLASS], now[:-1]])  # a text follows an end
                    held = (np.frombuffer(expand(x), _WHO)["flags"] & 2) > 0
                    train = np.repeat(~held, count)
                    table += np.bincount(before[train] * CLASSES + now[train], minlength=len(table))
                    sums = np.zeros(len(count), _SUMS)
                    sums["known"], sums["base"], sums["emission"] = (np.add.reduceat(v, first) for v in ((c[at] > 0).astype(np.int64), base[at], emission[at]))
                    yield row(-1, x, y, squeeze(now.astype(np.uint8).tobytes()), squeeze(sums.tobytes()))
        matrix = table.reshape(CLASSES, CLASSES)
        for i in np.flatnonzero(matrix.any(axis=1)).tolist():
            yield row(i, pack(matrix[i]), b"", b"", b"")

    return map_runs(rows, ["gid"], ["kind", "seq"], apply, _CLASSED, place)


def settle(now: np.ndarray, unseen: np.ndarray) -> np.ndarray:
    """Gives the words not seen among the tokens' classes now, in place, the classes that the classes
    before them ask for, one after another; returns the class before each token."""
    new = now == UNSEEN
    place = np.arange(len(now))
    # how many unseen words end here, and the class before the first of them; a text follows an end
    run = np.where(new, place - np.maximum.accumulate(np.where(new, -1, place)), 0)
    first = np.where(place - run < 0, END_CLASS, now[place - run])
    after = [np.arange(CLASSES)]
    for _ in range(int(run.max(initial=0))):
        after.append(unseen[after[-1]])
    now[new] = np.stack(after)[run[new], first[new]]
    return np.concatenate([[END_CLASS], now[:-1]])


def _settled(units_model: Model, replies: DataFrame, classed: DataFrame) -> Model:
    """The model under the words' final classes."""
    parts = replies.where("kind = 3").select(F.lit(0).cast("long").alias("unit"), F.col("a").alias("n"))
    rows = added_up(parts, "unit", "n", lambda x: unpack(x, np.int64), pack).collect()
    tokens, words = (unpack(rows[0]["n"], np.int64) if rows else np.zeros(2 * CLASSES, np.int64)).reshape(2, -1)
    table = _matrix(classed.where("unit >= 0").select("unit", F.col("a").alias("n")), CLASSES)
    room, transition = tokens + SMOOTH * (words + 1), _transition(table)
    # of the open classes that have words, if any has
    value = transition - np.log10(room)
    value[:, np.append(tokens[:OPEN] == 0, [tokens.any(), True])] = -np.inf
    return replace(units_model, table=table, transition=transition, room=room, unseen=value.argmax(axis=1))


def _scores(classed: DataFrame, model) -> DataFrame:
    """Scores of the documents of each bundle."""

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        # an end is always sure within its class
        room = np.append(np.log10(m.room[:-1]), 0.0)
        for b in batches:
            for w, x, y, z in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                who, count, sums = np.frombuffer(expand(w), _WHO), unpack(x, np.int64), np.frombuffer(expand(z), _SUMS)
                now = np.frombuffer(expand(y), np.uint8).astype(np.int64)
                before = settle(now, m.unseen)
                first = np.concatenate([[0], np.cumsum(count)[:-1]])
                score = np.add.reduceat(m.transition[before, now] - room[now], first) + sums["emission"]
                plain = sums["base"] - count * np.log10(m.tokens + m.words + 1)
                ids = pa.array(who["id"].copy(), mask=(who["flags"] & 1) == 0)
                yield pa.RecordBatch.from_arrays([ids, pa.array((who["flags"] & 2) > 0), pa.array(count), pa.array(sums["known"].copy()), pa.array(np.full(len(count), m.tokens, np.int64)), pa.array(plain), pa.array(score), pa.array(10 ** (-score / count))], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return classed.where("unit = -1").select("a", "b", "c", "d").mapInArrow(apply, schema)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", common: int = COMMON) -> DataFrame:
    """One row for each row of docs, learned from those that are not held_out: doc_id, held_out,
    n_tokens, n_known, train_tokens (N), base_score (add-one unigram), score (log10 probability of the
    text under the class model) and perplexity. common: how many words are exchanged one by one."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "brown")
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    tokens = scratch.write(_tokens(given), "tokens")
    # compressed lists take about 8 bytes an entry
    size, groups, last = tokens.where("kind = 0").agg(F.sum(F.length("a")), F.count("*"), F.max(F.shiftright("gid", TASK_SHIFT))).first()
    bits = max(0, int((size or 0) // 8 // SHARD)).bit_length()
    found = _model(scratch.write(_heads(_requests(tokens, bits), common, bits), "heads"), given, common)
    model = spark.sparkContext.broadcast(found)
    # contexts outnumber words
    bits += 2
    replies = scratch.write(_replies(_requests(tokens, bits).union(_contexts(given, model, bits)), model, bits), "replies")
    classed = scratch.write(_classed(tokens.union(replies.where("kind = 1")), _by_group(groups, (last or 0) + 1)), "classed")
    return _scores(classed, spark.sparkContext.broadcast(_settled(found, replies, classed)))
