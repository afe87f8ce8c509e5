"""Vectorised word kernels over the raw UTF-8 buffers of an Arrow string column.

Words are `[^\\x20\\x09-\\x0D]+`. Texts are processed whole, a bounded number of bytes at a time;
a text longer than that bound is a piece of its own. Words and lines are told apart by a
64-bit hash of their bytes.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text in one piece of work; arrays of eight bytes a character stay near 8 MB.
PIECE = 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1342543DE82EF95)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += np.uint8(32)
#: Spans up to this many bytes are hashed together, in blocks of eight bytes; longer ones by XXH3 each.
SHORT = 64
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Texts:
    """Rows of a string column as bytes: data, and off with n + 1 offsets. Nulls are empty."""

    def __init__(self, column: pa.Array) -> None:
        if pa.types.is_large_string(column.type):
            width = np.int64
        else:
            column, width = column.cast(pa.string()), np.int32
        if column.null_count:
            column = column.fill_null("")
        _, offsets, data = column.buffers()
        n = len(column)
        off = np.frombuffer(offsets, width, count=n + 1, offset=column.offset * np.dtype(width).itemsize).astype(np.int64) if n else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        self.data, self.off, self.n = raw[off[0] : off[-1]], off - off[0], n

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def pieces(batch: pa.RecordBatch, text_at: int, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of whole rows with about size bytes of text each, one row at least."""
    if not batch.num_rows:
        return
    off = Texts(batch.column(text_at)).off
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi
    release()


def release() -> None:
    """Gives freed memory back, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


class Words:
    """start, end: byte positions of all words; off: offsets of each text's words, n + 1."""

    def __init__(self, texts: Texts) -> None:
        data, off = texts.data, texts.off
        self.texts = texts
        space = SPACE[data]
        before, after = np.ones(len(data) + 1, bool), np.ones(len(data) + 1, bool)
        before[1:] = np.concatenate([space, [True]])[: len(data)]
        before[off[:-1]] = True
        after[: len(data)] = np.concatenate([space[1:], [True]])[: len(data)]
        full = off[1:] > off[:-1]
        after[off[1:][full] - 1] = True
        self.start = np.flatnonzero(before[: len(data)] & ~space)
        self.end = np.flatnonzero(after[: len(data)] & ~space) + 1
        self.off = np.searchsorted(self.start, off)
        self.count = np.diff(self.off)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts.n), self.count)

    def hashes(self, lower: bool) -> np.ndarray:
        """A 64-bit hash of each word; lower: with A-Z as a-z."""
        return span_hashes(self.texts.data, self.start, self.end, LOWER if lower else None)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, letters: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the byte spans [start, end); letters: what each byte counts as. Every block of eight
    bytes, the last filled up with zeros, goes through the finaliser together with all before it, and the
    length comes first: no two spans are known to meet but by chance, unlike those of a polynomial."""
    n = end - start
    if letters is not None:
        data = letters[data]
    out = mix(n.astype(np.uint64) * STEP + BASE)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    at = np.flatnonzero((n > 0) & (n <= SHORT))
    first, left = start[at], n[at]
    while len(at):
        block = padded[first[:, None] + np.arange(8)].view(np.uint64)[:, 0] & _MASKS[np.minimum(left, 8)]
        out[at] = mix(out[at] ^ block)
        more = left > 8
        at, first, left = at[more], first[more] + 8, left[more] - 8
    for i in np.flatnonzero(n > SHORT).tolist():
        out[i] ^= np.uint64(xxhash.xxh3_64_intdigest(data[start[i] : end[i]], seed=int(STEP)))
    return out


def windows(h: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows within texts, and the index of each one's first word. h are hashes, so
    a polynomial over these few is safe."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total = total * BASE + h[j : n - k + 1 + j]
    room = np.repeat(off[1:], np.diff(off))[: n - k + 1]
    at = np.flatnonzero(np.arange(n - k + 1) + k <= room)
    return mix(total[at]), at


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the k-word shingles; of a text with fewer words, its whole sequence."""
    h = words.hashes(lower=True)
    own, at = windows(h, words.off, k)
    doc = words.doc()
    hashes, docs = [own], [doc[at]]
    for n in range(1, k):
        some = np.flatnonzero(words.count == n)
        if len(some):
            total = np.full(len(some), n, np.uint64) * STEP
            for j in range(n):
                total = total * BASE + h[words.off[some] + j]
            hashes.append(mix(total))
            docs.append(some)
    return np.concatenate(hashes), np.concatenate(docs)


def distinct(docs: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (text, hash) pairs, sorted."""
    order = np.lexsort((hashes, docs)) if len(docs) else np.zeros(0, np.int64)
    d, h = docs[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return d[new], h[new]
