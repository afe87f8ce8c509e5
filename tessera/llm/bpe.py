"""Byte-level BPE encoding and decoding by a public rank file.

Texts are encoded as the tiktoken library would: the pattern splits a text into pre-tokens and each is
merged by rank. A text longer than DEALT is cut into chunks that share an overlap, and these are dealt to
tasks. Each is pre-tokenised and encoded on its own. From the first place in an overlap where the
pre-token boundaries of both chunks agree, they agree for good, because a match depends only on what
follows its start; there the chunks' ids are stitched. Where an overlap holds no such place, the text since
the last one is carried on into the next chunk and encoded again. Decoding joins the bytes of the tokens.

Memory: a task holds the texts of one Arrow batch, or one chunk, or the ids of one text; ids and bytes never
become Python objects, and one Python step makes everything that leaves a text's task.

Defined results: a null text counts as empty and has no ids; ids keep the order of the text; ids that
the vocabulary lacks raise KeyError when decoded, null ids decode to null; rows are treated one by
one, so ties, repeated rows and empty tables need no care; a very long text gives the ids that it would
give in one piece; other columns pass through untouched, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.shared import map_runs, prepare
from tessera.llm.textkern import pieces, release

#: Characters of a chunk, of what it shares with the next, and of the longest text that is not cut.
CHUNK = 1 << 14
OVERLAP = 512
DEALT = 1 << 16
#: A match that ends this close to a chunk's end may be cut short by it (contractions have 3 characters).
MARGIN = 4


def public_ranks() -> tuple[str, str]:
    """The default rank file and its pattern."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


class Strings:
    """Byte strings by number, end to end in one array."""

    def __init__(self, of: dict[int, bytes]) -> None:
        self.length = np.full(max(of, default=-1) + 1, -1, np.int64)
        for i, x in of.items():
            self.length[i] = len(x)
        self.start = np.concatenate([[0], np.cumsum(np.maximum(self.length, 0))])[:-1]
        self.data = np.frombuffer(b"".join(of[i] for i in sorted(of)), np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.length) or (length := self.length[ids]).min() < 0:
            raise KeyError("an id that the vocabulary lacks")
        before = np.cumsum(length) - length
        return self.data[np.repeat(self.start[ids] - before, length) + np.arange(length.sum())].tobytes()


class Chunk:
    """A chunk's ids; marks: places and how many ids come before each; over: the place from which the
    next chunk agrees, 0 if there is none; last: whether it is the text's last."""

    def __init__(self, ids: np.ndarray, marks: np.ndarray, over: int, last: bool) -> None:
        self.ids, self.marks, self.over, self.last = ids, marks, over, last

    def before(self, place: int) -> int:
        return int(self.marks[1][np.searchsorted(self.marks[0], place)]) if place else 0


class Coder:
    """Encodes and decodes by the content of a rank file and a pattern."""

    def __init__(self, ranks: bytes, pattern: str) -> None:
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.tokens = Strings({b: a for a, b in table.items()})
        self.decimals = Strings({b: b"%d," % b for b in table.values()})

    def whole(self, text: str) -> np.ndarray:
        """The ids of a text in one piece."""
        return self.core.encode_to_numpy(text).astype(np.int32) if text else np.zeros(0, np.int32)

    def decode(self, ids) -> bytes:
        return self.tokens.join(np.asarray(ids, np.int64))

    def listed(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by commas."""
        return self.decimals.join(ids.astype(np.int64))[:-1]

    def ends(self, text: str, start: int, last: bool) -> list[int]:
        """Ends of the matches from start on that the text's end, unless it is the last, cannot have cut
        short, and at which a piece can end: white space before them might be split otherwise there."""
        stop = len(text) if last else len(text) - MARGIN
        return [e for m in self.pattern.finditer(text, start) if (e := m.end()) <= stop and not text[e - 1].isspace()]

    def chunk(self, text: str, last: bool, overlap: int) -> Chunk:
        own = self.ends(text, 0, last)
        fresh = set() if last else set(self.ends(text, len(text) - overlap, last))
        over = len(text) if last else next((e for e in own if e in fresh), 0)
        marks = sorted({e for e in own if e <= overlap} | {over or len(text), len(text)})
        parts = [self.whole(text[a:b]) for a, b in zip([0, *marks[:-1]], marks, strict=True)]
        return Chunk(np.concatenate(parts), np.array([marks, np.cumsum([len(x) for x in parts])], np.int64), over, last)

    def stitched(self, chunks: Iterable[Chunk], chunk: int, overlap: int) -> np.ndarray:
        """The ids of the text whose chunks follow one another."""
        out, at, carry = [np.zeros(0, np.int32)], 0, None
        for c in chunks:
            if carry is None:
                lo = c.before(at)
                if c.over:
                    out.append(c.ids[lo : c.before(c.over)])
                    at = c.over - chunk
                else:  # the text since the last place is carried on
                    carry = self.decode(c.ids[lo:]).decode()
                continue
            carry += self.decode(c.ids).decode()[overlap:]
            over, done = len(carry), len(carry)
            if not c.last:
                own = self.ends(carry, 0, False)
                fresh = set(self.ends(carry, len(carry) - overlap, False))
                over = next((e for e in own if e in fresh), 0)
                done = over or (own[-1] if own else 0)
            out.append(self.whole(carry[:done]))
            at, carry = over - len(carry) + overlap, None if over else carry[done:]
        return np.concatenate(out)

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """The ids of a text by way of its chunks."""
        return self.stitched((self.chunk(t, last, overlap) for t, last in cut(text, chunk, overlap)), chunk, overlap)


def cut(text: str, chunk: int, overlap: int) -> Iterator[tuple[str, bool]]:
    """Chunks of a text, each with what it shares with the next, and whether it is the last."""
    at = 0
    while len(text) - at > chunk + overlap:
        yield text[at : at + chunk + overlap], False
        at += chunk
    yield text[at:], True


_coders: dict[tuple[int, str], Coder] = {}


def _coder(ranks, pattern: str) -> Coder:
    key = (hash(ranks.value), pattern)
    if key not in _coders:
        _coders[key] = Coder(ranks.value, pattern)
    return _coders[key]


def _shared(df: DataFrame, path: str | None, pattern: str | None):
    prepare(df.sparkSession)
    if path is None:
        path, pattern = public_ranks()
    with open(path, "rb") as f:  # a vocabulary file: its size is fixed
        return df.sparkSession.sparkContext.broadcast(f.read()), pattern


_CHUNKS = "key long, part int, last boolean, text string"
_CODED = "key long, part int, last boolean, ids binary, marks binary, over int"


def _coded(docs: DataFrame, columns: list[str], text_col: str, finish: Callable, schema: T.StructType, path: str | None, pattern: str | None, chunk: int, overlap: int, dealt: int) -> DataFrame:
    """finish(coder, batch of the columns, texts, ids) -> batch, over all rows of docs. A cut text's chunks go to
    many tasks and only their ids meet; its row travels with the first chunk."""
    ranks, pattern = _shared(docs, path, pattern)
    kind = T.StructType([docs.schema[c] for c in columns])
    text_at = columns.index(text_col)
    given = docs.select(F.struct(*columns).alias("row"))
    long = F.coalesce(F.length(F.col("row")[text_col]) > dealt, F.lit(False))

    def fields(rows: pa.StructArray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(rows.flatten(), names=[f"c{i}" for i in range(rows.type.num_fields)])

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in batches:
            for part in pieces(fields(batch.column(0)), text_at):
                texts = part.column(text_at).to_pylist()
                yield finish(coder, part, texts, [coder.whole(t or "") for t in texts])
                del texts, part
                release()

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 40
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.column(0).slice(i, 1)
                for k, (text, last) in enumerate(cut(row.field(text_at)[0].as_py(), chunk, overlap)):
                    yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([k], pa.int32()), pa.array([last]), pa.array([text]), row if not k else pa.nulls(1, row.type)], names=["key", "part", "last", "text", "row"])
                key += 1

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for b in batches:
            for i in range(b.num_rows):
                c = coder.chunk(b.column(3)[i].as_py(), b.column(2)[i].as_py(), overlap)
                own = [pa.array([c.ids.tobytes()], pa.binary()), pa.array([c.marks.tobytes()], pa.binary()), pa.array([c.over], pa.int32())]
                yield pa.RecordBatch.from_arrays([*(x.slice(i, 1) for x in b.columns[:3]), *own, b.column(4).slice(i, 1)], names=["key", "part", "last", "ids", "marks", "over", "row"])
            release()

    def stitch(key: tuple, run: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = _coder(ranks, pattern), []

        def parts() -> Iterator[Chunk]:
            for b in run:
                for i in range(b.num_rows):
                    if not row:
                        row.append(fields(b.column(6).slice(i, 1)))
                    ids, marks = (b.column(k)[i].as_buffer() for k in (3, 4))
                    yield Chunk(np.frombuffer(ids, np.int32).copy(), np.frombuffer(marks, np.int64).reshape(2, -1).copy(), b.column(5)[i].as_py(), b.column(2)[i].as_py())

        ids = coder.stitched(parts(), chunk, overlap)
        yield finish(coder, row[0], row[0].column(text_at).to_pylist(), [ids])
        release()

    whole = given.where(~long).mapInArrow(short, schema)
    kinds = lambda ddl: T.StructType([*T.StructType.fromDDL(ddl).fields, T.StructField("row", kind)])
    pieces_of = given.where(long).mapInArrow(chunks, kinds(_CHUNKS)).repartition("key", "part").mapInArrow(code, kinds(_CODED))
    return whole.union(map_runs(pieces_of, ["key"], ["part"], stitch, schema))


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    off = np.zeros(len(ids) + 1, np.int32)
    np.cumsum([len(x) for x in ids], out=off[1:])
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _added(df: DataFrame, *more: T.StructField) -> T.StructType:
    names = {f.name for f in more}
    return T.StructType([*(f for f in df.schema.fields if f.name not in names), *more])


def encode(docs: DataFrame, text_col: str = "text", ids_col: str = "ids", check_col: str | None = None, path: str | None = None, pattern: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, dealt: int = DEALT) -> DataFrame:
    """docs with the token ids of each whole text as array<int> in ids_col, and in check_col, if named,
    whether they decode to the text (columns of these names are replaced)."""
    more = [T.StructField(ids_col, T.ArrayType(T.IntegerType())), *([T.StructField(check_col, T.BooleanType())] if check_col else [])]
    schema = _added(docs, *more)
    columns = schema.names[: -len(more)]

    def finish(coder: Coder, part: pa.RecordBatch, texts: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        own = [_lists(ids)]
        if check_col:
            own.append(pa.array([coder.decode(x) == (t or "").encode() for t, x in zip(texts, ids, strict=True)], pa.bool_()))
        return pa.RecordBatch.from_arrays([*part.columns, *own], names=schema.names)

    return _coded(docs, columns, text_col, finish, schema, path, pattern, chunk, overlap, dealt)


def decode(encoded: DataFrame, ids_col: str = "ids", bytes_col: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """encoded with the bytes that its ids stand for in bytes_col (replaced if it is there)."""
    ranks, pattern = _shared(encoded, path, pattern)
    rest = encoded.drop(bytes_col)
    ids_at = rest.columns.index(ids_col)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks, pattern)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = [None if x.values is None else coder.decode(x.values.to_numpy(zero_copy_only=False)) for x in part.column(ids_at)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*part.schema.names, bytes_col])
            release()

    return rest.mapInArrow(apply, _added(encoded, T.StructField(bytes_col, T.BinaryType())))


_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids as text and of the decoded bytes."""

    def finish(coder: Coder, part: pa.RecordBatch, texts: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        of = [[hashlib.sha256(f(x)).hexdigest() for x in ids] for f in (coder.listed, coder.decode)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), *map(pa.array, of)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    args = {"path": None, "pattern": None, "chunk": CHUNK, "overlap": OVERLAP, "dealt": DEALT} | how
    return _coded(given, ["doc_id", "text"], "text", finish, T.StructType.fromDDL(_DIGESTS), **args)
