"""Zstandard-compressed WARC archives: a writer with revisit records, and a reader.

An archive begins with a skippable frame that holds the dictionary, then has one frame for each record.
The reader loads the dictionary, finds each frame's end from its block headers, decodes it, and validates
the record: version line, mandatory headers, block length, trailing line ends and digests. A page
whose payload equals that of a page with a smaller id is written as a revisit of it, without payload.

Each task writes its archives under a name of its own and renames the finished folder, so that a retried
or doubled task leaves one whole set. Archives are read by Spark's binary file source.

Defined results: null html is an empty payload; rows that share the least page_id of a payload are all
responses; a row with a null page_id is a response, nothing refers to it, and is read back with a null
page_id; null urls are read back as null; other columns are ignored; an empty table writes no archive
and reads back as no rows; a malformed archive raises WarcError with the place.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import Scratch

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("WARC-Record-ID", "WARC-Date", "WARC-Type", "Content-Length")
#: Date of all records: archives of the same pages have the same bytes.
DATE = "2020-01-01T00:00:00Z"
#: Compressed bytes after which a new archive begins.
ARCHIVE = 8 << 20
DICTIONARY = 32 << 10
#: The dictionary is trained on so many pages at most, and so many characters of each.
SAMPLE, SAMPLE_CHARS = 256, 8192
LEVEL = 3
MIN_REVISIT = 0


class WarcError(ValueError):
    """An archive that breaks the format."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def train_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of the samples; where there are too few to train one, their beginnings."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or b"<!DOCTYPE html><html><head></head><body></body></html>"


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def _line(value: str) -> str:
    """A header value cannot hold line ends; in urls they are percent-encoded."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def page_id_urn(page_id: int | None) -> str:
    return f"<urn:pages:{'' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    digest = sha1_base32(payload)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", page_id_urn(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", _line(url)))
    headers += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers_to is not None:
        headers += [("WARC-Refers-To", page_id_urn(refers_to)), ("WARC-Profile", PROFILE)]
    block = http + (payload if refers_to is None else b"")
    return record([*headers, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}")], block)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame at `at` ends, from its header and block headers."""
    if bytes(data[at : at + 4]) != FRAME_MAGIC:
        raise WarcError(f"no frame at byte {at}")
    try:
        head = bytes(data[at : at + 18])
        checked, at = zstandard.get_frame_parameters(head).has_checksum, at + zstandard.frame_header_size(head)
    except zstandard.ZstdError as e:
        raise WarcError(f"bad frame header at byte {at}: {e}") from e
    last = 0
    while not last:
        if at + 3 > len(data):
            raise WarcError(f"frame cut short at byte {at}")
        word = data[at] | data[at + 1] << 8 | data[at + 2] << 16
        last, kind, size = word & 1, word >> 1 & 3, word >> 3
        if kind == 3:
            raise WarcError(f"reserved block type at byte {at}")
        at += 3 + (1 if kind == 1 else size)
    at += 4 * checked
    if at > len(data):
        raise WarcError("frame cut short at the end")
    return at


def frames(archive: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of every record frame of an archive."""
    data = memoryview(archive).cast("B")
    if len(data) < 8:
        raise WarcError("no dictionary frame")
    magic, size = struct.unpack("<II", data[:8])
    if magic != DICTIONARY_MAGIC:
        raise WarcError(f"the first frame has magic {magic:#x}")
    if 8 + size > len(data):
        raise WarcError("dictionary frame cut short")
    dictionary = bytes(data[8 : 8 + size])
    if dictionary[:4] == FRAME_MAGIC:  # a dictionary may itself be compressed
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    at = 8 + size
    while at < len(data):
        end = frame_end(data, at)
        try:
            yield at, decoder.decompress(data[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"frame at byte {at}: {e}") from e
        at = end


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """The headers and block of one record, validated."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != VERSION:
        raise WarcError(f"bad version line {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:40]!r}")
        headers[name.strip()] = value.strip()
    if missing := [x for x in MANDATORY if x not in headers]:
        raise WarcError(f"headers missing: {missing}")
    if not headers["Content-Length"].isdigit() or len(rest) != int(headers["Content-Length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError(f"block of {len(rest) - 4} bytes, Content-Length {headers['Content-Length']}")
    block = rest[:-4]
    if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != f"sha1:{sha1_base32(block)}":
        raise WarcError(f"block digest of {headers['WARC-Record-ID']}")
    return headers, block


def _page(urn: str | None) -> int | None:
    if urn is None or not (urn.startswith("<urn:pages:") and urn.endswith(">")):
        return None
    return int(urn[11:-1]) if urn[11:-1] else None


def page_of(raw: bytes) -> dict | None:
    """What a response or revisit record says of its page; None for other records."""
    headers, block = parse(raw)
    kind = headers["WARC-Type"]
    if kind not in ("response", "revisit"):
        return None
    http, sep, payload = block.partition(b"\r\n\r\n")
    lengths = [x.split(b":", 1)[1].strip() for x in http.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not sep or not http.startswith(b"HTTP/1.") or len(lengths) != 1 or not lengths[0].isdigit():
        raise WarcError(f"bad HTTP head in {headers['WARC-Record-ID']}")
    size, digest = int(lengths[0]), headers.get("WARC-Payload-Digest", "")
    if kind == "response" and (len(payload) != size or digest != f"sha1:{sha1_base32(payload)}"):
        raise WarcError(f"payload of {headers['WARC-Record-ID']} differs from its length or digest")
    if kind == "revisit" and (payload or "WARC-Refers-To" not in headers):
        raise WarcError(f"revisit {headers['WARC-Record-ID']} has a payload or refers to nothing")
    return {"page_id": _page(headers["WARC-Record-ID"]), "url": headers.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest.removeprefix("sha1:"), "record_type": kind, "refers_to": _page(headers.get("WARC-Refers-To")), "payload": payload if kind == "response" else None}


def _filesystem(root: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" not in root and not root.startswith("file:"):
        return arrow_fs.LocalFileSystem(), root
    return arrow_fs.FileSystem.from_uri(root if "://" in root else root.replace("file:", "file://", 1))


def revisits(pages: DataFrame, least: int = MIN_REVISIT) -> DataFrame:
    """(page_id, digest, bytes, refers_to) of the pages that repeat a payload of a smaller id."""
    keyed = pages.select("page_id", "digest", "bytes").where((F.col("bytes") >= least) & F.col("page_id").isNotNull()).distinct()
    first = keyed.groupBy("digest", "bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1").drop("c")
    return keyed.join(first, ["digest", "bytes"]).where("page_id <> refers_to")


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = MIN_REVISIT) -> DataFrame:
    """Writes a record for each page into archives under root; returns the manifest (file, records)
    as a lazy DataFrame whose execution does the writing."""
    spark = pages.sparkSession
    given = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    given = given.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("bytes", F.octet_length("html").cast("long"))
    # the sample is chosen by ids alone, so that no task sends texts it may not be asked for
    place = F.xxhash64("page_id")
    last = given.select(place.alias("h")).orderBy("h").limit(SAMPLE).agg(F.max("h")).first()[0]
    samples = given.where(place <= F.lit(last)).select(F.substring("html", 1, SAMPLE_CHARS).alias("s")).limit(SAMPLE).collect() if last is not None else []
    dictionary = spark.sparkContext.broadcast(train_dictionary([r["s"].encode() for r in samples if r["s"]]))
    both = given.join(revisits(given, least), ["page_id", "digest", "bytes"], "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _filesystem(root)
        task = TaskContext.get()
        final, own = f"{base}/part-{task.partitionId():06d}", f"{base}/_part-{task.partitionId():06d}-{task.taskAttemptId()}"
        coder = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary.value), write_checksum=True)
        names, counts, buffer, size = [], [], [], 0

        def flush() -> None:
            if not names:
                store.create_dir(own, recursive=True)
            names.append(f"{len(names):05d}.warc.zst")
            counts.append(len(buffer) - 1)
            with store.open_output_stream(f"{own}/{names[-1]}", compression=None) as out:
                out.write(dictionary_frame(dictionary.value) + b"".join(buffer))

        for b in batches:
            for lo in range(0, b.num_rows, 64):
                for r in b.slice(lo, 64).to_pylist():
                    if not buffer:
                        info = record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archives:{task.partitionId()}:{len(names)}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                        buffer, size = [coder.compress(info)], 0
                    buffer.append(coder.compress(page_record(r["page_id"], r["url"], r["html"].encode(), r["refers_to"])))
                    size += len(buffer[-1])
                    if size >= ARCHIVE:
                        flush()
                        buffer = []
        if buffer:
            flush()
        if names:
            try:
                store.move(own, final)
            except OSError:
                # another attempt of this task has finished: its archives hold the same records
                if store.get_file_info(final).type != arrow_fs.FileType.Directory:
                    raise
                store.delete_dir(own)
        yield pa.RecordBatch.from_arrays([pa.array([f"{final}/{x}" for x in names], pa.string()), pa.array(np.array(counts, np.int64))], names=["file", "records"])

    return both.mapInArrow(write, "file string, records long")


def read_archives(spark: SparkSession, root: str, payload: bool = True) -> DataFrame:
    """One row for each response and revisit record of the archives under root."""
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payload
    names = [x.split()[0] for x in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows: dict[str, list] = {x: [] for x in names}
                held = 0
                try:
                    for _, raw in frames(data.as_buffer()):
                        if page := page_of(raw):
                            for x in names:
                                rows[x].append(page[x])
                            held += len(raw)
                        if held >= ARCHIVE:
                            yield _batch(rows, payload)
                            rows, held = {x: [] for x in names}, 0
                except WarcError as e:
                    raise WarcError(f"{path}: {e}") from e
                yield _batch(rows, payload)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.warc.zst").load(root)
    return files.select("path", "content").mapInArrow(read, schema)


def _batch(rows: dict[str, list], payload: bool) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), *[pa.binary()] * payload]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back, without payloads."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    written = scratch.write(write_archives(pages, scratch.path("archives"), **how), "manifest")
    if written.isEmpty():
        return spark.createDataFrame([], "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, scratch.path("archives"), payload=False)
