"""WARC archives in Zstandard: a shared dictionary first, then one frame per record.

Archives are written by Spark's own text writer, so they land on whatever file
system the shared folder is on, and a task that is lost is simply run again.
The line separator it needs is an empty skippable frame, which readers pass
over.  Reading is by whole files, each no larger than one write task made it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, shared_dir

# Fixed values of the formats.
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
SEPARATOR = struct.pack("<II", 0x184D2A50, 0)
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

DICTIONARY_BYTES = 16 << 10
DICTIONARY_SAMPLES = 64
LEVEL = 3
MIN_BYTES = 0
DATE = "2020-01-01T00:00:00Z"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


class WarcError(ValueError):
    """An archive that breaks the format, with what is wrong and where."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, str(page_id))}>"


def _target(url: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url or "urn:none")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC record: a response with the payload, or a revisit of ``refers_to`` without it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if refers_to is None else http
    head = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id), "WARC-Date": DATE, "WARC-Target-URI": _target(url)}
    if page_id is not None:
        head["X-Page-ID"] = str(page_id)
    if refers_to is not None:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to), "X-Refers-To-Page-ID": str(refers_to)}
    head |= {
        "WARC-Payload-Digest": f"sha1:{digest(payload)}", "WARC-Block-Digest": f"sha1:{digest(block)}", "X-Payload-Length": str(len(payload)),
        "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block)),
    }
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, block and payload of exactly one record; every length and digest is held against the bytes."""
    if not data.startswith(VERSION + b"\r\n"):
        raise WarcError("a record doesn't begin with its version")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("a record's header doesn't end")
    head: dict[str, str] = {}
    for line in data[len(VERSION) + 2 : end].decode("utf-8").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"not a header line: {line[:80]!r}")
        head[name] = value.strip()
    if missing := [k for k in REQUIRED if k not in head]:
        raise WarcError(f"headers missing: {', '.join(missing)}")
    if not head["Content-Length"].isdigit():
        raise WarcError("Content-Length isn't a number")
    size = int(head["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size :] != b"\r\n\r\n":
        raise WarcError(f"Content-Length {size} isn't the block's length")
    if (said := head.get("WARC-Block-Digest", "").partition("sha1:")[2]) and said != digest(block):
        raise WarcError("the block's digest differs")
    payload = None
    if head["WARC-Type"] == "response":
        split = block.find(b"\r\n\r\n")
        if split < 0:
            raise WarcError("a response without the end of its HTTP header")
        payload = block[split + 4 :]
        length = re.search(rb"(?im)^content-length:[ \t]*(\d+)", block[:split])
        if length and int(length[1]) != len(payload):
            raise WarcError("the HTTP Content-Length isn't the payload's length")
        if (said := head.get("WARC-Payload-Digest", "").partition("sha1:")[2]) and said != digest(payload):
            raise WarcError("the payload's digest differs")
    elif head["WARC-Type"] == "revisit" and "WARC-Refers-To" not in head:
        raise WarcError("a revisit that refers to nothing")
    return {"head": head, "block": block, "payload": payload}


def dictionary_frame(samples: list[bytes]) -> tuple[bytes, zstandard.ZstdCompressionDict | None]:
    """Skippable frame with a dictionary trained on ``samples``; with too little to learn from, the samples' own bytes serve."""
    try:
        made = zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL)
    except zstandard.ZstdError:
        raw = b"".join(samples)[-DICTIONARY_BYTES:]
        made = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(raw) >= 8 else None
    if made is None:
        return struct.pack("<II", DICTIONARY_FRAME, 0), None
    packed = zstandard.ZstdCompressor(level=9).compress(made.as_bytes())
    return struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed, made


def frame_size(data: memoryview) -> int:
    """Bytes of the Zstandard frame that ``data`` begins with, by its block headers."""
    try:
        info, at = zstandard.get_frame_parameters(data[:18]), zstandard.frame_header_size(data[:18])
    except zstandard.ZstdError as e:
        raise WarcError(f"a broken frame header: {e}") from None
    while True:
        if at + 3 > len(data):
            raise WarcError("the archive ends within a frame")
        head = int.from_bytes(data[at : at + 3], "little")
        kind, size = head >> 1 & 3, head >> 3
        if kind == 3:
            raise WarcError("a reserved block type")
        at += 3 + (1 if kind == 1 else size)
        if head & 1:
            break
    at += 4 * info.has_checksum
    if at > len(data):
        raise WarcError("the archive ends within a frame")
    return at


def read_archive(data: bytes) -> Iterator[dict]:
    """Records of one archive, a frame each; the dictionary is taken from the leading skippable frame."""
    view, at, reader = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        if at + 4 > len(view):
            raise WarcError("the archive ends within a frame")
        magic = int.from_bytes(view[at : at + 4], "little")
        if magic in SKIPPABLE:
            if at + 8 > len(view) or (size := int.from_bytes(view[at + 4 : at + 8], "little")) + at + 8 > len(view):
                raise WarcError("the archive ends within a skippable frame")
            body = bytes(view[at + 8 : at + 8 + size])
            if magic == DICTIONARY_FRAME and at == 0 and body:
                if body.startswith(FRAME):
                    body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
            continue
        if view[at : at + 4] != FRAME:
            raise WarcError(f"no frame at byte {at}")
        size = frame_size(view[at:])
        try:
            plain = reader.decompressobj().decompress(view[at : at + size])
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from None
        yield parse_record(plain)
        at += size


def decide(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """``page_id, url, payload, refers_to``: of equal payloads of ``min_bytes`` or more, all but that of the largest page_id refer to it."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")))
    groups = rows.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1")
    out = lookup(rows, groups, ["digest"], pages.count(), "page_id")
    away = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    return out.select("page_id", "url", "payload", F.when(away, F.col("original")).alias("refers_to"))


def write(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES) -> None:
    """Archives of ``pages(page_id, url, html)`` as files of the folder ``path``.

    A null html is an empty payload, a null url the target ``urn:none``.
    Repeated rows of the largest page_id of a group are all responses; rows
    with a null page_id are never referred to, and of such rows alone all are
    responses.  Other columns are not read; an empty table gives no records.
    """

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = None
        for b in batches:
            found = [record(*row) for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            frames = []
            if packer is None and found:
                frame, made = dictionary_frame(found[:DICTIONARY_SAMPLES])
                packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_checksum=True, write_content_size=True)
                frames.append(frame)
            frames += [packer.compress(r) for r in found] if packer else []
            yield pa.RecordBatch.from_arrays([pa.array(frames, pa.binary())], names=["frame"])

    frames = decide(pages, min_bytes).mapInArrow(archive, "frame binary")
    frames.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR.decode("ascii")).text(path)


def read(spark, path: str) -> DataFrame:
    """All records of the archives in ``path``; the first that breaks the format fails the read.

    ``page_id, record_type, target_uri, payload_bytes, payload_digest,
    refers_to, payload``: of a revisit the length and digest are those of the
    payload it refers to, and payload is null.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "record_type", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, held = [], 0
                try:
                    for r in read_archive(data.as_py()):
                        h, body = r["head"], r["payload"]
                        number = lambda k, h=h: int(h[k]) if k in h else None
                        size = len(body) if body is not None else number("X-Payload-Length")
                        rows.append((number("X-Page-ID"), h["WARC-Type"], h.get("WARC-Target-URI"), size, h.get("WARC-Payload-Digest", "").removeprefix("sha1:"), number("X-Refers-To-Page-ID"), body))
                        held += len(body or b"")
                        if held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, held = [], 0
                except WarcError as e:
                    raise WarcError(f"{name}: {e}") from None
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, "page_id bigint, record_type string, target_uri string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write archives of ``pages`` to the shared folder, read them back: one row per page without its payload."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, min_bytes)
    return read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
