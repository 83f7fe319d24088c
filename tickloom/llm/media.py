"""Texts as lossless images: a media column that is written, read back and measured."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import webp

UNIT = 192
WIDTH = 64
#: Rows of one image; a longer payload goes on in a further file of the same column value.
ROWS = 4096
FILL = b" "


def payload_of(text: str | None) -> bytes:
    data = (text or "").encode("utf-8", "replace")
    return data + FILL * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def write_image(payload: bytes) -> bytes:
    """Files of 64 pixels a row, three bytes a pixel, one after the other."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 3)
    return b"".join(webp.encode(samples[i : i + ROWS]) for i in range(0, len(samples), ROWS))


def read_image(media: bytes) -> np.ndarray:
    """Samples ``(rows, 64, 3)`` of all files of a value."""
    parts = [p[..., None].view(np.uint8).reshape(*p.shape, 4)[..., 2::-1] for p in webp.decode_all(media)]
    return np.concatenate(parts)


def feature_of(samples: np.ndarray) -> str:
    """Rows, mean and deviation of each channel, mean step between neighbours in a row."""
    flat = samples.reshape(-1, 3).astype(np.float64)
    step = np.abs(np.diff(samples.astype(np.int16), axis=1)).mean()
    return f"{samples.shape[1]}x{samples.shape[0]};" + ",".join(f"{m:.4f}" for m in (*flat.mean(axis=0), *flat.std(axis=0), step))


def encode(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, media`` for every row of ``docs(doc_id, text)``.

    A null text is empty, and an empty one a row of blanks; repeated rows each
    give a row; a null doc_id stays null; other columns are not read; an empty
    table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                texts = [(t or "").encode("utf-8", "replace") for t in part.column(1).to_pylist()]
                media = [write_image(t + FILL * (max(1, -(-len(t) // UNIT)) * UNIT - len(t))) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary")


def measure(media: DataFrame) -> DataFrame:
    """Digests and features of every row of ``media(doc_id, n_bytes, media)``, from the decoded pixels alone."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(2).to_pylist():
                samples = read_image(data)
                payload = np.ascontiguousarray(samples).tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature_of(samples)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "n_bytes", *names])

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
