"""Packing documents into training windows with a bounded number of open windows.

Each partition packs its own documents online: whole windows are cut off long
documents, the rest goes into the open window that it fills best; when none has
room and no more may be opened, the fullest is topped up with a cut (or, when
its gap is within ``max_pad``, left padded) and emitted.  What is still open at
the end of a partition, at most ``open_windows`` windows, is merged with that of
``merge`` neighbouring partitions, and the last rest is cut into lengths that
are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokenizer
from .common import materialize

WINDOW = 2048
OPEN = 16
MAX_PAD = 8
MERGE = 64
END_ID = 1
_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = [x.split()[0] for x in _PIECE.split(", ")]


class Packer:
    """Best-fit into at most ``most`` open windows; ``add`` and ``close`` yield finished windows as lists of pieces.

    A piece is ``(doc, start, ids, doc_tokens)``; ids stand as little-endian
    unsigned 32-bit numbers.
    """

    def __init__(self, window: int = WINDOW, most: int = OPEN, max_pad: int = MAX_PAD):
        self.window, self.most, self.max_pad = window, most, max_pad
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)

    def add(self, doc, start: int, ids: np.ndarray, doc_tokens: int) -> Iterator[list]:
        w = self.window
        while len(ids) >= w:
            yield [(doc, start, ids[:w], doc_tokens)]
            start, ids = start + w, ids[w:]
        while n := len(ids):
            fits = [(w - fill, i) for i, (fill, _) in enumerate(self.open) if w - fill >= n]
            if fits:
                gap, i = min(fits)
                self._put(i, (doc, start, ids, doc_tokens))
                if gap == n:
                    yield self.open.pop(i)[1]
                return
            if len(self.open) < self.most:
                self.open.append((n, [(doc, start, ids, doc_tokens)]))
                return
            gap, i = min((w - fill, i) for i, (fill, _) in enumerate(self.open))
            if gap > self.max_pad:
                self._put(i, (doc, start, ids[:gap], doc_tokens))
                start, ids = start + gap, ids[gap:]
            yield self.open.pop(i)[1]

    def _put(self, i: int, piece: tuple) -> None:
        fill, pieces = self.open[i]
        self.open[i] = (fill + len(piece[2]), [*pieces, piece])

    def close(self) -> Iterator[list]:
        """Concatenate what is open; the last rest is cut into powers of two."""
        held, fill = [], 0
        for _, pieces in sorted(self.open, key=lambda x: -x[0]):
            for doc, start, ids, doc_tokens in pieces:
                while fill + len(ids) >= self.window:
                    cut = self.window - fill
                    yield [*held, (doc, start, ids[:cut], doc_tokens)]
                    held, fill, start, ids = [], 0, start + cut, ids[cut:]
                if len(ids):
                    held.append((doc, start, ids, doc_tokens))
                    fill += len(ids)
        self.open = []
        while fill:
            want, part = 1 << (fill.bit_length() - 1), []
            fill -= want
            while want:
                doc, start, ids, doc_tokens = held.pop(0)
                part.append((doc, start, ids[:want], doc_tokens))
                if len(ids) > want:
                    held.insert(0, (doc, start + want, ids[want:], doc_tokens))
                want -= len(part[-1][2])
            yield part


def _rows(pieces: list, sequence: int) -> Iterator[tuple]:
    at = 0
    for doc, start, ids, doc_tokens in pieces:
        yield doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids)), doc_tokens, sequence, at
        at += len(ids)


def pack(docs: DataFrame, path: str, window: int = WINDOW, open_windows: int = OPEN, max_pad: int = MAX_PAD, merge: int = MERGE, end_id: int = END_ID) -> DataFrame:
    """Pieces of every row of ``docs(doc_id, text)``: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A null or empty text is the end id alone; repeated rows are packed once
    each; a null doc_id stays null; other columns are not read; an empty table
    gives no pieces.  One pass over the texts; the pieces are written to the
    shared folder before the leftovers are merged, so a retried task cannot
    change a window that another has merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, packer, part, made = tokenizer.load(path), Packer(window, open_windows, max_pad), TaskContext.get().partitionId(), 0

        def out(rows: list, left: list) -> pa.RecordBatch:
            columns = [pa.array(list(c), pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 7
            return pa.RecordBatch.from_arrays([*columns, pa.array(left, pa.binary()), pa.array([part // merge] * len(rows), pa.int64())], names=[*_NAMES, "ids", "grp"])

        for b in batches:
            rows: list = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = tokens.ids(text) if text else []
                ids.append(end_id)
                for pieces in packer.add(doc, 0, np.array(ids, dtype="<u4"), len(ids)):
                    rows += _rows(pieces, (part << 40) + made)
                    made += 1
            yield out(rows, [None] * len(rows))
        rows, left = [], []
        for _, pieces in packer.open:
            rows += _rows(pieces, (part << 40) + made)
            left += [np.ascontiguousarray(p[2]).tobytes() for p in pieces]
            made += 1
        yield out(rows, left)

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        packer, rows, made = Packer(window, open_windows, max_pad), [], (1 << 62) + (int(key[0]) << 40)
        pdf = pdf.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True])
        for doc, start, doc_tokens, ids in zip(pdf["doc_id"], pdf["start"], pdf["doc_tokens"], pdf["ids"], strict=True):
            for pieces in packer.add(None if pd.isna(doc) else int(doc), int(start), np.frombuffer(ids, dtype="<u4"), int(doc_tokens)):
                rows += _rows(pieces, made)
                made += 1
        for pieces in packer.close():
            rows += _rows(pieces, made)
            made += 1
        return pd.DataFrame(rows, columns=_NAMES).astype({"doc_id": "Int64"})

    base = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    first = materialize(base.mapInArrow(run, f"{_PIECE}, ids binary, grp bigint"), "pack")
    rest = first.where(F.col("ids").isNotNull())
    return first.where(F.col("ids").isNull()).select(*_NAMES).unionByName(rest.groupBy("grp").applyInPandas(join, _PIECE))
