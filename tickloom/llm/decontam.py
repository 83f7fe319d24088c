"""Benchmark decontamination by greedy string tiling.

Texts are word sequences.  Word n-grams of the benchmark (seeds) are looked up
in every document; a document and an item that share a seed are tiled: the
longest match of unmarked words on both sides is marked, again and again, until
none of ``min_match`` words is left, so an item's passages are found in any
order.  The share of an item's words that tiles cover decides.

The benchmark is a query set against all documents.  It is broadcast in blocks
of bounded size, one pass over the documents for each.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_MATCH = 5
MIN_COVERAGE = 0.5
#: UTF-8 bytes of benchmark text in a broadcast block, about.
BLOCK_BYTES = 16 << 20
_WORD = re.compile(r"\w+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


class Rolling:
    """Karp-Rabin hashes modulo 2**64 of the windows of a sequence, of any length from one running sum.

    The sum takes each word times a power of the base; the difference of two of
    its values, brought back by the inverse power, is the hash of the words
    between, wherever they stand.  Ids are mixed first, so they need not be spread.
    """

    def __init__(self, ids: np.ndarray):
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        power = lambda base: np.cumprod(np.append(np.uint64(1), np.full(max(len(x) - 1, 0), base)), dtype=np.uint64)[: len(x)]
        self.total = np.append(np.uint64(0), np.cumsum(x * power(_BASE), dtype=np.uint64))
        self.back = power(_INVERSE)

    def windows(self, size: int) -> np.ndarray:
        n = len(self.back) - size + 1
        return (self.total[size:] - self.total[:n]) * self.back[:n]


def _open(marked: np.ndarray, size: int) -> np.ndarray:
    """Starts of windows without a marked word."""
    total = np.append(0, np.cumsum(marked))
    return np.flatnonzero(total[size:] == total[:-size])


def _matches(a: Rolling, b: Rolling, mark_a: np.ndarray, mark_b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Open windows of both sides whose hash the other side has too: starts and hashes."""
    at_a, at_b = _open(mark_a, size), _open(mark_b, size)
    h_a, h_b = a.windows(size)[at_a], b.windows(size)[at_b]
    in_a, in_b = np.isin(h_a, h_b), np.isin(h_b, h_a)
    return at_a[in_a], h_a[in_a], at_b[in_b], h_b[in_b]


def tile(a: np.ndarray, b: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiles ``(start in a, start in b, length)`` of two sequences, longest first, ties leftmost.

    Words marked -1 in ``b`` match nothing.  A common run of some length has
    runs of every smaller length in it, so the longest is found by bisection.
    """
    mark_a, mark_b, out = np.zeros(len(a), bool), b < 0, []
    roll_a, roll_b = Rolling(a), Rolling(b)
    high = min(len(a), len(b))
    while high >= least:
        low, size = least, 0
        while low <= high:
            mid = (low + high) // 2 if size else low
            if len(_matches(roll_a, roll_b, mark_a, mark_b, mid)[0]):
                size, low = mid, mid + 1
            else:
                high = mid - 1
        if not size:
            break
        at_a, h_a, at_b, h_b = _matches(roll_a, roll_b, mark_a, mark_b, size)
        places = defaultdict(list)
        for p, h in zip(at_b.tolist(), h_b.tolist(), strict=True):
            places[h].append(p)
        for p, h in zip(at_a.tolist(), h_a.tolist(), strict=True):
            if mark_a[p : p + size].any():
                continue
            for q in places[h]:
                if not mark_b[q : q + size].any() and (a[p : p + size] == b[q : q + size]).all():
                    mark_a[p : p + size] = mark_b[q : q + size] = True
                    out.append((p, q, size))
                    break
        high = size - 1  # no open match of this length is left
    return out


class Seeds:
    """Items of one block as word numbers, and the n-grams that lead to them."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        self.vocabulary: dict[str, int] = {}
        self.items = []
        for item, text in items:
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text)], dtype=np.int64)
            if len(ids):
                self.items.append((item, ids, min(least, len(ids))))
        self.tables = {}
        for size in sorted({s for _, _, s in self.items}):
            found = [(int(h), i) for i, (_, ids, s) in enumerate(self.items) if s == size for h in np.unique(Rolling(ids).windows(size))]
            found.sort()
            self.tables[size] = np.array([h for h, _ in found], dtype=np.uint64), np.array([i for _, i in found], dtype=np.int64)

    def tiles(self, text: str | None) -> Iterator[tuple[int, float, int, list[tuple[int, int, int]]]]:
        """``item, coverage, words covered, tiles`` for every item that shares a seed with the text."""
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words(text)], dtype=np.int64)
        rolling = Rolling(ids) if len(ids) else None
        for size, (hashes, owner) in self.tables.items():
            if len(ids) < size:
                continue
            whole = _open(ids < 0, size)
            if not len(whole):
                continue
            own = rolling.windows(size)[whole]
            lo, hi = np.searchsorted(hashes, own, "left"), np.searchsorted(hashes, own, "right")
            by_item = defaultdict(list)
            for p, x, y in zip(whole[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for i in owner[x:y].tolist():
                    by_item[i].append(p)
            for i, at in by_item.items():
                item, sequence, least = self.items[i]
                near = np.zeros(len(ids) + 1, bool)
                for k in range(size):
                    near[np.array(at) + k] = True
                # only words inside shared seeds can be in a tile: the rest is cut out, a gap stays
                keep = np.flatnonzero(near | np.append(False, near[:-1]))
                part = np.where(near[:-1], ids, -1)[keep[keep < len(ids)]]
                found = tile(sequence, part, least)
                covered = sum(n for _, _, n in found)
                yield item, covered / len(sequence), covered, [(p, int(keep[q]), n) for p, q, n in found]


def _blocks(docs: DataFrame, benchmark: DataFrame, block_bytes: int) -> list:
    """The benchmark as broadcasts of about ``block_bytes`` of text each; one where it is empty."""
    items = benchmark.selectExpr("cast(item_id as bigint) item_id", "cast(text as string) text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + size // block_bytes
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks))
    return [docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in items.where(own == k).collect()]) for k in range(n_blocks)]


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id, item_id, coverage, n_covered, tiles`` for each row of ``docs(doc_id, text)`` and benchmark item covered by ``min_coverage`` or more.

    tiles: ``item start:document start:length`` in words, longest first.  An item
    of fewer than ``min_match`` words must be found whole; null and wordless
    texts and items match nothing.  Repeated rows on either side each give
    their rows; null ids stay null; other columns are not read; an empty table
    gives an empty result.
    """
    base = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    schema, out = "doc_id bigint, item_id bigint, coverage double, n_covered bigint, tiles string", None
    for shared in _blocks(docs, benchmark, block_bytes):

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(shared.value, min_match)
            for b in batches:
                rows = []
                for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    for item, coverage, covered, tiles in seeds.tiles(text):
                        if coverage >= min_coverage:
                            rows.append((doc, item, coverage, covered, ",".join(f"{p}:{q}:{n}" for p, q, n in tiles)))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "coverage", "n_covered", "tiles"])

        found = base.mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, min_coverage: float = MIN_COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of ``docs`` that cover less than ``min_coverage`` of every benchmark item; all columns stay, no shuffle."""
    at, schema = docs.columns.index("text"), docs.schema
    for shared in _blocks(docs, benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds = Seeds(shared.value, min_match)
            for b in batches:
                yield b.filter(pa.array([all(x[1] < min_coverage for x in seeds.tiles(t)) for t in b.column(at).to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
