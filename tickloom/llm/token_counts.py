"""Token counts of whole texts by overlap resynchronisation.

A text longer than ``chunk`` characters is encoded in chunks that overlap.  Two
neighbours are spliced at a position of their overlap where both start a token
and where the split pattern cuts whatever stands further off; text before it is
taken from the left chunk, text after it from the right one.  An overlap that
holds no such position is doubled, up to the whole rest of the text, so the
count always equals that of the text encoded at once, while memory is bounded
by the chunk and the widest overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokenizer

CHUNK = 1 << 16
OVERLAP = 256
LIMIT = 1024
_PUNCT = frozenset("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")


def _kind(c: str) -> str:
    return "d" if c.isascii() and c.isdigit() else "a" if c.isascii() and c.isalpha() else "p" if c in _PUNCT else ""


def stable(before: str, after: str, blanks_only: bool) -> bool:
    """Whether every text is cut between these two characters, whatever surrounds them.

    Each alternative of the split pattern takes a blank only as its first
    character or in an all-blank run, and never mixes letters, digits and
    punctuation; so a cut is certain before a blank that follows a non-blank,
    between an ASCII letter and digit, and before punctuation after either.  A
    special string is taken whole and holds no blank, hence ``blanks_only``.
    """
    if after in " \n":
        return not before.isspace()
    if blanks_only:
        return False
    return (_kind(before), _kind(after)) in (("a", "d"), ("d", "a"), ("a", "p"), ("d", "p"))


def _starts(tokens: tokenizer.Tokens, ids: list[int]) -> np.ndarray:
    ends = np.cumsum(tokens.lengths[np.asarray(ids, dtype=np.int64)])
    return np.concatenate([[0], ends[:-1]]) if len(ends) else ends


def _joint(left: np.ndarray, right: np.ndarray, shared: str, blanks_only: bool) -> int | None:
    """Byte offset in ``shared`` of the first stable cut at which both chunks start a token."""
    both, at = set(np.intersect1d(left, right, assume_unique=True).tolist()), 0
    for i, c in enumerate(shared):
        if i and at in both and stable(shared[i - 1], c, blanks_only):
            return at
        at += len(c.encode("utf-8", "surrogatepass"))
    return None


def count_tokens(tokens: tokenizer.Tokens, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Number of ids of ``text``; equal to ``len(tokens.ids(text))`` for any chunk and overlap."""
    if len(text) <= chunk + overlap or tokens.lengths is None or any(c.isspace() for s in tokens.specials for c in s):
        return len(tokens.ids(text))
    blanks_only = tokens.has_special(text)
    total, at, skip = 0, 0, 0  # skip: bytes of the present chunk that the left one has counted
    while True:
        wide, nxt = overlap, at + chunk
        while True:
            end = nxt + wide
            left = tokens.ids(text[at:end])
            if end >= len(text):
                return total + int((_starts(tokens, left) >= skip).sum())
            base = len(text[at:nxt].encode())
            starts = _starts(tokens, left)
            right = _starts(tokens, tokens.ids(text[nxt:end]))
            cut = _joint(starts - base, right, text[nxt:end], blanks_only)
            if cut is not None:
                break
            wide *= 2
        total += int(((starts >= skip) & (starts < base + cut)).sum())
        at, skip = nxt, cut


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Per row of ``docs(doc_id, text)``: ``doc_id, n_bytes, n_tokens, over_limit``.

    A null text counts as empty (0 bytes, 0 tokens); repeated rows each give a
    row; a null doc_id stays null; other columns, whatever their names, are not
    read; an empty table gives an empty result.  One pass, no shuffle.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokenizer.load(path)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [count_tokens(tokens, t, chunk, overlap) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(
        count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )
