"""Quality selection by importance resampling.

Hashed words and word pairs give two bags: one of target texts (labelled good),
one of all texts.  A document's weight is the ratio of its probabilities under
the two models: the log ratios of its n-grams add up.  Gumbel noise drawn from the
id is added to the log weight and the largest keep their documents: a sample
without replacement in proportion to the weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .shingles import Words, mix

BUCKETS = 1 << 14
#: Labelled target documents learned from at most (those with the smallest hashed id).
SAMPLE = 4000
#: Share of the documents that is kept.
KEEP = 0.5
SMOOTHING = 1.0
SEED = 17
_BINS = 4096
_FEW = 4096


def features(text: str | None, words: Words, buckets: int) -> np.ndarray:
    """Buckets of the words and adjacent pairs of the whole text, A-Z lower-cased."""
    found = text.encode("utf-8", "replace").lower().split() if text else []
    if not found:
        return np.empty(0, dtype=np.int64)
    h = np.fromiter(map(words.__getitem__, found), dtype=np.uint64, count=len(found))
    pairs = mix(h[:-1] * np.uint64(3) + h[1:])
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def bag(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of each bucket over all rows: summed within a partition first, ``buckets`` rows reach the driver."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = Words(), np.zeros(buckets, dtype=np.int64)
        for b in batches:
            for text in b.column(1).to_pylist():
                total += np.bincount(features(text, seen, buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in _texts(docs).mapInArrow(tally, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def train(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log ratio of target to raw probability for each bucket.

    Target: documents labelled quality 1 and not toxic, ``sample`` of them at
    most; raw: all documents.  Without target rows all ratios are 0.
    """
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").selectExpr("cast(doc_id as bigint) doc_id").distinct()
    picked = [r["doc_id"] for r in good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]
    if not picked:
        return np.zeros(buckets)
    ids = docs.sparkSession.createDataFrame([(i,) for i in picked], "doc_id bigint")
    target = bag(_texts(docs).join(F.broadcast(ids), "doc_id", "left_semi"), buckets)
    raw = bag(docs, buckets)
    share = lambda n: np.log((n + smoothing) / (n.sum() + smoothing * buckets))
    return share(target) - share(raw)


def weigh(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``doc_id, log_weight``: sum of the log ratios of a document's n-grams, null where it has no word."""
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, own = Words(), shared.value
        for b in batches:
            at = [features(t, seen, len(own)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([float(own[x].sum()) if len(x) else None for x in at], pa.float64())], names=["doc_id", "log_weight"])

    return _texts(docs).mapInArrow(score, "doc_id bigint, log_weight double")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    u = (F.shiftrightunsigned(F.xxhash64(doc_id, F.lit(seed)), 12).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(-F.ln(u))


def threshold(scores: DataFrame, k: int) -> tuple[float, int] | None:
    """The k-th row of ``scores(key, doc_id)`` by falling key, then doc_id: found by ever finer counts, whatever k."""
    span = scores.agg(F.min("key").alias("lo"), F.max("key").alias("hi")).first()
    lo, hi = span["lo"], span["hi"]
    if lo is None or k < 1:
        return None
    left, part = k, scores
    while hi > lo:
        width = (hi - lo) / _BINS
        at = F.least(F.floor((F.col("key") - lo) / width), F.lit(_BINS - 1)) if width > 0 else F.lit(0)
        found = part.groupBy(at.alias("at")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(found, key=lambda r: -r["at"]):
            if r["n"] >= left:
                break
            left -= r["n"]
        else:
            return lo, 0
        lo, hi, n = r["lo"], r["hi"], r["n"]
        part = scores.where(F.col("key").between(lo, hi))
        if n <= _FEW:
            break
    if hi > lo:
        rows = part.orderBy(F.desc("key"), "doc_id").limit(left).collect()
        return rows[-1]["key"], rows[-1]["doc_id"]
    # all that are left share one key: ids decide, by the same refinement over ids
    ids = part.select(F.col("doc_id").alias("id"))
    low, high = ids.agg(F.min("id"), F.max("id")).first()
    while low < high:
        mid = (low + high) // 2
        if ids.where(F.col("id") <= mid).count() >= left:
            high = mid
        else:
            low = mid + 1
    return lo, low


def resample(docs: DataFrame, labels: DataFrame, keep: float = KEEP, seed: int = SEED) -> DataFrame:
    """``doc_id, log_weight, key, selected`` for every row of ``docs(doc_id, text)``.

    selected: whether the row is among the ``keep`` share with the largest key,
    ``log_weight`` plus Gumbel noise of its id; equal keys go by
    doc_id, and repeated rows, whose keys and ids are equal, stand or fall
    together.  A null text or one without words has null weight and key and is
    not selected, nor is a row with a null doc_id.  Other columns are not read;
    an empty table gives an empty result.
    """
    found = materialize(weigh(docs, train(docs, labels)), "weights")
    keyed = found.withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("log_weight") + gumbel(F.col("doc_id"), seed)))
    scores = keyed.where("key is not null").select("key", "doc_id")
    at = threshold(scores, int(round(keep * scores.count())))
    if at is None:
        return keyed.withColumn("selected", F.lit(False))
    chosen = (F.col("key") > at[0]) | ((F.col("key") == at[0]) & (F.col("doc_id") <= at[1]))
    return keyed.withColumn("selected", F.coalesce(chosen, F.lit(False)))
