"""Language identification by rank-order profiles of character n-grams.

A profile lists a language's most frequent n-grams (1 to 3 letters, words
framed by blanks) by rank.  A document's own list is compared to each profile by
the out-of-place distance: the sum of the rank differences, with the profile's
length for n-grams that it lacks.  The nearest profile wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranks in a profile, and in the list of a document.
RANKS = 400
#: Labelled documents learned from, for each language at most (those with the smallest hashed id).
SAMPLE = 800
#: Languages whose ranks are held in one table; any number is learned.
TOGETHER = 100
UNKNOWN = "und"
_BLANK = 32


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def grams(text: str) -> np.ndarray:
    """All n-grams of ``text`` as exact 63-bit codes (21 bits a letter); empty when it has no letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    codes = np.where(_letters()[codes], codes, _BLANK)
    codes = np.concatenate([[_BLANK], codes, [_BLANK]])
    codes = codes[np.concatenate([[True], (codes[1:] != _BLANK) | (codes[:-1] != _BLANK)])]
    if len(codes) < 3:
        return np.empty(0, dtype=np.int64)
    two = codes[:-1] << 21 | codes[1:]
    three = (two[:-1] << 21 | codes[2:])[codes[1:-1] != _BLANK]
    return np.concatenate([codes[codes != _BLANK], two, three])


def counts(text: str, step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes of the whole text and their counts; long texts go by slices cut at blanks, which no n-gram spans."""
    if len(text) <= step:
        return np.unique(grams(text), return_counts=True)
    code, n, at = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
    while at < len(text):
        end = text.find(" ", at + step)
        end = len(text) if end < 0 else end
        more, k = np.unique(grams(text[at:end]), return_counts=True)
        code, back = np.unique(np.concatenate([code, more]), return_inverse=True)
        n, at = np.bincount(back, np.concatenate([n, k]), len(code)).astype(np.int64), end
    return code, n


def ranked(code: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The most frequent codes, by falling count, then by code."""
    if len(code) > most:
        least = np.partition(n, len(n) - most)[len(n) - most]
        code, n = code[n >= least], n[n >= least]
    return code[np.argsort(-n, kind="stable")][:most]


class Profiles:
    """Profiles of any number of languages, in tables of ``TOGETHER`` languages each."""

    def __init__(self, rows: list[tuple[str, int, int]], ranks: int):
        """rows: (language, code, rank from 0)."""
        self.ranks, self.langs, self.tables = ranks, sorted({r[0] for r in rows}), []
        for k in range(0, len(self.langs), TOGETHER):
            col = {v: i for i, v in enumerate(self.langs[k : k + TOGETHER])}
            own = [r for r in rows if r[0] in col] if len(self.langs) > TOGETHER else rows
            codes = np.array(sorted({r[1] for r in own}), dtype=np.int64)
            place, at = np.full((len(codes) + 1, len(col)), -1, dtype=np.int32), {c: i for i, c in enumerate(codes.tolist())}
            for lang, code, rank in own:
                place[at[code], col[lang]] = rank
            self.tables.append((codes, place))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a ranked list of codes to each language."""
        out = []
        for codes, table in self.tables:
            i = np.searchsorted(codes, own)
            i[i == len(codes)] = 0
            i[codes[i] != own] = len(codes)
            place = table[i]
            out.append(np.where(place < 0, self.ranks, np.abs(place - np.arange(len(own))[:, None])).sum(axis=0))
        return np.concatenate(out)

    def nearest(self, text: str | None) -> tuple[str, float]:
        own = ranked(*counts(text), self.ranks) if text else ()
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        away = self.distances(own)
        best = int(away.argmin())  # of equal distances the first language by name
        return self.langs[best], float(1 - away[best] / (self.ranks * len(own)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, ranks: int = RANKS, sample: int = SAMPLE) -> Profiles:
    """Profiles from the labelled rows of ``docs(doc_id, text, lang)`` that are not held out.

    At most ``sample`` rows of each language, and every language.  Rows with a
    null doc_id, text or lang teach nothing; without any row there is no profile.
    """
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", "cast(lang as string) lang")
    rows = rows.where("doc_id is not null and lang is not null").where(~held_out(F.col("doc_id")))
    counts = rows.groupBy("lang").count().collect()
    if not counts:
        return Profiles([], ranks)
    # a hash threshold leaves some four times the sample before rows are ranked within a language
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 4 * sample / r["count"]))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    few = rows.where(draw < F.element_at(share, F.col("lang")) * (1 << 30)).where("text is not null")
    order = Window.partitionBy("lang").orderBy(draw, "doc_id", "text")
    few = few.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= sample)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                code, n = np.unique(np.concatenate([grams(t) for t in texts]), return_counts=True)
                yield pd.DataFrame({"lang": lang, "code": code, "n": n})

    total = few.select("lang", "text").mapInPandas(tally, "lang string, code bigint, n bigint").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    top = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))).where(F.col("r") <= ranks)
    return Profiles([(r["lang"], r["code"], r["r"] - 1) for r in top.select("lang", "code", "r").collect()], ranks)


def identify(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs(doc_id, text)``; only the text decides.

    ``und`` with score 0 for a null text, one without a letter, or no profiles.
    Score: 1 less the distance as a share of the greatest possible.  Ties go to
    the first language by name; whole texts count; repeated rows give a row
    each; other columns are not read; an empty table gives an empty result.
    """

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.nearest(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"]
            )

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(predict, "doc_id bigint, lang_pred string, score double")


def keep_known(docs: DataFrame, profiles: Profiles, min_score: float) -> DataFrame:
    """Rows of ``docs`` whose text is in a known language with at least ``min_score``; all columns stay, one pass, no shuffle.

    Texts that are null or have no letter go; with no profiles nothing is known
    and all rows go.  Repeated rows are judged alike.
    """
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [profiles.nearest(t) for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([lang != UNKNOWN and score >= min_score for lang, score in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
