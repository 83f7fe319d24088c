"""Runs of regime labels, their statistics, and smoothing of short runs."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import with_runs

PASSES = 10
JS_BINS, JS_TINY = 10, 1e-10


def regime_runs(labels: DataFrame, regime: str = "regime", pos: str = "pos", series: str = "series") -> DataFrame:
    """``series, run_id, regime, start, end, length``."""
    return with_runs(labels, regime, [series], [pos]).groupBy(series, "run_id").agg(
        F.first(regime).alias("regime"), F.min(pos).alias("start"), F.max(pos).alias("end"), F.count("*").alias("length")
    )


def run_length_stats(runs: DataFrame) -> DataFrame:
    n = F.col("length")
    return runs.groupBy("regime").agg(F.count("*").alias("n"), F.avg(n).alias("mean"), F.min(n).alias("shortest"), F.max(n).alias("longest"), F.percentile(n, 0.5).alias("median"))


def transition_matrix(labels: DataFrame, regime: str = "regime", pos: str = "pos", series: str = "series") -> DataFrame:
    """``src, dst, p``: share of the steps from each regime that lead to each."""
    o = Window.partitionBy(series).orderBy(pos)
    steps = labels.select(F.col(regime).alias("src"), F.lead(regime).over(o).alias("dst")).where("dst is not null")
    n = steps.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return n.select("src", "dst", (F.col("n") / F.sum("n").over(Window.partitionBy("src"))).alias("p"))


def transition_forecast(matrix: DataFrame, steps: int) -> DataFrame:
    """``step, src, dst, p``: distribution after 1 to ``steps`` steps, by repeated joins of the small matrix."""
    now, out = matrix.select("src", "dst", "p"), matrix.select(F.lit(1).alias("step"), "src", "dst", "p")
    for k in range(2, steps + 1):
        step = matrix.select(F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("p").alias("q"))
        now = now.join(step, "dst").groupBy("src", F.col("to").alias("dst")).agg(F.sum(F.col("p") * F.col("q")).alias("p"))
        out = out.unionByName(now.select(F.lit(k).alias("step"), "src", "dst", "p"))
    return out


def transition_points(labels: DataFrame, regime: str = "regime", pos: str = "pos", series: str = "series") -> DataFrame:
    """Rows whose regime differs from the one before: ``series, pos, src, dst``."""
    o = Window.partitionBy(series).orderBy(pos)
    return labels.select(series, pos, F.lag(regime).over(o).alias("src"), F.col(regime).alias("dst")).where("src <> dst")


def regime_stats(labels: DataFrame, value: str, regime: str = "regime") -> DataFrame:
    x = F.col(value)
    return labels.groupBy(regime).agg(F.count("*").alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("lo"), F.max(x).alias("hi"))


def _neighbours(runs: DataFrame, series: str) -> DataFrame:
    o = Window.partitionBy(series).orderBy("run_id")
    for side, f in (("left", F.lag), ("right", F.lead)):
        for c in ("regime", "weight"):
            runs = runs.withColumn(f"{side}_{c}", f(c).over(o))
    return runs


def _apply(runs: DataFrame, short, left_wins, series: str) -> DataFrame:
    runs = _neighbours(runs, series)
    take = F.when(F.col("left_regime").isNull(), F.col("right_regime")).when(F.col("right_regime").isNull(), F.col("left_regime"))
    take = take.otherwise(F.when(left_wins, F.col("left_regime")).otherwise(F.col("right_regime")))
    return runs.withColumn("smoothed", F.when(short, F.coalesce(take, F.col("regime"))).otherwise(F.col("regime")))


def smooth_persistence_pass(runs: DataFrame, least: int, series: str = "series") -> DataFrame:
    """Runs under ``least`` take the regime of the longer neighbour, the left one on a tie; all read the labels before the pass."""
    runs = runs.withColumn("weight", F.col("length").cast("double"))
    return _apply(runs, F.col("length") < least, F.col("left_weight") >= F.col("right_weight"), series)


def smooth_confidence_pass(runs: DataFrame, confidence: DataFrame, least: int, share: float = 0.5, series: str = "series") -> DataFrame:
    """The same with lengths raised by the run's mean confidence: ``confidence(series, run_id, confidence)``."""
    runs = runs.join(confidence, [series, "run_id"], "left")
    runs = runs.withColumn("weight", F.col("length") * (1 + share * F.coalesce("confidence", F.lit(1.0))))
    return _apply(runs, F.col("length") < least, F.col("left_weight") >= F.col("right_weight"), series)


def smooth_transition_pass(runs: DataFrame, matrix: DataFrame, least: int, series: str = "series") -> DataFrame:
    """The likelier of the steps in and out of a short run decides."""
    runs = _neighbours(runs.withColumn("weight", F.lit(0.0)), series)
    step = lambda a, b, p: matrix.select(F.col("src").alias(a), F.col("dst").alias(b), F.col("p").alias(p))
    runs = runs.join(F.broadcast(step("left_regime", "regime", "p_in")), ["left_regime", "regime"], "left")
    runs = runs.join(F.broadcast(step("regime", "right_regime", "p_out")), ["regime", "right_regime"], "left")
    left = F.coalesce("p_in", F.lit(0.0)) >= F.coalesce("p_out", F.lit(0.0))
    take = F.when(F.col("left_regime").isNull(), F.col("right_regime")).when(F.col("right_regime").isNull(), F.col("left_regime"))
    take = take.otherwise(F.when(left, F.col("left_regime")).otherwise(F.col("right_regime")))
    return runs.withColumn("smoothed", F.when(F.col("length") < least, F.coalesce(take, F.col("regime"))).otherwise(F.col("regime")))


def smooth(labels: DataFrame, least: int, passes: int = PASSES, series: str = "series", pos: str = "pos") -> DataFrame:
    """Persistence passes until no run is short, ``passes`` at most: ``series, pos, regime, smoothed``.

    A pass works on the runs, which are fewer than the rows; runs that a pass
    made alike are one run for the next.
    """
    runs = regime_runs(labels, pos=pos, series=series).select(series, "start", "end", "length", "regime", F.col("run_id"))
    for _ in range(passes):
        done = smooth_persistence_pass(runs, least, series).select(series, "start", "end", "length", F.col("smoothed").alias("regime"))
        merged = with_runs(done, "regime", [series], ["start"])
        runs = merged.groupBy(series, "run_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("length").alias("length"), F.first("regime").alias("regime")).checkpoint()
        if not runs.where((F.col("length") < least)).limit(1).take(1):
            break
    spans = runs.select(series, F.explode(F.sequence("start", "end")).alias(pos), F.col("regime").alias("smoothed"))
    return labels.join(spans, [series, pos])


def js_distance(left: DataFrame, right: DataFrame, value: str, key: list[str], bins: int = JS_BINS) -> DataFrame:
    """Jensen-Shannon distance per key of two samples over shared equal-width bins: ``*key, js``."""
    both = left.select(*key, value, F.lit(0).alias("side")).unionByName(right.select(*key, value, F.lit(1).alias("side"))).where(F.col(value).isNotNull())
    w = Window.partitionBy(*key)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    both = both.withColumn("lo", lo).withColumn("hi", hi)
    bin_ = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0)
    counts = both.groupBy(*key, "side", bin_.alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))
    # densities, as the sizes of the samples and the bin width set the weight of the small constant
    total = F.sum("n").over(Window.partitionBy(*key, "side"))
    width = F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0 / bins)
    density = counts.withColumn("d", F.col("n") / total / width)
    grid = density.select(*key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    wide = density.groupBy(*key, "bin").agg(F.sum(F.when(F.col("side") == 0, F.col("d"))).alias("a"), F.sum(F.when(F.col("side") == 1, F.col("d"))).alias("b"))
    wide = grid.join(wide, [*key, "bin"], "left").select(*key, *[(F.coalesce(c, F.lit(0.0)) + JS_TINY).alias(c) for c in "ab"])
    p = [F.col(c) / F.sum(c).over(w) for c in "ab"]
    wide = wide.select(*key, p[0].alias("p"), p[1].alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = F.sum(F.col("p") * F.ln(F.col("p") / F.col("m")) + F.col("q") * F.ln(F.col("q") / F.col("m"))) / 2
    return wide.groupBy(*key).agg(F.sqrt(F.greatest(part, F.lit(0.0))).alias("js"))


def _js(a: np.ndarray, b: np.ndarray) -> float:
    lo, hi = min(a.min(), b.min()), max(a.max(), b.max())
    p, q = (np.histogram(x, JS_BINS, (lo, hi), density=True)[0] + JS_TINY for x in (a, b))
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    return float(np.sqrt(max(0.0, (p * np.log(p / m) + q * np.log(q / m)).sum() / 2)))


def rsip_smooth(labels: DataFrame, features: list[str], least: int, alpha: float = 0.4, beta: float = 0.3, gamma: float = 0.3, series: str = "series", pos: str = "pos") -> DataFrame:
    """Order-dependent smoothing, a series at a time: short runs by length join the neighbour of lower cost, then of more length.

    The cost is the difference of mean confidence, a fixed penalty and the mean
    Jensen-Shannon distance of the features.  Columns: ``series, pos, regime,
    smoothed``.  Each decision reads earlier ones, so a series is one task.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(pos)
        regime, sure = pdf["regime"].to_numpy(), pdf["confidence"].fillna(1.0).to_numpy()
        values = [pdf[c].to_numpy(float) for c in features]
        edge = np.flatnonzero(np.append(True, regime[1:] != regime[:-1]))
        runs = list(zip(edge, np.append(edge[1:], len(regime)), strict=True))
        out = regime.copy()
        for k in sorted((i for i, (a, b) in enumerate(runs) if b - a < least), key=lambda i: (runs[i][1] - runs[i][0], i)):
            a, b = runs[k]
            if out[a] != regime[a] or len(runs) == 1:
                continue
            costs = []
            for j in (k - 1, k + 1):
                if not 0 <= j < len(runs):
                    costs.append(np.inf)
                    continue
                c, d = runs[j]
                apart = [_js(v[a:b], v[c:d]) for v in values if len(np.unique(v[a:b])) > 1]
                costs.append(alpha * abs(sure[c:d].mean() - sure[a:b].mean()) + beta + gamma * (np.mean(apart) if apart else 0.0))
            out[a:b] = out[runs[k - 1 if costs[0] < costs[1] else k + 1][0]]
        for _ in range(PASSES - 1):
            edge = np.flatnonzero(np.append(True, out[1:] != out[:-1]))
            runs = list(zip(edge, np.append(edge[1:], len(out)), strict=True))
            short = [i for i, (a, b) in enumerate(runs) if b - a < least]
            if not short or len(runs) == 1:
                break
            old = out.copy()
            for i in short:
                size = [runs[j][1] - runs[j][0] if 0 <= j < len(runs) else -1 for j in (i - 1, i + 1)]
                out[runs[i][0] : runs[i][1]] = old[runs[i - 1 if size[0] > size[1] else i + 1][0]]
        return pd.DataFrame({series: pdf[series], pos: pdf[pos], "regime": regime, "smoothed": out})

    types = dict(labels.dtypes)
    schema = f"{series} {types[series]}, {pos} {types[pos]}, regime {types['regime']}, smoothed {types['regime']}"
    return labels.select(series, pos, "regime", "confidence", *features).groupBy(series).applyInPandas(run, schema)


def _expected_runs(counts: DataFrame, lengths: list[int]) -> list[float]:
    """Expected number of runs of at least each of ``lengths`` rows, over all series, when the labels of a series are shuffled.

    Of n labels with k of a kind, (n - k + 1) k (k-1)...(k-m+1) / (n (n-1)...(n-m+1)) runs of that kind have m rows or more.
    """

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(lengths))
        for b in batches:
            for n, k, times in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                log, done = np.log(n - k + 1), 0
                for i, m in enumerate(lengths):
                    if m > k:
                        break
                    if m - done <= 4096:
                        step = np.arange(done, m)
                        log += (np.log(k - step) - np.log(n - step)).sum()
                    else:
                        log += lgamma(k - done + 1) - lgamma(k - m + 1) - lgamma(n - done + 1) + lgamma(n - m + 1)
                    done = m
                    total[i] += times * np.exp(log)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(lengths)), pa.int32()), pa.array(total)], names=["i", "runs"])

    found = counts.mapInArrow(tally, "i int, runs double").groupBy("i").agg(F.sum("runs").alias("runs")).collect()
    at = {r["i"]: r["runs"] for r in found}
    return [at.get(i, 0.0) for i in range(len(lengths))]


def min_run_length(labels: DataFrame, regime: str = "regime", series: str = "series", significance: float = 0.05) -> int:
    """Length that a run of labels has to have to stand out from shuffled ones: 95th percentile of the run lengths of random
    permutations, and one; 3 at least.

    The run lengths of all permutations are known in closed form from the counts of the labels, so none is drawn: the
    result is what ever more draws come to.  Only counts of labels are aggregated, whatever the length of a series.
    """
    k = labels.groupBy(series, regime).agg(F.count("*").alias("k"))
    n = labels.groupBy(series).agg(F.count("*").alias("n"))
    counts = k.join(n, series).groupBy("n", "k").agg(F.count("*").alias("times")).select("n", "k", "times")
    most = counts.agg(F.max("k")).first()[0]
    if most is None:
        return 3
    # the least m with fewer than a share of the runs longer than m, by ever finer grids
    lo, hi = 0, most
    total = _expected_runs(counts, [1])[0]
    while hi - lo > 1:
        grid = sorted({*(lo + 1 + (hi - lo - 1) * i // 64 for i in range(64)), *range(lo + 1, min(lo + 65, hi))} - {hi})
        longer = _expected_runs(counts, [m + 1 for m in grid])
        under = [m for m, x in zip(grid, longer, strict=True) if x < significance * total]
        over = [m for m, x in zip(grid, longer, strict=True) if x >= significance * total]
        lo, hi = max(over, default=lo), min(under, default=hi)
    return max(hi + 1, 3)
