"""Entropy, mutual information, transfer entropy and feature rankings over long ``(row_id, feature, x)`` tables.

Bins are counted in the engine; only matrices of features by features, whose
size the number of features sets, ever meet on one task or the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.series import histogram_bin

TINY = 1e-10


def unpivot(df: DataFrame, row_id: str, names: list[str]) -> DataFrame:
    return df.select(F.col(row_id).alias("row_id"), *names).unpivot("row_id", names, "feature", "x").where("x is not null")


def binned(long: DataFrame, bins: int) -> DataFrame:
    """``row_id, feature, bin`` with equal-width bins over each feature's range."""
    span = long.groupBy("feature").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return long.join(F.broadcast(span), "feature").select("row_id", "feature", histogram_bin(F.col("x"), F.col("lo"), F.col("hi"), bins).alias("bin"))


def histogram(long: DataFrame, bins: int) -> DataFrame:
    """``feature, bin, n`` of the bins that hold values."""
    return binned(long, bins).groupBy("feature", "bin").agg(F.count("*").alias("n"))


def entropy(long: DataFrame, bins: int = 10) -> DataFrame:
    """``feature, h``: entropy of the bins' shares, in nats."""
    p = F.col("n") / F.sum("n").over(Window.partitionBy("feature"))
    return histogram(long, bins).select("feature", p.alias("p")).groupBy("feature").agg((-F.sum(F.col("p") * F.ln("p"))).alias("h"))


def mutual_information(long: DataFrame, bins: int = 64) -> DataFrame:
    """``fi, fj, mi`` for each pair ``fi < fj`` of features, from joint bins of the rows that have both."""
    b = binned(long, bins)
    left, right = b.select("row_id", F.col("feature").alias("fi"), F.col("bin").alias("bi")), b.select("row_id", F.col("feature").alias("fj"), F.col("bin").alias("bj"))
    joint = left.join(right, "row_id").where("fi < fj").groupBy("fi", "fj", "bi", "bj").agg(F.count("*").alias("n"))
    total = lambda *k: F.sum("n").over(Window.partitionBy("fi", "fj", *k))
    joint = joint.select("fi", "fj", "n", total().alias("t"), total("bi").alias("ni"), total("bj").alias("nj"))
    return joint.groupBy("fi", "fj").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("ni") * F.col("nj")))).alias("mi"))


def both_ways(mi: DataFrame) -> DataFrame:
    return mi.unionByName(mi.select(F.col("fj").alias("fi"), F.col("fi").alias("fj"), "mi"))


def tail_factor(long: DataFrame) -> DataFrame:
    """``feature, k, factor``: excess kurtosis and ln(1 + |k|) where it is positive, else 1."""
    k = long.groupBy("feature").agg(F.kurtosis("x").alias("k"))
    return k.withColumn("factor", F.when(F.col("k") > 0, F.ln(1 + F.abs("k"))).otherwise(1.0))


def conditional_entropy(long: DataFrame, target: str, bins: int = 10) -> DataFrame:
    """``feature, h``: entropy of the target's bins given the feature's."""
    b = binned(long, bins)
    of = b.where(F.col("feature") == target).select("row_id", F.col("bin").alias("bt"))
    joint = b.where(F.col("feature") != target).join(of, "row_id").groupBy("feature", "bin", "bt").agg(F.count("*").alias("n"))
    joint = joint.withColumn("given", F.sum("n").over(Window.partitionBy("feature", "bin"))).withColumn("t", F.sum("n").over(Window.partitionBy("feature")))
    return joint.groupBy("feature").agg((-F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("given")))).alias("h"))


def transfer_entropy(long: DataFrame, bins: int = 8) -> DataFrame:
    """``src, dst, te`` for each ordered pair: what the source's bin tells of the target's next one beyond its present one.

    ``row_id`` must be consecutive: the next row is that with the next id.
    """
    b = binned(long, bins)
    nxt = b.select((F.col("row_id") - 1).alias("row_id"), "feature", F.col("bin").alias("y1"))
    y = b.select("row_id", "feature", F.col("bin").alias("y0")).join(nxt, ["row_id", "feature"]).withColumnRenamed("feature", "dst")
    x = b.select("row_id", F.col("feature").alias("src"), F.col("bin").alias("x0"))
    n = y.join(x, "row_id").where("src <> dst").groupBy("src", "dst", "y1", "y0", "x0").agg(F.count("*").alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy("src", "dst", *k))
    n = n.select("src", "dst", "n", over().alias("t"), over("y0").alias("n0"), over("y1", "y0").alias("n10"), over("y0", "x0").alias("n0x"))
    te = F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("n0") / (F.col("n10") * F.col("n0x"))))
    return n.groupBy("src", "dst").agg(F.greatest(te, F.lit(0.0)).alias("te"))


def rolling_kl(series: DataFrame, window: int, gap: int, bins: int) -> DataFrame:
    """``pos, kl`` at every ``gap`` rows: a window's histogram against that of the window ``gap`` rows earlier.

    Bins are equal-width over both windows; series(pos, x).
    """
    n = series.agg(F.max("pos").alias("n")).select(F.explode(F.sequence(F.lit(window + gap).cast("long"), F.col("n"), F.lit(gap).cast("long"))).alias("at"))
    # each row belongs to the few windows that end within window + gap rows after it: an equi-join on blocks of that width
    width = window + gap
    blocks = n.withColumn("block", F.explode(F.array((F.col("at") - width) / width, (F.col("at") - 1) / width))).withColumn("block", F.floor("block")).distinct()
    rows = series.withColumn("block", F.floor(F.col("pos") / width)).join(blocks, "block").where((F.col("pos") >= F.col("at") - width) & (F.col("pos") < F.col("at")))
    rows = rows.select("at", "pos", "x")
    late, early = F.col("pos") >= F.col("at") - window, F.col("pos") < F.col("at") - gap
    w = Window.partitionBy("at")
    rows = rows.withColumn("lo", F.min("x").over(w)).withColumn("hi", F.max("x").over(w)).withColumn("bin", histogram_bin(F.col("x"), F.col("lo"), F.col("hi"), bins))
    n = rows.groupBy("at", "bin").agg(F.sum(late.cast("int")).alias("p"), F.sum(early.cast("int")).alias("q"))
    p, q = F.col("p") / window + TINY, F.col("q") / window + TINY
    return n.groupBy(F.col("at").alias("pos")).agg(F.sum(p * F.ln(p / q)).alias("kl"))


def nmi_rank(h: DataFrame, mi: DataFrame, target: str) -> DataFrame:
    """``feature, nmi, rank`` by falling normalised information with the target."""
    of = both_ways(mi).where(F.col("fj") == target).select(F.col("fi").alias("feature"), "mi")
    t = h.where(F.col("feature") == target).select(F.col("h").alias("ht"))
    out = of.join(h, "feature").crossJoin(F.broadcast(t)).select("feature", F.coalesce(F.try_divide(F.col("mi"), F.sqrt(F.col("h") * F.col("ht"))), F.lit(0.0)).alias("nmi"))
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(F.round("nmi", 9)), "feature")))


def _minmax(name: str):
    w = Window.partitionBy()
    lo, hi = F.min(name).over(w), F.max(name).over(w)
    return (F.col(name) - lo + TINY) / (hi - lo + TINY)


def feature_importance(h: DataFrame, mi: DataFrame, target: str) -> DataFrame:
    """``feature, importance``: half scaled entropy, half scaled information with the target."""
    of = both_ways(mi).where(F.col("fj") == target).select(F.col("fi").alias("feature"), "mi")
    both = h.join(of, "feature")
    return both.select("feature", F.greatest(0.5 * _minmax("h") + 0.5 * _minmax("mi"), F.lit(0.0)).alias("importance"))


def selector_scores(h: DataFrame, mi: DataFrame, target: str, alpha: float = 0.5, gamma: float = 0.3) -> DataFrame:
    """``feature, score``: information with the target, and its ratio to the mean information with all others."""
    all_pairs = both_ways(mi)
    signal = all_pairs.where(F.col("fj") == target).select(F.col("fi").alias("feature"), "mi")
    noise = all_pairs.where((F.col("fj") != target) & (F.col("fi") != target)).groupBy(F.col("fi").alias("feature")).agg(F.avg("mi").alias("noise"))
    t = h.where(F.col("feature") == target).select(F.col("h").alias("ht"))
    s = signal.join(h, "feature").join(noise, "feature").crossJoin(F.broadcast(t))
    s = s.select("feature", (F.col("mi") / F.sqrt(F.col("h") * F.col("ht"))).alias("nmi"), (F.col("mi") / (F.col("noise") + TINY)).alias("snr"))
    return s.select("feature", (alpha * F.col("nmi") + gamma * F.col("snr") / F.max("snr").over(Window.partitionBy())).alias("score"))


def redundancy(h: DataFrame, mi: DataFrame) -> DataFrame:
    """``fi, fj, redundancy``: information over the smaller entropy."""
    a, b = h.select(F.col("feature").alias("fi"), F.col("h").alias("hi")), h.select(F.col("feature").alias("fj"), F.col("h").alias("hj"))
    out = mi.join(F.broadcast(a), "fi").join(F.broadcast(b), "fj")
    return out.select("fi", "fj", F.coalesce(F.try_divide(F.col("mi"), F.least("hi", "hj")), F.lit(0.0)).alias("redundancy"))


def greedy_select(scores: DataFrame, redundant: DataFrame, k: int, penalty: float = 0.5) -> list[str]:
    """Features by greatest score less the penalty times their largest redundancy with those chosen; tables by feature."""
    score = {r["feature"]: r["score"] for r in scores.collect()}
    pair = {frozenset((r["fi"], r["fj"])): r["redundancy"] for r in redundant.collect()}
    chosen: list[str] = []
    while len(chosen) < min(k, len(score)):
        left = sorted(f for f in score if f not in chosen)
        chosen.append(max(left, key=lambda f: score[f] - penalty * max((pair.get(frozenset((f, c)), 0.0) for c in chosen), default=0.0)))
    return chosen


def enhancement_potential(te: DataFrame, mi: DataFrame, target: str) -> DataFrame:
    """``feature, potential``: transfer entropy to the target over the information shared with it, 0 where that is none."""
    of = both_ways(mi).where(F.col("fj") == target).select(F.col("fi").alias("feature"), "mi")
    to = te.where(F.col("dst") == target).select(F.col("src").alias("feature"), "te")
    ratio = F.when(F.col("mi") > 0, F.coalesce("te", F.lit(0.0)) / F.col("mi")).otherwise(0.0)
    return of.join(to, "feature", "left").select("feature", ratio.alias("potential"))


def strategy(h: DataFrame, te: DataFrame, tails: DataFrame, mi: DataFrame, target: str) -> DataFrame:
    """``feature, entropy_weighted, te_weighted, kl_weighted, tail_emphasis``: the enhancements that each feature calls for.

    Entropy above the median of the features; transfer entropy to the target above 0.01 (the target itself: always);
    mean information with all features, its own entropy included, above 0.1; excess kurtosis above 2.
    """
    to = te.where(F.col("dst") == target).select(F.col("src").alias("feature"), "te")
    shared = both_ways(mi).groupBy(F.col("fi").alias("feature")).agg(F.sum("mi").alias("shared"), F.count("*").alias("others"))
    rows = h.join(to, "feature", "left").join(shared, "feature", "left").join(tails.select("feature", "k"), "feature", "left")
    typical = h.agg(F.percentile("h", 0.5).alias("typical"))
    mean = (F.coalesce("shared", F.lit(0.0)) + F.col("h")) / (F.coalesce("others", F.lit(0)) + 1)
    return rows.crossJoin(F.broadcast(typical)).select(
        "feature",
        (F.col("h") > F.col("typical")).alias("entropy_weighted"),
        ((F.col("feature") == target) | (F.coalesce("te", F.lit(0.0)) > 0.01)).alias("te_weighted"),
        (mean > 0.1).alias("kl_weighted"),
        (F.coalesce("k", F.lit(0.0)) > 2).alias("tail_emphasis"),
    )


def entropy_weighted(df: DataFrame, importance: dict[str, float]) -> DataFrame:
    """Each feature times its weight, as ``<name>_ent_weighted``."""
    return _weighted(df, importance, "ent_weighted")


def te_weighted(df: DataFrame, te_to_target: dict[str, float]) -> DataFrame:
    """Each feature that leads the target times its transfer entropy, as ``<name>_te_weighted``."""
    return _weighted(df, {c: w for c, w in te_to_target.items() if w > 0}, "te_weighted")


def tail_emphasized(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Each feature with a tail factor above 1 times it, as ``<name>_tail_emphasized``."""
    return _weighted(df, {c: w for c, w in factors.items() if w > 1}, "tail_emphasized")


def _weighted(df: DataFrame, weights: dict[str, float], suffix: str) -> DataFrame:
    return df.select("*", *[(F.col(c) * w).alias(f"{c}_{suffix}") for c, w in sorted(weights.items())])


def kl_weighted(df: DataFrame, kl: dict[str, DataFrame], order: str, gap: int) -> DataFrame:
    """Each feature times 1 + ln(1 + its divergence), as ``<name>_kl_weighted``.

    ``kl[name]`` has ``pos, kl`` at every ``gap`` rows; a row takes the value of the last of these positions up to it, 0 before the first.
    """
    out = df.withColumn("_at", F.floor(F.col(order) / gap) * gap)
    for c, table in sorted(kl.items()):
        out = out.join(F.broadcast(table.select(F.col("pos").alias("_at"), F.col("kl").alias("_kl"))), "_at", "left")
        out = out.withColumn(f"{c}_kl_weighted", F.col(c) * (1 + F.log1p(F.greatest(F.coalesce("_kl", F.lit(0.0)), F.lit(0.0))))).drop("_kl")
    return out.drop("_at")


def lagged_correlation(df: DataFrame, names: list[str], order: str) -> DataFrame:
    """``src, dst, te``: squared correlation of each feature with each other's next value, over the greatest."""
    o = Window.partitionBy().orderBy(order)
    df = df.select(*names, *[F.lead(c).over(o).alias(f"next_{c}") for c in names])
    row = df.agg(*[F.pow(F.corr(a, f"next_{b}"), 2).alias(f"{a}|{b}") for a in names for b in names if a != b])
    long = row.unpivot([], row.columns, "pair", "te").select(F.split("pair", r"\|")[0].alias("src"), F.split("pair", r"\|")[1].alias("dst"), F.coalesce("te", F.lit(0.0)).alias("te"))
    return long.withColumn("te", F.coalesce(F.try_divide("te", F.max("te").over(Window.partitionBy())), F.lit(0.0)))


def select_by_variance(df: DataFrame, names: list[str], k: int) -> DataFrame:
    """``feature, variance`` of the k most variable."""
    return df.agg(*[F.var_pop(c).alias(c) for c in names]).unpivot([], names, "feature", "variance").orderBy(F.desc("variance"), "feature").limit(k)


def kde_entropy(long: DataFrame, points: int = 1000) -> DataFrame:
    """``feature, h`` from a cosine-kernel density on a grid of two deviations beyond the range.

    The bandwidth is 0.9 min(sigma, IQR/1.34) n^-0.2, at least 1e-3.  Values are
    first counted on a grid of bins far finer than the bandwidth; the kernel
    runs over those counts, so a feature of any length is bounded.
    """
    fine = 20_000
    stats = long.groupBy("feature").agg(
        F.count("*").alias("n"), F.stddev_pop("x").alias("sd"), F.percentile("x", F.array(F.lit(0.25), F.lit(0.75))).alias("q"), F.min("x").alias("lo"), F.max("x").alias("hi")
    )
    b = long.join(F.broadcast(stats), "feature")
    counts = b.withColumn("bin", histogram_bin(F.col("x"), F.col("lo"), F.col("hi"), fine)).groupBy("feature", "bin").agg(
        F.count("*").alias("k"), F.avg("x").alias("x"), F.first("n").alias("n"), F.first("sd").alias("sd"), F.first("q").alias("q"), F.first("lo").alias("lo"), F.first("hi").alias("hi")
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, sd, q = pdf["n"].iloc[0], pdf["sd"].iloc[0], pdf["q"].iloc[0]
        width = max(0.9 * min(sd, (q[1] - q[0]) / 1.34) * n**-0.2, 1e-3)
        grid = np.linspace(pdf["lo"].iloc[0] - 2 * sd, pdf["hi"].iloc[0] + 2 * sd, points)
        x, k = pdf["x"].to_numpy(), pdf["k"].to_numpy()
        p = np.array([(np.where(np.abs(u := (g - x) / width) < 1, np.pi / 4 * np.cos(np.pi / 2 * u), 0) * k).sum() for g in grid]) / (n * width)
        f = np.where(p > 0, p * np.log(np.maximum(p, 1e-300)), 0)
        return pd.DataFrame({"feature": [pdf["feature"].iloc[0]], "h": [float(-np.trapezoid(f, grid))]})

    return counts.groupBy("feature").applyInPandas(run, "feature string, h double")
