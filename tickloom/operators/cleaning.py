"""Tick cleaning: rolling robust scores, outlier flags, duplicate-time and velocity checks, cluster collapse."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.kernels import smooth_detail
from tickloom.functions.schema import TICKS, TickSchema
from tickloom.functions.series import centred, clip, finite, holds, ieee_div, median_of_three, rolled, seconds_between, trailing, with_runs

# Fixed values of the cleaning rules.
MAD_SCALE = 1.4826
SIMILAR, EXTREME_PCT, STABLE, DEVIATES = 0.005, 1.5, 0.0015, 0.002
WAVELET_SHARE, WAVELET_PCT, WAVELET_ROWS = 0.005, 0.8, 100
FLAGS = ("zscore_outlier", "extreme_outlier", "isolated_outlier", "wavelet_outlier", "reversal_outlier")


def market_hours(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Rows from 09:30 up to, not including, 16:00."""
    minute = F.hour(ts) * 60 + F.minute(ts)
    return df.where((minute >= 570) & (minute < 960))


def default_volatility(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    """Mean over 20 rows of the absolute relative price change, in percent; a change from a price of 0 is missing."""
    o = s.order()
    change = F.abs(finite(ieee_div(F.col(s.price), F.lag(s.price).over(o))) - 1)
    return df.withColumn("_change", change).withColumn(s.volatility, F.avg("_change").over(trailing(o, 20)) * 100).drop("_change")


def price_change(df: DataFrame, s: TickSchema = TICKS, least_pct: float = 0.05) -> DataFrame:
    o = s.order()
    df = df.withColumn("change", F.col(s.price) - F.lag(s.price).over(o)).withColumn("pct", ieee_div(F.col("change"), F.lag(s.price).over(o)) * 100)
    return df.withColumn("significant", holds(F.abs("pct") >= least_pct))


def rolling_mad(df: DataFrame, s: TickSchema = TICKS, window: int = 50) -> DataFrame:
    """Centred median and median absolute deviation, trailing deviation where the latter is 0, centred deviation and mean volume."""
    o, price = s.order(), F.col(s.price)
    wide, short = centred(o, window), centred(o, 20)
    df = df.withColumn("rolling_median", rolled(F.percentile(s.price, 0.5), price, wide, 3))
    df = df.withColumn("_away", F.abs(price - F.col("rolling_median")))
    mad = rolled(F.percentile("_away", 0.5), F.col("_away"), wide, 3) * MAD_SCALE
    df = df.withColumn("_mad", mad).withColumn("_std10", F.stddev_samp(s.price).over(trailing(o, 10)))
    df = df.withColumn("mad_adjusted", F.when(F.col("_mad") == 0, F.col("_std10")).otherwise(F.col("_mad")))
    df = df.withColumn("rolling_std", rolled(F.stddev_samp(s.price), price, short, 3))
    return df.withColumn("rolling_volume", rolled(F.avg(s.volume), F.col(s.volume), short, 3)).drop("_away", "_mad", "_std10")


def robust_zscore(df: DataFrame, s: TickSchema = TICKS, window: int = 50) -> DataFrame:
    """Scores of a price against its rolling median, damped by unusual volume and volatility."""
    away, volatility = F.col(s.price) - F.col("rolling_median"), F.col(s.volatility)
    df = df.withColumn("price_zscore", ieee_div(away, F.col("rolling_std"))).withColumn("volume_ratio", ieee_div(F.col(s.volume), F.col("rolling_volume")))
    df = df.withColumn("median_diff_pct", F.abs(ieee_div(away, F.col("rolling_median")) * 100))
    df = df.withColumn("_vol_mean", F.avg(volatility).over(centred(s.order(), window)))
    calm, busy = clip(1 + ieee_div(volatility, F.col("_vol_mean")), 1.0, 2.0), clip(1 + F.col("volume_ratio"), 1.0, 2.0)
    return df.withColumn("z_score", ieee_div(away, F.col("mad_adjusted")) / busy / calm).drop("_vol_mean")


def scored(df: DataFrame, s: TickSchema = TICKS, window: int = 50, least_pct: float = 0.05) -> DataFrame:
    """All measures that the flags need."""
    if s.volatility not in df.columns:
        df = default_volatility(df, s)
    return robust_zscore(rolling_mad(price_change(df, s, least_pct), s, window), s, window)


def flag_zscore(df: DataFrame, s: TickSchema = TICKS, threshold: float = 3.0) -> DataFrame:
    """A large score on a significant change, unless one of the next three prices is close."""
    o, price = s.order(), F.col(s.price)
    like = [holds(ieee_div(F.abs(F.lead(s.price, k).over(o) - price), price) < SIMILAR) for k in (1, 2, 3)]
    return df.withColumn("zscore_outlier", holds(F.abs("z_score") > threshold) & F.col("significant") & ~(like[0] | like[1] | like[2]))


def flag_extreme(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    return df.withColumn("extreme_outlier", holds(F.abs("pct") > EXTREME_PCT))


def flag_isolated_stat(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    far = (F.col("median_diff_pct") > 0.5) & (F.abs("price_zscore") > 2.0) & (F.col("volume_ratio") < 1.0)
    return df.withColumn("isolated_stat", holds(far))


def flag_isolated_local(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    """Stable prices on both sides of a price that is off both their medians."""
    o, price = s.order(), F.col(s.price)
    df = df.withColumn("_calm", holds(F.abs(ieee_div(price, F.lag(s.price).over(o)) - 1) < STABLE).cast("int"))
    side = lambda f: [F.coalesce(f("_calm", k).over(o), F.lit(0)) for k in (1, 2, 3, 4, 5)]
    most = lambda c: F.greatest(*[c[i] + c[i + 1] + c[i + 2] for i in range(3)])
    near = lambda f: median_of_three(*[f(s.price, k).over(o) for k in (1, 2, 3)])
    before, after = near(F.lag), near(F.lead)
    n, at = F.count("*").over(Window.partitionBy(s.symbol)), F.row_number().over(o) - 1
    inside = (at >= 5) & (at < n - 5)
    off = (ieee_div(F.abs(price - before), before) > DEVIATES) & (ieee_div(F.abs(price - after), after) > DEVIATES)
    return df.withColumn("isolated_local", holds(inside & (most(side(F.lag)) >= 2) & (most(side(F.lead)) >= 2) & off)).drop("_calm")


def flag_reversal(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    """A move of over half a percent that turns back by a third within two ticks marks all rows it spans."""
    o, price = s.order(), F.col(s.price)
    n, at = F.count("*").over(Window.partitionBy(s.symbol)), F.row_number().over(o) - 1
    move = [ieee_div(F.lead(s.price, j + 1).over(o) - price, price) * 100 for j in range(3)]
    back = [holds((move[j] * move[0] < 0) & (F.abs(move[j]) > 0.3 * F.abs(move[0]))) for j in (1, 2)]
    inside = holds((at >= 3) & (at < n - 3) & (F.abs(move[0]) > 0.5))
    df = df.withColumn("_span", F.when(inside & back[0], 2).when(inside & back[1], 3))
    marked = [holds(F.lag("_span", k).over(o) >= k) if k else F.col("_span").isNotNull() for k in range(4)]
    return df.withColumn("reversal_outlier", marked[0] | marked[1] | marked[2] | marked[3]).drop("_span")


def flag_wavelet(df: DataFrame, s: TickSchema = TICKS, threshold: float = 3.0) -> DataFrame:
    """Prices off a reconstruction without the coarsest detail, where another measure is unusual too."""
    keys = [s.symbol, s.order_key]

    def rebuilt(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([s.ts, s.order_key])
        price = pdf[s.price].to_numpy()
        smooth = smooth_detail(price) if len(price) > WAVELET_ROWS else price
        return pd.DataFrame({s.symbol: pdf[s.symbol], s.order_key: pdf[s.order_key], "wavelet_diff": np.divide(price - smooth, price, where=price != 0, out=np.where(price == smooth, np.nan, np.inf))})

    types = dict(df.dtypes)
    schema = f"{s.symbol} {types[s.symbol]}, {s.order_key} {types[s.order_key]}, wavelet_diff double"
    diff = df.where(finite(F.col(s.price)).isNotNull()).select(*keys, s.ts, s.price).groupBy(s.symbol).applyInPandas(rebuilt, schema)
    diff = diff.withColumn("wavelet_diff", F.nanvl("wavelet_diff", F.lit(None).cast("double")))
    unusual = holds(F.abs("z_score") > 0.7 * threshold) | holds(F.abs("pct") > WAVELET_PCT)
    return df.join(diff, keys, "left").withColumn("wavelet_outlier", holds(F.abs("wavelet_diff") > WAVELET_SHARE) & unusual)


def flag_outliers(df: DataFrame, s: TickSchema = TICKS, window: int = 50, threshold: float = 3.0, least_pct: float = 0.05, wavelet: bool = True) -> DataFrame:
    """All five flags and ``is_outlier``, their disjunction."""
    df = flag_reversal(flag_isolated_local(flag_isolated_stat(flag_extreme(flag_zscore(scored(df, s, window, least_pct), s, threshold), s), s), s), s)
    df = df.withColumn("isolated_outlier", F.col("isolated_stat") | F.col("isolated_local"))
    df = flag_wavelet(df, s, threshold) if wavelet else df.withColumn("wavelet_outlier", F.lit(False))
    return df.withColumn("is_outlier", F.col(FLAGS[0]) | F.col(FLAGS[1]) | F.col(FLAGS[2]) | F.col(FLAGS[3]) | F.col(FLAGS[4]))


def outlier_counts(flagged: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    """Rows and rows under each flag, per symbol, in one aggregation."""
    return flagged.groupBy(s.symbol).agg(F.count("*").alias("n"), *[F.sum(F.col(f).cast("bigint")).alias(f) for f in (*FLAGS, "is_outlier")])


def seconds_from_open(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    first = F.min(s.ts).over(Window.partitionBy(s.symbol, F.to_date(s.ts)))
    return df.withColumn("seconds_from_open", seconds_between(first, F.col(s.ts)))


def flag_timestamp_group(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    """Rows of one time whose prices differ too much; the one with most volume stays clear."""
    same = Window.partitionBy(s.symbol, s.ts)
    low = F.min(s.price).over(same)
    wide = ieee_div(F.max(s.price).over(same) - low, low) * 100 > F.when(F.col("seconds_from_open") < 60, 1.0).otherwise(0.5)
    first = F.row_number().over(same.orderBy(F.desc(s.volume), s.order_key)) == 1
    return df.withColumn("timestamp_group", holds(wide) & ~first)


def flag_velocity(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    """Price change per second beyond a threshold that grows with the volume ratio; stricter in the first two minutes."""
    o = s.order()
    pct = (ieee_div(F.col(s.price), F.lag(s.price).over(o)) - 1) * 100
    gap = seconds_between(F.lag(s.ts).over(o), F.col(s.ts))
    df = df.withColumn("_pct", pct).withColumn("_gap", gap)
    df = df.withColumn("price_velocity", F.when(F.col("_gap") == 0, 0.0).otherwise(ieee_div(F.col("_pct"), F.col("_gap"))))
    df = df.withColumn("rolling_vol_10min", rolled(F.avg(s.volatility), F.col(s.volatility), trailing(o, 20), 5))
    factor = clip(F.sqrt("volume_ratio"), 0.5, 2.0)
    early = F.col("seconds_from_open") < 120
    fast = holds(F.abs("price_velocity") > F.when(early, 50.0).otherwise(30.0) * factor)
    real = holds(F.abs("_pct") > 0.3) | holds(F.col("volume_ratio") < 0.3)
    method = F.when(early & fast, "market_open_artifact").when(~early & fast & real, "price_velocity")
    return df.withColumn("velocity_method", method).drop("_pct", "_gap")


def collapse_clusters(df: DataFrame, s: TickSchema = TICKS, suspicious: str = "is_suspicious", rows: int = 5, seconds: float = 1.0) -> DataFrame:
    """A run of more than ``rows`` suspicious ticks within ``seconds`` becomes its first tick at the run's mean price by volume."""
    df = with_runs(df, suspicious, [s.symbol], [s.ts, s.order_key], "_run")
    run = Window.partitionBy(s.symbol, "_run")
    short = seconds_between(F.min(s.ts).over(run), F.max(s.ts).over(run)) < seconds
    cluster = F.col(suspicious) & (F.count("*").over(run) > rows) & short
    mean = ieee_div(F.sum(F.col(s.price) * F.col(s.volume)).over(run), F.sum(s.volume).over(run))
    first = F.row_number().over(run.orderBy(s.ts, s.order_key)) == 1
    df = df.withColumn("_cluster", cluster).withColumn("_mean", F.when(cluster, mean)).withColumn("_first", first)
    kept = F.col("_cluster") & F.col("_first")
    df = df.withColumn(s.price, F.when(kept, F.col("_mean")).otherwise(F.col(s.price)))
    df = df.withColumn("in_cluster", F.col("_cluster") & ~F.col("_first")).withColumn(suspicious, F.col(suspicious) & ~kept)
    return df.drop("_run", "_cluster", "_mean", "_first")


def suspicious(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    """The second pass: ``is_suspicious`` and, of its reasons, the last in ``outlier_method``."""
    df = flag_velocity(flag_timestamp_group(seconds_from_open(df, s), s), s)
    df = df.withColumn("is_suspicious", F.col("timestamp_group") | F.col("velocity_method").isNotNull())
    method = F.coalesce("velocity_method", F.when(F.col("timestamp_group"), F.lit("timestamp_group")), F.lit(""))
    df = collapse_clusters(df.withColumn("_method", method), s)
    last: Column = F.when(F.col("in_cluster"), "suspicious_cluster").when(F.col("is_suspicious"), F.col("_method")).otherwise("")
    return df.withColumn("outlier_method", last).drop("_method")


def clean_ticks(df: DataFrame, s: TickSchema = TICKS, window: int = 50, threshold: float = 3.0, least_pct: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """The two passes: clean ticks with the columns of the input and volatility, and all rows of the second pass with diagnostics."""
    columns = [*df.columns, *([] if s.volatility in df.columns else [s.volatility])]
    first = flag_outliers(df, s, window, threshold, least_pct).where(~F.col("is_outlier"))
    full = suspicious(first, s)
    return full.where(~F.col("is_suspicious")).select(*columns), full


def vwap(df: DataFrame, keys: list[str], s: TickSchema = TICKS) -> DataFrame:
    return df.groupBy(*keys).agg(ieee_div(F.sum(F.col(s.price) * F.col(s.volume)), F.sum(s.volume)).alias("vwap"), F.sum(s.volume).alias("volume"))
