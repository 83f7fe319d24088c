"""Microstructure features of a tick table, as columns of one pass over each symbol."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.schema import TICKS, TickSchema
from tickloom.functions.series import backward_fill, clip, finite, forward_fill, ieee_div, rolled, seconds_between, trailing

WINDOWS = (10, 50, 100)
TINY = 1e-8


def least_rows(window: int) -> int:
    return min(max(2, window // 5), 5)


def base(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    """Returns, signs, gaps and one-sided volumes that the features are made of; a return from or to a price of 0 is 0, like a first one."""
    o = s.order()
    df = df.withColumn("ret", F.coalesce(F.ln(s.price) - F.ln(F.lag(s.price).over(o)), F.lit(0.0))).withColumn("sign", F.signum("ret"))
    gap = seconds_between(F.lag(s.ts).over(o), F.col(s.ts))
    df = df.withColumn("_gap", gap).withColumn("_typical", F.percentile("_gap", 0.5).over(Window.partitionBy(s.symbol)))
    df = df.withColumn("gap", F.coalesce("_gap", "_typical", F.lit(1.0))).withColumn("gap", F.when(F.col("gap") == 0, 0.001).otherwise(F.col("gap")))
    buy = F.when(F.col("ret") >= 0, F.col(s.volume)).otherwise(0.0)
    sell = F.when(F.col("ret") < 0, F.col(s.volume)).otherwise(0.0)
    return df.withColumn("buy", buy).withColumn("sell", sell).drop("_gap", "_typical")


def tick_metrics(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    before = F.lag("sign").over(s.order())
    df = df.withColumn("tick_direction", F.col("sign")).withColumn("tick_reversal", F.coalesce(F.col("sign") * before, F.lit(0.0)))
    return df.withColumn("tick_run_length", F.coalesce(F.col("sign") == before, F.lit(False)).cast("int")).withColumn("tick_volatility", F.abs("ret"))


def volume_imbalance(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    return df.withColumn("volume_imbalance", (F.col("buy") - F.col("sell")) / (F.col("buy") + F.col("sell") + TINY))


def price_impact(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    size = F.abs("ret")
    return df.withColumn("kyle_lambda", size / (F.sqrt(s.volume) + TINY)).withColumn("amihud", size / (F.col(s.volume) + TINY))


def rs_volatility(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    """Squared log return, missing from and to a price of 0."""
    before = F.coalesce(F.lag(s.price).over(s.order()), F.col(s.price))
    return df.withColumn("rs_volatility", F.pow(F.ln(s.price) - F.ln(before), 2))


def intensity(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    return df.withColumn("trading_intensity", F.col(s.volume) / F.col("gap")).withColumn("return_intensity", F.abs("ret") / F.col("gap"))


def realized_vol(df: DataFrame, s: TickSchema = TICKS, windows=WINDOWS) -> DataFrame:
    for w in windows:
        f, least = trailing(s.order(), w), least_rows(w)
        df = df.withColumn(f"realized_vol_{w}", F.sqrt(rolled(F.sum(F.col("ret") * F.col("ret")), F.col("ret"), f, least)))
        df = df.withColumn(f"abs_return_{w}", rolled(F.avg(F.abs("ret")), F.col("ret"), f, least))
    return df


def garman_klass(df: DataFrame, s: TickSchema = TICKS, windows=WINDOWS) -> DataFrame:
    """Range and close-to-open ratio of a window; ratios within 1e-4 of 1 are pushed to that distance, exactly 1 stays.

    A window with a price of 0 for its lowest or first one has no ratio and takes the realized volatility.
    """
    o, price = s.order(), F.col(s.price)
    first = F.first(s.price).over(o.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    for w in windows:
        f, least = trailing(o, w), least_rows(w)
        high_low = F.try_divide(rolled(F.max(s.price), price, f, least), rolled(F.min(s.price), price, f, least))
        ratio = F.try_divide(price, F.coalesce(F.lag(s.price, w).over(o), first))
        ratio = F.when(ratio <= 0, 1.0001).otherwise(ratio)
        ratio = F.when(F.abs(ratio - 1) < 1e-4, 1 + F.signum(ratio - 1) * 1e-4).otherwise(ratio)
        spread = F.when(high_low.isNotNull(), F.ln(F.greatest(high_low, F.lit(1.0001))))
        term = 0.5 * spread * spread - (2 * math.log(2) - 1) * F.ln(ratio) * F.ln(ratio)
        df = df.withColumn(f"gk_vol_{w}", F.coalesce(F.sqrt(F.when(term.isNotNull(), F.greatest(term, F.lit(1e-10)))), F.col(f"realized_vol_{w}")))
    return df


def order_flow(df: DataFrame, s: TickSchema = TICKS, windows=WINDOWS) -> DataFrame:
    for w in windows:
        f, least = trailing(s.order(), w), least_rows(w)
        b, v = (rolled(F.sum(c), F.col(c), f, least) for c in ("buy", "sell"))
        df = df.withColumn(f"order_flow_imbalance_{w}", F.coalesce(F.try_divide(b - v, b + v), F.lit(0.0)))
    return df


def variance_ratio(df: DataFrame, s: TickSchema = TICKS, windows=WINDOWS) -> DataFrame:
    for w in (w for w in windows if w >= 4):
        least = least_rows(w)
        short = rolled(F.var_samp("ret"), F.col("ret"), trailing(s.order(), w // 2), least // 2)
        long = rolled(F.var_samp("ret"), F.col("ret"), trailing(s.order(), w), least)
        df = df.withColumn(f"variance_ratio_{w}", F.coalesce(short / (long / 2 + TINY), F.lit(1.0)))
    return df


def rolling_liquidity(df: DataFrame, s: TickSchema = TICKS, windows=WINDOWS) -> DataFrame:
    typical = F.avg(s.volume).over(Window.partitionBy(s.symbol))
    for w in windows:
        f, least = trailing(s.order(), w), least_rows(w)
        mean = lambda c, f=f, least=least: rolled(F.avg(c), F.col(c), f, least)
        df = df.withColumn(f"kyle_lambda_{w}", mean("kyle_lambda")).withColumn(f"amihud_{w}", mean("amihud"))
        df = df.withColumn(f"tick_pattern_{w}", mean("sign")).withColumn(f"rel_volume_{w}", ieee_div(mean(s.volume), typical))
    return df


def time_cyclic(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    angle = 2 * math.pi * (F.hour(s.ts) * 60 + F.minute(s.ts)) / 1440
    return df.withColumn("sin_time", F.sin(angle)).withColumn("cos_time", F.cos(angle))


def vol_adjusted(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    sigma = F.col(s.volatility) + TINY
    return df.withColumn("vol_adjusted_return", F.col("ret") / sigma).withColumn("vol_impact_ratio", F.col("kyle_lambda") / sigma)


def vol_trend(df: DataFrame, s: TickSchema = TICKS, windows=WINDOWS) -> DataFrame:
    sigma = F.col(s.volatility)
    for w in windows:
        mean = rolled(F.avg(sigma), sigma, trailing(s.order(), w), max(2, w // 5))
        ratio = sigma / F.when(mean.isNotNull(), F.greatest(mean, F.lit(1e-10)))
        df = df.withColumn(f"vol_trend_{w}", F.coalesce(clip(ratio, 0.1, 10.0) - 1, F.lit(0.0)))
    return df


def all_features(df: DataFrame, s: TickSchema = TICKS, windows=WINDOWS) -> DataFrame:
    """Every feature; all frames of a symbol share one sort."""
    df = price_impact(volume_imbalance(tick_metrics(base(df, s), s), s), s)
    df = garman_klass(realized_vol(intensity(rs_volatility(df, s), s), s, windows), s, windows)
    df = rolling_liquidity(variance_ratio(order_flow(df, s, windows), s, windows), s, windows)
    return vol_trend(vol_adjusted(time_cyclic(df, s), s), s, windows)


def feature_names(windows=WINDOWS) -> list[str]:
    plain = ["tick_direction", "tick_reversal", "tick_run_length", "tick_volatility", "volume_imbalance", "kyle_lambda", "amihud", "rs_volatility", "trading_intensity", "return_intensity"]
    rolled_names = ["realized_vol", "abs_return", "gk_vol", "order_flow_imbalance", "variance_ratio", "kyle_lambda", "amihud", "tick_pattern", "rel_volume", "vol_trend"]
    return [*plain, *[f"{n}_{w}" for w in windows for n in rolled_names], "sin_time", "cos_time", "volatility", "vol_adjusted_return", "vol_impact_ratio"]


def null_profile(df: DataFrame, names: list[str]) -> DataFrame:
    """``feature, n, n_null`` of each column, from one pass."""
    totals = df.agg(F.count("*").alias("n"), *[F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in names])
    return totals.unpivot("n", names, "feature", "n_null").select("feature", "n", F.coalesce("n_null", F.lit(0)).alias("n_null"))


def kept_features(df: DataFrame, names: list[str], most: float = 0.05) -> list[str]:
    """Names of the columns with at most that share of nulls: a fitted choice, to be reused when scoring."""
    return [r["feature"] for r in null_profile(df, names).where(F.col("n_null") <= most * F.col("n")).collect()]


def fill_chain(df: DataFrame, name: str, s: TickSchema = TICKS) -> DataFrame:
    """Infinities become null; then the last value, the next value, the median, 0."""
    o, x = s.order(), F.col(name)
    df = df.withColumn("_x", finite(x))
    return df.withColumn(name, F.coalesce(forward_fill(F.col("_x"), o), backward_fill(F.col("_x"), s.reverse()), F.percentile("_x", 0.5).over(Window.partitionBy(s.symbol)), F.lit(0.0))).drop("_x")


def standardize(df: DataFrame, names: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column keeps scale 1.  One row of statistics is joined back."""
    stats = df.agg(*[f(c).alias(f"_{k}_{c}") for c in names for k, f in (("m", F.avg), ("d", F.stddev_pop))])
    scale = lambda c: F.when(F.col(f"_d_{c}") == 0, 1.0).otherwise(F.col(f"_d_{c}"))
    return df.crossJoin(F.broadcast(stats)).select(*[((F.col(c) - F.col(f"_m_{c}")) / scale(c)).alias(c) if c in names else F.col(c) for c in df.columns])


def feature_corr_rank(df: DataFrame, names: list[str], target: str) -> DataFrame:
    """``feature, importance``: absolute correlation with the target."""
    row = df.agg(*[F.abs(F.corr(c, target)).alias(c) for c in names])
    return row.unpivot([], names, "feature", "importance")


