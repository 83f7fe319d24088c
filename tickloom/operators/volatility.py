"""Per-tick volatility: maximum-likelihood and Fourier windows, frequency bands, weighted averages, their mean."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.kernels import banded_volatility, ewma_volatility
from tickloom.functions.schema import TICKS, TickSchema
from tickloom.functions.series import backward_fill, centred, forward_fill, positioned, seconds_between

WINDOW, STEP, FREQUENCIES, SMOOTH, LEAST = 1000, 100, 50, 0.5, 50
FLOOR = 1e-10


def log_returns(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    """Log return (0 in the first row, and from or to a price of 0), its size, seconds since the last tick (0.001 in the first row)."""
    o = s.order()
    df = df.withColumn("log_price", F.ln(s.price))
    df = df.withColumn("ret", F.coalesce(F.col("log_price") - F.lag("log_price").over(o), F.lit(0.0)))
    return df.withColumn("abs_ret", F.abs("ret")).withColumn("gap", F.coalesce(seconds_between(F.lag(s.ts).over(o), F.col(s.ts)), F.lit(0.001)))


def in_windows(df: DataFrame, size: int = WINDOW, step: int = STEP, pos: str = "pos") -> DataFrame:
    """Each row once for every window of ``size`` rows, begun every ``step``, that covers it."""
    first = F.greatest(F.lit(0), F.ceil((F.col(pos) - (size - 1)) / step)).cast("int")
    return df.withColumn("win", F.explode(F.sequence(first, F.floor(F.col(pos) / step).cast("int"))))


def _per_tick(ticks: DataFrame, windows: DataFrame, s: TickSchema, name: str, smooth: int) -> DataFrame:
    """Largest estimate of the windows over a tick, gaps filled from the left, then smoothed."""
    keys = [s.symbol, "pos"]
    best = in_windows(ticks.select(*keys)).join(windows, [s.symbol, "win"]).groupBy(*keys).agg(F.max("vol").alias("_vol"))
    out = ticks.join(best, keys, "left")
    o, reverse = Window.partitionBy(s.symbol).orderBy("pos"), Window.partitionBy(s.symbol).orderBy(F.desc("pos"))
    given = F.when(F.col("_vol") > 0, F.col("_vol"))
    out = out.withColumn("_vol", F.coalesce(forward_fill(given, o), backward_fill(given, reverse), F.lit(0.0)))
    return out.withColumn(name, F.avg("_vol").over(centred(o, smooth)) if smooth else F.col("_vol")).drop("_vol")


def mle_volatility(df: DataFrame, s: TickSchema = TICKS, smooth: float = SMOOTH) -> DataFrame:
    """Root mean square return of each window: the likelihood's maximum for normal returns."""
    ticks = positioned(log_returns(df, s), s.order())
    each = in_windows(ticks.select(s.symbol, "pos", "ret")).groupBy(s.symbol, "win")
    windows = each.agg(F.count("*").alias("n"), F.greatest(F.sqrt(F.avg(F.col("ret") * F.col("ret"))), F.lit(FLOOR)).alias("vol")).where(F.col("n") >= LEAST)
    return _per_tick(ticks, windows.select(s.symbol, "win", "vol"), s, "mle_vol", int(WINDOW * smooth))


def fourier_windows(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    """``symbol, win, n, vol``: power of the returns at the first frequencies of each window."""
    ticks = positioned(log_returns(df, s), s.order())
    clock = F.unix_micros(s.ts) / 1e6

    def power(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        t, r = pdf["clock"].to_numpy(), pdf["ret"].to_numpy()
        span = t[-1] - t[0]
        vol = np.nan
        if len(pdf) >= LEAST and span > 0:
            angle = 2 * np.pi * np.arange(1, FREQUENCIES + 1)[:, None] * ((t[1:] - t[0]) / span)[None, :]
            vol = np.sqrt(((np.cos(angle) @ r[1:]) ** 2 + (np.sin(angle) @ r[1:]) ** 2).sum() / (2 * span))
        return pd.DataFrame({s.symbol: pdf[s.symbol].iloc[:1], "win": pdf["win"].iloc[:1], "n": len(pdf), "vol": vol})

    rows = in_windows(ticks.select(s.symbol, "pos", "ret", clock.alias("clock")))
    found = rows.groupBy(s.symbol, "win").applyInPandas(power, f"{s.symbol} string, win int, n bigint, vol double")
    return found.where(~F.isnan("vol"))


def fourier_volatility(df: DataFrame, s: TickSchema = TICKS, smooth: float = SMOOTH) -> DataFrame:
    ticks = positioned(log_returns(df, s), s.order())
    return _per_tick(ticks, fourier_windows(df, s).select(s.symbol, "win", "vol"), s, "fourier_vol", int(WINDOW * smooth))


def _kernel(df: DataFrame, s: TickSchema, name: str, kernel) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([s.ts, s.order_key])
        return pd.DataFrame({s.symbol: pdf[s.symbol], s.order_key: pdf[s.order_key], name: kernel(np.nan_to_num(pdf["ret"].to_numpy()))})

    types = dict(df.dtypes)
    schema = f"{s.symbol} {types[s.symbol]}, {s.order_key} {types[s.order_key]}, {name} double"
    return log_returns(df, s).select(s.symbol, s.ts, s.order_key, "ret").groupBy(s.symbol).applyInPandas(run, schema).withColumn(name, F.nanvl(name, F.lit(None).cast("double")))


def ewma_vol(df: DataFrame, s: TickSchema = TICKS, span: float = WINDOW // 5) -> DataFrame:
    return _kernel(df, s, "ewma_vol", lambda r: ewma_volatility(r, span))


def banded_vol(df: DataFrame, s: TickSchema = TICKS, smooth: float = SMOOTH) -> DataFrame:
    """Frequency bands; symbols too short for them get the weighted average."""

    def kernel(r: np.ndarray) -> np.ndarray:
        try:
            return banded_volatility(r, int(WINDOW * smooth))
        except (ValueError, ZeroDivisionError):
            return ewma_volatility(r, WINDOW // 5)

    return _kernel(df, s, "stft_vol", kernel)


def combined_volatility(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    """Mean of the likelihood estimate and the weighted average, of those there are."""
    both = mle_volatility(df, s).join(ewma_vol(df, s), [s.symbol, s.order_key])
    parts = [F.col("mle_vol"), F.col("ewma_vol")]
    there = sum((p.isNotNull().cast("int") for p in parts), F.lit(0))
    total = sum((F.coalesce(p, F.lit(0.0)) for p in parts), F.lit(0.0))
    return both.withColumn("combined_vol", F.when(there > 0, total / there))
