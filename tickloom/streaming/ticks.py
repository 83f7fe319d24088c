"""Ticks as a stream: scoring by a fitted model, windowed statistics, and rolling volatility with kept state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.functions.schema import TICKS, TickSchema
from tickloom.functions.series import ieee_div
from tickloom.operators.regimes import RegimeModel


def scored(stream: DataFrame, model: RegimeModel, key: str) -> DataFrame:
    """Regime and confidence of every row; the model is plain numbers, so no state is kept."""
    return model.transform(stream, key)


def windowed(stream: DataFrame, s: TickSchema = TICKS, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Count, mean price by volume and range of each symbol and window; rows later than ``late`` are dropped.

    A time without zone is taken in the session's zone, as watermarks need one.
    """
    rows = stream.withColumn(s.ts, F.col(s.ts).cast("timestamp")).withWatermark(s.ts, late)
    agg = rows.groupBy(F.window(s.ts, width), s.symbol).agg(
        F.count("*").alias("n"), ieee_div(F.sum(F.col(s.price) * F.col(s.volume)), F.sum(s.volume)).alias("vwap"), F.min(s.price).alias("low"), F.max(s.price).alias("high")
    )
    return agg.select(F.col("window.start").alias("start"), s.symbol, "n", "vwap", "low", "high")


def rolling_volatility(stream: DataFrame, s: TickSchema = TICKS, width: int = 20) -> DataFrame:
    """``symbol, ts, order_key, volatility`` as the batch operator gives it, a symbol's last ``width`` changes being its state.

    Rows of a batch are put in order; a row older than the last one seen of its
    symbol is taken as it comes.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, changes = state.get if state.exists else (None, [])
        changes = list(changes)
        rows = pd.concat(list(batches)).sort_values([s.ts, s.order_key])
        out = []
        for price in rows[s.price]:
            if last is not None and last != 0:
                changes = [*changes, abs(price / last - 1)][-width:]
            last = price
            out.append(sum(changes) / len(changes) * 100 if changes else None)
        state.update((last, changes))
        yield pd.DataFrame({s.symbol: key[0], s.ts: rows[s.ts], s.order_key: rows[s.order_key], s.volatility: pd.Series(out, index=rows.index, dtype=float)})

    rows = stream.select(s.symbol, F.col(s.ts).cast("timestamp").alias(s.ts), s.order_key, s.price)
    return rows.groupBy(s.symbol).applyInPandasWithState(
        run, f"{s.symbol} string, {s.ts} timestamp, {s.order_key} long, {s.volatility} double", "last double, changes array<double>", "append", GroupStateTimeout.NoTimeout
    )
