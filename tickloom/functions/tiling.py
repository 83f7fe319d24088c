"""One long series in many tasks: tiles of consecutive rows with a halo of their neighbours.

A window over a whole symbol runs in one task.  Frames of bounded width need
only their own tile and some rows of the tiles next to it, so a long symbol is
cut into tiles, the rows near a border are copied to the neighbour, the windows
run per tile, and the copies are dropped.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .schema import TickSchema


def positions(df: DataFrame, s: TickSchema, parts: int) -> DataFrame:
    """``pos`` from 0 within a symbol without a window over a whole symbol.

    Rows are dealt by ranges of (symbol, time, key), numbered in each range,
    and moved on by what the ranges before hold of the same symbol.
    """
    # dealt once into a table of its own, so every reader sees the same ranges
    dealt = df.repartitionByRange(parts, s.symbol, s.ts, s.order_key).withColumn("_part", F.spark_partition_id()).checkpoint()
    local = dealt.withColumn("_local", F.row_number().over(Window.partitionBy("_part", s.symbol).orderBy(s.ts, s.order_key)) - 1)
    held = dealt.groupBy("_part", s.symbol).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(s.symbol).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return local.join(held, ["_part", s.symbol]).withColumn("pos", F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def tiled(df: DataFrame, s: TickSchema, rows: int, back: int, ahead: int, run: Callable[[DataFrame, TickSchema], DataFrame]) -> DataFrame:
    """``run`` over tiles of ``rows`` rows with a halo of ``back`` and ``ahead`` rows; equal to ``run`` over whole symbols
    for operators whose frames reach no further.  ``df`` has ``pos``."""
    tile, at = F.floor(F.col("pos") / rows), F.col("pos") % rows
    targets = F.filter(
        F.array(
            tile,
            F.when((at >= rows - back), tile + 1),
            F.when((at < ahead) & (tile > 0), tile - 1),
        ),
        lambda t: t.isNotNull(),
    )
    spread = df.withColumn("_own", tile).withColumn("_tile", F.explode(targets))
    spread = spread.withColumn("_series", F.concat_ws("\x1f", F.col(s.symbol), F.col("_tile").cast("string")))
    out = run(spread, replace(s, symbol="_series"))
    return out.where(F.col("_own") == F.col("_tile")).drop("_own", "_tile", "_series")
