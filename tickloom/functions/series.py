"""Expressions over ordered rows with the null and division rules of floating-point series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ieee_div(num: Column, den: Column) -> Column:
    """num/den as floating-point numbers have it: signed infinity for a zero divisor, null for 0/0 and where either is missing."""
    inf = float("inf")
    return F.when(den != 0, num / den).when((den == 0) & (num > 0), F.lit(inf)).when((den == 0) & (num < 0), F.lit(-inf))


def finite(x: Column) -> Column:
    """``x``, null where it is infinite or not a number; rolling statistics take such values as missing."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def holds(predicate: Column) -> Column:
    """A comparison with a missing value is false, not null."""
    return F.coalesce(predicate, F.lit(False))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def trailing(order: WindowSpec, width: int) -> WindowSpec:
    return order.rowsBetween(-(width - 1), 0)


def centred(order: WindowSpec, width: int) -> WindowSpec:
    """An even width reaches one row further back than forward."""
    return order.rowsBetween(-(width // 2), (width - 1) // 2)


def rolled(agg: Column, x: Column, frame: WindowSpec, least: int) -> Column:
    """``agg`` over ``frame``, null where fewer than ``least`` values of ``x`` are in it."""
    return F.when(F.count(x).over(frame) >= least, agg.over(frame))


def median_of_three(a: Column, b: Column, c: Column) -> Column:
    return F.when(a.isNotNull() & b.isNotNull() & c.isNotNull(), F.greatest(F.least(a, b), F.least(F.greatest(a, b), c)))


def seconds_between(earlier: Column, later: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", earlier, later) / 1e6


def forward_fill(x: Column, order: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))


def backward_fill(x: Column, reverse: WindowSpec) -> Column:
    """The next value, from a running frame over the falling order: a frame to the end of the rows would be scanned again for each row."""
    return forward_fill(x, reverse)


def positioned(df: DataFrame, order: WindowSpec, name: str = "pos") -> DataFrame:
    """Position from 0 within a partition."""
    return df.withColumn(name, F.row_number().over(order) - 1)


def with_runs(df: DataFrame, value: str, keys: list[str], by: list[str], name: str = "run_id") -> DataFrame:
    """Number of the run of equal values each row is in, from 0 within ``keys``."""
    order = Window.partitionBy(*keys).orderBy(*by)
    before = F.lag(value).over(order)
    starts = F.when(F.row_number().over(order) == 1, 0).when(F.col(value).eqNullSafe(before), 0).otherwise(1)
    return df.withColumn("_starts", starts).withColumn(name, F.sum("_starts").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_starts")


def histogram_bin(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    """Equal-width bin from 0; the last is closed, and all values fall in bin 0 where there is one value only."""
    return F.when(hi > lo, F.least(F.floor((x - lo) / (hi - lo) * bins).cast("bigint"), F.lit(bins - 1).cast("bigint"))).when(x.isNotNull(), F.lit(0).cast("bigint"))
