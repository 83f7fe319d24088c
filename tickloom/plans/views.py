"""Views of the supplied tables that the registered queries work on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.schema import TICKS
from tickloom.functions.series import positioned
from tickloom.sources.ticks import load, tick_view

#: Bins, windows and thresholds that queries and oracles share.
FEATURES = ["price", "volume", "minute", "activity"]
TARGET = "price"
EPSILON = 1.28
LEAST_RUN = 3


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tick_view(load(spark, sf_dir, "events"))


def coarse_ticks(spark: SparkSession, sf_dir: str, unit: str = "hour") -> DataFrame:
    """Ticks whose times repeat: cut to the hour or day."""
    return ticks(spark, sf_dir).withColumn("ts", F.date_trunc(unit, "ts"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A regime for each tick from its price, with a confidence: ``series, pos, regime, confidence, price, volume``."""
    t = positioned(ticks(spark, sf_dir), TICKS.order())
    return t.select(F.col("symbol").alias("series"), "pos", F.floor(F.col("price") / 125).cast("int").alias("regime"), (F.col("volume") / 100).alias("confidence"), "price", "volume")


def feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``row_id`` and four measures of each event."""
    e = load(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("row_id"), F.col("value").alias("price"), (F.get_json_object("props", "$.k").cast("int") + 1).cast("double").alias("volume"),
        (F.hour("ts") * 60 + F.minute("ts")).cast("double").alias("minute"), F.col("user_id").cast("double").alias("activity"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a series of points: ``pos, t, v, y``."""
    e = load(spark, sf_dir, "embeddings")
    e = e.crossJoin(F.broadcast(e.agg(F.max("vec_id").alias("_last"))))
    last = F.col("_last")
    return e.select(F.col("vec_id").alias("pos"), (F.col("vec_id") / F.greatest(last, F.lit(1))).alias("t"), F.col("embedding").alias("v"), F.col("embedding")[0].cast("double").alias("y"), "label")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many digits, without a negative zero; counts as bigint.

    The double times its power of ten is rounded, as SQL's ``round`` of a double does it: ``F.round(x, digits)`` rounds
    the printed decimal instead, which differs where the product falls on a half and the decimal does not.
    """
    kinds, unit = dict(df.dtypes), 10.0**digits
    near = lambda x: F.when(F.abs(x) < 1e300, F.round(x * unit) / unit).otherwise(x)
    cast = {"double": lambda c: near(F.col(c)) + F.lit(0.0), "int": lambda c: F.col(c).cast("bigint")}
    return df.select(*[cast[kinds[c]](c).alias(c) if kinds[c] in cast else F.col(c) for c in df.columns])
