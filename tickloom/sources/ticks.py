"""Reading and writing tick tables and text series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.schema import TICKS, TickSchema

TICK_DDL = "symbol string, ts timestamp, price double, volume double, volatility double"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tick_view(events: DataFrame) -> DataFrame:
    """The event stream as ticks: type as symbol, value as price, one more than the property ``k`` as volume."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("value").cast("double").alias("price"),
        (F.get_json_object("props", "$.k").cast("int") + 1).cast("double").alias("volume"),
        F.col("event_id").alias("order_key"),
    )


def read_csv(spark: SparkSession, path: str, ddl: str = TICK_DDL) -> DataFrame:
    """Ticks from delimited text with a header under a given schema; timestamps that cannot be read become null."""
    return spark.read.schema(ddl).option("header", True).option("mode", "PERMISSIVE").csv(path)


def usable(df: DataFrame, s: TickSchema = TICKS) -> DataFrame:
    """Rows with a time and a positive price, NaN counting as missing."""
    price = F.nanvl(F.col(s.price), F.lit(None).cast("double"))
    return df.withColumn(s.price, price).where(F.col(s.ts).isNotNull() & (F.col(s.price) > 0))


def write(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
