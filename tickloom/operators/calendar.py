"""Economic-calendar pages: month addresses, dates, rows of the table, filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the pages.
IMPACT = {"icon--ff-impact-red": "High", "icon--ff-impact-yel": "Medium", "icon--ff-impact-gry": "Low"}
CELLS = ("time", "currency", "impact", "event", "actual", "forecast", "previous")


def month_urls(spark: SparkSession, base: str, start: str, end: str) -> DataFrame:
    """``month, url`` for the first of each month from ``start`` to ``end`` (yyyy-MM)."""
    months = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(f"{start}-01")), F.to_date(F.lit(f"{end}-01")), F.expr("interval 1 month"))).alias("month"))
    return months.select("month", F.concat(F.lit(base), F.lower(F.date_format("month", "MMM.yyyy"))).alias("url"))


def parse_date(text: Column, year: Column) -> Column:
    """``Mon D`` and a year as a date, null where that is none."""
    return F.to_date(F.try_to_timestamp(F.concat_ws(" ", F.regexp_replace(F.trim(text), r"\s+", " "), year.cast("string")), F.lit("MMM d yyyy")))


def impact(css: Column) -> Column:
    out = F.lit("N/A")
    for name, word in reversed(IMPACT.items()):
        out = F.when(F.array_contains(F.split(css, r"\s+"), name), word).otherwise(out)
    return out


def calendar_rows(pages: DataFrame) -> DataFrame:
    """Rows of the table in ``pages(page_id, year, html)``; date and time carry forward from row to row of a page.

    A time carries forward within its date only; a page of a month is the unit,
    so the window over a page is bounded by a month's events.
    """
    rows = pages.select("page_id", "year", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?s)<tr\b[^>]*>.*?</tr>"), F.lit(0))).alias("row", "tr"))
    head = F.regexp_extract("tr", r"^<tr\b[^>]*>", 0)
    text = lambda c: F.trim(F.regexp_replace(c, r"<[^>]*>", ""))
    cell = lambda name: F.regexp_extract("tr", rf'(?s)<td[^>]*class="[^"]*calendar__{name}[^"]*"[^>]*>(.*?)</td>', 1)
    stamp = F.regexp_extract(head, r'data-day-dateline="(\d+)"', 1).try_cast("long")
    breaker = head.contains("calendar__row--day-breaker")
    said = F.when(breaker, parse_date(text(F.regexp_extract("tr", r"(?s)<span[^>]*>(.*?)</span>", 1)), F.col("year"))).otherwise(F.to_date(F.timestamp_seconds(stamp)))
    o = Window.partitionBy("page_id").orderBy("row")
    rows = rows.select("page_id", "row", "tr", breaker.alias("breaker"), head.contains("calendar__row--").alias("event_row"), F.last(said, True).over(o).alias("date"), text(cell("time")).alias("own_time"))
    day = Window.partitionBy("page_id", "date").orderBy("row")
    time = F.coalesce(F.last(F.when((F.col("own_time") != "") & ~F.col("breaker"), F.col("own_time")), True).over(day), F.lit("N/A"))
    rows = rows.withColumn("time", time).where("event_row and not breaker")
    css = F.regexp_extract(cell("impact"), r'<span[^>]*class="([^"]*)"', 1)
    return rows.select("page_id", "row", "date", "time", text(cell("currency")).alias("currency"), impact(css).alias("impact"), *[text(cell(c)).alias(c) for c in ("event", "actual", "forecast", "previous")])


def calendar_filter(rows: DataFrame, currency: str = "USD", level: str = "High") -> DataFrame:
    full = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("actual", "forecast", "previous")]
    return rows.where((F.col("currency") == currency) & (F.col("impact") == level) & full[0] & full[1] & full[2])
