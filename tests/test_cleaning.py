import os
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tickloom.functions import kernels
from tickloom.operators import cleaning

from test_series import made


def flagged(spark, prices, volumes=None):
    return cleaning.flag_outliers(made(spark, prices, volumes)).orderBy("order_key").toPandas()


def test_constant_prices_have_no_outliers(spark):
    got = flagged(spark, [100.0] * 150)
    assert not got["is_outlier"].any() and got["z_score"].isna().all()


def test_single_spike_is_found_and_counted(spark):
    prices = [100 + 0.01 * (i % 7) for i in range(150)]
    prices[75] = 110.0
    got = flagged(spark, prices)
    assert got["is_outlier"][75] and got["extreme_outlier"][75] and got["isolated_local"][75]
    counts = cleaning.outlier_counts(cleaning.flag_outliers(made(spark, prices))).first()
    assert counts["n"] == 150 and counts["is_outlier"] >= 1


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_counts_hold_rows_that_only_the_wavelet_flags(spark):
    of = lambda name: entry.queries()[name](spark, DATA).toPandas().set_index("order_key")
    t = entry.ticks(spark, DATA).toPandas().sort_values(["symbol", "ts", "order_key"]).set_index("order_key")
    t = t.join(of("robust_zscore")[["z_score"]]).join(of("price_change")[["pct"]])
    smooth = t.groupby("symbol")["price"].transform(lambda x: kernels.smooth_detail(x.to_numpy()) if len(x) > 100 else x)
    t["wavelet"] = (((t["price"] - smooth) / t["price"]).abs() > 0.005) & ((t["z_score"].abs() > 2.1) | (t["pct"].abs() > 0.8))
    t["any"] = t["wavelet"]
    for name in ("flag_zscore", "flag_extreme", "flag_isolated_stat", "flag_isolated_local", "flag_reversal"):
        t["any"] |= of(name).iloc[:, 0] == 1
    want = t.groupby("symbol").agg(n=("price", "size"), wavelet_outlier=("wavelet", "sum"), is_outlier=("any", "sum"))
    got = entry.queries()["outlier_counts"](spark, DATA).toPandas().set_index("symbol")
    assert want["wavelet_outlier"].sum() > 0 and (got[list(want.columns)].sort_index() == want.sort_index()).all(axis=None)


def test_zero_prices_are_counted(spark):
    prices = [100 + 0.01 * (i % 7) for i in range(150)]
    prices[75] = 0.0
    got = cleaning.outlier_counts(cleaning.flag_outliers(made(spark, prices))).first()
    assert got["n"] == 150 and got["is_outlier"] >= 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["robust_zscore", "flag_zscore", "flag_reversal", "outlier_counts_sql", "flag_timestamp_group", "flag_velocity", "collapse_suspicious_cluster", "vwap", "log_returns", "all_features", "null_profile"])
def test_zero_prices_and_volumes_equal_oracle(spark, tmp_path, name):
    """Zero prices, alone and in a row, and zero volumes in the middle of every symbol."""
    e = spark.read.parquet(f"{DATA}/events.parquet")
    at = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    e = e.withColumn("_at", at).withColumn("value", F.when(F.col("_at").isin(1, 40, 41, 90, 120), 0.0).otherwise(F.col("value")))
    e = e.withColumn("props", F.when(F.col("_at").between(60, 75), '{"k": -1}').otherwise(F.col("props"))).drop("_at")
    e.coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    a, b = entry.queries()[name](spark, str(tmp_path)).toPandas(), con.execute(entry.oracle_sql()[name]).df()
    order = [c for c in sorted(a.columns) if a[c].dtype.kind != "f"] + [c for c in sorted(a.columns) if a[c].dtype.kind == "f"]
    a, b = (x[order].sort_values(order).reset_index(drop=True) for x in (a, b))
    for c in order:
        if a[c].dtype.kind == "f":
            np.testing.assert_allclose(a[c].to_numpy(float), b[c].to_numpy(float), atol=2e-6, err_msg=c)
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c


def test_reversal_marks_its_span(spark):
    got = flagged(spark, [100.0] * 10 + [102.0, 99.0] + [100.0] * 10)
    assert got["reversal_outlier"][9] and got["reversal_outlier"][10] and not got["reversal_outlier"][3]


def test_null_zero_and_short_symbols_do_not_fail(spark):
    df = made(spark, [None, 1.0, 2.0], [0, 0, 0]).unionByName(made(spark, [5.0], symbol="one"))
    clean, full = cleaning.clean_ticks(df)
    assert full.count() <= 4 and "volatility" in clean.columns


def test_empty_table(spark):
    clean, _ = cleaning.clean_ticks(made(spark, [1.0]).where("false"))
    assert clean.count() == 0


def test_timestamp_group_keeps_the_largest_volume(spark):
    df = made(spark, [100.0, 103.0, 101.0], [1, 5, 2], step=0.0)
    got = cleaning.flag_timestamp_group(cleaning.seconds_from_open(df)).orderBy("order_key").collect()
    assert [r["timestamp_group"] for r in got] == [True, False, True]


def test_cluster_collapses_to_one_tick(spark):
    at = datetime(2024, 1, 2, 10)
    rows = [("a", at + timedelta(milliseconds=10 * i), 100.0 + i, float(i + 1), i, i < 7) for i in range(9)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, price double, volume double, order_key long, is_suspicious boolean")
    got = cleaning.collapse_clusters(df).orderBy("order_key").collect()
    vwap = sum((100 + i) * (i + 1) for i in range(7)) / sum(range(1, 8))
    assert abs(got[0]["price"] - vwap) < 1e-9 and not got[0]["is_suspicious"]
    assert all(r["in_cluster"] and r["is_suspicious"] for r in got[1:7]) and not got[7]["in_cluster"]


def test_wavelet_reconstructs_and_removes_detail():
    rng = np.random.default_rng(1)
    for n in (101, 128, 333):
        x = rng.normal(size=n)
        low, high = kernels.dwt(x)
        assert len(low) == len(high) == (n + 7) // 2
        np.testing.assert_allclose(kernels.waverec(kernels.wavedec(x))[:n], x, atol=1e-9)
    np.testing.assert_allclose(kernels.smooth_detail(np.full(200, 3.0)), 3.0, atol=1e-9)


def test_market_hours(spark):
    rows = [(datetime(2024, 1, 2, h, m),) for h, m in ((9, 29), (9, 30), (15, 59), (16, 0))]
    got = cleaning.market_hours(spark.createDataFrame(rows, "ts timestamp"))
    assert sorted((r["ts"].hour, r["ts"].minute) for r in got.collect()) == [(9, 30), (15, 59)]


def test_window_plan_sorts_a_symbol_once(spark):
    plan = cleaning.default_volatility(made(spark, [1.0, 2.0])).select(F.col("volatility"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_price_change_rounds_halves_as_its_sql(spark, tmp_path):
    """Changes from a price of 0 whose seventh decimal is a 5, and the numbers next to them."""
    half = (2 * np.random.default_rng(5).integers(0, 10**9, 2000) + 1) / 2e6
    prices = [x for h in half for x in (h, 0.0, np.nextafter(h, 0), 0.0, np.nextafter(h, np.inf), 0.0)] + [1e300, 0.0, 5e-324, 1e-9]
    rows = [(i, datetime(2024, 1, 2) + timedelta(seconds=i), "a", float(p), '{"k": 1}') for i, p in enumerate(prices)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, event_type string, value double, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = entry.queries()["price_change"](spark, str(tmp_path)).toPandas().set_index("order_key").sort_index()
    want = con.execute(entry.oracle_sql()["price_change"]).df().set_index("order_key").sort_index()
    assert len(got) == len(prices) and got.equals(want[got.columns])
