import math
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tickloom.functions import series, tiling
from tickloom.functions.schema import TICKS
from tickloom.operators import cleaning, features
from tickloom.sources import ticks as source

START = datetime(2024, 1, 2, 9, 30)


def made(spark, prices, volumes=None, symbol="a", step=1.0):
    rows = [(symbol, START + timedelta(seconds=i * step), p, float(volumes[i] if volumes else 1), i) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "symbol string, ts timestamp, price double, volume double, order_key long")


def test_ieee_div(spark):
    row = spark.range(1).select(*[series.ieee_div(F.lit(a), F.lit(b)).alias(n) for n, a, b in (("p", 1.0, 0.0), ("m", -1.0, 0.0), ("z", 0.0, 0.0), ("q", 1.0, 2.0))]).first()
    assert row["p"] == math.inf and row["m"] == -math.inf and row["z"] is None and row["q"] == 0.5


def test_rolling_agrees_with_pandas(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(100, 5, 300).tolist()
    got = cleaning.rolling_mad(made(spark, x)).orderBy("order_key").toPandas()
    p = pd.Series(x)
    med = p.rolling(50, center=True, min_periods=3).median()
    mad = (p - med).abs().rolling(50, center=True, min_periods=3).median() * 1.4826
    np.testing.assert_allclose(got["rolling_median"], med)
    np.testing.assert_allclose(got["mad_adjusted"], mad)
    np.testing.assert_allclose(got["rolling_std"], p.rolling(20, center=True, min_periods=3).std())


def test_runs_and_histogram(spark):
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate("AAAABAAAA")], "k string, i int, v string")
    assert [r["run_id"] for r in series.with_runs(df, "v", ["k"], ["i"]).orderBy("i").collect()] == [0] * 4 + [1] + [2] * 4
    row = spark.range(1).select(*[series.histogram_bin(F.lit(x), F.lit(0.0), F.lit(h), 4).alias(n) for n, x, h in (("top", 1.0, 1.0), ("low", 0.0, 1.0), ("flat", 0.0, 0.0))]).first()
    assert tuple(row) == (3, 0, 0)


def test_tiles_equal_whole_symbols(spark):
    rng = np.random.default_rng(4)
    df = made(spark, (100 + rng.normal(0, 1, 700).cumsum()).clip(1).tolist()).unionByName(made(spark, rng.normal(50, 1, 90).tolist(), symbol="b"))
    with_pos = tiling.positions(df, TICKS, 5)
    plain = series.positioned(df, TICKS.order())
    assert with_pos.select("symbol", "order_key", "pos").exceptAll(plain.select("symbol", "order_key", F.col("pos").cast("bigint"))).count() == 0
    run = lambda d, s: features.realized_vol(features.base(d, s), s, (10, 50))
    cols = ["symbol", "order_key", "realized_vol_50", "abs_return_10"]
    whole = run(plain, TICKS).select(*cols).toPandas().sort_values(cols[:2]).reset_index(drop=True)
    tiles = tiling.tiled(with_pos, TICKS, 100, 60, 1, run).select(*cols).toPandas().sort_values(cols[:2]).reset_index(drop=True)
    assert len(whole) == len(tiles)
    np.testing.assert_allclose(whole["realized_vol_50"], tiles["realized_vol_50"], rtol=1e-9)


def test_csv_round_trip_and_usable(spark, tmp_path):
    df = made(spark, [1.0, float("nan"), -2.0, 3.0]).withColumn("volatility", F.lit(0.1)).drop("order_key")
    source.write(df, str(tmp_path / "t"), "csv")
    back = source.read_csv(spark, str(tmp_path / "t"))
    assert back.count() == 4 and sorted(r["price"] for r in source.usable(back).collect()) == [1.0, 3.0]
