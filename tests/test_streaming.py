import numpy as np
from pyspark.sql import functions as F

from test_series import made
from tickloom.operators import cleaning, regimes
from tickloom.streaming import ticks as streaming


def run(stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    rng = np.random.default_rng(1)
    df = made(spark, rng.uniform(90, 110, 120).tolist(), rng.integers(1, 9, 120).tolist())
    for k in range(3):
        df.where((F.col("order_key") >= 40 * k) & (F.col("order_key") < 40 * k + 40)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))

    run(streaming.windowed(stream(), width="1 minute"), "windows", "complete")
    want = df.groupBy(F.window("ts", "1 minute")).count().count()
    assert spark.table("windows").count() == want and spark.table("windows").agg(F.sum("n")).first()[0] == 120

    run(streaming.rolling_volatility(stream()), "rolling")
    batch = cleaning.default_volatility(df).select("order_key", "volatility").toPandas().set_index("order_key")["volatility"]
    live = spark.table("rolling").toPandas().set_index("order_key")["volatility"].sort_index()
    np.testing.assert_allclose(live, batch.sort_index(), rtol=1e-9)

    labelled = df.withColumn("regime", (F.col("price") > 100).cast("int"))
    model = regimes.RegimeModel.fit(labelled, ["price"])
    run(streaming.scored(stream(), model, "order_key"), "scored")
    assert spark.table("scored").join(model.transform(df, "order_key"), ["order_key", "regime"]).count() == 120
