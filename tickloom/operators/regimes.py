"""Regime detection, labelling of new data and its classifier."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Unit of length of the mixture.  Spark adds a fixed 2e-16 to each density, which drowns the densities of many
#: dimensions and makes all classes alike; in a smaller unit they are larger, and the mixture is the same.
UNIT = math.exp(-2)


def robust_scale(df: DataFrame, names: list[str]) -> DataFrame:
    """Less the median, over the interquartile range (1 where that is 0)."""
    stats = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{c}") for c in names])
    spread = lambda c: F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0]
    return df.crossJoin(F.broadcast(stats)).select(*[((F.col(c) - F.col(f"_q_{c}")[1]) / F.when(spread(c) == 0, 1.0).otherwise(spread(c))).alias(c) if c in names else F.col(c) for c in df.columns])


def centroids(df: DataFrame, names: list[str], regime: str = "regime") -> DataFrame:
    return df.where(F.col(regime).isNotNull()).groupBy(regime).agg(*[F.avg(c).alias(c) for c in names])


def nearest_centroid(df: DataFrame, centres: DataFrame, names: list[str], key: str, regime: str = "regime") -> DataFrame:
    """``key, regime, confidence``: nearest centre and the second distance over the first (2 with one centre).

    The centres, one row a regime, are collected and stand as expressions: each
    row is judged by itself, without a join.
    """
    rows = sorted(centres.collect(), key=lambda r: r[regime])
    if not rows:
        return df.select(key, F.lit(None).cast("int").alias("regime"), F.lit(None).cast("double").alias("confidence"))
    away = [F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.lit(r[c]), 2) for c in names])) for r in rows]
    ranked = F.array_sort(F.array(*[F.struct(d.alias("d"), F.lit(r[regime]).alias("regime")) for d, r in zip(away, rows, strict=True)]))
    out = df.select(key, ranked.alias("r"))
    sure = F.col("r")[1]["d"] / (F.col("r")[0]["d"] + 1e-10) if len(rows) > 1 else F.lit(2.0)
    return out.select(key, F.col("r")[0]["regime"].alias("regime"), sure.alias("confidence"))


def gmm_regimes(df: DataFrame, names: list[str], pos: str, k: int = 4, time_weight: float = 0.3, restarts: int = 5, seed: int = 11) -> DataFrame:
    """``pos, regime, stability``: mixture over standardised features and time; of the seeded restarts that of least BIC
    times one and the share of switches."""
    stats = df.agg(F.count("*").alias("n"), *[f(c).alias(f"{p}_{c}") for c in names for p, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
    n = stats["n"]
    scaled = [((F.col(c) - stats[f"m_{c}"]) / (stats[f"d_{c}"] or 1.0) * (1 - time_weight) * UNIT).alias(c) for c in names]
    points = df.select(F.col(pos).alias("pos"), *scaled, (F.col(pos) / max(n, 1) * time_weight * UNIT).alias("_time"))
    points = VectorAssembler(inputCols=[*names, "_time"], outputCol="features").transform(points).cache()
    d, best = len(names) + 1, None
    free = k * (d + d * (d + 1) / 2) + k - 1
    for i in range(restarts):
        model = GaussianMixture(k=k, seed=seed + i, maxIter=60).fit(points)
        labels = model.transform(points).select("pos", F.col("prediction").alias("regime"), F.array_max(vector_to_array("probability")).alias("stability"))
        before = F.lag("regime").over(Window.partitionBy().orderBy("pos"))
        switches = labels.select((F.col("regime") != before).cast("int").alias("s")).agg(F.sum("s")).first()[0] or 0
        bic = (free * math.log(max(n, 2)) - 2 * (model.summary.logLikelihood + n * d * math.log(UNIT))) * (1 + switches / max(n, 1))
        if best is None or bic < best[0]:
            best = bic, labels
    return best[1]


def extend_regimes(df: DataFrame, names: list[str], pos: str, train_share: float = 0.8, trees: int = 40, depth: int = 6, seed: int = 11) -> tuple[DataFrame, float]:
    """Labels for all rows from a classifier fitted on the first share of the labelled ones: ``pos, regime, confidence``, and
    its accuracy on the rest of them."""
    rows = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip").transform(df)
    labelled = rows.where("regime is not null").withColumn("label", F.col("regime").cast("double"))
    cut = labelled.agg(F.percentile(pos, train_share)).first()[0]
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(labelled.where(F.col(pos) <= cut))
    held = model.transform(labelled.where(F.col(pos) > cut)).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    out = model.transform(rows).select(F.col(pos).alias("pos"), F.col("prediction").cast("int").alias("regime"), F.array_max(vector_to_array("probability")).alias("confidence"))
    return out, held if held is not None else float("nan")


def blend(probability, stability):
    return 0.7 * probability + 0.3 * stability


class RegimeModel:
    """Fitted state as plain numbers: scaling and centres of the training rows; ``transform`` needs nothing else."""

    def __init__(self, names: list[str], scale: dict[str, tuple[float, float]], centres: list[dict]):
        self.names, self.scale, self.centres = names, scale, centres

    @classmethod
    def fit(cls, df: DataFrame, names: list[str], regime: str = "regime") -> RegimeModel:
        row = df.agg(*[f(c).alias(f"{p}_{c}") for c in names for p, f in (("m", F.avg), ("d", F.stddev_pop))]).first()
        scale = {c: (row[f"m_{c}"], row[f"d_{c}"] or 1.0) for c in names}
        scaled = df.select(regime, *[((F.col(c) - scale[c][0]) / scale[c][1]).alias(c) for c in names])
        return cls(names, scale, [r.asDict() for r in centroids(scaled, names, regime).collect()])

    def transform(self, df: DataFrame, key: str) -> DataFrame:
        """Stateless, so it also serves a stream."""
        scaled = df.select(key, *[((F.col(c) - self.scale[c][0]) / self.scale[c][1]).alias(c) for c in self.names])
        away = [F.sqrt(reduce(lambda a, b: a + b, [F.pow(F.col(c) - F.lit(r[c]), 2) for c in self.names])) for r in self.centres]
        ranked = F.array_sort(F.array(*[F.struct(d.alias("d"), F.lit(r["regime"]).alias("regime")) for d, r in zip(away, self.centres, strict=True)]))
        sure = F.col("_r")[1]["d"] / (F.col("_r")[0]["d"] + 1e-10) if len(self.centres) > 1 else F.lit(2.0)
        return scaled.withColumn("_r", ranked).select(key, F.col("_r")[0]["regime"].alias("regime"), sure.alias("confidence"))

    def to_json(self) -> str:
        import json

        return json.dumps({"names": self.names, "scale": self.scale, "centres": self.centres})

    @classmethod
    def from_json(cls, text: str) -> RegimeModel:
        import json

        x = json.loads(text)
        return cls(x["names"], {k: tuple(v) for k, v in x["scale"].items()}, x["centres"])
