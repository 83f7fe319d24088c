"""Shared plumbing: the durable folder, table loading, skew-proof lookups, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key is hot when it holds at least 1/HOT_SHARE of the rows, so there are at most HOT_SHARE hot keys.
HOT_SHARE = 1000
#: Keys with fewer rows than this are never worth separating.
HOT_MIN_ROWS = 256
#: Bytes of a batch of rows for a Python worker, about; a longer row is a batch of its own.
BATCH_BYTES = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session (tests) gets a temporary folder, kept for
    the session; a cluster session is refused, since its disks are not shared.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="tickloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cut lineage that outlives executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more; all that was made of them must be written itself."""
    for df in tables:
        if path := getattr(df, "_written_to", None):
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets the driver collect what steps that are written have left: plans, broadcast tables, and with them shuffle files.

    Spark drops these only when the driver happens to collect its garbage, and with
    hundreds of small jobs the heap grows to its limit before that.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile goes to Python workers in batches of ``BATCH_BYTES``, or of the session's own bound if that is less.

    By Spark's bounds (10,000 rows, 64 MB) a task's share of texts is one batch,
    and the executor and its workers hold it in several forms at once.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    own = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before))
    spark.conf.set(key, min(own, BATCH_BYTES) if own > 0 else BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def thrifty(kernel: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``kernel`` for ``mapInArrow`` after which the worker gives the memory it has freed back to the system.

    A worker lives on for the tasks of other stages, and what its allocators keep
    counts towards the executor's memory all that time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from kernel(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def lookup(rows: DataFrame, facts: DataFrame, key: list[str], n_rows: int, spread: str, count: str = "n", share: int = HOT_SHARE) -> DataFrame:
    """Left join of ``rows`` with ``facts`` (one row per key, ``count`` its number of rows) that no hot key slows.

    Keys that hold 1/share of ``n_rows`` or more number ``share`` at most,
    so their facts are broadcast whatever the input's size; all other keys go
    through a shuffled join.  Rows of hot and null keys pass that join too, dealt
    by the column ``spread`` instead of their key, so the input is read once.
    The zero that cold keys carry is computed from their count: a literal would
    be folded out of the join's keys, and hot rows would meet in one task again.
    """
    least = max(HOT_MIN_ROWS, n_rows // share)
    names = [c for c in facts.columns if c not in key]
    hot = facts.where(F.col(count) >= least).select(*[F.col(k).alias(f"_h_{k}") for k in key], F.struct(*names).alias("_hot"))
    cold = facts.where(F.col(count) < least).select(*[F.col(k).alias(f"_c_{k}") for k in key], F.pmod(F.col(count), F.lit(1)).cast("long").alias("_c_s"), F.struct(*names).alias("_cold"))
    same = lambda p: [F.col(k) == F.col(f"_{p}_{k}") for k in key]
    marked = rows.join(F.broadcast(hot), same("h"), "left").drop(*[f"_h_{k}" for k in key])
    alone = F.col("_hot").isNotNull()
    for k in key:
        alone = alone | F.col(k).isNull()
    marked = marked.withColumn("_s", F.when(alone, F.xxhash64(spread).bitwiseOR(F.lit(1).cast("long"))).otherwise(F.lit(0)).cast("long"))
    both = marked.join(cold, [*same("c"), F.col("_s") == F.col("_c_s")], "left")
    return both.select(*rows.columns, *[F.coalesce(F.col(f"_hot.{c}"), F.col(f"_cold.{c}")).alias(c) for c in names])


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` (long): ``node, comp`` with comp the smallest node, for every node of an edge.

    Alternating large-star and small-star: each round is two aggregations, the
    rounds grow with the logarithm of the size, and every round is written to
    the shared folder so a lost executor costs one round.  Stars hang off the
    smallest neighbour by way of a grouped minimum and a join, never a
    collected neighbour list, so a component of any size stays spread.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "cc")
    for _ in range(most_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        # large star: larger neighbours of u hang off u's smallest neighbour
        rows = 2 * e.count()
        large = lookup(both.where("v > u"), low, ["u"], rows, "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        # small star: smaller neighbours of u, and u, hang off the smallest of them
        large = materialize(large, "cc")
        low2 = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = lookup(large, low2, ["u"], rows, "v").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.unionAll(low2.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "cc")
        # star forest: each u once, and no centre hangs off another
        twice = new.groupBy("u").agg(F.count("*").alias("k")).where("k > 1").limit(1)
        chained = new.select(F.col("v").alias("u")).join(new.select("u"), "u", "left_semi").select("u").limit(1)
        forget(e, large)
        e = new
        if not twice.select("u").unionAll(chained).take(1):
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionAll(
        e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    )
