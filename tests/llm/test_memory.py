import re
from pathlib import Path

import psutil
import pyarrow as pa
import pytest

from helpers import DOCS, docs, rows
from test_joins import FIVE, brute, corpus
from tickloom.llm import common, jaccard

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def workers_mb():
    """What the Python workers of the session hold, without mapped files."""
    total = 0
    for p in psutil.Process().children(recursive=True):
        try:
            if "pyspark.daemon" in " ".join(p.cmdline()):
                total += int(re.search(r"Pss_Anon:\s+(\d+)", Path(f"/proc/{p.pid}/smaps_rollup").read_text())[1])
        except (OSError, psutil.Error):
            pass
    return total / 1024


def long_texts(spark, n):
    """One task's rows: ``n`` texts of 500 words, all different."""
    return spark.range(0, n, 1, 1).selectExpr("id doc_id", "array_join(transform(sequence(1, 500), i -> hex(xxhash64(id, i))), ' ') text")


@pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="memory of other processes is read from /proc")
def test_workers_keep_no_memory_of_their_tasks(spark):
    ids = spark.range(0, 6000).selectExpr("id node")
    jaccard.sets_of(long_texts(spark, 10), ids, FIVE)
    before = workers_mb()
    jaccard.sets_of(long_texts(spark, 6000), ids, FIVE)
    assert workers_mb() - before < 40


def test_batches_of_the_join_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(jaccard, "materialize", lambda df, tag, real=common.materialize: seen.append(int(spark.conf.get(BOUND).rstrip("b"))) or real(df, tag))
    before = spark.conf.get(BOUND)
    jaccard.join(docs(spark, corpus(30, 5)), FIVE).collect()
    assert seen and max(seen) <= common.BATCH_BYTES
    assert spark.conf.get(BOUND) == before


def test_small_batches(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    before = spark.conf.get(BOUND)
    with common.small_batches(spark):
        assert max(r["n"] for r in long_texts(spark, 1000).mapInArrow(sizes, "n long").collect()) < 1.5 * common.BATCH_BYTES
    with pytest.raises(KeyError), common.small_batches(spark):
        raise KeyError
    assert spark.conf.get(BOUND) == before
    spark.conf.set(BOUND, "64k")  # a lower bound of the session stays
    try:
        with common.small_batches(spark):
            assert int(spark.conf.get(BOUND)) == 1 << 16
        assert spark.conf.get(BOUND) == "64k"
    finally:
        spark.conf.set(BOUND, before)


def test_texts_longer_than_a_batch(spark):
    long = " ".join(f"word{i}" for i in range(300_000))
    assert len(long) > common.BATCH_BYTES
    source = list(enumerate([long, long + " end", "a b c d e f", None, "", long.upper(), "a b c d e f"]))
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in source], DOCS).coalesce(1)
    assert rows(jaccard.join(df, FIVE), "doc_id", "n_shingles", "component_id") == brute(source, FIVE)
