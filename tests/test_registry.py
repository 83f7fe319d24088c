import importlib
import os
import pathlib

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_optional_subpackage():
    for path in (ROOT / "tickloom").rglob("*.py"):
        if "llm" not in path.relative_to(ROOT).parts:
            assert "llm" not in path.read_text(), path


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", ["flag_zscore", "outlier_counts_sql", "min_run_length", "mle_vol", "garman_klass", "mutual_info", "transfer_entropy", "epsilon_graph", "smooth_persistence_pass", "nearest_centroid", "quote_spread"])
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    oracle = importlib.import_module("tickloom.plans.oracles").ORACLES[name]
    a, b = entry.queries()[name](spark, DATA).toPandas(), con.execute(oracle).df()
    assert sorted(a.columns) == sorted(b.columns) and len(a) == len(b)
    order = [c for c in sorted(a.columns) if a[c].dtype.kind != "f"] + [c for c in sorted(a.columns) if a[c].dtype.kind == "f"]
    a, b = (x[order].sort_values(order).reset_index(drop=True) for x in (a, b))
    for c in order:
        if a[c].dtype.kind == "f":
            assert ((a[c] - b[c]).abs().fillna(0) <= 2e-6).all() and (a[c].isna() == b[c].isna()).all(), c
        else:
            assert a[c].astype(str).tolist() == b[c].astype(str).tolist(), c
