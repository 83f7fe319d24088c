import inspect
import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.functions import kernels
from tickloom.operators import calendar, features, infotheory, regimes, runs, simulate, topology, volatility
from tickloom.plans import queries

from test_series import made


def test_constant_returns_have_floor_volatility(spark):
    got = volatility.mle_volatility(made(spark, [100.0] * 60)).agg(F.min("mle_vol"), F.max("mle_vol")).first()
    assert tuple(got) == (pytest.approx(1e-10), pytest.approx(1e-10))


def test_short_symbols_stay_zero(spark):
    assert volatility.mle_volatility(made(spark, [1.0, 2.0])).agg(F.max("mle_vol")).first()[0] == 0.0
    assert volatility.fourier_volatility(made(spark, [1.0, 2.0])).agg(F.max("fourier_vol")).first()[0] == 0.0
    assert volatility.banded_vol(made(spark, [1.0, 2.0])).count() == 2


def test_spectrogram_of_a_tone_peaks_at_it():
    x = np.sin(2 * np.pi * 0.125 * np.arange(1024))
    power = kernels.spectrogram(x, 128, 64)
    assert (power.argmax(axis=0) == 16).all() and power.shape[0] == 65


def test_ewma_volatility():
    r = np.random.default_rng(0).normal(size=50)
    w = (1 - 2 / 21) ** np.arange(50)[::-1]
    assert kernels.ewma_volatility(r, 20)[-1] == pytest.approx(math.sqrt((w * r * r).sum() / w.sum()))
    assert np.isnan(kernels.ewma_volatility(r, 20)[:9]).all()


def test_feature_names_are_there_and_distinct(spark):
    df = features.all_features(made(spark, (100 + np.random.default_rng(2).normal(size=130)).tolist()).withColumn("volatility", F.lit(0.5)))
    names = features.feature_names()
    assert len(names) == len(set(names)) == 45 and set(names) <= set(df.columns)
    assert df.select(*names).count() == 130


def test_fill_chain_and_dropped_features(spark):
    df = made(spark, [1.0, 2.0, 3.0]).withColumn("x", F.when(F.col("order_key") == 1, float("inf")).when(F.col("order_key") == 2, 5.0))
    assert [r["x"] for r in features.fill_chain(df, "x").orderBy("order_key").collect()] == [5.0, 5.0, 5.0]
    assert features.kept_features(df, ["x", "price"]) == ["price"]


def test_information_measures(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 4, 4000)
    rows = [(i, float(a[i]), float(a[i]), float(rng.integers(0, 4)), float(a[i - 1])) for i in range(1, 4000)]
    df = spark.createDataFrame(rows, "row_id long, a double, same double, noise double, late double")
    long = infotheory.unpivot(df, "row_id", ["a", "same", "noise", "late"])
    h = {r["feature"]: r["h"] for r in infotheory.entropy(long, 4).collect()}
    mi = {(r["fi"], r["fj"]): r["mi"] for r in infotheory.mutual_information(long, 4).collect()}
    assert h["a"] == pytest.approx(math.log(4), abs=0.01) and mi["a", "same"] == pytest.approx(h["a"]) and 0 <= mi["a", "noise"] < 0.01
    te = {(r["src"], r["dst"]): r["te"] for r in infotheory.transfer_entropy(long, 4).collect()}
    assert te["a", "late"] > 1.3 and te["noise", "a"] < 0.02 and min(te.values()) >= 0
    chosen = infotheory.greedy_select(spark.createDataFrame([("a", 1.0), ("same", 0.9), ("noise", 0.6)], "feature string, score double"), spark.createDataFrame([("a", "same", 1.0)], "fi string, fj string, redundancy double"), 2)
    assert chosen == ["a", "noise"]


def circle(n):
    t = 2 * np.pi * np.arange(n) / n
    p = np.c_[np.cos(t), np.sin(t)]
    return np.sqrt(((p[:, None] - p[None]) ** 2).sum(-1))


def test_persistence_of_simple_shapes():
    d = circle(12)
    found = kernels.persistence(kernels.simplices(d, 1.8), 0.01)
    loops = [x for x in found if x[0] == 1]
    assert len(loops) == 1 and loops[0][2] - loops[0][1] > 0.8
    assert sum(1 for x in found if x[0] == 0 and x[2] == math.inf) == 1
    two = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 1], [9, 9, 1, 0.0]])
    assert sum(1 for x in kernels.persistence(kernels.simplices(two, 2.0)) if x[2] == math.inf) == 2
    same = np.zeros((2, 2))
    assert kernels.persistence(kernels.simplices(same, 1.0)) == [(0, 0.0, math.inf)]


def test_path_homology_of_triangle_and_cycle(spark):
    cycle = [(0, 0, 1), (0, 1, 2), (0, 2, 3), (0, 3, 0)]
    triangle = [(1, 0, 1), (1, 1, 2), (1, 0, 2)]
    got = {(r["win"], r["dim"]): r["betti"] for r in topology.path_betti(spark.createDataFrame(cycle + triangle, "win int, src long, dst long"), 1).collect()}
    assert got == {(0, 0): 1, (0, 1): 1, (1, 0): 1, (1, 1): 0}


def test_paths_have_no_repeats(spark):
    e = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 1, 2)], "win int, src long, dst long")
    assert sorted(tuple(r["path"]) for r in topology.paths(e, 3).collect()) == [(0, 1), (0, 1, 2), (1, 0), (1, 2)]


def test_mapper_finds_segments(spark):
    rng = np.random.default_rng(42)
    rows = [(i, float(level + rng.normal() * 0.01), float(level)) for i, level in enumerate(np.repeat([0.1, 0.5, 0.1, 0.5, 0.3], 100))]
    nodes, links = topology.mapper_graph(spark.createDataFrame(rows, "pos long, y double, x double"), 10, 0.3, 0.1)
    assert nodes.count() >= 3 and nodes.agg(F.sum("n")).first()[0] >= 500 and links.count() >= 0


def labelled(spark, text, confidence=1.0):
    return spark.createDataFrame([("s", i, ord(c), confidence, float(i % 3)) for i, c in enumerate(text)], "series string, pos long, regime int, confidence double, x double")


@pytest.mark.parametrize("text,want", [("AAAABAAAA", "AAAAAAAAA"), ("AAAA", "AAAA"), ("B", "B"), ("AABBBB", "BBBBBB")])
def test_smoothing(spark, text, want):
    for out in (runs.smooth(labelled(spark, text), 3), runs.rsip_smooth(labelled(spark, text), ["x"], 3)):
        assert "".join(chr(r["smoothed"]) for r in out.orderBy("pos").collect()) == want


def test_run_statistics(spark):
    x = labelled(spark, "AABAB")
    p = {(r["src"], r["dst"]): r["p"] for r in runs.transition_matrix(x).collect()}
    assert p[65, 65] == pytest.approx(1 / 3) and sum(v for (a, _), v in p.items() if a == 65) == pytest.approx(1)
    assert runs.regime_runs(x).agg(F.sum("length")).first()[0] == 5


def test_js_distance_matches_kernel(spark):
    rng = np.random.default_rng(6)
    a, b = rng.normal(size=80), rng.normal(1, 1, 60)
    frame = lambda v: spark.createDataFrame([("k", float(x)) for x in v], "k string, x double")
    assert runs.js_distance(frame(a), frame(b), "x", ["k"]).first()["js"] == pytest.approx(runs._js(a, b), abs=1e-9)


def test_regime_models(spark):
    rng = np.random.default_rng(42)
    rows = [(i, float(k + rng.normal() * 0.05), float(-k), k if i < 400 else None) for i, k in enumerate(np.repeat([0, 1, 0, 2, 1], 100).tolist())]
    df = spark.createDataFrame(rows, "pos long, a double, b double, regime int")
    model = regimes.RegimeModel.fit(df.where("regime is not null"), ["a", "b"])
    again = regimes.RegimeModel.from_json(model.to_json()).transform(df, "pos")
    assert again.where("pos >= 400 and regime = 1").count() == 100
    near = regimes.nearest_centroid(df, regimes.centroids(df, ["a", "b"]), ["a", "b"], "pos")
    assert near.where("pos < 100 and regime = 0 and confidence > 1").count() == 100
    labels, held = regimes.extend_regimes(df, ["a", "b"], "pos")
    assert labels.count() == 500 and 0 <= held <= 1
    assert regimes.gmm_regimes(df, ["a", "b"], "pos", 3, restarts=1).count() == 500


def test_simulation_is_seeded(spark):
    a = simulate.efficient_price(spark, 300, 2, seed=3)
    assert a.toPandas().equals(simulate.efficient_price(spark, 300, 2, seed=3).toPandas()) and a.count() == 602
    q = simulate.quotes(a.withColumn("bid_noise", F.lit(-3.0)).withColumn("ask_noise", F.lit(-3.0)))
    assert q.where("bid >= ask").count() == 0
    assert simulate.arrivals(spark, 100).where("event").count() > 50
    children = simulate.child_orders(spark, q, rate=0.2)
    assert children.count() > 0 and children.where("size <= 0").count() == 0
    assert simulate.child_orders(spark, q, rate=0.0).count() == 0
    makers = simulate.maker_quotes(q, 2)
    assert makers.where("action = 'place'").count() >= makers.where("action = 'cancel'").count()


def test_calendar(spark):
    bad = spark.createDataFrame([("Feb 30", 2024), ("Feb 29", 2024), ("Jan  3", 2025), (None, 2025), ("x", 2025)], "t string, y int")
    assert [str(r[0]) for r in bad.select(calendar.parse_date(F.col("t"), F.col("y"))).collect()] == ["None", "2024-02-29", "2025-01-03", "None", "None"]
    urls = [r["url"] for r in calendar.month_urls(spark, "u?", "2024-12", "2025-02").collect()]
    assert urls == ["u?dec.2024", "u?jan.2025", "u?feb.2025"]
    empty = calendar.calendar_rows(spark.createDataFrame([(1, 2024, None), (2, 2024, "")], "page_id long, year int, html string"))
    assert empty.count() == 0


def test_calendar_rows_carry_date_and_time(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["calendar_rows"](spark, "").orderBy("row").collect()
    assert [(r["date"], r["time"], r["impact"], r["event"]) for r in got] == [("2025-01-03", "8:30am", "High", "Jobs"), ("2025-01-03", "8:30am", "Medium", "Rate"), ("2025-01-04", "N/A", "N/A", "Sales")]


def test_all_components_of_a_vector_count(spark, monkeypatch):
    """Classes that differ in component 40 only are told apart by the registered queries."""
    rng = np.random.default_rng(3)
    data = []
    for i in range(240):
        v, label = rng.normal(size=64), int(rng.integers(0, 4))
        v[39] += 40 * label
        data.append((i, i / 240, v.tolist(), 0.0, label))
    given = spark.createDataFrame(data, "pos long, t double, v array<double>, y double, label int")
    monkeypatch.setattr(queries, "points", lambda s, d: given)
    label = {r[0]: r[4] for r in data}
    near = queries.QUERIES["nearest_centroid_all"](spark, "").collect()
    assert all(r["regime"] == label[r["pos"]] for r in near)
    extended = queries.QUERIES["extend_regimes"](spark, "").collect()
    assert np.mean([r["regime"] == label[r["pos"]] for r in extended]) > 0.9


def test_mixture_of_many_dimensions_has_classes(spark):
    rng = np.random.default_rng(4)
    data = [(i, *(rng.normal(size=64) + 4 * (i % 2)).tolist()) for i in range(600)]
    names = [f"f{i}" for i in range(64)]
    df = spark.createDataFrame(data, ["pos", *names])
    got = regimes.gmm_regimes(df, names, "pos", k=2, restarts=1).collect()
    share = np.mean([r["regime"] == r["pos"] % 2 for r in got])
    assert max(share, 1 - share) > 0.95


@pytest.mark.parametrize("name,module", [("path_betti", topology), ("min_run_length", runs), ("gmm_regimes", regimes)])
def test_queries_run_with_the_defaults_of_their_operators(spark, monkeypatch, name, module):
    operator, given = getattr(module, name), {}

    def noted(*args, **more):
        given.update(inspect.signature(operator).bind(*args, **more).arguments)
        return operator(*args, **more)

    monkeypatch.setattr(module, name, noted)
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    plain = {k: p.default for k, p in inspect.signature(operator).parameters.items() if p.default is not p.empty}
    assert given and all(given.get(k, v) == v for k, v in plain.items())
    if name == "path_betti":
        assert {r["dim"] for r in out.select("dim").distinct().collect()} == {0, 1, 2}


def test_min_run_length_equals_permutations(spark):
    """Run lengths of shuffled labels, gathered over many draws; two series of uneven labels."""
    rng = np.random.default_rng(4)
    series = {"a": np.repeat([0, 1], [260, 40]), "b": np.repeat([0, 1, 2], [30, 30, 30])}
    found = []
    for x in series.values():
        for _ in range(1000):
            y = rng.permutation(x)
            found += np.diff(np.append(np.flatnonzero(np.append(True, y[1:] != y[:-1])), len(y))).tolist()
    want = max(sorted(found)[int(0.95 * len(found))] + 1, 3)
    rows = [(k, i, int(v)) for k, x in series.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "series string, pos int, regime int")
    assert runs.min_run_length(df) == want > 3
    assert runs.min_run_length(df.where("false")) == 3
    alone = spark.createDataFrame([("a", i, 1) for i in range(10_000)], "series string, pos int, regime int")
    assert runs.min_run_length(alone) == 10_001


def test_kl_weight_of_a_row_is_that_of_its_stretch(spark):
    df = spark.createDataFrame([(i, 2.0) for i in range(30)], "row_id long, x double")
    kl = spark.createDataFrame([(10, 1.0), (20, 3.0)], "pos long, kl double")
    got = {r["row_id"]: r["x_kl_weighted"] for r in infotheory.kl_weighted(df, {"x": kl}, "row_id", 10).collect()}
    assert got[5] == 2.0 and got[19] == pytest.approx(2 * (1 + math.log(2))) and got[20] == pytest.approx(2 * (1 + math.log(4)))


def _dense_rank2(rows, width):
    m, rank = np.zeros((len(rows), width), bool), 0
    for r, row in enumerate(rows):
        m[r, list(row)] = True
    for c in range(width):
        ones = rank + np.flatnonzero(m[rank:, c])
        if len(ones):
            m[[rank, ones[0]]] = m[[ones[0], rank]]
            below = rank + 1 + np.flatnonzero(m[rank + 1 :, c])
            m[below] ^= m[rank]
            rank += 1
    return rank


def test_rank_over_two_elements_equals_elimination():
    rng = np.random.default_rng(8)
    for _ in range(60):
        width = int(rng.integers(1, 25))
        rows = [set(rng.integers(0, width, int(rng.integers(0, 6))).tolist()) for _ in range(int(rng.integers(0, 30)))]
        assert kernels.rank2(rows) == _dense_rank2(rows, width)
    assert kernels.rank2([]) == 0


def test_path_homology_of_many_paths_takes_memory_by_their_faces(spark):
    """A window of 26 equal points: 14,950 paths of three edges, which a row for each path over all faces would make 39 MB; and a window of two such groups."""
    group = lambda win, at: [(win, at + i, at + j) for i in range(26) for j in range(i + 1, 26)]
    edges = spark.createDataFrame(group(0, 0) + group(1, 0) + group(1, 50), "win int, src long, dst long").toPandas()
    run, tracked = [], []

    class Edges:
        def select(self, *_):
            return self

        groupBy = select

        def applyInPandas(self, f, schema):
            for _, pdf in edges.groupby("win"):
                tracemalloc.start()
                run.append(f(pdf))
                tracked.append(tracemalloc.get_traced_memory()[1])
                tracemalloc.stop()

    topology.path_betti(Edges())
    got = {(int(r.win), int(r.dim)): int(r.betti) for pdf in run for r in pdf.itertuples()}
    assert got == {(0, 0): 1, (0, 1): 0, (0, 2): 0, (1, 0): 2, (1, 1): 0, (1, 2): 0}
    assert tracked[0] < 60e6


def test_windows_of_points_are_dealt_out(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dist = queries._dist(spark, "/root/testdata/sf0.001")
        assert dist.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
