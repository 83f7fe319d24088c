"""Windowed distance graphs, path complexes, persistence and Mapper graphs.

Points(pos, ts_norm, v array, y) are taken in overlapping windows; every pair,
path and simplex stays within its window, so work grows with the number of
windows, whose size is fixed.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.kernels import Forest, persistence, rank2, simplices
from tickloom.operators.volatility import in_windows

SIZE, STEP = 100, 50
ALPHA, BETA = 0.5, 1.0


def windows_of(points: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    return in_windows(points, size, step)


def _pairs(member: DataFrame, columns: list[str]) -> DataFrame:
    side = lambda k: member.select("win", *[F.col(c).alias(f"{c}_{k}") for c in ("pos", *columns)])
    # dealt by window: a broadcast side would leave the pairs in as many tasks as the points have files
    return side("i").join(side("j").hint("merge"), "win").where("pos_i < pos_j")


def temporal_distance(points: DataFrame, norm: int = 2, size: int = SIZE, step: int = STEP, alpha: float = ALPHA, beta: float = BETA) -> DataFrame:
    """``win, i, j, dist``: L2 or L1 distance, grown with the time between (as a share of the whole span)."""
    pair = _pairs(windows_of(points.select("pos", "t", "v"), size, step), ["t", "v"])
    apart = F.zip_with("v_i", "v_j", lambda a, b: a.cast("double") - b.cast("double"))
    add = lambda f: F.aggregate(apart, F.lit(0.0), lambda acc, x: acc + f(x))
    plain = F.sqrt(add(lambda x: x * x)) if norm == 2 else add(F.abs)
    return pair.select("win", F.col("pos_i").alias("i"), F.col("pos_j").alias("j"), (plain * (1 + alpha * (1 - F.exp(-beta * F.abs(F.col("t_j") - F.col("t_i")))))).alias("dist"))


def epsilon_graph(dist: DataFrame, epsilon: float) -> DataFrame:
    """Directed edges forward in time: ``win, src, dst, weight, distance``."""
    return dist.where(F.col("dist") <= epsilon).select("win", F.col("i").alias("src"), F.col("j").alias("dst"), (1 / F.greatest("dist", F.lit(1e-10))).alias("weight"), F.col("dist").alias("distance"))


def knn_graph(dist: DataFrame, k: int) -> DataFrame:
    """``win, src, dst, distance`` to the k nearest points, the smaller position first on ties."""
    both = dist.select("win", F.col("i").alias("src"), F.col("j").alias("dst"), "dist").unionByName(dist.select("win", F.col("j").alias("src"), F.col("i").alias("dst"), "dist"))
    near = F.row_number().over(Window.partitionBy("win", "src").orderBy("dist", "dst"))
    return both.withColumn("_r", near).where(F.col("_r") <= k).select("win", "src", "dst", F.col("dist").alias("distance"))


def paths(edges: DataFrame, k: int) -> DataFrame:
    """``win, k, path``: all simple directed paths of 1 to ``k`` edges."""
    step = edges.select("win", F.col("src").alias("last"), F.col("dst").alias("to"))
    now = edges.select("win", F.array("src", "dst").alias("path"))
    out = now.select("win", F.lit(1).alias("k"), "path")
    for n in range(2, k + 1):
        now = now.withColumn("last", F.element_at("path", -1)).join(step, ["win", "last"]).where(~F.array_contains("path", F.col("to"))).select("win", F.array_append("path", F.col("to")).alias("path"))
        out = out.unionByName(now.select("win", F.lit(n).alias("k"), "path"))
    return out


def path_counts(edges: DataFrame, k: int) -> DataFrame:
    return paths(edges, k).groupBy("win", "k").agg(F.count("*").alias("n"))


def top_paths(edges: DataFrame, points: DataFrame, most: int, least_change: float = 0.05) -> DataFrame:
    """Best two-edge paths of each window by mean edge score: ``win, a, b, c, score, volatile, rank``.

    An edge scores its weight times one and the change of ``y`` along it; half
    of the places are kept for paths with a change above ``least_change``.
    """
    y = points.select("pos", "y")
    e = edges.join(y.select(F.col("pos").alias("src"), F.col("y").alias("y0")), "src").join(y.select(F.col("pos").alias("dst"), F.col("y").alias("y1")), "dst")
    e = e.withColumn("change", F.abs(F.col("y1") - F.col("y0"))).withColumn("s", F.col("weight") * (1 + F.col("change")))
    one = e.select("win", F.col("src").alias("a"), F.col("dst").alias("b"), F.col("s").alias("s1"), F.col("change").alias("c1"))
    two = e.select("win", F.col("src").alias("b"), F.col("dst").alias("c"), F.col("s").alias("s2"), F.col("change").alias("c2"))
    p = one.join(two, ["win", "b"]).where("a <> c").select("win", "a", "b", "c", ((F.col("s1") + F.col("s2")) / 2).alias("score"), (F.greatest("c1", "c2") > least_change).alias("volatile"))
    order = [F.desc(F.round("score", 9)), "a", "b", "c"]
    p = p.withColumn("_own", F.row_number().over(Window.partitionBy("win", "volatile").orderBy(*order)))
    kept = F.col("volatile") & (F.col("_own") <= most // 2)
    p = p.withColumn("rank", F.row_number().over(Window.partitionBy("win").orderBy(F.desc(kept), *order)))
    return p.where(F.col("rank") <= most).drop("_own")


def directed_triangles(edges: DataFrame) -> DataFrame:
    """``win, a, b, c, filtration`` of ordered triangles, by their longest edge."""
    e = lambda x, y, d: edges.select("win", F.col("src").alias(x), F.col("dst").alias(y), F.col("distance").alias(d))
    t = e("a", "b", "d1").join(e("b", "c", "d2"), ["win", "b"]).join(e("a", "c", "d3"), ["win", "a", "c"])
    return t.select("win", "a", "b", "c", F.greatest("d1", "d2", "d3").alias("filtration"))


def network_stats(edges: DataFrame, size: int = SIZE) -> DataFrame:
    """``win, edges, density, mean_degree, max_degree``."""
    ends = edges.select("win", F.col("src").alias("v")).unionByName(edges.select("win", F.col("dst").alias("v"))).groupBy("win", "v").agg(F.count("*").alias("d"))
    degree = ends.groupBy("win").agg(F.sum("d").alias("s"), F.max("d").alias("max_degree"))
    return degree.select("win", (F.col("s") / 2).cast("bigint").alias("edges"), (F.col("s") / (size * (size - 1))).alias("density"), (F.col("s") / size).alias("mean_degree"), "max_degree")


def betti_curve(diagram: DataFrame, lo: float, hi: float, points: int = 100) -> DataFrame:
    """``win, dim, step, betti``: classes alive at each of ``points`` values from lo to hi.  diagram(win, dim, birth, death)."""
    grid = diagram.sparkSession.range(points).select(F.col("id").cast("int").alias("step"), (F.lit(lo) + F.col("id") * ((hi - lo) / (points - 1))).alias("f"))
    keys = diagram.select("win", "dim").distinct().crossJoin(F.broadcast(grid))
    alive = diagram.join(F.broadcast(grid), (F.col("birth") <= F.col("f")) & (F.col("f") < F.col("death"))).groupBy("win", "dim", "step").agg(F.count("*").alias("betti"))
    return keys.join(alive, ["win", "dim", "step"], "left").select("win", "dim", "step", F.coalesce("betti", F.lit(0)).alias("betti"))


def betti_summary(curve: DataFrame) -> DataFrame:
    b = F.col("betti")
    return curve.groupBy("win", "dim").agg(F.avg(b).alias("mean"), F.max(b).alias("most"), F.min(b).alias("least"), F.stddev_pop(b).alias("std"))


def _matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    nodes = np.unique(np.concatenate([pdf["i"], pdf["j"]]))
    a, b = np.searchsorted(nodes, pdf["i"]), np.searchsorted(nodes, pdf["j"])
    out = np.zeros((len(nodes), len(nodes)))
    out[a, b] = out[b, a] = pdf["dist"]
    return nodes, out


def window_persistence(dist: DataFrame, most: float, top: int = 2, least: float = 0.01) -> DataFrame:
    """``win, dim, birth, death`` of the Vietoris-Rips filtration of each window up to edges of ``most``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = persistence(simplices(_matrix(pdf)[1], most, top), least)
        return pd.DataFrame(found, columns=["dim", "birth", "death"]).assign(win=pdf["win"].iloc[0])[["win", "dim", "birth", "death"]]

    return dist.groupBy("win").applyInPandas(run, "win int, dim int, birth double, death double")


def h0_persistence(dist: DataFrame) -> DataFrame:
    """``win, death`` of the components: the edges of a minimum spanning tree."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, d = _matrix(pdf)
        forest, out = Forest(len(nodes)), []
        for x, i, j in sorted((d[i, j], i, j) for i in range(len(nodes)) for j in range(i + 1, len(nodes))):
            if forest.join(i, j):
                out.append(float(x))
        return pd.DataFrame({"win": pdf["win"].iloc[0], "death": out})

    return dist.groupBy("win").applyInPandas(run, "win int, death double")


def window_components(dist: DataFrame, epsilon: float) -> DataFrame:
    """``win, components`` of each window's graph of edges up to ``epsilon``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, d = _matrix(pdf)
        forest = Forest(len(nodes))
        joined = sum(forest.join(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(d <= epsilon, 1)), strict=True))
        return pd.DataFrame({"win": [pdf["win"].iloc[0]], "components": [len(nodes) - joined]})

    return dist.groupBy("win").applyInPandas(run, "win int, components int")


def path_betti(edges: DataFrame, k: int = 2, compat: bool = False) -> DataFrame:
    """``win, dim, betti`` of the directed path complex of each window.

    The dimension of the kernel of the boundary less the rank of the next one.
    The boundary leaves out each vertex, and chains are kept to those whose
    boundary is made of paths.  ``compat`` gives columns less rank of the
    incidence of paths and their contiguous sub-paths instead.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = sorted({*pdf["src"], *pdf["dst"]})
        nxt: dict = {}
        for a, b in zip(pdf["src"], pdf["dst"], strict=True):
            nxt.setdefault(a, set()).add(b)
        level = [[(v,) for v in nodes]]
        for _ in range(k + (not compat)):
            level.append(sorted(p + (b,) for p in level[-1] for b in nxt.get(p[-1], ()) if b not in p))
        out = []
        if compat:
            out.append((0, len(nodes)))
            for d in range(1, k + 1):
                at = {p: i for i, p in enumerate(level[d - 1])}
                m = np.zeros((len(level[d]), len(at)), bool)
                for r, p in enumerate(level[d]):
                    for q in (p[:-1], p[1:]):
                        m[r, at[q]] = True
                out.append((d, len(at) - (int(np.linalg.matrix_rank(m.astype(float))) if m.size else 0)))
        else:
            # over two elements: chains whose boundary needs no missing path
            kernel_rank = []
            for d in range(k + 2):
                if d == 0:
                    kernel_rank.append((len(nodes), 0))
                    continue
                known, at = len(level[d - 1]), {p: i for i, p in enumerate(level[d - 1])}
                faces = [{at.setdefault(p[:c] + p[c + 1 :], len(at)) for c in range(len(p))} for p in level[d]]
                whole, lost = rank2(faces), rank2([{q for q in face if q >= known} for face in faces])
                # allowed chains: kernel of the missing part; their boundary's rank is what is left of the whole rank
                kernel_rank.append((len(level[d]) - lost, whole - lost))
            out = [(d, kernel_rank[d][0] - kernel_rank[d][1] - kernel_rank[d + 1][1]) for d in range(k + 1)]
        return pd.DataFrame(out, columns=["dim", "betti"]).assign(win=pdf["win"].iloc[0])[["win", "dim", "betti"]]

    return edges.select("win", "src", "dst").groupBy("win").applyInPandas(run, "win int, dim int, betti bigint")


def window_overlap(points: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """``win, shared``: points that a window has in common with the next one."""
    m = windows_of(points.select("pos"), size, step)
    nxt = m.select((F.col("win") - 1).alias("win"), "pos")
    return m.join(nxt, ["win", "pos"]).groupBy("win").agg(F.count("*").alias("shared"))


def window_vol_stats(points: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    return windows_of(points.select("pos", "y"), size, step).groupBy("win").agg(
        F.count("*").alias("n"), F.avg("y").alias("mean"), F.stddev_pop("y").alias("std"), (F.max("y") - F.min("y")).alias("range")
    )


def adaptive_epsilon(stats: DataFrame, lo: float, hi: float) -> DataFrame:
    """``win, epsilon``: narrower where the window's range is wide."""
    share = F.try_divide(F.col("range"), F.max("range").over(Window.partitionBy()))
    return stats.select("win", (lo + (hi - lo) * (1 - 0.5 * F.coalesce(share, F.lit(0.0)))).alias("epsilon"))


def top_windows(points: DataFrame, most: int = 7, bins: int = 10, size: int = SIZE, step: int = STEP) -> DataFrame:
    """``win, h`` of the windows of greatest entropy of ``y``; all where there are ten or fewer."""
    m = windows_of(points.select("pos", "y"), size, step)
    span = Window.partitionBy("win")
    bin_ = F.least(F.floor((F.col("y") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    m = m.withColumn("lo", F.min("y").over(span)).withColumn("hi", F.max("y").over(span)).withColumn("bin", F.when(F.col("hi") > F.col("lo"), bin_).otherwise(0))
    p = F.col("n") / F.sum("n").over(span)
    h = m.groupBy("win", "bin").agg(F.count("*").alias("n")).select("win", p.alias("p")).groupBy("win").agg((-F.sum(F.col("p") * F.ln("p"))).alias("h"))
    rank = F.row_number().over(Window.orderBy(F.desc(F.round("h", 9)), "win"))
    return h.withColumn("_r", rank).withColumn("_n", F.count("*").over(Window.partitionBy())).where((F.col("_n") <= 10) | (F.col("_r") <= most)).select("win", "h")


def zigzag_windows(dist: DataFrame, points: DataFrame, at: float, size: int = SIZE, step: int = STEP) -> DataFrame:
    """``win, dim, betti, next_betti, count_diff, shared, rate``: change of the classes alive at ``at`` from a window to the next."""
    d = window_persistence(dist, at, 1, 0.0).where((F.col("birth") <= at) & (F.col("death") > at)).groupBy("win", "dim").agg(F.count("*").alias("betti"))
    dims = dist.sparkSession.createDataFrame([(0,), (1,)], "dim int")
    full = dist.select("win").distinct().crossJoin(F.broadcast(dims)).join(d, ["win", "dim"], "left").select("win", "dim", F.coalesce("betti", F.lit(0)).alias("betti"))
    nxt = full.select((F.col("win") - 1).alias("win"), "dim", F.col("betti").alias("next_betti"))
    out = full.join(nxt, ["win", "dim"]).join(window_overlap(points, size, step), "win")
    return out.withColumn("count_diff", F.col("next_betti") - F.col("betti")).withColumn("rate", F.col("count_diff") / F.col("shared"))


def transition_strength(points: DataFrame, diagram: DataFrame, size: int = SIZE, step: int = STEP) -> DataFrame:
    """``i, j, strength`` of windows i < j within reach: persistence weighted by dimension, decaying with their distance."""
    alive = diagram.where("death < double('inf')").groupBy("win").agg(F.sum((F.col("death") - F.col("birth")) * (F.col("dim") + 1) * F.exp(-F.col("dim"))).alias("s"))
    reach = math.ceil(size / step) + 1
    pair = alive.select(F.col("win").alias("i"), F.explode(F.sequence(F.col("win") + 1, F.col("win") + reach)).alias("j"), "s").join(alive.select(F.col("win").alias("j"), F.col("s").alias("t")), "j")
    raw = pair.select("i", "j", ((F.col("s") + F.col("t")) / 2 * F.exp(-(F.col("j") - F.col("i")) / (size / step))).alias("strength"))
    return raw.withColumn("strength", F.try_divide(F.col("strength"), F.max("strength").over(Window.partitionBy())))


def epsilon_range(dist: DataFrame, lo: float = 0.05, hi: float = 0.5) -> DataFrame:
    """``least, most``: percentiles held within one and a half interquartile ranges of the median."""
    q = dist.agg(F.percentile("dist", F.array(*[F.lit(x) for x in (lo, 0.25, 0.5, 0.75, hi)])).alias("q"))
    iqr = 1.5 * (F.col("q")[3] - F.col("q")[1])
    return q.select(F.greatest(F.col("q")[0], F.col("q")[2] - iqr).alias("least"), F.least(F.col("q")[4], F.col("q")[2] + iqr).alias("most"))


def epsilon_gain(dist: DataFrame, points: DataFrame, trials: list[float], bins: int = 10) -> DataFrame:
    """``epsilon, gain``: share of the target's entropy that the degree's bin explains, for each trial."""
    grid = dist.sparkSession.createDataFrame([(i, float(e)) for i, e in enumerate(trials)], "trial int, epsilon double")
    near = dist.join(F.broadcast(grid), F.col("dist") <= F.col("epsilon"))
    degree = near.select("trial", F.explode(F.array("i", "j")).alias("pos")).groupBy("trial", "pos").agg(F.count("*").alias("d"))
    span = points.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    target = points.crossJoin(F.broadcast(span)).select("pos", F.least(F.floor((F.col("y") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).alias("yb"))
    rows = target.crossJoin(F.broadcast(grid)).join(degree, ["trial", "pos"], "left").select("trial", "epsilon", "yb", F.coalesce("d", F.lit(0)).alias("d"))
    w = Window.partitionBy("trial")
    rows = rows.withColumn("lo", F.min("d").over(w)).withColumn("hi", F.max("d").over(w))
    rows = rows.withColumn("db", F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("d") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))).otherwise(0))
    n = rows.groupBy("trial", "epsilon", "yb", "db").agg(F.count("*").alias("n"))
    over = lambda *k: F.sum("n").over(Window.partitionBy("trial", *k))
    n = n.select("epsilon", "n", over().alias("t"), over("yb").alias("ny"), over("db").alias("nd"))
    h = n.groupBy("epsilon").agg((-F.sum(F.col("n") / F.col("t") * F.ln(F.col("ny") / F.col("t")))).alias("h"), (-F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") / F.col("nd")))).alias("given"))
    return h.select("epsilon", F.coalesce(F.try_divide(F.col("h") - F.col("given"), F.col("h")), F.lit(0.0)).alias("gain"))


def mapper_cover(values: DataFrame, intervals: int = 10, overlap: float = 0.3) -> DataFrame:
    """``pos, y, cell``: each point in every interval of the overlapping cover of ``y`` that holds it."""
    span = values.agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / intervals
    cells = values.crossJoin(F.broadcast(span)).withColumn("w", width).withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(intervals - 1))))
    lo, hi = F.col("lo") + F.col("cell") * F.col("w") - F.col("w") * overlap, F.col("lo") + (F.col("cell") + 1) * F.col("w") + F.col("w") * overlap
    return cells.where((F.col("y") >= lo) & (F.col("y") <= hi)).select("pos", "y", "cell")


def mapper_graph(values: DataFrame, intervals: int = 10, overlap: float = 0.3, gap: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Nodes ``cell, cluster, n`` and edges between clusters that share points: ``cell_a, cluster_a, cell_b, cluster_b, shared``.

    Within a cell, points are clusters of ``x`` without a gap above ``gap``.
    """
    cover = mapper_cover(values.select("pos", "y"), intervals, overlap).join(values.select("pos", "x"), "pos")
    o = Window.partitionBy("cell").orderBy("x", "pos")
    cover = cover.withColumn("_new", F.coalesce((F.col("x") - F.lag("x").over(o) > gap).cast("int"), F.lit(0)))
    cover = cover.withColumn("cluster", F.sum("_new").over(o.rowsBetween(Window.unboundedPreceding, 0))).select("pos", "cell", "cluster")
    nodes = cover.groupBy("cell", "cluster").agg(F.count("*").alias("n"))
    a, b = (cover.select("pos", F.col("cell").alias(f"cell_{k}"), F.col("cluster").alias(f"cluster_{k}")) for k in "ab")
    links = a.join(b, "pos").where("cell_a < cell_b").groupBy("cell_a", "cluster_a", "cell_b", "cluster_b").agg(F.count("*").alias("shared"))
    return nodes, links
