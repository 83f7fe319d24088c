"""Registered queries of the tick engine, one for each operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.schema import TICKS
from tickloom.functions.series import backward_fill, forward_fill, positioned
from tickloom.operators import calendar, cleaning, features, infotheory, regimes, runs, simulate, topology, volatility
from tickloom.plans.views import EPSILON, FEATURES, LEAST_RUN, TARGET, coarse_ticks, feature_rows, labels, points, rounded, ticks
from tickloom.sources.ticks import load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
K = ["order_key"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _columns(make, *names: str, digits: int = 6):
    return lambda spark, d: rounded(make(spark, d).select(*K, *names), digits)


def _scored(spark, d):
    return cleaning.scored(ticks(spark, d))


def _with_volatility(spark, d):
    return cleaning.default_volatility(ticks(spark, d))


def _base(spark, d):
    return features.base(_with_volatility(spark, d))


def _flag(name: str, make, column: str) -> None:
    QUERIES[name] = lambda spark, d: make(_scored(spark, d)).select(*K, F.col(column).cast("bigint").alias(column))


# cleaning
QUERIES["market_hours"] = _columns(lambda s, d: cleaning.market_hours(ticks(s, d)), "symbol", "price", "volume")
QUERIES["tick_volatility_default"] = _columns(_with_volatility, "volatility")
QUERIES["price_change"] = _columns(lambda s, d: cleaning.price_change(ticks(s, d)).withColumn("significant", F.col("significant").cast("bigint")), "change", "pct", "significant")
QUERIES["rolling_mad"] = _columns(lambda s, d: cleaning.rolling_mad(ticks(s, d)), "rolling_median", "mad_adjusted", "rolling_std", "rolling_volume", digits=8)
QUERIES["robust_zscore"] = _columns(_scored, "z_score", "price_zscore", "volume_ratio", "median_diff_pct")
_flag("flag_zscore", cleaning.flag_zscore, "zscore_outlier")
_flag("flag_extreme", cleaning.flag_extreme, "extreme_outlier")
_flag("flag_isolated_stat", cleaning.flag_isolated_stat, "isolated_stat")
_flag("flag_isolated_local", cleaning.flag_isolated_local, "isolated_local")
_flag("flag_reversal", cleaning.flag_reversal, "reversal_outlier")
_flag("flag_wavelet", cleaning.flag_wavelet, "wavelet_outlier")


@query
def outlier_counts(spark, d):
    """All five flags; the wavelet is beyond SQL, so ``outlier_counts_sql`` holds the other four against an oracle."""
    return rounded(cleaning.outlier_counts(cleaning.flag_outliers(ticks(spark, d))))


@query
def outlier_counts_sql(spark, d):
    return rounded(cleaning.outlier_counts(cleaning.flag_outliers(ticks(spark, d), wavelet=False)).drop("wavelet_outlier"))


@query
def seconds_from_open(spark, d):
    return rounded(cleaning.seconds_from_open(ticks(spark, d)).select(*K, "seconds_from_open"))


@query
def flag_timestamp_group(spark, d):
    found = cleaning.flag_timestamp_group(cleaning.seconds_from_open(coarse_ticks(spark, d)))
    return found.select(*K, F.col("timestamp_group").cast("bigint").alias("timestamp_group"))


@query
def flag_velocity(spark, d):
    t = cleaning.seconds_from_open(cleaning.scored(coarse_ticks(spark, d)))
    return rounded(cleaning.flag_velocity(t).select(*K, "price_velocity", "rolling_vol_10min", "velocity_method"))


@query
def collapse_suspicious_cluster(spark, d):
    t = coarse_ticks(spark, d, "day")
    t = cleaning.flag_timestamp_group(cleaning.seconds_from_open(t)).withColumn("is_suspicious", F.col("timestamp_group"))
    out = cleaning.collapse_clusters(t)
    return rounded(out.select(*K, "price", F.col("is_suspicious").cast("bigint").alias("is_suspicious"), F.col("in_cluster").cast("bigint").alias("in_cluster")))


@query
def clean_ticks(spark, d):
    return rounded(cleaning.clean_ticks(ticks(spark, d))[0])


@query
def vwap(spark, d):
    return rounded(cleaning.vwap(ticks(spark, d).withColumn("day", F.to_date("ts").cast("string")), ["symbol", "day"]))


@query
def sample_chunks(spark, d):
    """A tenth of each symbol in ten contiguous chunks."""
    t = positioned(ticks(spark, d), TICKS.order()).withColumn("n", F.count("*").over(Window.partitionBy("symbol")))
    step = F.greatest(F.floor(F.col("n") / 10), F.lit(1))
    return t.where((F.col("pos") % step) < F.greatest(F.floor(step / 10), F.lit(1))).select(*K, "symbol", F.col("pos").cast("bigint").alias("pos"))


# volatility
QUERIES["log_returns"] = _columns(lambda s, d: volatility.log_returns(ticks(s, d)), "ret", "abs_ret", "gap")
QUERIES["mle_vol"] = _columns(lambda s, d: volatility.mle_volatility(ticks(s, d)), "mle_vol")
QUERIES["fourier_vol"] = _columns(lambda s, d: volatility.fourier_volatility(ticks(s, d)), "fourier_vol")
QUERIES["ewma_vol"] = _columns(lambda s, d: volatility.ewma_vol(ticks(s, d)), "ewma_vol")
QUERIES["stft_vol"] = _columns(lambda s, d: volatility.banded_vol(ticks(s, d)), "stft_vol")
QUERIES["combined_vol"] = _columns(lambda s, d: volatility.combined_volatility(ticks(s, d)), "combined_vol")

# features
W3 = features.WINDOWS
QUERIES["tick_metrics"] = _columns(lambda s, d: features.tick_metrics(_base(s, d)), "tick_direction", "tick_reversal", "tick_run_length", "tick_volatility")
QUERIES["volume_imbalance"] = _columns(lambda s, d: features.volume_imbalance(_base(s, d)), "volume_imbalance")
QUERIES["price_impact"] = _columns(lambda s, d: features.price_impact(_base(s, d)), "kyle_lambda", "amihud")
QUERIES["rs_volatility"] = _columns(lambda s, d: features.rs_volatility(_base(s, d)), "rs_volatility")
QUERIES["intensity"] = _columns(lambda s, d: features.intensity(_base(s, d)), "trading_intensity", "return_intensity")
QUERIES["realized_vol"] = _columns(lambda s, d: features.realized_vol(_base(s, d)), *[f"{n}_{w}" for n in ("realized_vol", "abs_return") for w in W3])
QUERIES["garman_klass"] = _columns(lambda s, d: features.garman_klass(features.realized_vol(_base(s, d))), *[f"gk_vol_{w}" for w in W3])
QUERIES["order_flow"] = _columns(lambda s, d: features.order_flow(_base(s, d)), *[f"order_flow_imbalance_{w}" for w in W3])
QUERIES["variance_ratio"] = _columns(lambda s, d: features.variance_ratio(_base(s, d)), *[f"variance_ratio_{w}" for w in W3])
QUERIES["rolling_liquidity"] = _columns(lambda s, d: features.rolling_liquidity(features.price_impact(_base(s, d))), *[f"{n}_{w}" for n in ("kyle_lambda", "amihud", "tick_pattern", "rel_volume") for w in W3])
QUERIES["time_cyclic"] = _columns(lambda s, d: features.time_cyclic(ticks(s, d)), "sin_time", "cos_time")
QUERIES["vol_adjusted"] = _columns(lambda s, d: features.vol_adjusted(features.price_impact(_base(s, d))), "vol_adjusted_return", "vol_impact_ratio")
QUERIES["vol_trend"] = _columns(lambda s, d: features.vol_trend(_with_volatility(s, d)), *[f"vol_trend_{w}" for w in W3])
QUERIES["all_features"] = _columns(lambda s, d: features.all_features(_with_volatility(s, d)), *features.feature_names())


@query
def null_profile(spark, d):
    t = cleaning.price_change(_with_volatility(spark, d))
    return features.null_profile(t, ["price", "volume", "volatility", "change", "pct"])


@query
def fill_chain(spark, d):
    """Volumes of 20 and less taken out and filled."""
    t = ticks(spark, d).withColumn("volume", F.when(F.col("volume") > 20, F.col("volume")))
    o = TICKS.order()
    filled = features.fill_chain(t, "volume").select(*K, F.col("volume").alias("filled"))
    ends = t.select(*K, forward_fill(F.col("volume"), o).alias("ffilled"), backward_fill(F.col("volume"), TICKS.reverse()).alias("bfilled"))
    return rounded(filled.join(ends, K))


@query
def standardize(spark, d):
    return rounded(features.standardize(feature_rows(spark, d), FEATURES))


@query
def feature_corr_rank(spark, d):
    return rounded(features.feature_corr_rank(feature_rows(spark, d), FEATURES, TARGET))


# information
def _long(spark, d):
    return infotheory.unpivot(feature_rows(spark, d), "row_id", FEATURES)


def _information(spark, d):
    x = _long(spark, d)
    return infotheory.entropy(x, 16), infotheory.mutual_information(x, 16)


QUERIES["histogram"] = lambda s, d: rounded(infotheory.histogram(_long(s, d), 16))
QUERIES["hist_entropy"] = lambda s, d: rounded(infotheory.entropy(_long(s, d)))
QUERIES["kde_entropy"] = lambda s, d: rounded(infotheory.kde_entropy(_long(s, d)))
QUERIES["mutual_info"] = lambda s, d: rounded(infotheory.mutual_information(_long(s, d), 16))
QUERIES["tail_factor"] = lambda s, d: rounded(infotheory.tail_factor(_long(s, d)))
QUERIES["conditional_entropy"] = lambda s, d: rounded(infotheory.conditional_entropy(_long(s, d), TARGET))
QUERIES["transfer_entropy"] = lambda s, d: rounded(infotheory.transfer_entropy(_long(s, d)))
QUERIES["rolling_kl"] = lambda s, d: rounded(infotheory.rolling_kl(feature_rows(s, d).select(F.col("row_id").alias("pos"), F.col("price").alias("x")), 200, 100, 8))
QUERIES["nmi_rank"] = lambda s, d: rounded(infotheory.nmi_rank(*_information(s, d), TARGET))
QUERIES["feature_importance"] = lambda s, d: rounded(infotheory.feature_importance(*_information(s, d), TARGET))
QUERIES["selector_scores"] = lambda s, d: rounded(infotheory.selector_scores(*_information(s, d), TARGET))
QUERIES["feature_redundancy"] = lambda s, d: rounded(infotheory.redundancy(*_information(s, d)))
QUERIES["lagged_corr_te"] = lambda s, d: rounded(infotheory.lagged_correlation(feature_rows(s, d), FEATURES, "row_id"))
QUERIES["select_by_variance"] = lambda s, d: rounded(infotheory.select_by_variance(feature_rows(s, d), FEATURES, 2))


@query
def enhancement_strategy(spark, d):
    x = _long(spark, d)
    out = infotheory.strategy(infotheory.entropy(x, 16), infotheory.transfer_entropy(x), infotheory.tail_factor(x), infotheory.mutual_information(x, 16), TARGET)
    return out.select("feature", *[F.col(c).cast("bigint").alias(c) for c in out.columns[1:]])


QUERIES["enhancement_potential"] = lambda s, d: rounded(infotheory.enhancement_potential(infotheory.transfer_entropy(_long(s, d)), _information(s, d)[1], TARGET))


@query
def te_weighted(spark, d):
    te = infotheory.transfer_entropy(_long(spark, d)).where(F.col("dst") == TARGET).collect()
    return rounded(infotheory.te_weighted(feature_rows(spark, d), {r["src"]: r["te"] for r in te}).drop(*FEATURES), 4)


@query
def tail_emphasized(spark, d):
    """Sixth powers of the measures, which have tails."""
    x = feature_rows(spark, d).select("row_id", *[F.pow(c, 6).alias(c) for c in ("price", "volume")])
    k = infotheory.tail_factor(infotheory.unpivot(x, "row_id", ["price", "volume"])).collect()
    out = infotheory.tail_emphasized(x, {r["feature"]: r["factor"] for r in k}).drop("price", "volume")
    return out.select("row_id", *[(F.round(F.col(c) / 1e9, 3) + F.lit(0.0)).alias(c) for c in out.columns[1:]])


@query
def kl_weighted(spark, d):
    rows = feature_rows(spark, d)
    kl = infotheory.rolling_kl(rows.select(F.col("row_id").alias("pos"), F.col("price").alias("x")), 200, 100, 8)
    return rounded(infotheory.kl_weighted(rows, {"price": kl}, "row_id", 100).select("row_id", "price_kl_weighted"))


@query
def greedy_selection(spark, d):
    h, mi = _information(spark, d)
    chosen = infotheory.greedy_select(infotheory.selector_scores(h, mi, TARGET), infotheory.redundancy(h, mi), 2)
    return spark.createDataFrame(list(enumerate(chosen)), "rank int, feature string")


@query
def entropy_weighted(spark, d):
    h, mi = _information(spark, d)
    weight = {r["feature"]: r["importance"] for r in infotheory.feature_importance(h, mi, TARGET).collect()}
    return rounded(infotheory.entropy_weighted(feature_rows(spark, d), weight).select("row_id", *[f"{c}_ent_weighted" for c in sorted(weight)]), 4)


# topology
def _dist(spark, d):
    return topology.temporal_distance(points(spark, d))


def _edges(spark, d):
    return topology.epsilon_graph(_dist(spark, d), EPSILON)


def _diagram(spark, d):
    return topology.window_persistence(_dist(spark, d), EPSILON)


QUERIES["temporal_distance"] = lambda s, d: rounded(_dist(s, d))
QUERIES["temporal_distance_l1"] = lambda s, d: rounded(topology.temporal_distance(points(s, d), 1))
QUERIES["epsilon_graph"] = lambda s, d: rounded(_edges(s, d))
QUERIES["knn_graph"] = lambda s, d: rounded(topology.knn_graph(_dist(s, d), 5))
QUERIES["path_counts"] = lambda s, d: rounded(topology.path_counts(_edges(s, d), 3))
QUERIES["top_paths"] = lambda s, d: rounded(topology.top_paths(_edges(s, d), points(s, d), 20).withColumn("volatile", F.col("volatile").cast("bigint")))
QUERIES["directed_triangles"] = lambda s, d: rounded(topology.directed_triangles(_edges(s, d)))
QUERIES["network_stats"] = lambda s, d: rounded(topology.network_stats(_edges(s, d)))
QUERIES["path_betti"] = lambda s, d: rounded(topology.path_betti(_edges(s, d)))
QUERIES["h0_persistence"] = lambda s, d: rounded(topology.h0_persistence(_dist(s, d)))
QUERIES["window_persistence"] = lambda s, d: rounded(_diagram(s, d))
QUERIES["window_components"] = lambda s, d: rounded(topology.window_components(_dist(s, d), EPSILON))
QUERIES["window_overlap"] = lambda s, d: rounded(topology.window_overlap(points(s, d)))
QUERIES["window_vol_stats"] = lambda s, d: rounded(topology.window_vol_stats(points(s, d)))
QUERIES["adaptive_epsilon"] = lambda s, d: rounded(topology.adaptive_epsilon(topology.window_vol_stats(points(s, d)), 1.2, 1.4))
QUERIES["top_windows"] = lambda s, d: rounded(topology.top_windows(points(s, d)))
QUERIES["zigzag_windows"] = lambda s, d: rounded(topology.zigzag_windows(_dist(s, d), points(s, d), EPSILON))
QUERIES["transition_strength"] = lambda s, d: rounded(topology.transition_strength(points(s, d), topology.window_persistence(_dist(s, d), EPSILON, 1)))
QUERIES["epsilon_range"] = lambda s, d: rounded(topology.epsilon_range(_dist(s, d)))
QUERIES["epsilon_gain"] = lambda s, d: rounded(topology.epsilon_gain(_dist(s, d), points(s, d).select("pos", "y"), [1.2, 1.25, 1.3, 1.35]))
QUERIES["mapper_cover"] = lambda s, d: rounded(topology.mapper_cover(points(s, d).select("pos", "y")).select("pos", "cell"))


def _given_diagram(spark, d):
    """A diagram made of line items, to hold the curve against an oracle."""
    li = load(spark, d, "lineitem")
    return li.select((F.col("l_orderkey") % 20).cast("int").alias("win"), F.col("l_linenumber").cast("int").alias("dim"), F.col("l_discount").alias("birth"), (F.col("l_discount") + F.col("l_tax")).alias("death"))


QUERIES["betti_curve"] = lambda s, d: rounded(topology.betti_curve(_given_diagram(s, d), 0.0, 0.2, 33))
QUERIES["betti_summary"] = lambda s, d: rounded(topology.betti_summary(topology.betti_curve(_given_diagram(s, d), 0.0, 0.2, 33)))


@query
def mapper_graph(spark, d):
    p = points(spark, d).select("pos", "y", F.col("v")[1].cast("double").alias("x"))
    return rounded(topology.mapper_graph(p, gap=0.02)[1])


# regimes and runs
QUERIES["regime_runs"] = lambda s, d: rounded(runs.regime_runs(labels(s, d)))
QUERIES["run_length_stats"] = lambda s, d: rounded(runs.run_length_stats(runs.regime_runs(labels(s, d))))
QUERIES["transition_matrix"] = lambda s, d: rounded(runs.transition_matrix(labels(s, d)))
QUERIES["transition_forecast"] = lambda s, d: rounded(runs.transition_forecast(runs.transition_matrix(labels(s, d)), 3))
QUERIES["transition_points"] = lambda s, d: rounded(runs.transition_points(labels(s, d)))
QUERIES["regime_stats"] = lambda s, d: rounded(runs.regime_stats(labels(s, d), "volume"))
QUERIES["regime_feature_stats"] = lambda s, d: rounded(runs.regime_stats(labels(s, d), "price"))
QUERIES["smooth_persistence_pass"] = lambda s, d: rounded(runs.smooth_persistence_pass(runs.regime_runs(labels(s, d)), LEAST_RUN).select("series", "run_id", "regime", "smoothed"))


@query
def smooth_transition_pass(spark, d):
    x = labels(spark, d)
    return rounded(runs.smooth_transition_pass(runs.regime_runs(x), runs.transition_matrix(x), LEAST_RUN).select("series", "run_id", "regime", "smoothed"))


def _in_runs(spark, d):
    return runs.with_runs(labels(spark, d), "regime", ["series"], ["pos"])


@query
def smooth_confidence_pass(spark, d):
    sure = _in_runs(spark, d).groupBy("series", "run_id").agg(F.avg("confidence").alias("confidence"))
    return rounded(runs.smooth_confidence_pass(runs.regime_runs(labels(spark, d)), sure, LEAST_RUN).select("series", "run_id", "regime", "smoothed"))


@query
def js_distance(spark, d):
    """Prices of each symbol in the first and second half of the day."""
    t = ticks(spark, d)
    return rounded(runs.js_distance(t.where(F.hour("ts") < 12), t.where(F.hour("ts") >= 12), "price", ["symbol"]))


@query
def rsip_costs(spark, d):
    """Divergence of each run of three or more from the one before."""
    x = _in_runs(spark, d).withColumn("n", F.count("*").over(Window.partitionBy("series", "run_id")))
    run = x.where("n >= 3").select("series", "run_id", "price")
    before = x.select("series", (F.col("run_id") + 1).alias("run_id"), "price").join(run.select("series", "run_id").distinct(), ["series", "run_id"])
    return rounded(runs.js_distance(run.join(before.select("series", "run_id").distinct(), ["series", "run_id"]), before, "price", ["series", "run_id"]))


@query
def rsip_smooth(spark, d):
    return rounded(runs.rsip_smooth(labels(spark, d), ["price", "volume"], LEAST_RUN))


@query
def min_run_length(spark, d):
    return spark.createDataFrame([(runs.min_run_length(labels(spark, d)),)], "least long")


QUERIES["robust_scale"] = lambda s, d: rounded(regimes.robust_scale(feature_rows(s, d), FEATURES))


def _vector_rows(spark, d, width=None):
    """``pos, label, f0..`` with all components of the vectors, or the first ``width``, and the names of the latter columns.

    The rows pass an identity, or Spark would work out the constraints of so many aliases, which doubles with each.
    """
    p = points(spark, d)
    names = [f"f{i}" for i in range(width or p.agg(F.max(F.size("v"))).first()[0] or 0)]
    rows = p.select("pos", "label", *[F.get("v", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)])
    return rows.mapInArrow(lambda batches: batches, rows.schema), names


def _nearest(p, names):
    return rounded(regimes.nearest_centroid(p, regimes.centroids(p.withColumnRenamed("label", "regime"), names), names, "pos"))


@query
def nearest_centroid(spark, d):
    """Over the eight components of the SQL; ``nearest_centroid_all`` has the whole vectors."""
    return _nearest(*_vector_rows(spark, d, 8))


@query
def nearest_centroid_all(spark, d):
    return _nearest(*_vector_rows(spark, d))


@query
def gmm_regimes(spark, d):
    p, names = _vector_rows(spark, d)
    return rounded(regimes.gmm_regimes(p, names, "pos"))


@query
def extend_regimes(spark, d):
    p, names = _vector_rows(spark, d)
    return rounded(regimes.extend_regimes(p.withColumn("regime", F.col("label") % 4), names, "pos")[0])


# simulation and calendar
def _given_path(spark, d):
    """Orders as a path of prices, so that simulation formulas meet an oracle."""
    o = load(spark, d, "orders")
    price = F.col("o_totalprice") / 1000 + 1
    return o.select(
        (F.col("o_custkey") % 5).cast("int").alias("series"), F.col("o_orderkey").alias("idx"), price.alias("price"), F.ln(price).alias("log_price"), ((F.col("o_custkey") % 7 + 1) / 20).alias("volatility"),
        ((F.col("o_orderkey") % 11) / 100).alias("bid_noise"), ((F.col("o_orderkey") % 13) / 100).alias("ask_noise"),
    )


QUERIES["quote_spread"] = lambda s, d: rounded(simulate.quotes(_given_path(s, d)).select("idx", "bid", "ask", "mid", "spread"))
QUERIES["momentum_factor"] = lambda s, d: rounded(simulate.momentum_factor(_given_path(s, d)).select("idx", "momentum_factor"))
QUERIES["quote_revision_points"] = lambda s, d: simulate.quote_revisions(_given_path(s, d), threshold=0.9).select("idx")


@query
def order_flow_impact(spark, d):
    p = _given_path(spark, d)
    li = load(spark, d, "orders").where("o_orderstatus <> 'P'")
    orders = li.select((F.col("o_custkey") % 5).cast("int").alias("series"), F.col("o_orderkey").alias("idx"), F.when(F.col("o_orderstatus") == "O", "buy").otherwise("sell").alias("direction"), (F.col("o_custkey") % 9 + 1).cast("double").alias("size"))
    return rounded(simulate.order_flow_impact(p, orders).select("idx", "impact"))


def _simulated(spark, n=2000):
    path = simulate.efficient_price(spark, n, 2)
    rng = lambda k: (F.pmod(F.xxhash64("series", "idx", F.lit(k)), F.lit(2001)) - 1000) / 10000
    return path, simulate.quotes(path.withColumn("bid_noise", rng(1)).withColumn("ask_noise", rng(2)))


QUERIES["sim_price"] = lambda s, d: rounded(simulate.efficient_price(s, 2000, 2))
QUERIES["sim_arrivals"] = lambda s, d: rounded(simulate.arrivals(s, 2000, 2))
QUERIES["sim_child_orders"] = lambda s, d: rounded(simulate.child_orders(s, _simulated(s)[1]))
QUERIES["sim_maker_quotes"] = lambda s, d: rounded(simulate.maker_quotes(_simulated(s)[1]))


@query
def sim_order_flow(spark, d):
    path = _simulated(spark)[0]
    return rounded(simulate.order_flow(path, simulate.arrivals(spark, 2000, 2, 1), simulate.arrivals(spark, 2000, 2, 2)))


@query
def sim_noise_components(spark, d):
    path, quoted = _simulated(spark)
    flow = simulate.order_flow(path, simulate.arrivals(spark, 2000, 2, 1), simulate.arrivals(spark, 2000, 2, 2))
    return rounded(simulate.noise_components(quoted, flow, simulate.child_orders(spark, quoted), simulate.maker_quotes(quoted)))


@query
def month_urls(spark, d):
    return calendar.month_urls(spark, "https://example.org/calendar?month=", "2024-11", "2025-02").select(F.col("month").cast("string").alias("month"), "url")


@query
def parse_calendar_date(spark, d):
    """Order dates written as ``Mon D`` with a year, some of them impossible, read back."""
    o = load(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 7 == 0, F.lit("Feb 30")).otherwise(F.date_format("o_orderdate", "MMM d"))
    return o.select("o_orderkey", calendar.parse_date(text, F.year("o_orderdate")).cast("string").alias("date"))


@query
def calendar_filter(spark, d):
    """Orders as calendar rows: priority as impact."""
    o = load(spark, d, "orders")
    level = F.when(F.col("o_orderpriority") == "1-URGENT", "High").otherwise("Low")
    blank = lambda m: F.when(F.col("o_orderkey") % m == 0, "").otherwise(F.col("o_orderstatus"))
    rows = o.select("o_orderkey", F.when(F.col("o_custkey") % 2 == 0, "USD").otherwise("EUR").alias("currency"), level.alias("impact"), blank(3).alias("actual"), blank(5).alias("forecast"), blank(7).alias("previous"))
    return calendar.calendar_filter(rows)


@query
def calendar_rows(spark, d):
    """Three lines of a calendar page; the supplied pages hold no such table."""
    row = lambda css, attr, time, level, event: (
        f'<tr class="calendar__row {css}"{attr}><td class="calendar__cell calendar__time">{time}</td><td class="calendar__currency">USD</td>'
        f'<td class="calendar__impact"><span class="{level}"></span></td><td class="calendar__event"><b>{event}</b></td><td class="calendar__actual">1</td><td class="calendar__forecast">2</td><td class="calendar__previous"></td></tr>'
    )
    html = '<table><tr class="calendar__row--day-breaker"><td class="calendar__cell"><span>Jan 3</span></td></tr>'
    html += row("calendar__row--grey", "", "8:30am", "icon icon--ff-impact-red", "Jobs") + row("calendar__row--grey", "", "", "icon icon--ff-impact-yel", "Rate")
    html += row("calendar__row--new-day", ' data-day-dateline="1735948800"', "", "icon", "Sales") + "</table>"
    out = calendar.calendar_rows(spark.createDataFrame([(1, 2025, html)], "page_id long, year int, html string"))
    return rounded(out.withColumn("date", F.col("date").cast("string")))
