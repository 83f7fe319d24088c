"""DuckDB SQL for the registered queries, written from the definitions, not from the engine's plans."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

TICKS = """t AS (
  SELECT event_type AS symbol, CAST(ts AS TIMESTAMP) AS ts, CAST(value AS DOUBLE) AS price,
         CAST(1 + CAST(props::json->>'$.k' AS INT) AS DOUBLE) AS volume, event_id AS order_key FROM events)"""
W = "(PARTITION BY symbol ORDER BY ts, order_key)"


def over(frame: str = "") -> str:
    return f"(PARTITION BY symbol ORDER BY ts, order_key {frame})"


def back(n: int) -> str:
    return over(f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW")


def mid(n: int) -> str:
    return over(f"ROWS BETWEEN {n // 2} PRECEDING AND {(n - 1) // 2} FOLLOWING")


def r(*names: str, digits: int = 6) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE), {digits}) + 0.0 AS {n}" for n in names)


def big(*names: str) -> str:
    return ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in names)


def div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) WHEN ({b}) = 0 AND ({a}) > 0 THEN 'inf'::DOUBLE WHEN ({b}) = 0 AND ({a}) < 0 THEN '-inf'::DOUBLE END"


def ln(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN ln({x}) END"


def mean_change(n: int) -> str:
    return f"avg(CASE WHEN abs(rel) < 'inf'::DOUBLE THEN abs(rel) END) OVER {back(n)} * 100"


def seconds(a: str, b: str) -> str:
    return f"date_diff('microsecond', {a}, {b}) / 1e6"


def scored(source: str = TICKS) -> str:
    return f"""{source}, a AS (
  SELECT *, {div("price", f"lag(price) OVER {W}")} - 1 AS rel, price - lag(price) OVER {W} AS change,
         ({div(f"price - lag(price) OVER {W}", f"lag(price) OVER {W}")}) * 100 AS pct,
         CASE WHEN count(price) OVER {mid(50)} >= 3 THEN median(price) OVER {mid(50)} END AS rolling_median FROM t
), b AS (
  SELECT *, {mean_change(20)} AS volatility, coalesce(abs(pct) >= 0.05, false) AS significant,
         abs(price - rolling_median) AS away,
         stddev_samp(price) OVER {back(10)} AS std10,
         CASE WHEN count(price) OVER {mid(20)} >= 3 THEN stddev_samp(price) OVER {mid(20)} END AS rolling_std,
         CASE WHEN count(volume) OVER {mid(20)} >= 3 THEN avg(volume) OVER {mid(20)} END AS rolling_volume FROM a
), c AS (
  SELECT *, CASE WHEN count(away) OVER {mid(50)} >= 3 THEN median(away) OVER {mid(50)} * 1.4826 END AS mad,
         avg(volatility) OVER {mid(50)} AS vol_mean FROM b
), d AS (
  SELECT *, CASE WHEN mad = 0 THEN std10 ELSE mad END AS mad_adjusted,
         {div("price - rolling_median", "rolling_std")} AS price_zscore, {div("volume", "rolling_volume")} AS volume_ratio,
         abs({div("price - rolling_median", "rolling_median")} * 100) AS median_diff_pct FROM c
), s AS (
  SELECT *, ({div("price - rolling_median", "mad_adjusted")})
            / CASE WHEN volume_ratio IS NOT NULL THEN least(greatest(1 + volume_ratio, 1), 2) END
            / CASE WHEN ({div("volatility", "vol_mean")}) IS NOT NULL THEN least(greatest(1 + ({div("volatility", "vol_mean")}), 1), 2) END AS z_score,
         row_number() OVER {W} - 1 AS pos, count(*) OVER (PARTITION BY symbol) AS n FROM d
)"""


def lead(k: int, x: str = "price") -> str:
    return f"lead({x}, {k}) OVER {W}"


def lag(k: int, x: str = "price") -> str:
    return f"lag({x}, {k}) OVER {W}"


def med3(a: str, b: str, c: str) -> str:
    return f"(CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL AND {c} IS NOT NULL THEN greatest(least({a}, {b}), least(greatest({a}, {b}), {c})) END)"


ORACLES["market_hours"] = f"WITH {TICKS} SELECT order_key, symbol, {r('price', 'volume')} FROM t WHERE CAST(ts AS TIME) >= '09:30:00' AND CAST(ts AS TIME) < '16:00:00'"
ORACLES["tick_volatility_default"] = f"WITH {scored()} SELECT order_key, {r('volatility')} FROM s"
ORACLES["price_change"] = f"WITH {scored()} SELECT order_key, {r('change', 'pct')}, {big('significant')} FROM s"
ORACLES["rolling_mad"] = f"WITH {scored()} SELECT order_key, {r('rolling_median', 'mad_adjusted', 'rolling_std', 'rolling_volume', digits=8)} FROM s"
ORACLES["robust_zscore"] = f"WITH {scored()} SELECT order_key, {r('z_score', 'price_zscore', 'volume_ratio', 'median_diff_pct')} FROM s"

_FLAGS = f"""{scored()}, f AS (
  SELECT *, coalesce(abs(z_score) > 3, false) AND significant
         AND NOT ({' OR '.join(f'coalesce(({div(f"abs({lead(k)} - price)", "price")}) < 0.005, false)' for k in (1, 2, 3))}) AS zscore_outlier,
         coalesce(abs(pct) > 1.5, false) AS extreme_outlier,
         coalesce(median_diff_pct > 0.5 AND abs(price_zscore) > 2 AND volume_ratio < 1, false) AS isolated_stat,
         CASE WHEN coalesce(abs(rel) < 0.0015, false) THEN 1 ELSE 0 END AS calm,
         {lag(1)} AS p1, {lag(2)} AS p2, {lag(3)} AS p3, {lead(1)} AS n1, {lead(2)} AS n2, {lead(3)} AS n3 FROM s
), g AS (
  SELECT *, {', '.join(f'coalesce({lag(k, "calm")}, 0) AS cb{k}, coalesce({lead(k, "calm")}, 0) AS ca{k}' for k in range(1, 6))},
         ({div('n1 - price', 'price')}) * 100 AS f0, ({div('n2 - price', 'price')}) * 100 AS f1, ({div('n3 - price', 'price')}) * 100 AS f2 FROM f
), h AS (
  SELECT *, coalesce(pos >= 5 AND pos < n - 5 AND greatest(cb1 + cb2 + cb3, cb2 + cb3 + cb4, cb3 + cb4 + cb5) >= 2
            AND greatest(ca1 + ca2 + ca3, ca2 + ca3 + ca4, ca3 + ca4 + ca5) >= 2
            AND ({div(f"abs(price - {med3('p1', 'p2', 'p3')})", med3('p1', 'p2', 'p3'))}) > 0.002
            AND ({div(f"abs(price - {med3('n1', 'n2', 'n3')})", med3('n1', 'n2', 'n3'))}) > 0.002, false) AS isolated_local,
         CASE WHEN pos >= 3 AND pos < n - 3 AND abs(f0) > 0.5 THEN
           CASE WHEN f1 * f0 < 0 AND abs(f1) > 0.3 * abs(f0) THEN 2 WHEN f2 * f0 < 0 AND abs(f2) > 0.3 * abs(f0) THEN 3 END END AS span FROM g
), o AS (
  SELECT *, span IS NOT NULL OR {' OR '.join(f'coalesce({lag(k, "span")} >= {k}, false)' for k in (1, 2, 3))} AS reversal_outlier FROM h
)"""
for _name, _column in (("flag_zscore", "zscore_outlier"), ("flag_extreme", "extreme_outlier"), ("flag_isolated_stat", "isolated_stat"), ("flag_isolated_local", "isolated_local"), ("flag_reversal", "reversal_outlier")):
    ORACLES[_name] = f"WITH {_FLAGS} SELECT order_key, {big(_column)} FROM o"
ORACLES["outlier_counts_sql"] = f"""WITH {_FLAGS} SELECT symbol, count(*) AS n, CAST(count(*) FILTER (zscore_outlier) AS BIGINT) AS zscore_outlier,
  CAST(count(*) FILTER (extreme_outlier) AS BIGINT) AS extreme_outlier, CAST(count(*) FILTER (isolated_stat OR isolated_local) AS BIGINT) AS isolated_outlier,
  CAST(count(*) FILTER (reversal_outlier) AS BIGINT) AS reversal_outlier,
  CAST(count(*) FILTER (zscore_outlier OR extreme_outlier OR isolated_stat OR isolated_local OR reversal_outlier) AS BIGINT) AS is_outlier FROM o GROUP BY symbol"""


def coarse(unit: str) -> str:
    return TICKS.replace("CAST(ts AS TIMESTAMP)", f"date_trunc('{unit}', ts)::TIMESTAMP")


_OPEN = seconds("min(ts) OVER (PARTITION BY symbol, CAST(ts AS DATE))", "ts")
ORACLES["seconds_from_open"] = f"WITH {TICKS} SELECT order_key, round({_OPEN}, 6) + 0.0 AS seconds_from_open FROM t"


def groups(unit: str) -> str:
    return f"""{coarse(unit)}, u AS (SELECT *, {_OPEN} AS sfo FROM t), g AS (
  SELECT *, ({div("max(price) OVER p - min(price) OVER p", "min(price) OVER p")}) * 100 > CASE WHEN sfo < 60 THEN 1.0 ELSE 0.5 END
            AND row_number() OVER (PARTITION BY symbol, ts ORDER BY volume DESC, order_key) > 1 AS timestamp_group
  FROM u WINDOW p AS (PARTITION BY symbol, ts))"""


ORACLES["flag_timestamp_group"] = f"WITH {groups('hour')} SELECT order_key, {big('timestamp_group')} FROM g"
ORACLES["flag_velocity"] = f"""WITH {scored(coarse('hour'))}, u AS (
  SELECT *, {_OPEN} AS sfo, {seconds(f'lag(ts) OVER {W}', 'ts')} AS gap, rel * 100 AS move,
         CASE WHEN count(volatility) OVER {back(20)} >= 5 THEN avg(volatility) OVER {back(20)} END AS rolling_vol_10min FROM s
), v AS (SELECT *, CASE WHEN gap = 0 THEN 0.0 ELSE {div('move', 'gap')} END AS price_velocity,
         CASE WHEN volume_ratio IS NOT NULL THEN least(greatest(sqrt(volume_ratio), 0.5), 2.0) END AS factor FROM u)
SELECT order_key, {r('price_velocity', 'rolling_vol_10min')},
  CASE WHEN sfo < 120 AND coalesce(abs(price_velocity) > 50 * factor, false) THEN 'market_open_artifact'
       WHEN sfo >= 120 AND coalesce(abs(price_velocity) > 30 * factor, false) AND (coalesce(abs(move) > 0.3, false) OR coalesce(volume_ratio < 0.3, false)) THEN 'price_velocity' END AS velocity_method
FROM v"""
ORACLES["collapse_suspicious_cluster"] = f"""WITH {groups('day')}, e AS (
  SELECT *, CASE WHEN timestamp_group IS DISTINCT FROM lag(timestamp_group) OVER {W} THEN 1 ELSE 0 END AS edge FROM g
), i AS (SELECT *, sum(edge) OVER {over('ROWS UNBOUNDED PRECEDING')} AS run FROM e
), k AS (SELECT symbol, run, count(*) AS n, {seconds('min(ts)', 'max(ts)')} AS span, {div("sum(price * volume)", "sum(volume)")} AS mean, min(struct_pack(ts := ts, k := order_key)).k AS first FROM i WHERE timestamp_group GROUP BY symbol, run)
SELECT order_key, round(CASE WHEN n > 5 AND span < 1 AND first = order_key THEN mean ELSE price END, 6) + 0.0 AS price,
  CAST(timestamp_group AND NOT coalesce(n > 5 AND span < 1 AND first = order_key, false) AS BIGINT) AS is_suspicious,
  CAST(timestamp_group AND coalesce(n > 5 AND span < 1 AND first <> order_key, false) AS BIGINT) AS in_cluster
FROM i LEFT JOIN k USING (symbol, run)"""
ORACLES["vwap"] = f"WITH {TICKS} SELECT symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, round({div("sum(price * volume)", "sum(volume)")}, 6) + 0.0 AS vwap, round(sum(volume), 6) + 0.0 AS volume FROM t GROUP BY ALL"
ORACLES["sample_chunks"] = f"""WITH {TICKS}, p AS (SELECT *, row_number() OVER {W} - 1 AS pos, greatest(count(*) OVER (PARTITION BY symbol) // 10, 1) AS step FROM t)
SELECT order_key, symbol, CAST(pos AS BIGINT) AS pos FROM p WHERE pos % step < greatest(step // 10, 1)"""

# volatility
_RET = f"""{TICKS}, v0 AS (SELECT *, coalesce(({ln("price")}) - lag({ln("price")}) OVER {W}, 0) AS ret, coalesce({seconds(f'lag(ts) OVER {W}', 'ts')}, 0.001) AS gap,
  row_number() OVER {W} - 1 AS pos FROM t)"""
ORACLES["log_returns"] = f"WITH {_RET}, x AS (SELECT *, abs(ret) AS abs_ret FROM v0) SELECT order_key, {r('ret', 'abs_ret', 'gap')} FROM x"


def per_tick(windows: str, name: str) -> str:
    return f"""{_RET}, m AS (
  SELECT *, unnest(range(CAST(greatest(0, ceil((pos - 999) / 100.0)) AS BIGINT), CAST(floor(pos / 100.0) AS BIGINT) + 1)) AS win FROM v0
), {windows}, best AS (SELECT symbol, pos, max(vol) AS vol FROM m JOIN w USING (symbol, win) GROUP BY ALL
), j AS (SELECT v0.symbol, v0.ts, v0.order_key, v0.pos, CASE WHEN best.vol > 0 THEN best.vol END AS vol FROM v0 LEFT JOIN best USING (symbol, pos)
), k AS (SELECT *, coalesce(last_value(vol IGNORE NULLS) OVER {over('ROWS UNBOUNDED PRECEDING')},
                   first_value(vol IGNORE NULLS) OVER {over('ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')}, 0) AS filled FROM j
), {name}_x AS (SELECT symbol, order_key, avg(filled) OVER {mid(500)} AS {name} FROM k)"""


_MLE = per_tick("w AS (SELECT symbol, win, greatest(sqrt(avg(ret * ret)), 1e-10) AS vol FROM m GROUP BY ALL HAVING count(*) >= 50)", "mle_vol")
ORACLES["mle_vol"] = f"WITH {_MLE} SELECT order_key, {r('mle_vol')} FROM mle_vol_x"
_FOURIER = per_tick(
    """c AS (SELECT symbol, win, pos, ret, epoch_us(ts) / 1e6 AS clock FROM m
), s AS (SELECT symbol, win, min(pos) AS p0, min(clock) AS t0, max(clock) - min(clock) AS span, count(*) AS n FROM c GROUP BY ALL
), q AS (SELECT symbol, win, f, any_value(span) AS span, sum(ret * cos(2 * pi() * f * (clock - t0) / span)) AS a, sum(ret * sin(2 * pi() * f * (clock - t0) / span)) AS b
  FROM c JOIN s USING (symbol, win), range(1, 51) fr(f) WHERE pos > p0 AND n >= 50 AND span > 0 GROUP BY ALL
), w AS (SELECT symbol, win, sqrt(sum(a * a + b * b) / (2 * any_value(span))) AS vol FROM q GROUP BY ALL)""",
    "fourier_vol",
)
ORACLES["fourier_vol"] = f"WITH {_FOURIER} SELECT order_key, {r('fourier_vol')} FROM fourier_vol_x"
# weights (1 - 2/201)^k fall below 1e-9 of the first after 2100 rows, beyond what six digits show
_EWMA = f"""ew AS (SELECT a.symbol, a.order_key, a.pos, sum(b.ret * b.ret * pow(1 - 2.0 / 201, a.pos - b.pos)) / sum(pow(1 - 2.0 / 201, a.pos - b.pos)) AS x
  FROM v0 a JOIN v0 b ON a.symbol = b.symbol AND b.pos <= a.pos AND b.pos > a.pos - 2600 GROUP BY ALL
), ewma_vol_x AS (SELECT symbol, order_key, CASE WHEN pos >= 9 THEN sqrt(x) END AS ewma_vol FROM ew)"""
ORACLES["ewma_vol"] = f"WITH {_RET}, {_EWMA} SELECT order_key, {r('ewma_vol')} FROM ewma_vol_x"
ORACLES["combined_vol"] = f"""WITH {_MLE}, {_EWMA}
SELECT order_key, round(CASE WHEN ewma_vol IS NULL THEN mle_vol ELSE (mle_vol + ewma_vol) / 2 END, 6) + 0.0 AS combined_vol FROM mle_vol_x JOIN ewma_vol_x USING (symbol, order_key)"""

# features
_F = f"""{_RET}, f0 AS (
  SELECT *, sign(ret) AS sg, {seconds(f'lag(ts) OVER {W}', 'ts')} AS g0, {div("price", f"lag(price) OVER {W}")} - 1 AS rel FROM v0
), f1 AS (SELECT * EXCLUDE (gap), coalesce(g0, median(g0) OVER (PARTITION BY symbol), 1) AS g1, {mean_change(20)} AS volatility,
         CASE WHEN ret >= 0 THEN volume ELSE 0 END AS buy, CASE WHEN ret < 0 THEN volume ELSE 0 END AS sell,
         abs(ret) / (sqrt(volume) + 1e-8) AS kyle_lambda, abs(ret) / (volume + 1e-8) AS amihud FROM f0
), f AS (SELECT *, CASE WHEN g1 = 0 THEN 0.001 ELSE g1 END AS gap FROM f1)"""
WINDOWS = (10, 50, 100)


def least(w: int) -> int:
    return min(max(2, w // 5), 5)


def gated(agg: str, x: str, w: int, m: int) -> str:
    return f"CASE WHEN count({x}) OVER {back(w)} >= {m} THEN {agg} OVER {back(w)} END"


def features(columns: dict[str, str]) -> str:
    body = ", ".join(f"{e} AS {c}_" for c, e in columns.items())
    return f"WITH {_F}, x AS (SELECT order_key, {body} FROM f) SELECT order_key, " + ", ".join(f"round(CAST({c}_ AS DOUBLE), 6) + 0.0 AS {c}" for c in columns) + " FROM x"


_TICK = {
    "tick_direction": "sg", "tick_reversal": f"coalesce(sg * lag(sg) OVER {W}, 0)",
    "tick_run_length": f"CASE WHEN sg = lag(sg) OVER {W} THEN 1 ELSE 0 END", "tick_volatility": "abs(ret)",
}
ORACLES["tick_metrics"] = features(_TICK).replace("round(CAST(tick_run_length_ AS DOUBLE), 6) + 0.0 AS", "CAST(tick_run_length_ AS BIGINT) AS")
_IMBALANCE = {"volume_imbalance": "(buy - sell) / (buy + sell + 1e-8)"}
_IMPACT = {"kyle_lambda": "kyle_lambda", "amihud": "amihud"}
_RS = {"rs_volatility": f"pow(({ln('price')}) - ({ln(f'coalesce(lag(price) OVER {W}, price)')}), 2)"}
_INTENSITY = {"trading_intensity": "volume / gap", "return_intensity": "abs(ret) / gap"}
_REALIZED = {f"realized_vol_{w}": f"sqrt({gated('sum(ret * ret)', 'ret', w, least(w))})" for w in WINDOWS} | {f"abs_return_{w}": gated("avg(abs(ret))", "ret", w, least(w)) for w in WINDOWS}


def _gk(w: int) -> str:
    wide = f"(max(price) OVER {back(w)} / nullif(min(price) OVER {back(w)}, 0))"
    hl = f"ln(greatest({wide}, 1.0001))"
    q = f"(price / nullif(coalesce(lag(price, {w}) OVER {W}, first_value(price) OVER {W}), 0))"
    co = f"ln(CASE WHEN {q} <= 0 THEN 1.0001 WHEN abs({q} - 1) < 1e-4 THEN 1 + sign({q} - 1) * 1e-4 ELSE {q} END)"
    there = f"count(price) OVER {back(w)} >= {least(w)} AND {wide} IS NOT NULL AND {q} IS NOT NULL"
    return f"CASE WHEN {there} THEN sqrt(greatest(0.5 * pow({hl}, 2) - (2 * ln(2) - 1) * pow({co}, 2), 1e-10)) ELSE {_REALIZED[f'realized_vol_{w}']} END"


_GK = {f"gk_vol_{w}": _gk(w) for w in WINDOWS}
_FLOW = {f"order_flow_imbalance_{w}": f"CASE WHEN count(*) OVER {back(w)} >= {least(w)} AND sum(volume) OVER {back(w)} <> 0 THEN (sum(buy) OVER {back(w)} - sum(sell) OVER {back(w)}) / (sum(buy) OVER {back(w)} + sum(sell) OVER {back(w)}) ELSE 0 END" for w in WINDOWS}
_VR = {f"variance_ratio_{w}": f"coalesce(({gated('var_samp(ret)', 'ret', w // 2, least(w) // 2)}) / (({gated('var_samp(ret)', 'ret', w, least(w))}) / 2 + 1e-8), 1)" for w in WINDOWS}
_LIQUID = (
    {f"kyle_lambda_{w}": gated("avg(kyle_lambda)", "kyle_lambda", w, least(w)) for w in WINDOWS}
    | {f"amihud_{w}": gated("avg(amihud)", "amihud", w, least(w)) for w in WINDOWS}
    | {f"tick_pattern_{w}": gated("avg(sg)", "sg", w, least(w)) for w in WINDOWS}
    | {f"rel_volume_{w}": f"({gated('avg(volume)', 'volume', w, least(w))}) / avg(volume) OVER (PARTITION BY symbol)" for w in WINDOWS}
)
_CYCLE = {f"{f}_time": f"{f}(2 * pi() * (hour(ts) * 60 + minute(ts)) / 1440)" for f in ("sin", "cos")}
_ADJUSTED = {"vol_adjusted_return": "ret / (volatility + 1e-8)", "vol_impact_ratio": "kyle_lambda / (volatility + 1e-8)"}


def _trend(w: int) -> str:
    mean = gated("avg(volatility)", "volatility", w, max(2, w // 5))
    return f"coalesce(CASE WHEN volatility IS NOT NULL AND ({mean}) IS NOT NULL THEN least(greatest(volatility / greatest({mean}, 1e-10), 0.1), 10) - 1 END, 0)"


_TREND = {f"vol_trend_{w}": _trend(w) for w in WINDOWS}
for _name, _columns in (
    ("volume_imbalance", _IMBALANCE), ("price_impact", _IMPACT), ("rs_volatility", _RS), ("intensity", _INTENSITY), ("realized_vol", _REALIZED), ("garman_klass", _GK),
    ("order_flow", _FLOW), ("variance_ratio", _VR), ("rolling_liquidity", _LIQUID), ("time_cyclic", _CYCLE), ("vol_adjusted", _ADJUSTED), ("vol_trend", _TREND),
):
    ORACLES[_name] = features(_columns)
_ALL = _TICK | _IMBALANCE | _IMPACT | _RS | _INTENSITY | _REALIZED | _GK | _FLOW | _VR | _LIQUID | _TREND | _CYCLE | {"volatility": "volatility"} | _ADJUSTED
ORACLES["all_features"] = features(_ALL).replace("round(CAST(tick_run_length_ AS DOUBLE), 6) + 0.0 AS", "CAST(tick_run_length_ AS BIGINT) AS")
ORACLES["null_profile"] = f"WITH {scored()} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) AS n, count(*) - count({c}) AS n_null FROM s" for c in ("price", "volume", "volatility", "change", "pct"))
ORACLES["fill_chain"] = f"""WITH {TICKS}, x AS (SELECT *, CASE WHEN volume > 20 THEN volume END AS v FROM t
), y AS (SELECT order_key, last_value(v IGNORE NULLS) OVER {over('ROWS UNBOUNDED PRECEDING')} AS ffilled,
  first_value(v IGNORE NULLS) OVER {over('ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING')} AS bfilled, median(v) OVER (PARTITION BY symbol) AS typical FROM x)
SELECT order_key, round(coalesce(ffilled, bfilled, typical, 0), 6) + 0.0 AS filled, {r('ffilled', 'bfilled')} FROM y"""

_ROWS = """fr AS (SELECT event_id AS row_id, CAST(value AS DOUBLE) AS price, CAST(1 + CAST(props::json->>'$.k' AS INT) AS DOUBLE) AS volume,
  CAST(hour(ts) * 60 + minute(ts) AS DOUBLE) AS minute, CAST(user_id AS DOUBLE) AS activity FROM events)"""
NAMES = ("price", "volume", "minute", "activity")
ORACLES["standardize"] = f"WITH {_ROWS} SELECT row_id, " + ", ".join(f"round(({c} - (SELECT avg({c}) FROM fr)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM fr), 6) + 0.0 AS {c}" for c in NAMES) + " FROM fr"
ORACLES["feature_corr_rank"] = f"WITH {_ROWS} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, round(abs(corr({c}, price)), 6) + 0.0 AS importance FROM fr" for c in NAMES)
ORACLES["robust_scale"] = f"WITH {_ROWS} SELECT row_id, " + ", ".join(f"round(({c} - (SELECT median({c}) FROM fr)) / (SELECT CASE WHEN q3 = q1 THEN 1 ELSE q3 - q1 END FROM (SELECT quantile_cont({c}, 0.75) q3, quantile_cont({c}, 0.25) q1 FROM fr)), 6) + 0.0 AS {c}" for c in NAMES) + " FROM fr"


# information
def bins(n: int) -> str:
    return f"""{_ROWS}, lg AS ({' UNION ALL '.join(f"SELECT row_id, '{c}' AS feature, {c} AS x FROM fr" for c in NAMES)}
), sp AS (SELECT feature, min(x) AS lo, max(x) AS hi FROM lg GROUP BY feature
), bn AS (SELECT row_id, feature, x, CASE WHEN hi > lo THEN least(CAST(floor((x - lo) / (hi - lo) * {n}) AS BIGINT), {n - 1}) ELSE 0 END AS bin FROM lg JOIN sp USING (feature))"""


_H = "SELECT feature, -sum(p * ln(p)) AS h FROM (SELECT feature, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY feature) AS p FROM bn GROUP BY feature, bin) GROUP BY feature"
_MI = """SELECT fi, fj, sum(p * ln(p / (pi_ * pj))) AS mi FROM (
  SELECT fi, fj, p, sum(p) OVER (PARTITION BY fi, fj, bi) AS pi_, sum(p) OVER (PARTITION BY fi, fj, bj) AS pj FROM (
    SELECT a.feature AS fi, b.feature AS fj, a.bin AS bi, b.bin AS bj, count(*) * 1.0::DOUBLE / (SELECT count(*) FROM fr) AS p
    FROM bn a JOIN bn b ON a.row_id = b.row_id AND a.feature < b.feature GROUP BY ALL)) GROUP BY fi, fj"""
_INFO = f"{bins(16)}, h AS ({_H}), m AS ({_MI}), m2 AS (SELECT fi, fj, mi FROM m UNION ALL SELECT fj, fi, mi FROM m)"
ORACLES["histogram"] = f"WITH {bins(16)} SELECT feature, bin, count(*) AS n FROM bn GROUP BY ALL"
ORACLES["hist_entropy"] = f"WITH {bins(10)}, h AS ({_H}) SELECT feature, {r('h')} FROM h"
ORACLES["mutual_info"] = f"WITH {_INFO} SELECT fi, fj, {r('mi')} FROM m"
ORACLES["tail_factor"] = f"WITH {bins(10)}, k AS (SELECT feature, kurtosis_pop(x) AS k FROM lg GROUP BY feature) SELECT feature, round(k, 6) + 0.0 AS k, round(CASE WHEN k > 0 THEN ln(1 + k) ELSE 1 END, 6) + 0.0 AS factor FROM k"
ORACLES["conditional_entropy"] = f"""WITH {bins(10)}, j AS (SELECT a.feature, a.bin AS bx, b.bin AS bt, count(*) AS n FROM bn a JOIN bn b ON a.row_id = b.row_id AND b.feature = 'price' WHERE a.feature <> 'price' GROUP BY ALL
), k AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature, bx) AS g, sum(n) OVER (PARTITION BY feature) AS t FROM j)
SELECT feature, round(-sum(n / t * ln(n / g)), 6) + 0.0 AS h FROM k GROUP BY feature"""
_TE = f"""WITH {bins(8)}, j AS (
  SELECT x.feature AS src, y.feature AS dst, z.bin AS y1, y.bin AS y0, x.bin AS x0, count(*) * 1.0::DOUBLE AS n
  FROM bn y JOIN bn z ON z.feature = y.feature AND z.row_id = y.row_id + 1 JOIN bn x ON x.row_id = y.row_id AND x.feature <> y.feature GROUP BY ALL
), a AS (SELECT src, dst, -sum(n * ln(n / g)) / sum(n) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY src, dst, y0) AS g FROM (SELECT src, dst, y1, y0, sum(n) AS n FROM j GROUP BY ALL)) GROUP BY ALL
), b AS (SELECT src, dst, -sum(n * ln(n / g)) / sum(n) AS h FROM (SELECT *, sum(n) OVER (PARTITION BY src, dst, y0, x0) AS g FROM j) GROUP BY ALL)
SELECT src, dst, greatest(a.h - b.h, 0) AS te FROM a JOIN b USING (src, dst)"""
ORACLES["transfer_entropy"] = f"SELECT src, dst, {r('te')} FROM ({_TE})"
_KL = f"""WITH {_ROWS}, ends AS (SELECT unnest(range(300, (SELECT max(row_id) FROM fr) + 1, 100)) AS pos
), rw AS (SELECT pos, price, row_id >= pos - 200 AS late, row_id < pos - 100 AS early FROM ends JOIN fr ON row_id >= pos - 300 AND row_id < pos
), sp AS (SELECT pos, min(price) AS lo, max(price) AS hi FROM rw GROUP BY pos
), c AS (SELECT pos, CASE WHEN hi > lo THEN least(floor((price - lo) / (hi - lo) * 8), 7) ELSE 0 END AS bin, count(*) FILTER (late) / 200.0 + 1e-10 AS p, count(*) FILTER (early) / 200.0 + 1e-10 AS q FROM rw JOIN sp USING (pos) GROUP BY ALL)
SELECT pos, sum(p * ln(p / q)) AS kl FROM c GROUP BY pos"""
ORACLES["rolling_kl"] = f"SELECT pos, {r('kl')} FROM ({_KL})"
ORACLES["nmi_rank"] = f"""WITH {_INFO}, x AS (SELECT fi AS feature, coalesce(mi / sqrt(h.h * (SELECT h FROM h WHERE feature = 'price')), 0) AS nmi FROM m2 JOIN h ON h.feature = fi WHERE fj = 'price')
SELECT feature, round(nmi, 6) + 0.0 AS nmi, row_number() OVER (ORDER BY round(nmi, 9) DESC, feature) AS rank FROM x"""
_IMPORTANCE = """imp AS (SELECT feature, greatest(0.5 * (h - min(h) OVER () + 1e-10) / (max(h) OVER () - min(h) OVER () + 1e-10) + 0.5 * (mi - min(mi) OVER () + 1e-10) / (max(mi) OVER () - min(mi) OVER () + 1e-10), 0) AS importance
  FROM h JOIN m2 ON fi = feature AND fj = 'price')"""
ORACLES["feature_importance"] = f"WITH {_INFO}, {_IMPORTANCE} SELECT feature, {r('importance')} FROM imp"
_SCORES = """sc0 AS (SELECT s.fi AS feature, s.mi / sqrt(h.h * (SELECT h FROM h WHERE feature = 'price')) AS nmi,
    s.mi / ((SELECT avg(mi) FROM m2 z WHERE z.fi = s.fi AND z.fj <> 'price') + 1e-10) AS snr FROM m2 s JOIN h ON h.feature = s.fi WHERE s.fj = 'price'
), sc AS (SELECT feature, 0.5 * nmi + 0.3 * snr / max(snr) OVER () AS score FROM sc0)"""
ORACLES["selector_scores"] = f"WITH {_INFO}, {_SCORES} SELECT feature, {r('score')} FROM sc"
ORACLES["feature_redundancy"] = f"WITH {_INFO} SELECT fi, fj, round(coalesce(mi / least(a.h, b.h), 0), 6) + 0.0 AS redundancy FROM m JOIN h a ON a.feature = fi JOIN h b ON b.feature = fj"
ORACLES["greedy_selection"] = f"""WITH {_INFO}, {_SCORES}, one AS (SELECT feature FROM sc ORDER BY score DESC, feature LIMIT 1
), two AS (SELECT sc.feature FROM sc, one LEFT JOIN m2 ON m2.fi = one.feature AND m2.fj = sc.feature LEFT JOIN h a ON a.feature = m2.fi LEFT JOIN h b ON b.feature = m2.fj
  WHERE sc.feature <> one.feature ORDER BY score - 0.5 * coalesce(mi / least(a.h, b.h), 0) DESC, sc.feature LIMIT 1)
SELECT CAST(0 AS INT) AS rank, feature FROM one UNION ALL SELECT CAST(1 AS INT), feature FROM two"""
ORACLES["entropy_weighted"] = f"WITH {_INFO}, {_IMPORTANCE} SELECT row_id, " + ", ".join(f"round({c} * (SELECT importance FROM imp WHERE feature = '{c}'), 4) + 0.0 AS {c}_ent_weighted" for c in NAMES if c != "price") + " FROM fr"
_TO_TARGET = f"te AS (SELECT src AS feature, te FROM ({_TE}) WHERE dst = 'price')"
ORACLES["enhancement_potential"] = f"""WITH {_INFO}, {_TO_TARGET}
SELECT fi AS feature, round(CASE WHEN mi > 0 THEN te / mi ELSE 0 END, 6) + 0.0 AS potential FROM m2 JOIN te ON te.feature = fi WHERE fj = 'price'"""
ORACLES["enhancement_strategy"] = f"""WITH {_INFO}, {_TO_TARGET}, k AS (SELECT feature, kurtosis_pop(x) AS k FROM lg GROUP BY feature
), sh AS (SELECT fi AS feature, sum(mi) AS s, count(*) AS n FROM m2 GROUP BY fi)
SELECT h.feature, CAST(h.h > (SELECT median(h) FROM h) AS BIGINT) AS entropy_weighted, CAST(h.feature = 'price' OR coalesce(te, 0) > 0.01 AS BIGINT) AS te_weighted,
  CAST((s + h.h) / (n + 1) > 0.1 AS BIGINT) AS kl_weighted, CAST(k > 2 AS BIGINT) AS tail_emphasis
FROM h JOIN sh USING (feature) JOIN k USING (feature) LEFT JOIN te USING (feature)"""
ORACLES["te_weighted"] = f"WITH {_ROWS}, {_TO_TARGET} SELECT row_id, " + ", ".join(f"round({c} * (SELECT te FROM te WHERE feature = '{c}'), 4) + 0.0 AS {c}_te_weighted" for c in NAMES if c != "price") + " FROM fr"
_SIXTH = f"{_ROWS}, sx AS (SELECT row_id, pow(price, 6) AS price, pow(volume, 6) AS volume FROM fr)"
ORACLES["tail_emphasized"] = f"WITH {_SIXTH} SELECT row_id, " + ", ".join(f"round({c} * (SELECT ln(1 + kurtosis_pop({c})) FROM sx) / 1e9, 3) + 0.0 AS {c}_tail_emphasized" for c in ("price", "volume")) + " FROM sx"
ORACLES["kl_weighted"] = f"""WITH {_ROWS}, k AS ({_KL})
SELECT row_id, round(price * (1 + ln(1 + greatest(coalesce(kl, 0), 0))), 6) + 0.0 AS price_kl_weighted FROM fr LEFT JOIN k ON k.pos = row_id // 100 * 100"""
ORACLES["lagged_corr_te"] = (
    f"WITH {_ROWS}, n AS (SELECT *, " + ", ".join(f"lead({c}) OVER (ORDER BY row_id) AS next_{c}" for c in NAMES) + " FROM fr), c AS ("
    + " UNION ALL ".join(f"SELECT '{a}' AS src, '{b}' AS dst, coalesce(pow(corr({a}, next_{b}), 2), 0) AS te FROM n" for a in NAMES for b in NAMES if a != b)
    + ") SELECT src, dst, round(coalesce(te / nullif(max(te) OVER (), 0), 0), 6) + 0.0 AS te FROM c"
)
ORACLES["select_by_variance"] = f"WITH {_ROWS}, v AS (" + " UNION ALL ".join(f"SELECT '{c}' AS feature, var_pop({c}) AS variance FROM fr" for c in NAMES) + f") SELECT feature, {r('variance')} FROM v ORDER BY variance DESC, feature LIMIT 2"

# topology
_PT = """pt AS (SELECT vec_id AS pos, vec_id / greatest((SELECT max(vec_id) FROM embeddings), 1) AS t, embedding::DOUBLE[] AS v, CAST(embedding[1] AS DOUBLE) AS y, CAST(embedding[2] AS DOUBLE) AS x, label FROM embeddings
), mb AS (SELECT *, unnest(range(CAST(greatest(0, ceil((pos - 99) / 50.0)) AS BIGINT), CAST(floor(pos / 50.0) AS BIGINT) + 1)) AS win FROM pt)"""


def distances(plain: str) -> str:
    return f"{_PT}, ds AS (SELECT a.win, a.pos AS i, b.pos AS j, {plain} * (1 + 0.5 * (1 - exp(-abs(b.t - a.t)))) AS dist FROM mb a JOIN mb b ON a.win = b.win AND a.pos < b.pos)"


_D2 = distances("list_distance(a.v, b.v)")
_E = f"{_D2}, e AS (SELECT win, i AS src, j AS dst, 1 / greatest(dist, 1e-10) AS weight, dist AS distance FROM ds WHERE dist <= 1.28)"
ORACLES["temporal_distance"] = f"WITH {_D2} SELECT win, i, j, {r('dist')} FROM ds"
ORACLES["temporal_distance_l1"] = "WITH " + distances("list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))") + f" SELECT win, i, j, {r('dist')} FROM ds"
ORACLES["epsilon_graph"] = f"WITH {_E} SELECT win, src, dst, {r('weight', 'distance')} FROM e"
ORACLES["knn_graph"] = f"""WITH {_D2}, b AS (SELECT win, i AS src, j AS dst, dist FROM ds UNION ALL SELECT win, j, i, dist FROM ds)
SELECT win, src, dst, round(dist, 6) + 0.0 AS distance FROM b QUALIFY row_number() OVER (PARTITION BY win, src ORDER BY dist, dst) <= 5"""
ORACLES["path_counts"] = f"""WITH {_E}, p2 AS (SELECT a.win, a.src AS a, a.dst AS b, c.dst AS c FROM e a JOIN e c ON a.win = c.win AND a.dst = c.src)
SELECT win, CAST(1 AS BIGINT) AS k, count(*) AS n FROM e GROUP BY win UNION ALL SELECT win, 2, count(*) FROM p2 GROUP BY win
UNION ALL SELECT p2.win, 3, count(*) FROM p2 JOIN e ON e.win = p2.win AND e.src = p2.c GROUP BY p2.win"""
ORACLES["top_paths"] = f"""WITH {_E}, s AS (SELECT e.*, abs(b.y - a.y) AS change, weight * (1 + abs(b.y - a.y)) AS s FROM e JOIN pt a ON a.pos = src JOIN pt b ON b.pos = dst
), p AS (SELECT f.win, f.src AS a, f.dst AS b, g.dst AS c, (f.s + g.s) / 2 AS score, greatest(f.change, g.change) > 0.05 AS volatile FROM s f JOIN s g ON f.win = g.win AND f.dst = g.src
), q AS (SELECT *, volatile AND row_number() OVER (PARTITION BY win, volatile ORDER BY round(score, 9) DESC, a, b, c) <= 10 AS kept FROM p
), z AS (SELECT *, row_number() OVER (PARTITION BY win ORDER BY CAST(kept AS INT) DESC, round(score, 9) DESC, a, b, c) AS rank FROM q)
SELECT win, a, b, c, {r('score')}, {big('volatile')}, rank FROM z WHERE rank <= 20"""
ORACLES["directed_triangles"] = f"""WITH {_E} SELECT f.win, f.src AS a, f.dst AS b, g.dst AS c, round(greatest(f.distance, g.distance, k.distance), 6) + 0.0 AS filtration
FROM e f JOIN e g ON f.win = g.win AND f.dst = g.src JOIN e k ON k.win = f.win AND k.src = f.src AND k.dst = g.dst"""
ORACLES["network_stats"] = f"""WITH {_E}, g AS (SELECT win, v, count(*) AS d FROM (SELECT win, src AS v FROM e UNION ALL SELECT win, dst FROM e) GROUP BY ALL)
SELECT win, CAST(sum(d) / 2 AS BIGINT) AS edges, round(sum(d) / 9900.0, 6) + 0.0 AS density, round(sum(d) / 100.0, 6) + 0.0 AS mean_degree, max(d) AS max_degree FROM g GROUP BY win"""
ORACLES["window_overlap"] = f"WITH {_PT} SELECT a.win, count(*) AS shared FROM mb a JOIN mb b ON b.win = a.win + 1 AND a.pos = b.pos GROUP BY a.win"
_STATS = f"{_PT}, st AS (SELECT win, count(*) AS n, avg(y) AS mean, stddev_pop(y) AS std, max(y) - min(y) AS range FROM mb GROUP BY win)"
ORACLES["window_vol_stats"] = f"WITH {_STATS} SELECT win, n, {r('mean', 'std', 'range')} FROM st"
ORACLES["adaptive_epsilon"] = f"WITH {_STATS} SELECT win, round(1.2 + (1.4 - 1.2) * (1 - 0.5 * coalesce(range / nullif(max(range) OVER (), 0), 0)), 6) + 0.0 AS epsilon FROM st"
ORACLES["top_windows"] = f"""WITH {_PT}, s AS (SELECT win, min(y) AS lo, max(y) AS hi, count(*) AS n FROM mb GROUP BY win
), b AS (SELECT win, CASE WHEN hi > lo THEN least(floor((y - lo) / (hi - lo) * 10), 9) ELSE 0 END AS bin, count(*) * 1.0::DOUBLE / any_value(n) AS p FROM mb JOIN s USING (win) GROUP BY ALL
), h AS (SELECT win, -sum(p * ln(p)) AS h FROM b GROUP BY win)
SELECT win, {r('h')} FROM h QUALIFY count(*) OVER () <= 10 OR row_number() OVER (ORDER BY round(h, 9) DESC, win) <= 7"""
ORACLES["epsilon_range"] = f"""WITH {_D2}, q AS (SELECT quantile_cont(dist, [0.05, 0.25, 0.5, 0.75, 0.5]) AS q FROM ds)
SELECT round(greatest(q[1], q[3] - 1.5 * (q[4] - q[2])), 6) + 0.0 AS least, round(least(q[5], q[3] + 1.5 * (q[4] - q[2])), 6) + 0.0 AS most FROM q"""
ORACLES["epsilon_gain"] = f"""WITH {_D2}, tr AS (SELECT unnest([1.2, 1.25, 1.3, 1.35])::DOUBLE AS epsilon
), dg AS (SELECT epsilon, v AS pos, count(*) AS d FROM (SELECT epsilon, i AS v FROM ds, tr WHERE dist <= epsilon UNION ALL SELECT epsilon, j FROM ds, tr WHERE dist <= epsilon) GROUP BY ALL
), tg AS (SELECT pos, least(floor((y - (SELECT min(y) FROM pt)) / ((SELECT max(y) FROM pt) - (SELECT min(y) FROM pt)) * 10), 9) AS yb FROM pt
), rw AS (SELECT epsilon, tg.pos, yb, coalesce(d, 0) AS d FROM tg CROSS JOIN tr LEFT JOIN dg USING (epsilon, pos)
), sp AS (SELECT epsilon, min(d) AS lo, max(d) AS hi, count(*) AS t FROM rw GROUP BY epsilon
), c AS (SELECT epsilon, yb, CASE WHEN hi > lo THEN least(floor((d - lo) / (hi - lo) * 10), 9) ELSE 0 END AS db, count(*) * 1.0::DOUBLE / any_value(t) AS p FROM rw JOIN sp USING (epsilon) GROUP BY ALL
), hy AS (SELECT epsilon, -sum(p * ln(p)) AS h FROM (SELECT epsilon, yb, sum(p) AS p FROM c GROUP BY ALL) GROUP BY epsilon
), hd AS (SELECT epsilon, -sum(p * ln(p / g)) AS h FROM (SELECT epsilon, p, sum(p) OVER (PARTITION BY epsilon, db) AS g FROM c) GROUP BY epsilon)
SELECT epsilon, round(coalesce((hy.h - hd.h) / nullif(hy.h, 0), 0), 6) + 0.0 AS gain FROM hy JOIN hd USING (epsilon)"""
_COVER = f"""{_PT}, sp AS (SELECT min(y) AS lo, max(y) AS hi, (max(y) - min(y)) / 10 AS w FROM pt
), cv AS (SELECT pos, y, x, cell FROM pt, sp, range(0, 10) r(cell) WHERE y >= lo + cell * w - w * 0.3 AND y <= lo + (cell + 1) * w + w * 0.3)"""
ORACLES["mapper_cover"] = f"WITH {_COVER} SELECT pos, CAST(cell AS BIGINT) AS cell FROM cv"
ORACLES["mapper_graph"] = f"""WITH {_COVER}, g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY cell ORDER BY x, pos) > 0.02 THEN 1 ELSE 0 END AS edge FROM cv
), k AS (SELECT pos, cell, CAST(sum(edge) OVER (PARTITION BY cell ORDER BY x, pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g)
SELECT CAST(a.cell AS BIGINT) AS cell_a, a.cluster AS cluster_a, CAST(b.cell AS BIGINT) AS cell_b, b.cluster AS cluster_b, count(*) AS shared FROM k a JOIN k b ON a.pos = b.pos AND a.cell < b.cell GROUP BY ALL"""
_CURVE = """dg AS (SELECT CAST(l_orderkey % 20 AS BIGINT) AS win, CAST(l_linenumber AS BIGINT) AS dim, l_discount AS birth, l_discount + l_tax AS death FROM lineitem
), gr AS (SELECT CAST(i AS BIGINT) AS step, 0.0::DOUBLE + i * ((0.2::DOUBLE - 0.0) / 32) AS f FROM range(0, 33) r(i)
), cu AS (SELECT win, dim, step, coalesce(betti, 0) AS betti FROM (SELECT DISTINCT win, dim FROM dg) CROSS JOIN gr LEFT JOIN (
  SELECT win, dim, step, count(*) AS betti FROM dg JOIN gr ON birth <= f AND f < death GROUP BY ALL) USING (win, dim, step))"""
ORACLES["betti_curve"] = f"WITH {_CURVE} SELECT win, dim, step, betti FROM cu"
ORACLES["betti_summary"] = f"WITH {_CURVE} SELECT win, dim, round(avg(betti), 6) + 0.0 AS mean, max(betti) AS most, min(betti) AS least, round(stddev_pop(betti), 6) + 0.0 AS std FROM cu GROUP BY win, dim"

# regimes and runs
_LB = f"""{TICKS}, lb AS (SELECT symbol AS series, row_number() OVER {W} - 1 AS pos, CAST(floor(price / 125) AS BIGINT) AS regime, volume / 100 AS confidence, price, volume FROM t
), ed AS (SELECT *, CASE WHEN pos > 0 AND regime <> lag(regime) OVER (PARTITION BY series ORDER BY pos) THEN 1 ELSE 0 END AS edge FROM lb
), ir AS (SELECT *, CAST(sum(edge) OVER (PARTITION BY series ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run_id FROM ed
), ru AS (SELECT series, run_id, any_value(regime) AS regime, min(pos) AS "start", max(pos) AS "end", count(*) AS length, avg(confidence) AS confidence FROM ir GROUP BY series, run_id
), tm AS (SELECT src, dst, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY src) AS p FROM (SELECT regime AS src, lead(regime) OVER (PARTITION BY series ORDER BY pos) AS dst FROM lb) WHERE dst IS NOT NULL GROUP BY src, dst)"""
ORACLES["regime_runs"] = f'WITH {_LB} SELECT series, run_id, regime, "start", "end", length FROM ru'
ORACLES["run_length_stats"] = f"WITH {_LB} SELECT regime, count(*) AS n, round(avg(length), 6) + 0.0 AS mean, min(length) AS shortest, max(length) AS longest, round(median(length), 6) + 0.0 AS median FROM ru GROUP BY regime"
# expected runs of m rows or more among shuffled labels: (n - k + 1) k..(k-m+1) / n..(n-m+1) for each kind
ORACLES["min_run_length"] = f"""WITH {_LB}, kc AS (SELECT series, regime, count(*) AS k, sum(count(*)) OVER (PARTITION BY series) AS n FROM lb GROUP BY series, regime
), tl AS (SELECT m, sum(CASE WHEN m <= k THEN (n - k + 1) * list_product(list_transform(range(0, m), lambda i: (k - i)::DOUBLE / (n - i))) ELSE 0 END) AS x FROM kc, range(1, 400) r(m) GROUP BY m)
SELECT CAST(greatest(min(m) + 1, 3) AS BIGINT) AS least FROM (SELECT m - 1 AS m FROM tl WHERE x < 0.05 * (SELECT x FROM tl WHERE m = 1))"""
ORACLES["transition_matrix"] = f"WITH {_LB} SELECT src, dst, {r('p')} FROM tm"
ORACLES["transition_forecast"] = f"""WITH {_LB}, p2 AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM tm a JOIN tm b ON a.dst = b.src GROUP BY ALL), p3 AS (SELECT a.src, b.dst, sum(a.p * b.p) AS p FROM p2 a JOIN tm b ON a.dst = b.src GROUP BY ALL)
SELECT CAST(1 AS BIGINT) AS step, src, dst, {r('p')} FROM tm UNION ALL SELECT 2, src, dst, {r('p')} FROM p2 UNION ALL SELECT 3, src, dst, {r('p')} FROM p3"""
ORACLES["transition_points"] = f"WITH {_LB}, x AS (SELECT series, pos, lag(regime) OVER (PARTITION BY series ORDER BY pos) AS src, regime AS dst FROM lb) SELECT * FROM x WHERE src <> dst"


def stats(x: str) -> str:
    return f"WITH {_LB} SELECT regime, count(*) AS n, round(avg({x}), 6) + 0.0 AS mean, round(stddev_pop({x}), 6) + 0.0 AS std, round(min({x}), 6) + 0.0 AS lo, round(max({x}), 6) + 0.0 AS hi FROM lb GROUP BY regime"


ORACLES["regime_stats"], ORACLES["regime_feature_stats"] = stats("volume"), stats("price")


def smoothing(weight: str, left: str = "lw >= rw") -> str:
    return f"""WITH {_LB}, nb AS (SELECT *, {weight} AS w FROM ru), nn AS (
  SELECT *, lag(regime) OVER o AS lr, lead(regime) OVER o AS rr, lag(w) OVER o AS lw, lead(w) OVER o AS rw FROM nb WINDOW o AS (PARTITION BY series ORDER BY run_id))
SELECT series, run_id, regime, CASE WHEN length >= 3 THEN regime WHEN lr IS NULL THEN coalesce(rr, regime) WHEN rr IS NULL THEN lr WHEN {left} THEN lr ELSE rr END AS smoothed FROM nn"""


ORACLES["smooth_persistence_pass"] = smoothing("length")
ORACLES["smooth_confidence_pass"] = smoothing("length * (1 + 0.5 * confidence)")
ORACLES["smooth_transition_pass"] = smoothing("0", "coalesce((SELECT p FROM tm WHERE src = lr AND dst = regime), 0) >= coalesce((SELECT p FROM tm WHERE src = regime AND dst = rr), 0)")


def js(sample: str, key: str) -> str:
    """sample: CTEs that end in ``sm(key, side, x)``."""
    return f"""WITH {sample}, sp AS (SELECT {key}, min(x) AS lo, max(x) AS hi FROM sm GROUP BY ALL
), n AS (SELECT {key}, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb FROM sm GROUP BY ALL
), c AS (SELECT {key}, CASE WHEN hi > lo THEN least(floor((x - lo) / (hi - lo) * 10), 9) ELSE 0 END AS bin, count(*) FILTER (side = 0) AS ca, count(*) FILTER (side = 1) AS cb FROM sm JOIN sp USING ({key}) GROUP BY ALL
), f AS (SELECT {key}, bin, coalesce(ca, 0) / na / CASE WHEN hi > lo THEN (hi - lo) / 10 ELSE 0.1 END + 1e-10 AS a, coalesce(cb, 0) / nb / CASE WHEN hi > lo THEN (hi - lo) / 10 ELSE 0.1 END + 1e-10 AS b
  FROM sp JOIN n USING ({key}) CROSS JOIN (SELECT i * 1.0::DOUBLE AS bin FROM range(0, 10) r(i)) LEFT JOIN c USING ({key}, bin)
), p AS (SELECT {key}, a / sum(a) OVER (PARTITION BY {key}) AS p, b / sum(b) OVER (PARTITION BY {key}) AS q FROM f)
SELECT {key}, round(sqrt(greatest(sum(p * ln(2 * p / (p + q)) + q * ln(2 * q / (p + q))) / 2, 0)), 6) + 0.0 AS js FROM p GROUP BY {key}"""


ORACLES["js_distance"] = js(f"{TICKS}, sm AS (SELECT symbol, CASE WHEN hour(ts) < 12 THEN 0 ELSE 1 END AS side, price AS x FROM t)", "symbol")
ORACLES["rsip_costs"] = js(
    f"{_LB}, lg AS (SELECT series, run_id FROM ru WHERE length >= 3 AND run_id > 0), sm AS (SELECT series, run_id, 0 AS side, price AS x FROM ir JOIN lg USING (series, run_id) UNION ALL SELECT ir.series, lg.run_id, 1, price FROM ir JOIN lg ON ir.series = lg.series AND ir.run_id + 1 = lg.run_id)",
    "series, run_id",
)
_VEC = f"{_PT}, vp AS (SELECT pos, label, list_slice(v, 1, 8) AS f FROM pt), ct AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(f[i]) AS m FROM vp, range(1, 9) r(i) GROUP BY label, i) GROUP BY label)"
ORACLES["nearest_centroid"] = f"""WITH {_VEC}, d AS (SELECT pos, ct.label, list_distance(f, c) AS d, row_number() OVER (PARTITION BY pos ORDER BY list_distance(f, c), ct.label) AS k FROM vp, ct)
SELECT pos, CAST(max(label) FILTER (k = 1) AS BIGINT) AS regime, round(max(d) FILTER (k = 2) / (max(d) FILTER (k = 1) + 1e-10), 6) + 0.0 AS confidence FROM d GROUP BY pos"""

# simulation and calendar
_GP = """gp AS (SELECT o_custkey % 5 AS series, o_orderkey AS idx, o_totalprice / 1000 + 1 AS price, ln(o_totalprice / 1000 + 1) AS log_price, (o_custkey % 7 + 1) / 20 AS volatility,
  (o_orderkey % 11) / 100 AS bn, (o_orderkey % 13) / 100 AS an FROM orders)"""
ORACLES["quote_spread"] = f"""WITH {_GP}, a AS (SELECT *, 1e-4 * (1 + 0.5 * volatility) * price AS wide, idx * 10.0::DOUBLE / max(idx) OVER (PARTITION BY series) AS x FROM gp
), b AS (SELECT *, price - wide / 2 * (1 + bn) AS b0, price + wide / 2 * (1 + an) AS a0, 1 + 0.2 * sin(x) + 0.1 * sin(2 * x) + 0.05 * sin(5 * x) AS season FROM a
), c AS (SELECT *, CASE WHEN b0 >= a0 THEN (b0 + a0) / 2 - wide / 2 ELSE b0 END AS b1, CASE WHEN b0 >= a0 THEN (b0 + a0) / 2 + wide / 2 ELSE a0 END AS a1 FROM b
), d AS (SELECT idx, price - (price - b1) * season AS bid, price + (a1 - price) * season AS ask FROM c), e AS (SELECT *, (bid + ask) / 2 AS mid, ask - bid AS spread FROM d)
SELECT idx, {r('bid', 'ask', 'mid', 'spread')} FROM e"""
ORACLES["momentum_factor"] = f"""WITH {_GP}, m AS (SELECT idx, 0.5 + 0.3 * tanh(coalesce((log_price - lag(log_price, 5) OVER (PARTITION BY series ORDER BY idx)) / greatest(volatility * sqrt(5e-4), 1e-8), 0)) AS momentum_factor FROM gp)
SELECT idx, {r('momentum_factor')} FROM m"""
ORACLES["quote_revision_points"] = f"WITH {_GP}, m AS (SELECT idx, price, coalesce(lag(price) OVER (PARTITION BY series ORDER BY idx), price) AS before FROM gp) SELECT idx FROM m WHERE abs(price - before) / greatest(before, 1e-8) >= 0.9 OR idx % 20 = 0"
ORACLES["order_flow_impact"] = f"""WITH {_GP}, o AS (SELECT o_orderkey AS idx, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE -1 END * (o_custkey % 9 + 1) AS flow FROM orders WHERE o_orderstatus <> 'P'
), m AS (SELECT idx, sum(coalesce(flow, 0) * 2e-5 * price) OVER (PARTITION BY series ORDER BY idx ROWS UNBOUNDED PRECEDING) AS impact FROM gp LEFT JOIN o USING (idx))
SELECT idx, {r('impact')} FROM m"""
ORACLES["month_urls"] = """SELECT CAST(CAST(m AS DATE) AS VARCHAR) AS month, 'https://example.org/calendar?month=' || lower(strftime(m, '%b.%Y')) AS url
FROM (SELECT unnest(generate_series(TIMESTAMP '2024-11-01', TIMESTAMP '2025-02-01', INTERVAL 1 MONTH)) AS m)"""
ORACLES["parse_calendar_date"] = "SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS date FROM orders"
ORACLES["calendar_filter"] = """SELECT o_orderkey, 'USD' AS currency, 'High' AS impact, o_orderstatus AS actual, o_orderstatus AS forecast, o_orderstatus AS previous FROM orders
WHERE o_custkey % 2 = 0 AND o_orderpriority = '1-URGENT' AND o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 7 <> 0"""
