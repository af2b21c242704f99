"""Queries for daily indicators, regime, long trend and attention."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import rnd
from tidemark.operators import daily as D
from tidemark.plans.registry import query
from tidemark.plans.sqltext import daily_cte, ema_sql, gap_ewm_sql, r
from tidemark.sources.tables import daily_closes, table

DW = "PARTITION BY symbol ORDER BY session_date"


def days(spark, d):
    return daily_closes(table(spark, d, "orders"))


def full(n, agg, x):
    frame = f"OVER ({DW} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {agg}({x}) {frame} END"


# a recursive walk per symbol: each smoother carries its last value (and the gap weight where values can be missing)
IND_SQL = f"""{daily_cte()}, b0 AS (SELECT *, row_number() OVER ({DW}) AS n, close - lag(close) OVER ({DW}) AS delta, high - lag(high) OVER ({DW}) AS um, lag(low) OVER ({DW}) - low AS dm,
  greatest(high - low, abs(high - lag(close) OVER ({DW})), abs(low - lag(close) OVER ({DW}))) AS tr, close / lag(close) OVER ({DW}) - 1 AS ret,
  (close - {full(9, 'min', 'low')}) / nullif({full(9, 'max', 'high')} - {full(9, 'min', 'low')}, 0) * 100 AS rsv FROM days),
b AS MATERIALIZED (SELECT *, CASE WHEN um > dm AND um > 0 THEN um ELSE 0 END AS pdm, CASE WHEN dm > um AND dm > 0 THEN dm ELSE 0 END AS mdm FROM b0),
walk AS (WITH RECURSIVE rec AS (
  SELECT symbol, n, close AS e12, close AS e26, CAST(NULL AS DOUBLE) AS g, CAST(NULL AS DOUBLE) AS l, tr AS st, pdm AS sp, mdm AS sm, rsv AS k, CAST(1 AS DOUBLE) AS kw FROM b WHERE n = 1
  UNION ALL SELECT b.symbol, b.n, e12 * (1 - 2.0 / 13) + close * 2.0 / 13, e26 * (1 - 2.0 / 27) + close * 2.0 / 27,
    CASE WHEN g IS NULL THEN greatest(delta, 0) ELSE g * 13 / 14 + greatest(delta, 0) / 14 END, CASE WHEN l IS NULL THEN greatest(-delta, 0) ELSE l * 13 / 14 + greatest(-delta, 0) / 14 END,
    st * 13 / 14 + tr / 14, sp * 13 / 14 + pdm / 14, sm * 13 / 14 + mdm / 14,
    CASE WHEN k IS NULL THEN rsv WHEN rsv IS NULL THEN k ELSE (kw * 2.0 / 3 * k + rsv / 3) / (kw * 2.0 / 3 + 1.0 / 3) END,
    CASE WHEN k IS NULL OR rsv IS NOT NULL THEN 1 ELSE kw * 2.0 / 3 END
  FROM rec JOIN b ON b.symbol = rec.symbol AND b.n = rec.n + 1) SELECT * FROM rec),
w1 AS MATERIALIZED (SELECT b.*, e12 - e26 AS macd, 100 - 100 / (1 + g / nullif(l, 0)) AS rsi14, k AS kdj_k, 100 * sp / nullif(st, 0) AS pdi, 100 * sm / nullif(st, 0) AS mdi,
  abs(100 * sp / nullif(st, 0) - 100 * sm / nullif(st, 0)) / nullif(100 * sp / nullif(st, 0) + 100 * sm / nullif(st, 0), 0) * 100 AS dx FROM b JOIN walk USING (symbol, n)),
walk2 AS (WITH RECURSIVE rec AS (
  SELECT symbol, n, macd AS sig, kdj_k AS kd, dx AS adx, CAST(1 AS DOUBLE) AS aw FROM w1 WHERE n = 1
  UNION ALL SELECT w1.symbol, w1.n, sig * 0.8 + macd * 0.2, CASE WHEN kd IS NULL THEN kdj_k ELSE kd * 2.0 / 3 + kdj_k / 3 END,
    CASE WHEN adx IS NULL THEN dx WHEN dx IS NULL THEN adx ELSE (aw * 13.0 / 14 * adx + dx / 14) / (aw * 13.0 / 14 + 1.0 / 14) END,
    CASE WHEN adx IS NULL OR dx IS NOT NULL THEN 1 ELSE aw * 13.0 / 14 END
  FROM rec JOIN w1 ON w1.symbol = rec.symbol AND w1.n = rec.n + 1) SELECT * FROM rec),
ind AS (SELECT w1.*, kd AS kdj_d, 3 * kdj_k - 2 * kd AS kdj_j, macd - sig AS macd_hist, adx AS adx14, pdi AS plus_di14, mdi AS minus_di14,
  {full(20, 'avg', 'close')} AS ma20, {full(50, 'avg', 'close')} AS ma50, {full(200, 'avg', 'close')} AS ma200, 4 * {full(20, 'stddev_samp', 'close')} / {full(20, 'avg', 'close')} * 100 AS bw,
  {full(14, 'avg', 'tr')} / close * 100 AS atr14_pct, {full(20, 'stddev_samp', 'ret')} * sqrt(252) * 100 AS rv, ret * 100 AS return_1d,
  (close / coalesce(lag(close, 5) OVER ({DW}), first(close) OVER ({DW})) - 1) * 100 AS return_5d, (close / coalesce(lag(close, 20) OVER ({DW}), first(close) OVER ({DW})) - 1) * 100 AS return_20d
  FROM w1 JOIN walk2 USING (symbol, n)),
lst AS (SELECT *, coalesce(lag(macd_hist) OVER ({DW}), macd_hist) AS macd_hist_prev, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS q FROM ind),
reg AS (SELECT *, CASE WHEN close > ma20 AND ma20 > ma50 AND ma50 > ma200 AND coalesce(adx14, 0) >= 20 AND plus_di14 > minus_di14 THEN 'Uptrend'
  WHEN close < ma20 AND ma20 < ma50 AND coalesce(adx14, 0) >= 20 AND minus_di14 > plus_di14 THEN 'Downtrend'
  WHEN coalesce(adx14, 0) < 18 OR coalesce(bw, 0) < 8 THEN 'Range' ELSE 'Inflection' END AS regime FROM lst)"""
IND_COLS = {
    "macd": "macd", "macd_hist": "macd_hist", "macd_hist_prev": "macd_hist_prev", "rsi14": "rsi14", "kdj_k": "kdj_k", "kdj_d": "kdj_d", "kdj_j": "kdj_j", "ma20": "ma20", "ma50": "ma50",
    "ma200": "ma200", "bollinger_bandwidth_pct": "bw", "atr14_pct": "atr14_pct", "adx14": "adx14", "plus_di14": "plus_di14", "minus_di14": "minus_di14", "realized_vol_20d": "rv",
    "return_1d": "return_1d", "return_5d": "return_5d", "return_20d": "return_20d",
}

# price-sized recursions are compared to the cent, plain means to six places
DIGITS = {"macd": 2, "macd_hist": 2, "macd_hist_prev": 2, "ma20": 6, "ma50": 6, "ma200": 6}


@query("f01_daily_indicators", f"WITH {IND_SQL} SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, {', '.join(r(x, c, DIGITS.get(c, 4)) for c, x in IND_COLS.items())} FROM lst")
def _(spark, d):
    out = D.daily_indicators(days(spark, d))
    return out.select("symbol", F.col("session_date").cast("string"), *[rnd(c, DIGITS.get(c, 4)).alias(c) for c in IND_COLS])


@query("f02_regime", f"WITH {IND_SQL} SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, regime FROM reg")
def _(spark, d):
    return D.daily_indicators(days(spark, d)).select("symbol", F.col("session_date").cast("string"), D.regime().alias("regime"))


BIAS_SQL = """CASE WHEN regime = 'Uptrend' AND macd_hist >= macd_hist_prev AND coalesce(nullif(rsi14, 0), 50) < 75 THEN 'long_trend'
  WHEN regime = 'Downtrend' AND macd_hist <= macd_hist_prev THEN 'short_trend'
  WHEN regime = 'Range' AND (coalesce(nullif(rsi14, 0), 50) > 65 OR coalesce(nullif(kdj_k, 0), 50) > 80) THEN 'range_top'
  WHEN regime = 'Range' AND (coalesce(nullif(rsi14, 0), 50) < 40 OR coalesce(nullif(kdj_k, 0), 50) < 25) THEN 'range_bottom'
  WHEN regime = 'Range' THEN 'range_middle'
  WHEN macd_hist > macd_hist_prev AND coalesce(nullif(kdj_k, 0), 50) > coalesce(nullif(kdj_d, 0), 50) THEN 'turning_up'
  ELSE 'turning_down' END"""


@query("f03_directional_bias", f"WITH {IND_SQL} SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, {BIAS_SQL} AS bias FROM reg")
def _(spark, d):
    df = D.daily_indicators(days(spark, d)).withColumn("regime", D.regime())
    return df.select("symbol", F.col("session_date").cast("string"), D.directional_bias(F.col("regime")).alias("bias"))


@query(
    "f04_volatility_proxy",
    f"""WITH {daily_cte()}, t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS k FROM days)
    SELECT symbol, {r('arg_max(close, session_date)', 'latest')}, {r('avg(close)', 'average_20d')}, {r('(arg_max(close, session_date) / avg(close) - 1) * 100', 'distance_20d_pct')} FROM t WHERE k <= 20 GROUP BY symbol""",
)
def _(spark, d):
    out = D.volatility_proxy(days(spark, d))
    return out.select("symbol", *[rnd(c).alias(c) for c in ("latest", "average_20d", "distance_20d_pct")])


@query("f05_regime_snapshot", f"WITH {IND_SQL} SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, regime, {BIAS_SQL} AS directional_bias, {r('macd_hist', 'macd_hist', 2)}, {r('adx14', 'adx14', 4)} FROM reg WHERE q = 1")
def _(spark, d):
    out = D.regime_snapshot(days(spark, d))
    return out.select("symbol", F.col("session_date").cast("string"), "regime", "directional_bias", rnd("macd_hist", 2).alias("macd_hist"), rnd("adx14", 4).alias("adx14"))


SAMPLE_SQL = f"""{daily_cte()}, nm AS (SELECT *, row_number() OVER ({DW}) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM days),
  st AS (SELECT DISTINCT symbol, CAST(round_even(s * (n - 1) / 99.0, 0) AS BIGINT) AS i FROM (SELECT DISTINCT symbol, n FROM nm), (SELECT unnest(range(100)) AS s)),
  smp AS (SELECT nm.* FROM nm JOIN st USING (symbol, i))"""


@query("f07_even_sample", f"WITH {SAMPLE_SQL} SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, {r('close', 'close')} FROM smp")
def _(spark, d):
    return D.sample_evenly(days(spark, d), 100).select("symbol", F.col("session_date").cast("string"), rnd("close").alias("close"))


@query(
    "f06_price_trend",
    f"""WITH {daily_cte()} SELECT symbol, count(*) AS point_count, {r('arg_min(close, session_date)', 'first_close')}, {r('arg_max(close, session_date)', 'latest_close')}, {r('min(close)', 'min_close')},
    {r('max(close)', 'max_close')}, {r('(arg_max(close, session_date) - arg_min(close, session_date)) / abs(arg_min(close, session_date))', 'total_return')} FROM days GROUP BY symbol""",
)
def _(spark, d):
    out = D.price_trend(days(spark, d))
    return out.select("symbol", "point_count", *[rnd(c).alias(c) for c in ("first_close", "latest_close", "min_close", "max_close", "total_return")])


TREND_SQL = f"""{daily_cte()}, nm AS (SELECT *, row_number() OVER ({DW}) - 1 AS i, ln(close) AS y FROM days WHERE close > 0),
  rg AS (SELECT symbol, regr_slope(y, i) AS slope, regr_intercept(y, i) AS intercept, regr_r2(y, i) AS r2, count(*) AS points FROM nm GROUP BY symbol)"""


@query("f08_detrended_gap", f"WITH {TREND_SQL} SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, {r('exp(y - (intercept + slope * i)) - 1', 'value')} FROM nm JOIN rg USING (symbol)")
def _(spark, d):
    return D.trend_points(days(spark, d)).select("symbol", F.col("session_date").cast("string"), rnd("value").alias("value"))


@query("f09_log_regression", f"WITH {TREND_SQL} SELECT symbol, points, {r('slope', 'slope', 9)}, {r('intercept', 'intercept')}, {r('r2', 'r2', 9)} FROM rg")
def _(spark, d):
    out = D.log_regression(days(spark, d))
    return out.select("symbol", "points", rnd("slope", 9).alias("slope"), rnd("intercept").alias("intercept"), rnd("r2", 9).alias("r2"))


@query(
    "f10_cagr",
    f"""WITH {daily_cte()}, g AS (SELECT symbol, arg_min(close, session_date) AS a, arg_max(close, session_date) AS b, date_diff('day', min(session_date), max(session_date)) / 365.25 AS y FROM days GROUP BY symbol)
    SELECT symbol, {r('(b - a) / a', 'total_return')}, {r('pow(b / a, 1 / y) - 1', 'cagr')} FROM g""",
)
def _(spark, d):
    return D.long_trend(days(spark, d)).select("symbol", rnd("total_return").alias("total_return"), rnd("cagr").alias("cagr"))


@query(
    "f11_attention",
    f"""WITH {daily_cte()}, li AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS session_date, l_returnflag, l_linestatus, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    ds AS (SELECT symbol, sum(l_extendedprice) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS i1, sum(l_extendedprice) FILTER (l_returnflag = 'A' AND l_linestatus = 'O') AS i2,
      sum(l_extendedprice) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS o1, sum(l_extendedprice) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS o2 FROM li GROUP BY symbol),
    fl AS (SELECT symbol, session_date, sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE -l_extendedprice END) AS s, sum(CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE -l_extendedprice END) AS b FROM li GROUP BY ALL),
    f20 AS (SELECT symbol, sum(s) AS s, sum(b) AS b FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS k FROM fl) WHERE k <= 20 GROUP BY symbol),
    kd AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC) AS k FROM days),
    kc AS (SELECT symbol, max(close) FILTER (k = 1) AS c0, max(close) FILTER (k = 6) AS c5, max(close) FILTER (k = 21) AS c20, max(close) FILTER (k <= 60) AS hi, min(close) FILTER (k <= 60) AS lo FROM kd GROUP BY symbol),
    j AS (SELECT symbol, (i1 + i2) / (o1 + o2) AS ratio, i1 / o1 AS sr, s + b AS flow, c0 / c5 - 1 AS r5, c0 / c20 - 1 AS r20, (c0 - lo) / (hi - lo) AS pos FROM ds JOIN f20 USING (symbol) JOIN kc USING (symbol))
    SELECT symbol, {r('ratio', 'large_buy_sell_ratio')}, {r('sr', 'super_buy_sell_ratio')}, {r('flow', 'large_net_flow_20d', 2)}, {r('r5', 'return_5d')}, {r('r20', 'return_20d')}, {r('pos', 'price_range_position_60d')},
      CASE WHEN ratio >= 1.2 AND r20 <= 0.12 THEN 'quiet_accumulation' WHEN ratio >= 1.2 AND r20 >= 0.30 THEN 'crowded_momentum' WHEN ratio < 0.9 AND r20 >= 0.20 THEN 'distribution_risk' ELSE 'neutral' END AS label FROM j""",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("session_date"))
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", "l_linestatus", "l_extendedprice").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    amount, flag, status = F.col("l_extendedprice"), F.col("l_returnflag"), F.col("l_linestatus")

    def part(f, s):
        return F.sum(F.when((flag == f) & (status == s), amount))

    dist = li.groupBy("symbol").agg(
        part("A", "F").alias("capital_in_super"), part("A", "O").alias("capital_in_big"), part("R", "F").alias("capital_out_super"), part("R", "O").alias("capital_out_big")
    )
    flows = li.groupBy("symbol", "session_date").agg(
        F.sum(F.when(flag == "A", amount).otherwise(-amount)).alias("super_in_flow"), F.sum(F.when(status == "F", amount).otherwise(-amount)).alias("big_in_flow"), F.sum(amount).alias("main_in_flow")
    )
    out = D.attention_metrics(dist, flows, days(spark, d))
    return out.select(
        "symbol", *[rnd(c).alias(c) for c in ("large_buy_sell_ratio", "super_buy_sell_ratio", "return_5d", "return_20d", "price_range_position_60d")],
        rnd("large_net_flow_20d", 2).alias("large_net_flow_20d"), F.col("attention_flow_label").alias("label"),
    )
