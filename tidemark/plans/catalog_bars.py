"""Queries for bar building and bar features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import rnd
from tidemark.operators import bars as B
from tidemark.operators import features as X
from tidemark.plans.registry import query
from tidemark.plans.sqltext import bars_cte, ema_sql, gap_ewm_sql, r
from tidemark.sources.tables import event_quotes, table

KEYS = ["symbol", "session_date", "bar_index"]


def hourly(spark: SparkSession, folder: str) -> DataFrame:
    return B.resample(event_quotes(table(spark, folder, "events")), B.ALL_DAY_HOURLY)


def minute_points(spark: SparkSession, folder: str) -> DataFrame:
    """One row per symbol and minute, so a symbol's series is bounded by the calendar."""
    return B.resample(event_quotes(table(spark, folder, "events")), B.SessionSpec(0, 1440, 1))


def keyed(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Bar keys as text and integers plus rounded columns."""
    return df.select(
        "symbol",
        F.col("session_date").cast("string").alias("session_date"),
        F.col("bar_index").cast("bigint").alias("bar_index"),
        *[rnd(c, digits).alias(c) for c in cols],
    )


KEY_SQL = "symbol, CAST(session_date AS VARCHAR) AS session_date, CAST(bar_index AS BIGINT) AS bar_index"
W = "PARTITION BY symbol, session_date ORDER BY bar_index"


def full_sql(n: int, agg: str, x: str) -> str:
    frame = f"OVER ({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} = {n} THEN {agg}({x}) {frame} END"


def bars_query(name: str, step, cols: list[str], body: str, digits: int = 6):
    """Register ``step`` on hourly bars; ``body`` gives the SQL after the bars CTE."""
    tail = ", ".join(r(c, c, digits) for c in cols)
    sql = f"WITH {bars_cte()}{body} SELECT {KEY_SQL}, {tail} FROM out"
    query(name, sql)(lambda spark, d: keyed(step(hourly(spark, d)), *cols, digits=digits))


@query(
    "a02_normalise_bars",
    """SELECT event_type AS symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts,
       round(CASE WHEN event_id % 7 = 0 THEN value ELSE value - 0.25 END, 6) AS open,
       round(CASE WHEN event_id % 5 = 0 THEN value ELSE value + 1 END, 6) AS high,
       round(value, 6) AS low, round(value, 6) AS close
       FROM events WHERE event_id % 11 <> 0""",
)
def _(spark, d):
    raw = table(spark, d, "events").select(
        F.col("event_type").alias("symbol"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("time_key"),
        F.when(F.col("event_id") % 7 == 0, F.lit("0")).otherwise((F.col("value") - 0.25).cast("string")).alias("open"),
        F.when(F.col("event_id") % 5 == 0, F.lit(None)).otherwise(F.col("value") + 1).alias("high"),
        F.when(F.col("event_id") % 11 == 0, F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("close"),
    )
    out = B.normalise_bars(raw)
    return out.select(
        "symbol",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        *[rnd(c).alias(c) for c in ("open", "high", "low", "close")],
    )


@query(
    "c16_session_minute",
    """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS session_date,
       CAST(hour(ts) * 60 + minute(ts) - 570 AS BIGINT) AS session_minute
       FROM events WHERE hour(ts) * 60 + minute(ts) - 570 BETWEEN 0 AND 389""",
)
def _(spark, d):
    out = B.session_columns(table(spark, d, "events"))
    return out.select("event_id", F.col("session_date").cast("string"), F.col("session_minute").cast("bigint"))


@query(
    "e01_resample_bars",
    f"""WITH {bars_cte()} SELECT {KEY_SQL}, CAST(session_minute AS BIGINT) AS session_minute,
    strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(source_rows AS BIGINT) AS source_rows,
    {", ".join(r(c, c) for c in ("open", "high", "low", "close", "volume"))} FROM bars""",
)
def _(spark, d):
    return hourly(spark, d).select(
        "symbol",
        F.col("session_date").cast("string").alias("session_date"),
        F.col("bar_index").cast("bigint").alias("bar_index"),
        F.col("session_minute").cast("bigint").alias("session_minute"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        F.col("source_rows").cast("bigint").alias("source_rows"),
        *[rnd(c).alias(c) for c in ("open", "high", "low", "close", "volume")],
    )


@query(
    "entry_above_vwap",
    f"""WITH {bars_cte()}, v AS (
      SELECT symbol, session_date, bar_index, close,
             sum((high + low + close) / 3 * volume) OVER ({W}) / nullif(sum(volume) OVER ({W}), 0) AS vwap FROM bars),
    last AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date DESC, bar_index DESC) AS k FROM v)
    SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, {r("close", "close")}, {r("vwap", "vwap")},
           {r("close / vwap - 1", "vwap_dev")},
           CAST(row_number() OVER (ORDER BY close / vwap - 1 DESC NULLS LAST, symbol) AS BIGINT) AS place
    FROM last WHERE k = 1""",
)
def above_vwap(spark: SparkSession, d: str) -> DataFrame:
    """Latest bar of each symbol ranked by its distance above the session VWAP."""
    df = X.moving_averages(X.session_vwap(hourly(spark, d)))
    pick = F.struct("session_date", "close", "vwap", "vwap_dev", "sma5")
    latest = df.groupBy("symbol").agg(F.max_by(pick, F.struct("session_date", "bar_index")).alias("p")).select("symbol", "p.*")
    # one row per symbol is left here; the global order is over that short list
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("vwap_dev"), "symbol"))
    return latest.select(
        "symbol",
        F.col("session_date").cast("string").alias("session_date"),
        rnd("close").alias("close"),
        rnd("vwap").alias("vwap"),
        rnd("vwap_dev").alias("vwap_dev"),
        place.cast("bigint").alias("place"),
    )


bars_query(
    "e02_session_vwap",
    X.session_vwap,
    ["vwap", "vwap_dev"],
    f""", v AS (SELECT *, sum((high + low + close) / 3 * volume) OVER ({W}) / nullif(sum(volume) OVER ({W}), 0) AS vwap FROM bars),
    out AS (SELECT *, close / vwap - 1 AS vwap_dev FROM v)""",
)
bars_query(
    "e03_bar_returns",
    X.bar_returns,
    [f"ret_{k}bar" for k in (1, 2, 3, 5, 10)],
    ", out AS (SELECT *, " + ", ".join(f"close / lag(close, {k}) OVER ({W}) - 1 AS ret_{k}bar" for k in (1, 2, 3, 5, 10)) + " FROM bars)",
)
bars_query(
    "e04_sma",
    X.moving_averages,
    [f"{p}sma{n}{s}" for n in (5, 10, 20, 50) for p, s in (("", ""), ("close_", "_pct"))],
    ", s AS (SELECT *, "
    + ", ".join(f"{full_sql(n, 'avg', 'close')} AS sma{n}" for n in (5, 10, 20, 50))
    + " FROM bars), out AS (SELECT *, "
    + ", ".join(f"close / sma{n} - 1 AS close_sma{n}_pct" for n in (5, 10, 20, 50))
    + " FROM s)",
)
bars_query(
    "e05_ema",
    X.exponential_averages,
    ["ema5", "ema9", "ema21", "ema50", "ema9_ema21_spread_pct", "ema21_ema50_spread_pct", "ema9_slope_3bar", "ema21_slope_3bar"],
    ", m AS (SELECT *, "
    + ", ".join(f"{ema_sql('close', f'(2.0 / {n + 1})', W)} AS ema{n}" for n in (5, 9, 21, 50))
    + f""" FROM bars), out AS (SELECT *, ema9 / ema21 - 1 AS ema9_ema21_spread_pct, ema21 / ema50 - 1 AS ema21_ema50_spread_pct,
    ema9 / lag(ema9, 3) OVER ({W}) - 1 AS ema9_slope_3bar, ema21 / lag(ema21, 3) OVER ({W}) - 1 AS ema21_slope_3bar FROM m)""",
)
def rsi_ctes(src: str = "bars", out: str = "out") -> str:
    up = "CASE WHEN delta > 0 THEN delta WHEN delta IS NOT NULL THEN 0 END"
    down = "CASE WHEN delta < 0 THEN -delta WHEN delta IS NOT NULL THEN 0 END"
    means = ", ".join(f"{ema_sql(x, f'(1.0 / {n})', W)} AS {s}{n}" for n in (6, 14) for s, x in (("gain", up), ("loss", down)))
    final = ", ".join(
        f"CASE WHEN loss{n} > 0 THEN 100 - 100 / (1 + gain{n} / loss{n}) WHEN gain{n} > 0 THEN 100.0 ELSE 50.0 END AS rsi{n}"
        for n in (6, 14)
    )
    return f""", rsi_d AS (SELECT *, close - lag(close) OVER ({W}) AS delta FROM {src}),
    rsi_g AS (SELECT *, {means} FROM rsi_d), {out} AS (SELECT *, {final} FROM rsi_g)"""


bars_query("e06_rsi_wilder", X.wilder_rsi, ["rsi6", "rsi14"], rsi_ctes())
bars_query(
    "e07_rsi_simple",
    lambda df: X.simple_rsi(df, 6, X.SESSION, "bar_index"),
    ["rsi"],
    f""", d AS (SELECT *, close - lag(close) OVER ({W}) AS delta FROM bars),
    g AS (SELECT *, {full_sql(6, 'count', 'delta')} AS n,
      avg(greatest(delta, 0)) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS gain,
      avg(greatest(-delta, 0)) OVER ({W} ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS loss FROM d),
    out AS (SELECT *, CASE WHEN n IS NULL THEN NULL WHEN loss = 0 THEN CASE WHEN gain > 0 THEN 100.0 ELSE 50.0 END
      ELSE round(100 - 100 / (1 + gain / loss), 2) END AS rsi FROM g)""",
    digits=2,
)
def kdj_ctes(src: str = "bars", out: str = "out") -> str:
    return f""", kdj_lo AS (SELECT *, {full_sql(9, 'min', 'low')} AS low9, {full_sql(9, 'max', 'high')} AS high9 FROM {src}),
    kdj_v AS (SELECT *, (close - low9) / nullif(high9 - low9, 0) * 100 AS rsv FROM kdj_lo),
    kdj_k AS (SELECT *, {gap_ewm_sql('rsv', '(1.0 / 3)', W)} AS kdj_k FROM kdj_v),
    kdj_dd AS (SELECT *, {gap_ewm_sql('kdj_k', '(1.0 / 3)', W)} AS kdj_d FROM kdj_k),
    {out} AS (SELECT *, 3 * kdj_k - 2 * kdj_d AS kdj_j FROM kdj_dd)"""


bars_query("e08_kdj", X.kdj, ["kdj_k", "kdj_d", "kdj_j"], kdj_ctes())
bars_query(
    "e09_kdj_seeded",
    lambda df: X.seeded_kdj(df, X.SESSION, "bar_index"),
    ["kdj_k", "kdj_d", "kdj_j"],
    f""", lo AS (SELECT *, min(low) OVER ({W} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS low9,
      max(high) OVER ({W} ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS high9 FROM bars),
    v AS (SELECT *, CASE WHEN bar_index < 8 THEN NULL WHEN high9 <= low9 THEN 50.0 ELSE (close - low9) / (high9 - low9) * 100 END AS rsv FROM lo),
    k AS (SELECT *, CASE WHEN bar_index >= 8 THEN {gap_ewm_sql('rsv', '(1.0 / 3)', W, '50.0')} END AS kdj_k FROM v),
    dd AS (SELECT *, CASE WHEN bar_index >= 8 THEN {gap_ewm_sql('kdj_k', '(1.0 / 3)', W, '50.0')} END AS kdj_d FROM k),
    out AS (SELECT *, 3 * kdj_k - 2 * kdj_d AS kdj_j FROM dd)""",
)
def macd_ctes(src: str = "bars", out: str = "out") -> str:
    return f""", macd_m AS (SELECT *, {ema_sql('close', '(2.0 / 13)', W)} - {ema_sql('close', '(2.0 / 27)', W)} AS macd_dif FROM {src}),
    macd_e AS (SELECT *, {ema_sql('macd_dif', '(2.0 / 10)', W)} AS macd_dea FROM macd_m),
    macd_h AS (SELECT *, macd_dif - macd_dea AS macd_hist FROM macd_e),
    {out} AS (SELECT *, macd_hist - lag(macd_hist, 1) OVER ({W}) AS macd_hist_delta_1,
      macd_hist - lag(macd_hist, 3) OVER ({W}) AS macd_hist_delta_3 FROM macd_h)"""


bars_query("e10_macd", X.macd, ["macd_dif", "macd_dea", "macd_hist", "macd_hist_delta_1", "macd_hist_delta_3"], macd_ctes())
def boll_ctes(src: str = "bars", out: str = "out") -> str:
    return f""", boll_b AS (SELECT *, {full_sql(20, 'avg', 'close')} AS bb_mid20, {full_sql(20, 'stddev_samp', 'close')} AS sd FROM {src}),
    boll_u AS (SELECT *, bb_mid20 + 2 * sd AS bb_upper20, bb_mid20 - 2 * sd AS bb_lower20 FROM boll_b),
    {out} AS (SELECT *, (close - bb_mid20) / nullif(sd, 0) AS bb_z,
      (close - bb_lower20) / nullif(bb_upper20 - bb_lower20, 0) AS bb_percent_b FROM boll_u)"""


bars_query("e11_bollinger", X.bollinger, ["bb_mid20", "bb_upper20", "bb_lower20", "bb_z", "bb_percent_b"], boll_ctes())
def atr_ctes(src: str = "bars", out: str = "out") -> str:
    return f""", atr_t AS (SELECT *, greatest(high - low, abs(high - lag(close) OVER ({W})), abs(low - lag(close) OVER ({W}))) AS true_range FROM {src}),
    atr_a AS (SELECT *, {full_sql(14, 'avg', 'true_range')} AS atr14 FROM atr_t),
    {out} AS (SELECT *, atr14 / nullif(close, 0) AS atr14_pct FROM atr_a)"""


bars_query("e12_atr", X.average_true_range, ["true_range", "atr14", "atr14_pct"], atr_ctes())
def vol_ctes(src: str = "bars", out: str = "out") -> str:
    return f""", vol_rr AS (SELECT *, close / lag(close) OVER ({W}) - 1 AS ret_1bar,
      coalesce(sign(close - lag(close) OVER ({W})), 0) * volume AS signed FROM {src}),
    vol_s AS (SELECT *, {full_sql(10, 'stddev_samp', 'ret_1bar')} AS realized_vol_10, {full_sql(20, 'stddev_samp', 'ret_1bar')} AS realized_vol_20,
      {full_sql(20, 'avg', 'volume')} AS volume_avg20, {full_sql(20, 'stddev_samp', 'volume')} AS vsd,
      sum(signed) OVER ({W}) AS obv, {full_sql(10, 'min', 'low')} AS lo10, {full_sql(10, 'max', 'high')} AS hi10 FROM vol_rr),
    {out} AS (SELECT *, volume / nullif(volume_avg20, 0) AS volume_ratio_20, (volume - volume_avg20) / nullif(vsd, 0) AS volume_z_20,
      (obv - lag(obv, 5) OVER ({W})) / nullif(volume_avg20, 0) AS obv_slope_5,
      (close - lo10) / nullif(hi10 - lo10, 0) AS range_pos_10 FROM vol_s)"""


bars_query(
    "e13a_volume_volatility",
    lambda df: X.volume_and_volatility(X.bar_returns(df)),
    ["realized_vol_10", "realized_vol_20", "volume_avg20", "volume_ratio_20", "volume_z_20", "obv", "obv_slope_5", "range_pos_10"],
    vol_ctes(),
)
bars_query(
    "e13b_opening_range",
    X.opening_range,
    ["or15_high", "or15_low", "dist_or_high", "dist_or_low"],
    """, o AS (SELECT *, max(CASE WHEN bar_index < 5 THEN high END) OVER (PARTITION BY symbol, session_date) AS or15_high,
      min(CASE WHEN bar_index < 5 THEN low END) OVER (PARTITION BY symbol, session_date) AS or15_low FROM bars),
    out AS (SELECT *, close / nullif(or15_high, 0) - 1 AS dist_or_high, close / nullif(or15_low, 0) - 1 AS dist_or_low FROM o)""",
)
bars_query(
    "e13c_session_extremes",
    X.session_extremes,
    ["day_high_so_far", "day_low_so_far", "dist_day_high", "dist_day_low"],
    f""", o AS (SELECT *, max(high) OVER ({W}) AS day_high_so_far, min(low) OVER ({W}) AS day_low_so_far FROM bars),
    out AS (SELECT *, close / day_high_so_far - 1 AS dist_day_high, close / day_low_so_far - 1 AS dist_day_low FROM o)""",
)
CROSS_SQL = """, ds AS (SELECT symbol, session_date, arg_min(open, bar_index) AS so, arg_max(close, bar_index) AS sc, max(high) AS sh,
      min(low) AS sl, sum(CASE WHEN bar_index < 5 THEN volume END) AS ov FROM bars GROUP BY ALL),
    dl AS (SELECT *, lag(sc) OVER p AS prior_close, (lag(sh) OVER p - lag(sl) OVER p) / nullif(lag(sc) OVER p, 0) AS prior_session_range_pct,
      so / nullif(lag(sc) OVER p, 0) - 1 AS gap_pct,
      CASE WHEN count(ov) OVER q >= 5 THEN ov / nullif(quantile_cont(ov, 0.5) OVER q, 0) END AS opening_relative_volume_15
      FROM ds WINDOW p AS (PARTITION BY symbol ORDER BY session_date),
      q AS (PARTITION BY symbol ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)),
    cx AS (SELECT b.*, prior_close, prior_session_range_pct, gap_pct, opening_relative_volume_15,
      CASE WHEN count(volume) OVER q >= 5 THEN volume / nullif(quantile_cont(volume, 0.5) OVER q, 0) END AS relative_volume_time_20
      FROM bars b LEFT JOIN dl USING (symbol, session_date)
      WINDOW q AS (PARTITION BY symbol, bar_index ORDER BY session_date ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""
bars_query(
    "e13d_cross_session",
    lambda df: df.join(X.cross_session_daily(df), list(X.SESSION), "left"),
    ["prior_close", "prior_session_range_pct", "gap_pct"],
    CROSS_SQL + ", out AS (SELECT * FROM cx)",
)
bars_query(
    "e13e_same_time_volume",
    X.same_time_volume,
    ["relative_volume_time_20"],
    CROSS_SQL + ", out AS (SELECT * FROM cx)",
)
bars_query(
    "e13f_opening_relative_volume",
    lambda df: df.join(X.cross_session_daily(df), list(X.SESSION), "left"),
    ["opening_relative_volume_15"],
    CROSS_SQL + ", out AS (SELECT * FROM cx)",
)
bars_query(
    "c20_candle_geometry",
    X.candle_geometry,
    ["body_pct", "range_pct", "upper_wick_ratio", "lower_wick_ratio"],
    """, out AS (SELECT *, (close - open) / nullif(open, 0) AS body_pct, (high - low) / nullif(close, 0) AS range_pct,
      (high - greatest(open, close)) / nullif(high - low, 0) AS upper_wick_ratio,
      (least(open, close) - low) / nullif(high - low, 0) AS lower_wick_ratio FROM bars)""",
)
bars_query(
    "c19_time_of_day",
    X.time_of_day,
    ["time_sin", "time_cos"],
    ", out AS (SELECT *, sin(2 * pi() * session_minute / 390) AS time_sin, cos(2 * pi() * session_minute / 390) AS time_cos FROM bars)",
)


def _mining_body() -> str:
    """Feature CTEs behind the mining columns, chained on the cross-session table."""

    body = CROSS_SQL
    body += f""", c1 AS (SELECT *, (high - greatest(open, close)) / nullif(high - low, 0) AS upper_wick_ratio,
      (least(open, close) - low) / nullif(high - low, 0) AS lower_wick_ratio,
      close / (sum((high + low + close) / 3 * volume) OVER ({W}) / nullif(sum(volume) OVER ({W}), 0)) - 1 AS vwap_dev,
      close / lag(close, 3) OVER ({W}) - 1 AS ret_3bar, close / lag(close, 5) OVER ({W}) - 1 AS ret_5bar,
      {ema_sql('close', '(2.0 / 10)', W)} AS ema9, {ema_sql('close', '(2.0 / 22)', W)} AS ema21 FROM cx),
    c2 AS (SELECT *, ema9 / ema21 - 1 AS ema9_ema21_spread_pct, ema9 / lag(ema9, 3) OVER ({W}) - 1 AS ema9_slope_3bar FROM c1)"""
    source = "c2"
    for i, ctes in enumerate((rsi_ctes, kdj_ctes, macd_ctes, boll_ctes, atr_ctes, vol_ctes), start=1):
        body += ctes(source, f"f{i}")
        source = f"f{i}"
    return body + f", out AS (SELECT * FROM {source})"


MINING_BODY = _mining_body()
bars_query("e13g_feature_matrix", lambda df: X.feature_matrix(df), X.MINING_FEATURES, MINING_BODY, digits=5)


VP_SQL = """pts AS (SELECT * FROM bars),
 vp AS (SELECT *, avg(CASE WHEN volume >= 0 THEN volume END) OVER q AS va, stddev_samp(CASE WHEN volume >= 0 THEN volume END) OVER q AS vs FROM pts
   WINDOW q AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


@query(
    "e13h_volume_profile",
    f"""WITH {bars_cte(1)}, {VP_SQL}
    SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round_even(va, 2) AS volume_avg20,
      round_even(CASE WHEN va > 0 THEN volume / va END, 2) AS volume_ratio, round_even((volume - va) / nullif(vs, 0), 2) + 0.0 AS volume_z,
      CASE WHEN va IS NULL OR va <= 0 THEN 'unknown' WHEN volume / va >= 2 THEN 'spike' WHEN volume / va <= 0.5 THEN 'dry' ELSE 'normal' END AS volume_state
    FROM vp""",
)
def _(spark, d):
    df = X.volume_profile(minute_points(spark, d), Window.partitionBy("symbol").orderBy("ts"))
    return df.select(
        "symbol",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
        *[rnd(c, 2).alias(c) for c in ("volume_avg20", "volume_ratio", "volume_z")],
        "volume_state",
    )
