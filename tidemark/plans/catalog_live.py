"""Queries for the panel, rotation, streaming, readers and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.numeric import rnd
from tidemark.operators import features as X
from tidemark.operators import joins as J
from tidemark.operators import rotation as RO
from tidemark.operators import zones as Z
from tidemark.plans.catalog_bars import CROSS_SQL, bars_query, hourly, minute_points
from tidemark.plans.catalog_store import OBS
from tidemark.plans.registry import query
from tidemark.plans.sqltext import bars_cte, r
from tidemark.session import shared_dir
from tidemark.sources import readers as RD
from tidemark.sources import tables as T
from tidemark.sources.tables import event_quotes, table
from tidemark.streaming import live as L

bars_query(
    "d05_daily_to_bars",
    lambda df: df.join(X.cross_session_daily(df), list(X.SESSION), "left"),
    ["prior_close", "gap_pct", "opening_relative_volume_15"],
    CROSS_SQL + ", out AS (SELECT * FROM cx)",
)

# --- panel -----------------------------------------------------------------------------------

def panel_sql(source: str) -> str:
    """Latest panel and its six checks over a ``bars`` CTE of minute points."""
    return f"""WITH {source}, p AS (SELECT *, row_number() OVER s AS n, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k, close - lag(close) OVER s AS dl,
    greatest(high - low, abs(high - lag(close) OVER s), abs(low - lag(close) OVER s)) AS tr, min(low) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS lo9,
    max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 8 PRECEDING AND CURRENT ROW) AS hi9, row_number() OVER (PARTITION BY symbol, session_date ORDER BY ts) AS dn
    FROM bars WINDOW s AS (PARTITION BY symbol ORDER BY ts)),
  a AS (SELECT symbol, max(session_date) AS day, list(close ORDER BY ts) AS cl, list(CASE WHEN hi9 <= lo9 THEN 50.0 ELSE (close - lo9) / (hi9 - lo9) * 100 END ORDER BY ts) FILTER (n >= 9) AS rsv,
    max(CASE WHEN k = 1 THEN close END) AS close, max(CASE WHEN k = 1 THEN volume END) AS vol, avg(tr) FILTER (k <= 14) AS atr, min(low) FILTER (k <= 5) AS rl,
    avg(volume) FILTER (k BETWEEN 2 AND 21) AS va, stddev_samp(volume) FILTER (k BETWEEN 2 AND 21) AS vs, avg(greatest(dl, 0)) FILTER (k <= 14) AS g, avg(greatest(-dl, 0)) FILTER (k <= 14) AS l FROM p GROUP BY symbol),
  dy AS (SELECT p.symbol, sum((high + low + p.close) / 3 * volume) FILTER (volume > 0) / sum(volume) FILTER (volume > 0) AS vwap, count(*) AS dr, max(high) FILTER (dn <= 15) AS oh, min(low) FILTER (dn <= 15) AS ol
    FROM p JOIN a ON a.symbol = p.symbol AND p.session_date = a.day GROUP BY p.symbol),
  b AS (SELECT a.*, CASE WHEN vol > 0 THEN round_even(vwap, 6) ELSE vwap END AS vwap, dr, oh, ol, CASE WHEN l = 0 THEN CASE WHEN g > 0 THEN 100 ELSE 50 END ELSE round_even(100 - 100 / (1 + g / l), 2) END AS rsi14,
    list_reduce(cl, lambda x, y: x * 0.8 + y * 0.2) AS e9, list_reduce(cl, lambda x, y: x * (1 - 2.0 / 22) + y * 2.0 / 22) AS e21, list_reduce(list_slice(cl, 1, len(cl) - 5), lambda x, y: x * 0.8 + y * 0.2) AS e9p,
    list_reduce(list_concat([{{'k': 50.0::DOUBLE, 'd': 50.0::DOUBLE}}], list_transform(rsv, lambda v: {{'k': v::DOUBLE, 'd': 0.0::DOUBLE}})), lambda x, y: {{'k': x.k * 2 / 3 + y.k / 3, 'd': x.d * 2 / 3 + (x.k * 2 / 3 + y.k / 3) / 3}}) AS kd
    FROM a JOIN dy USING (symbol)),
  c AS (SELECT *, round_even(kd.k, 2) AS k, round_even(kd.d, 2) AS d, round_even(3 * kd.k - 2 * kd.d, 2) AS j, round_even(vol / nullif(va, 0), 2) AS ratio, round_even((vol - va) / nullif(vs, 0), 2) AS z, vol / nullif(va, 0) AS rr,
    CASE WHEN e9 > e21 AND e9 / e9p - 1 > 0 THEN 2 WHEN e9 < e21 AND e9 / e9p - 1 < 0 THEN -2 ELSE 0 END AS s2, CASE WHEN dr < 15 THEN 0 WHEN close > oh THEN 1 WHEN close < ol THEN -1 ELSE 0 END AS s3,
    CASE WHEN atr / close < 0.001 THEN -1 ELSE 0 END AS s6 FROM b),
  e AS (SELECT *, CASE WHEN close > vwap AND rl >= vwap * 0.997 THEN 2 WHEN close < vwap AND rl < vwap THEN -2 ELSE 0 END AS s1, CASE WHEN ratio >= 1.3 OR z >= 1 THEN 1 WHEN ratio <= 0.55 THEN -1 ELSE 0 END AS s4,
    CASE WHEN rsi14 >= 72 OR (k >= 82 AND j >= 95) THEN -1 WHEN rsi14 <= 28 OR (k <= 18 AND j <= 8) THEN 1 ELSE 0 END AS s5,
    rsi14 >= 70 OR (k >= 80 AND d >= 75 AND j >= 90) AS over, rsi14 <= 30 OR (k <= 20 AND d <= 25 AND j <= 10) AS under FROM c),
  f AS (SELECT *, s1 + s2 + s3 + s4 + s5 + s6 AS bs FROM e)"""


PANEL_SQL = panel_sql(bars_cte(1))
TICK_SQL = panel_sql(
    """bars AS (SELECT event_type AS symbol, ts, CAST(ts AS DATE) AS session_date, value AS close, value AS high, value AS low, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume FROM events)"""
)


def panel_rows(df):
    return df.select(
        "symbol", *[rnd(c, 4).alias(c) for c in ("close", "vwap", "ema9", "ema21", "atr")], *[rnd(c, 2).alias(c) for c in ("rsi14", "kdj_k", "kdj_d", "kdj_j", "volume_ratio")],
        F.col("bias_score").cast("bigint").alias("bias_score"), "bias", "label",
    )


PANEL_COLS = f"""SELECT symbol, {r('close', 'close', 4)}, {r('vwap', 'vwap', 4)}, {r('e9', 'ema9', 4)}, {r('e21', 'ema21', 4)}, {r('atr', 'atr', 4)}, {r('rsi14', 'rsi14', 2)}, {r('k', 'kdj_k', 2)}, {r('d', 'kdj_d', 2)},
    {r('j', 'kdj_j', 2)}, {r('ratio', 'volume_ratio', 2)}, CAST(bs AS BIGINT) AS bias_score,
    CASE WHEN bs >= 4 THEN 'strong_long_bias' WHEN bs >= 2 THEN 'long_bias' WHEN bs <= -4 THEN 'strong_short_bias' WHEN bs <= -2 THEN 'short_bias' ELSE 'neutral' END AS bias,
    CASE WHEN over AND rr >= 2 THEN 'overbought_volume' WHEN under AND rr >= 2 THEN 'oversold_reversal_watch' WHEN over THEN 'overbought' WHEN under THEN 'oversold' WHEN rr >= 2 THEN 'volume_spike' ELSE 'neutral' END AS label FROM f"""


@query("e13j_latest_panel", f"{PANEL_SQL} {PANEL_COLS}")
def _(spark, d):
    return panel_rows(X.latest_panel(minute_points(spark, d)))


@query(
    "e13i_rule_checks",
    f"""{PANEL_SQL}, x AS (SELECT symbol, unnest([{{'id': 'vwap_hold', 's': s1}}, {{'id': 'ema_stack', 's': s2}}, {{'id': 'opening_range', 's': s3}}, {{'id': 'volume_confirm', 's': s4}}, {{'id': 'momentum_extreme', 's': s5}}, {{'id': 'atr_space', 's': s6}}]) AS q FROM f)
    SELECT symbol, q.id AS rule_id, CAST(q.s AS BIGINT) AS score FROM x""",
)
def _(spark, d):
    p = X.latest_panel(minute_points(spark, d)).select("symbol", F.explode("rules").alias("r"))
    return p.select("symbol", F.col("r.id").alias("rule_id"), F.col("r.score").cast("bigint").alias("score"))


# --- rotation ----------------------------------------------------------------------------------

PAIRS = [("p1", "view", "click", "error"), ("p2", "click", "purchase", "signup")]
LOOSE = (RO.Strategy("take", buy=35.0, sell=65.0, take_profit=0.5), RO.Strategy("hold", buy=35.0, sell=65.0))


def hour_points(spark, d):
    b = hourly(spark, d)
    ts = F.col("session_date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.col("bucket"))
    return b.select("symbol", ts.alias("ts"), "close")


HP = f"""{bars_cte()}, hp AS (SELECT symbol, CAST(session_date AS TIMESTAMP) + to_hours(bucket) AS ts, close FROM bars),
  pr(pair_id, a, b, c) AS (VALUES {", ".join(str(p) for p in PAIRS)}),
  tw AS (SELECT pair_id, s.ts, s.close AS signal_price, l.close AS long_price, h.close AS short_price, a FROM pr JOIN hp s ON s.symbol = a JOIN hp l ON l.symbol = b AND l.ts = s.ts JOIN hp h ON h.symbol = c AND h.ts = s.ts),
  dl AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY ts) AS x FROM hp),
  gl AS (SELECT *, count(x) OVER q AS n, avg(greatest(x, 0)) OVER q AS g, avg(greatest(-x, 0)) OVER q AS l FROM dl WINDOW q AS (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)),
  rs AS (SELECT symbol, ts, CASE WHEN n < 6 THEN NULL WHEN l = 0 THEN CASE WHEN g > 0 THEN 100.0 ELSE 50.0 END ELSE round(100 - 100 / (1 + g / l), 2) END AS rsi FROM gl),
  pt AS (SELECT tw.*, CAST(tw.ts AS DATE) AS session_date, rsi, greatest(0.0001, long_price - greatest(long_price * 0.0004, CASE WHEN long_price < 1 THEN 0.0001 ELSE 0.01 END) / 2) AS long_bid,
    long_price + greatest(long_price * 0.0004, CASE WHEN long_price < 1 THEN 0.0001 ELSE 0.01 END) / 2 AS long_ask, greatest(0.0001, short_price - greatest(short_price * 0.0004, CASE WHEN short_price < 1 THEN 0.0001 ELSE 0.01 END) / 2) AS short_bid,
    short_price + greatest(short_price * 0.0004, CASE WHEN short_price < 1 THEN 0.0001 ELSE 0.01 END) / 2 AS short_ask FROM tw LEFT JOIN rs ON rs.symbol = tw.a AND rs.ts = tw.ts)"""
TS = "strftime(ts, '%Y-%m-%d %H:%M') AS ts"


def tst(c="ts"):
    return F.date_format(c, "yyyy-MM-dd HH:mm").alias(c)


@query("d03_three_way_times", f"WITH {HP} SELECT pair_id, {TS}, {r('signal_price', 'signal_price')}, {r('long_price', 'long_price')}, {r('short_price', 'short_price')} FROM tw")
def _(spark, d):
    return RO.three_way_points(hour_points(spark, d), PAIRS).select("pair_id", tst(), *[rnd(c).alias(c) for c in ("signal_price", "long_price", "short_price")])


def points(spark, d):
    return RO.rotation_points(hour_points(spark, d), PAIRS, minutes=60)


@query("d04_bucket_lookup", f"WITH {HP} SELECT pair_id, {TS}, {r('rsi', 'rsi', 2)} FROM pt")
def _(spark, d):
    return points(spark, d).select("pair_id", tst(), rnd("rsi", 2).alias("rsi"))


@query("e14_rotation_points", f"WITH {HP} SELECT pair_id, {TS}, {r('rsi', 'rsi', 2)}, {r('long_bid', 'long_bid', 8)}, {r('long_ask', 'long_ask', 8)}, {r('short_bid', 'short_bid', 8)}, {r('short_ask', 'short_ask', 8)} FROM pt")
def _(spark, d):
    return points(spark, d).select("pair_id", tst(), rnd("rsi", 2).alias("rsi"), *[rnd(c, 8).alias(c) for c in ("long_bid", "long_ask", "short_bid", "short_ask")])


@query(
    "e18_decision_nodes",
    f"""WITH {HP}, b AS (SELECT pair_id, session_date, ts, date_trunc('hour', ts) AS bk FROM pt), n AS (SELECT *, coalesce(bk <> lag(bk) OVER (PARTITION BY pair_id, session_date ORDER BY ts), true) AS new_decision_node FROM b)
    SELECT pair_id, {TS}, new_decision_node, CAST(sum(new_decision_node::INT) OVER (PARTITION BY pair_id, session_date ORDER BY ts) AS BIGINT) AS decision_index FROM n""",
)
def _(spark, d):
    return RO.decision_nodes(points(spark, d)).select("pair_id", tst(), "new_decision_node", F.col("decision_index").cast("bigint").alias("decision_index"))


WALK = f"""WITH RECURSIVE {HP}, st(strategy_id, take) AS (VALUES ('take', 0.5), ('hold', NULL)),
  q AS (SELECT pt.*, strategy_id, CAST(take AS DOUBLE) AS take, row_number() OVER (PARTITION BY pair_id, session_date, strategy_id ORDER BY ts) AS n, count(*) OVER (PARTITION BY pair_id, session_date, strategy_id) AS last FROM pt, st),
  w AS (SELECT pair_id, session_date, strategy_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS le, CAST(NULL AS TIMESTAMP) AS lt, CAST(NULL AS DOUBLE) AS se, CAST(NULL AS TIMESTAMP) AS sst, CAST(NULL AS VARCHAR) AS leg, CAST(NULL AS VARCHAR) AS reason,
      CAST(NULL AS DOUBLE) AS ein, CAST(NULL AS DOUBLE) AS eout, CAST(NULL AS TIMESTAMP) AS tin, CAST(NULL AS TIMESTAMP) AS tout FROM q WHERE n = 1
    UNION ALL SELECT q.pair_id, q.session_date, q.strategy_id, q.n,
      CASE WHEN act = 'take' THEN NULL WHEN act = 'buy' THEN coalesce(le, long_ask) WHEN act = 'sell' THEN NULL ELSE le END, CASE WHEN act = 'take' THEN NULL WHEN act = 'buy' THEN coalesce(lt, q.ts) WHEN act = 'sell' THEN NULL ELSE lt END,
      CASE WHEN act = 'buy' THEN NULL WHEN act = 'sell' THEN coalesce(se, short_ask) ELSE se END, CASE WHEN act = 'buy' THEN NULL WHEN act = 'sell' THEN coalesce(sst, q.ts) ELSE sst END,
      CASE WHEN act IN ('take', 'sell') AND le IS NOT NULL THEN 'long' WHEN act = 'buy' AND se IS NOT NULL THEN 'short' END, CASE act WHEN 'take' THEN 'profit_take' WHEN 'sell' THEN 'overbought' WHEN 'buy' THEN 'oversold' END,
      CASE WHEN act IN ('take', 'sell') THEN le WHEN act = 'buy' THEN se END, CASE WHEN act IN ('take', 'sell') THEN long_bid WHEN act = 'buy' THEN short_bid END, CASE WHEN act IN ('take', 'sell') THEN lt WHEN act = 'buy' THEN sst END, q.ts
    FROM (SELECT w.le, w.lt, w.se, w.sst, q.*, CASE WHEN rsi IS NULL THEN 'none' WHEN take IS NOT NULL AND w.le IS NOT NULL AND long_bid / w.le - 1 >= take THEN 'take' WHEN rsi <= 35 THEN 'buy' WHEN rsi >= 65 THEN 'sell' ELSE 'none' END AS act
      FROM w JOIN q ON q.pair_id = w.pair_id AND q.session_date = w.session_date AND q.strategy_id = w.strategy_id AND q.n = w.n + 1) q),
  tr AS (SELECT * FROM w WHERE leg IS NOT NULL),
  fin AS (SELECT q.pair_id, q.session_date, q.strategy_id, coalesce((long_bid / le - 1) * 1000, 0) + coalesce((short_bid / se - 1) * 1000, 0) AS un, (CASE WHEN le IS NULL THEN 0 ELSE 1000.0 END) + (CASE WHEN se IS NULL THEN 0 ELSE 1000.0 END) AS opn, le, lt, se, sst FROM q JOIN w USING (pair_id, session_date, strategy_id, n) WHERE q.n = q.last),
  dly AS (SELECT fin.pair_id, fin.session_date, fin.strategy_id, any_value(un) AS un, any_value(opn) AS opn, coalesce(sum((eout / ein - 1) * 1000), 0) AS rz, count(leg) AS tc, count(*) FILTER (eout > ein) AS wt FROM fin LEFT JOIN tr USING (pair_id, session_date, strategy_id) GROUP BY ALL),
  day AS (SELECT *, rz + un AS pnl, CASE WHEN round(rz + un, 2) > 0 THEN 'win' WHEN round(rz + un, 2) < 0 THEN 'loss' ELSE 'flat' END AS outcome FROM dly)"""


@query("e15_rotation_ledger", f"{WALK} SELECT pair_id, CAST(session_date AS VARCHAR) AS session_date, strategy_id, leg, reason, strftime(tin, '%Y-%m-%d %H:%M') AS entry_time, strftime(tout, '%Y-%m-%d %H:%M') AS exit_time, {r('(eout / ein - 1) * 1000', 'pnl', 5)} FROM tr")
def _(spark, d):
    t = RO.rotation_ledger(RO.ledger_state(points(spark, d), LOOSE))
    return t.select("pair_id", F.col("session_date").cast("string"), "strategy_id", "leg", "reason", tst("entry_time"), tst("exit_time"), rnd("pnl", 5).alias("pnl"))


@query(
    "e16_daily_results",
    f"{WALK} SELECT pair_id, CAST(session_date AS VARCHAR) AS session_date, strategy_id, tc AS trade_count, {r('rz', 'realized_pnl', 5)}, {r('un', 'unrealized_pnl', 5)}, {r('pnl / 1000', 'return_pct', 7)}, outcome FROM day",
)
def _(spark, d):
    t = RO.daily_results(RO.ledger_state(points(spark, d), LOOSE))
    return t.select(
        "pair_id", F.col("session_date").cast("string"), "strategy_id", F.col("trade_count").cast("bigint").alias("trade_count"), rnd("realized_pnl", 5).alias("realized_pnl"),
        rnd("unrealized_pnl", 5).alias("unrealized_pnl"), rnd("return_pct", 7).alias("return_pct"), "outcome",
    )


@query(
    "e17_period_summary",
    f"""{WALK} SELECT pair_id, strategy_id, count(*) AS day_count, count(*) FILTER (outcome = 'win') AS winning_days, count(*) FILTER (outcome = 'loss') AS losing_days, CAST(sum(tc) AS BIGINT) AS trade_count,
    {r('sum(pnl)', 'total_pnl', 4)}, {r('coalesce(sum(wt) * 1.0 / nullif(sum(tc), 0), 0)', 'trade_win_rate')}, {r("count(*) FILTER (outcome = 'win') * 1.0 / nullif(count(*) FILTER (outcome <> 'flat'), 0)", 'day_win_rate')},
    CAST(arg_max(session_date, pnl) AS VARCHAR) AS best_day, CAST(arg_min(session_date, pnl) AS VARCHAR) AS worst_day FROM day GROUP BY ALL""",
)
def _(spark, d):
    t = RO.period_summary(RO.daily_results(RO.ledger_state(points(spark, d), LOOSE)))
    return t.select(
        "pair_id", "strategy_id", "day_count", "winning_days", "losing_days", F.col("trade_count").cast("bigint").alias("trade_count"), rnd("total_pnl", 4).alias("total_pnl"),
        rnd("trade_win_rate").alias("trade_win_rate"), rnd("day_win_rate").alias("day_win_rate"), F.col("best_day").cast("string"), F.col("worst_day").cast("string"),
    )


@query(
    "d16_missing_weekdays",
    """WITH h AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders), s AS (SELECT o_custkey, min(day) AS a, max(day) AS b FROM h GROUP BY 1),
    x AS (SELECT o_custkey, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s) SELECT o_custkey, count(*) AS missing FROM x ANTI JOIN h USING (o_custkey, day) WHERE isodow(day) < 6 GROUP BY 1""",
)
def _(spark, d):
    o = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return J.missing_weekdays(o, "o_custkey", "day").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("missing"))


@query(
    "d18_trade_markers",
    f"""{WALK}, mk AS (SELECT pair_id, session_date, strategy_id, leg, 'buy' AS type, tin AS ts, ein AS price FROM tr UNION ALL SELECT pair_id, session_date, strategy_id, leg, 'sell', tout, eout FROM tr
      UNION ALL SELECT pair_id, session_date, strategy_id, 'long', 'buy', lt, le FROM fin WHERE le IS NOT NULL UNION ALL SELECT pair_id, session_date, strategy_id, 'short', 'buy', sst, se FROM fin WHERE se IS NOT NULL)
    SELECT pair_id, strategy_id, leg, type, strftime(mk.ts, '%Y-%m-%d %H:%M') AS ts, {r('price', 'price', 6)}, {r('rsi', 'rsi', 2)} FROM mk JOIN pt USING (pair_id, ts)""",
)
def _(spark, d):
    p = points(spark, d)
    m = RO.trade_markers(RO.ledger_state(p, LOOSE), p)
    return m.select("pair_id", "strategy_id", "leg", "type", tst(), rnd("price").alias("price"), rnd("rsi", 2).alias("rsi"))


# --- streaming -----------------------------------------------------------------------------------


@query(
    "k01_live_bars",
    f"""WITH q AS (SELECT event_type AS symbol, ts, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v, time_bucket(INTERVAL 60 MINUTE, ts) AS s FROM events)
    SELECT symbol, strftime(s, '%Y-%m-%d %H:%M') AS bar_start, {r('arg_min(value, ts)', 'open')}, {r('max(value)', 'high')}, {r('min(value)', 'low')}, {r('arg_max(value, ts)', 'close')}, {r('sum(v)', 'volume')}, count(*) AS source_rows
    FROM q GROUP BY symbol, s HAVING s + INTERVAL 60 MINUTE <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
)
def _(spark, d):
    bars = L.live_bars(event_quotes(L.table_stream(spark, d, "events")), minutes=60)
    out = L.run_to_files(bars, L.new_path(spark, "bars"))
    return out.select("symbol", tst("bar_start"), *[rnd(c).alias(c) for c in ("open", "high", "low", "close", "volume")], "source_rows")


@query("k02_live_panel", f"{TICK_SQL} {PANEL_COLS}")
def _(spark, d):
    quotes = event_quotes(L.table_stream(spark, d, "events"))
    same = [F.col("close").alias(c) for c in ("open", "high", "low")]
    pts = quotes.select("symbol", "ts", *same, "close", "volume", F.lit(0.0).alias("turnover"))
    return panel_rows(L.newest_panel(L.live_panel(pts, L.new_path(spark, "panel"))))


@query(
    "k03_live_rotation",
    f"{WALK} SELECT pair_id, CAST(session_date AS VARCHAR) AS session_date, leg, reason, strftime(tin, '%Y-%m-%d %H:%M') AS entry_time, strftime(tout, '%Y-%m-%d %H:%M') AS exit_time, {r('(eout / ein - 1) * 1000', 'pnl', 5)} FROM tr WHERE strategy_id = 'take'",
)
def _(spark, d):
    # the points are written once and streamed file by file
    path = L.new_path(spark, "points")
    points(spark, d).select("pair_id", "session_date", "ts", "rsi", "long_bid", "long_ask", "short_bid", "short_ask").coalesce(1).write.parquet(f"{path}/in.parquet")
    trades = L.live_rotation(L.table_stream(spark, path, "in"), LOOSE[0])
    t = L.run_to_files(trades, path)
    pnl = (F.col("exit_price") / F.col("entry_price") - 1) * 1000
    return t.select("pair_id", F.col("session_date").cast("string"), "leg", "reason", tst("entry_time"), tst("exit_time"), rnd(pnl, 5).alias("pnl"))


@query(
    "k04_live_ingest",
    f"""WITH {OBS}, h AS (SELECT *, sha256(concat(ticker, chr(0), source_key, chr(0), observation_type, chr(0), coalesce(title, ''), chr(0), coalesce(source_url, ''), chr(0))) AS raw_hash FROM obs),
    m AS (SELECT raw_hash, mkey, last(mval ORDER BY fetched_at, run_id, mval) AS mval FROM h GROUP BY ALL), mm AS (SELECT raw_hash, string_agg(mkey || '=' || mval, ',' ORDER BY mkey) AS metadata FROM m GROUP BY ALL)
    SELECT ticker, source_key, observation_type, raw_hash, first(title ORDER BY fetched_at, run_id, title, source_url) AS title, max(CAST(fetched_at AS DATE)::VARCHAR) AS fetched_at,
      last(run_id ORDER BY fetched_at, run_id) AS run_id, any_value(metadata) AS metadata FROM h JOIN mm USING (raw_hash) GROUP BY ALL""",
)
def _(spark, d):
    stream = L.table_stream(spark, d, "lineitem")
    out = L.live_ingest(T.observation_rows(stream), L.new_path(spark, "ingest"))
    pairs = F.transform(F.map_entries("metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("ticker", "source_key", "observation_type", "raw_hash", "title", F.to_date("fetched_at").cast("string").alias("fetched_at"), "run_id", F.array_join(F.array_sort(pairs), ",").alias("metadata"))


@query(
    "k05_retention",
    """WITH k AS (SELECT event_id, event_type AS symbol, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS n FROM events) SELECT symbol, event_id FROM k WHERE n <= 420""",
)
def _(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("event_type").alias("symbol"), "ts")
    return RO.keep_last(e, ["symbol"], 420).select("symbol", "event_id")


# --- readers and sinks ---------------------------------------------------------------------------


def out_path(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/files/{name}-{uuid.uuid4().hex}"


@query("a01_read_bars", f"SELECT event_type AS symbol, count(*) AS n, {r('sum(value)', 'total', 2)} FROM events GROUP BY 1")
def _(spark, d):
    from tidemark.operators.bars import normalise_bars

    path = out_path(spark, "bars")
    e = table(spark, d, "events").select(F.col("event_type").alias("symbol"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time_key"), F.col("value").alias("close"))
    e.write.option("header", True).csv(path)
    bars = normalise_bars(RD.read_bars(spark, path))
    return bars.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("close"), 2).alias("total"))


@query("a06_read_watchlist", "SELECT p_name || '-' || p_partkey AS symbol FROM part WHERE p_size >= 10")
def _(spark, d):
    path = out_path(spark, "watch")
    line = F.when(F.col("p_size") < 5, F.lit("# comment")).when(F.col("p_size") < 10, F.lit("")).otherwise(F.concat(F.lit(" "), "p_name", F.lit("-"), F.col("p_partkey").cast("string"), F.lit(" ")))
    table(spark, d, "part").select(line.alias("value")).write.text(path)
    return RD.read_watchlist(spark, path)


@query(
    "b09_export_screen",
    """SELECT 'C' || c_custkey AS ticker, CAST(printf('%.2f', (c_acctbal - 2000) / 10000 * 100) AS DOUBLE) + 0.0 AS quarterly_revenue_yoy_pct, c_mktsegment || '; ' || c_nationkey AS tags FROM customer""",
)
def _(spark, d):
    path = out_path(spark, "screen")
    c = table(spark, d, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), ((F.col("c_acctbal") - 2000) / 10000).alias("quarterly_revenue_yoy"), F.array("c_mktsegment", F.col("c_nationkey").cast("string")).alias("tags")
    )
    RD.write_screen(c, path)
    back = spark.read.option("header", True).schema("ticker string, tags string, quarterly_revenue_yoy_pct double").csv(f"{path}/csv")
    return back.select("ticker", (F.col("quarterly_revenue_yoy_pct") + 0.0).alias("quarterly_revenue_yoy_pct"), "tags")


@query("b10_export_research", f"WITH {bars_cte()} SELECT symbol, count(*) AS bars FROM bars GROUP BY symbol")
def _(spark, d):
    path = out_path(spark, "research")
    bars = X.average_true_range(hourly(spark, d))
    RD.write_research({"features": bars, "zones": Z.turning_zones(bars)}, path)
    return spark.read.parquet(f"{path}/features").groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"))
