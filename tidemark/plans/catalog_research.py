"""Queries for turning zones, event backtests, rule mining, families and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import rnd
from tidemark.operators import bars as B
from tidemark.operators import events as E
from tidemark.operators import families as FM
from tidemark.operators import features as X
from tidemark.operators import joins as J
from tidemark.operators import rules as R
from tidemark.operators import zones as Z
from tidemark.plans.catalog_bars import KEY_SQL, MINING_BODY, W, atr_ctes, hourly, vol_ctes
from tidemark.plans.registry import query
from tidemark.plans.research import run_research
from tidemark.plans.sqltext import bars_cte, ema_sql, r
from tidemark.session import materialise
from tidemark.sources.tables import event_quotes, table

DAY = "PARTITION BY symbol, session_date"
INF = "CAST('inf' AS DOUBLE)"


def features(spark, d):
    return materialise(X.feature_matrix(hourly(spark, d)), "features")


def fine_features(spark, d):
    bars = B.resample(event_quotes(table(spark, d, "events")), B.ALL_DAY_FINE)
    return materialise(X.feature_matrix(bars), "fine-features")


def keys(df, *cols, big=("bar_index",)):
    out = []
    for c in df.columns:
        if c == "session_date":
            out.append(F.col(c).cast("string").alias(c))
        elif dict(df.dtypes)[c] in ("int", "smallint"):
            out.append(F.col(c).cast("bigint").alias(c))
        elif dict(df.dtypes)[c] == "double":
            out.append(rnd(c).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


# --- zones -------------------------------------------------------------------------------

ZONE = {"window_bars": 2, "prominence_atr": 1.0}
CAND_SQL = atr_ctes() + f""", cc AS (SELECT *, coalesce(nullif(atr14, 0), greatest(close * 0.001, high - low)) AS atr, count(*) OVER ({DAY}) AS n,
    max(high) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top, min(low) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS flo,
    least(high - min(low) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), high - min(low) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING)) AS up,
    least(max(high) OVER ({W} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) - low, max(high) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) - low) AS dn FROM out),
  cf AS (SELECT *, high >= top - greatest(atr * 0.18, close * 0.0001) AND up / nullif(atr, 0) >= 1.0 AS peak,
    low <= flo + greatest(atr * 0.18, close * 0.0001) AND dn / nullif(atr, 0) >= 1.0 AS trough FROM cc WHERE bar_index >= 2 AND bar_index < n - 2),
  cand AS (SELECT symbol, session_date, bar_index, CASE WHEN peak THEN 'peak' ELSE 'trough' END AS kind, CASE WHEN peak THEN high ELSE low END AS price, atr,
    CASE WHEN peak THEN up / atr ELSE dn / atr END AS strength FROM cf WHERE coalesce(peak, false) <> coalesce(trough, false))"""
MERGE_SQL = CAND_SQL + f""", lg AS (SELECT *, lag(kind) OVER ({W}) AS pk, lag(bar_index) OVER ({W}) AS pi, lag(price) OVER ({W}) AS pp, lag(atr) OVER ({W}) AS pa FROM cand),
  br AS (SELECT *, CASE WHEN kind = pk AND bar_index - pi <= 3 AND abs(price - pp) <= greatest(pa, atr) * 0.18 THEN 0 ELSE 1 END AS fresh FROM lg),
  isl AS (SELECT *, sum(fresh) OVER ({W}) AS sequence FROM br),
  mz AS (SELECT symbol, session_date, CAST(sequence AS BIGINT) AS sequence, kind, min(bar_index) AS start_index, max(bar_index) AS end_index,
    first(bar_index ORDER BY CASE kind WHEN 'peak' THEN -price ELSE price END, bar_index) AS representative_index,
    first(price ORDER BY CASE kind WHEN 'peak' THEN -price ELSE price END, bar_index) AS price, max(strength) AS strength FROM isl GROUP BY symbol, session_date, isl.sequence, kind)"""
ZONE_SQL = MERGE_SQL + """, rp AS (SELECT z.*, greatest(coalesce(b.atr14, 0) * 0.18, abs(z.price) * 0.0001) AS tol FROM mz z
    JOIN out b ON b.symbol = z.symbol AND b.session_date = z.session_date AND b.bar_index = z.representative_index),
  ez AS (SELECT z.symbol, z.session_date, z.sequence, z.kind, z.representative_index, z.price, z.strength,
    coalesce(max(b.bar_index) FILTER (b.bar_index < z.start_index AND abs(CASE z.kind WHEN 'peak' THEN b.high ELSE b.low END - z.price) > tol) + 1, 0) AS start_index,
    coalesce(min(b.bar_index) FILTER (b.bar_index > z.end_index AND abs(CASE z.kind WHEN 'peak' THEN b.high ELSE b.low END - z.price) > tol) - 1, max(b.bar_index)) AS end_index
    FROM rp z JOIN out b ON b.symbol = z.symbol AND b.session_date = z.session_date GROUP BY ALL),
  zones AS (SELECT *, CAST(session_date AS VARCHAR) || '-' || kind || '-' || sequence AS zone_id FROM ez)"""
LABEL_SQL = ZONE_SQL + """, lb AS (SELECT b.symbol, b.session_date, b.bar_index, coalesce(arg_max(z.kind, z.sequence) FILTER (b.bar_index BETWEEN z.start_index AND z.end_index), 'none') AS turn_zone,
    arg_max(z.zone_id, z.sequence) FILTER (b.bar_index BETWEEN z.start_index AND z.end_index) AS turn_zone_id,
    coalesce(arg_max(z.kind, z.sequence) FILTER (b.bar_index = z.representative_index), 'none') AS pivot_label,
    arg_max(z.strength, z.sequence) FILTER (b.bar_index = z.representative_index) AS pivot_strength
    FROM out b LEFT JOIN zones z ON b.symbol = z.symbol AND b.session_date = z.session_date GROUP BY ALL)"""


def atr_bars(spark, d):
    return X.average_true_range(hourly(spark, d))


@query("e19_turn_candidates", f"WITH {bars_cte()}{CAND_SQL} SELECT {KEY_SQL}, kind, {r('price', 'price')}, {r('atr', 'atr')}, {r('strength', 'strength')} FROM cand")
def _(spark, d):
    return keys(Z.turn_candidates(atr_bars(spark, d), **ZONE))


@query(
    "e20_merged_zones",
    f"""WITH {bars_cte()}{MERGE_SQL} SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, sequence, kind, CAST(start_index AS BIGINT) AS start_index,
    CAST(end_index AS BIGINT) AS end_index, CAST(representative_index AS BIGINT) AS representative_index, {r('price', 'price')}, {r('strength', 'strength')} FROM mz""",
)
def _(spark, d):
    return keys(Z.merge_candidates(Z.turn_candidates(atr_bars(spark, d), **ZONE)))


@query(
    "e21_turning_zones",
    f"""WITH {bars_cte()}{ZONE_SQL} SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, sequence, kind, CAST(start_index AS BIGINT) AS start_index,
    CAST(end_index AS BIGINT) AS end_index, zone_id, CAST(end_index - start_index + 1 AS BIGINT) AS duration_bars FROM zones""",
)
def _(spark, d):
    z = Z.turning_zones(atr_bars(spark, d), **ZONE)
    return keys(z.select("symbol", "session_date", "sequence", "kind", "start_index", "end_index", "zone_id", "duration_bars"))


@query("e21_bar_labels", f"WITH {bars_cte()}{LABEL_SQL} SELECT {KEY_SQL}, turn_zone, turn_zone_id, pivot_label, {r('pivot_strength', 'pivot_strength')} FROM lb")
def _(spark, d):
    out = Z.label_turning_zones(atr_bars(spark, d), **ZONE)
    return keys(out.select("symbol", "session_date", "bar_index", "turn_zone", "turn_zone_id", "pivot_label", "pivot_strength"))


@query(
    "e22_event_differences",
    f"""WITH {bars_cte()}{LABEL_SQL}, j AS (SELECT b.*, l.pivot_label, (close - open) / nullif(open, 0) AS body_pct, (high - low) / nullif(close, 0) AS range_pct
      FROM out b JOIN lb l USING (symbol, session_date, bar_index)),
    lon AS (SELECT symbol, 'body_pct' AS feature, pivot_label, body_pct AS v, lag(body_pct) OVER ({W}) AS b FROM j
      UNION ALL SELECT symbol, 'range_pct', pivot_label, range_pct, lag(range_pct) OVER ({W}) FROM j
      UNION ALL SELECT symbol, 'atr14_pct', pivot_label, atr14_pct, lag(atr14_pct) OVER ({W}) FROM j),
    st AS (SELECT symbol, feature, count(b) FILTER (pivot_label = 'peak') AS event_count, count(v) AS n, quantile_cont(b, 0.5) FILTER (pivot_label = 'peak') AS event_median,
      quantile_cont(v, 0.5) AS baseline_median, stddev_samp(v) AS sd FROM lon GROUP BY ALL)
    SELECT symbol, feature, event_count, {r('event_median', 'event_median')}, {r('baseline_median', 'baseline_median')},
      {r('coalesce((event_median - baseline_median) / nullif(sd, 0), 0)', 'standardized_difference')} FROM st WHERE event_count >= 5 AND n >= 20""",
)
def _(spark, d):
    labelled = Z.label_turning_zones(X.candle_geometry(atr_bars(spark, d)), **ZONE)
    return keys(Z.event_differences(labelled, "peak", ["body_pct", "range_pct", "atr14_pct"]))


# --- event backtest -------------------------------------------------------------------------


def trades_sql(sig: str, tag: str, rule_keys: str, bars: str = "out") -> str:
    """CTEs from a signal table to its trades ``{tag}``: symbol, session_date, bar_index, keys, exit fields."""
    k = rule_keys
    return f""", {tag}_ent AS (SELECT s.*, e.open AS entry FROM {sig} s JOIN {bars} e ON e.symbol = s.symbol AND e.session_date = s.session_date
    AND e.bar_index = s.bar_index + 1 WHERE e.open > 0),
  {tag}_pth AS (SELECT s.*, b.bar_index AS bi, coalesce(nullif(b.close, 0), entry) AS bc,
    CASE WHEN direction = 'long' THEN coalesce(nullif(b.low, 0), entry) <= entry * (1 - stop) ELSE coalesce(nullif(b.high, 0), entry) >= entry * (1 + stop) END AS st,
    CASE WHEN direction = 'long' THEN coalesce(nullif(b.high, 0), entry) >= entry * (1 + target) ELSE coalesce(nullif(b.low, 0), entry) <= entry * (1 - target) END AS tg
    FROM {tag}_ent s JOIN {bars} b ON b.symbol = s.symbol AND b.session_date = s.session_date AND b.bar_index BETWEEN s.bar_index + 1 AND s.bar_index + 1 + hold),
  {tag}_ex AS (SELECT symbol, session_date, bar_index, {k}, direction, entry, target, stop, cooldown, cap,
    coalesce(min(bi) FILTER (st OR tg), max(bi)) AS exit_index, arg_max(bc, bi) AS last_close,
    CASE WHEN count(*) FILTER (st OR tg) = 0 THEN 'time' WHEN arg_min(st, bi) FILTER (st OR tg) THEN 'stop' ELSE 'target' END AS exit_reason
    FROM {tag}_pth GROUP BY ALL),
  {tag}_px AS (SELECT *, CASE exit_reason WHEN 'time' THEN last_close WHEN 'stop' THEN CASE direction WHEN 'long' THEN entry * (1 - stop) ELSE entry * (1 + stop) END
    ELSE CASE direction WHEN 'long' THEN entry * (1 + target) ELSE entry * (1 - target) END END AS exit_price FROM {tag}_ex),
  {tag}_rt AS (SELECT *, CASE direction WHEN 'long' THEN exit_price / entry - 1 ELSE entry / exit_price - 1 END - 0.001 AS net_return FROM {tag}_px),
  {tag}_ls AS (SELECT symbol, session_date, {k}, cap, list({{'f': CAST(exit_index + 1 + cooldown AS BIGINT), 'b': CAST(bar_index AS BIGINT), 'k': [CAST(bar_index AS BIGINT)]}} ORDER BY bar_index) AS l
    FROM {tag}_rt GROUP BY ALL),
  {tag}_kp AS (SELECT symbol, session_date, {k}, unnest(list_reduce(list_concat([{{'f': CAST(-1 AS BIGINT), 'b': CAST(-1 AS BIGINT), 'k': CAST([] AS BIGINT[])}}], l),
    lambda a, b: CASE WHEN b.b >= a.f AND len(a.k) < cap THEN {{'f': b.f, 'b': b.b, 'k': list_concat(a.k, b.k)}} ELSE a END).k) AS bar_index FROM {tag}_ls),
  {tag} AS (SELECT t.* FROM {tag}_rt t JOIN {tag}_kp USING (symbol, session_date, {k}, bar_index))"""


def metrics_sql(trades: str, tag: str, group: str) -> str:
    """CTEs from trades to metrics per ``group``."""
    return f""", {tag}_a AS (SELECT *, sum(net_return) OVER (PARTITION BY {group} ORDER BY session_date, bar_index) AS cum,
    sum(net_return) OVER (PARTITION BY {group}, session_date) AS dn, row_number() OVER (PARTITION BY {group}, session_date ORDER BY bar_index) AS rn FROM {trades}),
  {tag}_b AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY {group} ORDER BY session_date, bar_index)) AS peak FROM {tag}_a),
  {tag}_c AS (SELECT {group}, count(*) AS trades, count(*) FILTER (net_return > 0) AS winning_trades, avg(net_return) AS average_net_return,
    quantile_cont(net_return, 0.5) AS median_net_return, sum(net_return) AS total_net_return, least(0, min(cum - peak)) AS max_drawdown,
    CASE WHEN count(*) FILTER (net_return < 0) > 0 THEN coalesce(sum(net_return) FILTER (net_return > 0), 0) / abs(sum(net_return) FILTER (net_return < 0))
      WHEN count(*) FILTER (net_return > 0) > 0 THEN {INF} ELSE 0 END AS profit_factor,
    count(*) FILTER (rn = 1) AS active_days, count(*) FILTER (rn = 1 AND dn > 0) AS profitable_days,
    coalesce(max(abs(dn)) / nullif(sum(abs(dn)) FILTER (rn = 1), 0), 0) AS largest_day_abs_pnl_share,
    count(*) FILTER (exit_reason = 'target') * 1.0 / count(*) AS target_rate, count(*) FILTER (exit_reason = 'stop') * 1.0 / count(*) AS stop_rate FROM {tag}_b GROUP BY {group}),
  {tag} AS (SELECT *, winning_trades * 1.0 / trades AS win_rate, profitable_days * 1.0 / active_days AS profitable_day_rate, trades * 1.0 / active_days AS trades_per_active_day,
    greatest(0, (win_rate + 3.8416 / (2 * trades) - 1.96 * sqrt((win_rate * (1 - win_rate) + 3.8416 / (4 * trades)) / trades)) / (1 + 3.8416 / trades)) AS win_rate_wilson_lower FROM {tag}_c)"""


COUNTS = ("trades", "winning_trades", "active_days", "profitable_days")


def metric_cols(prefix: str = "", names=E.METRICS) -> str:
    return ", ".join(f"{prefix}{m}" if m in COUNTS else r(f"{prefix}{m}", f"{prefix}{m}") for m in names)


DOWN_SIG = """, out AS (SELECT * FROM bars), sig AS (SELECT symbol, session_date, bar_index, d AS direction, 0.5 AS target, 0.3 AS stop, 4 AS hold, 1 AS cooldown, 3 AS cap
    FROM bars, (VALUES ('long'), ('short')) v(d) WHERE close < open)"""


def down_trades(spark, d):
    bars = E.with_path(hourly(spark, d), 4).filter(F.col("close") < F.col("open"))
    both = bars.withColumn("direction", F.explode(F.array(F.lit("long"), F.lit("short"))))
    return E.backtest(both, ["direction"], F.col("direction"), target=0.5, stop=0.3, hold=4, cooldown=1, cap=3)


@query(
    "e23_event_backtest",
    f"""WITH {bars_cte()}{DOWN_SIG}{trades_sql('sig', 'tr', 'direction')} SELECT {KEY_SQL}, direction, CAST(exit_index AS BIGINT) AS exit_index, exit_reason,
    {r('entry', 'entry_price')}, {r('exit_price', 'exit_price')}, {r('net_return', 'net_return')} FROM tr""".replace("tr_ent AS (SELECT s.*, e.open", "tr_ent AS (SELECT s.*, e.open"),
)
def _(spark, d):
    t = down_trades(spark, d)
    return keys(t.select("symbol", "session_date", "bar_index", "direction", "exit_index", "exit_reason", "entry_price", "exit_price", "net_return"))


COND_SQL = """, out AS (SELECT *, (high - greatest(open, close)) / nullif(high - low, 0) AS wick, (high - low) / nullif(close, 0) AS rng FROM bars),
    sig AS (SELECT symbol, session_date, bar_index, 'long' AS direction, 0.5 AS target, 0.3 AS stop, 7 AS hold, 2 AS cooldown, 1000000 AS cap FROM out WHERE wick >= 0.2 AND rng >= 0.5)"""


@query(
    "e24_condition_backtest",
    f"WITH {bars_cte()}{COND_SQL}{trades_sql('sig', 'tr', 'direction')} SELECT {KEY_SQL}, exit_reason, {r('net_return', 'net_return')} FROM tr",
)
def _(spark, d):
    bars = X.candle_geometry(hourly(spark, d))
    rules = R.fixed_rules(spark, bars.select("symbol").distinct(), [
        {"id": "wick", "direction": "long", "conditions": [("upper_wick_ratio", ">=", 0.2), ("range_pct", ">=", 0.5)], "target": 0.5, "stop": 0.3}
    ], ["upper_wick_ratio", "range_pct"])
    t = R.fixed_trades(bars, rules, ["upper_wick_ratio", "range_pct"])
    return keys(t.select("symbol", "session_date", "bar_index", "exit_reason", "net_return"))


@query(
    "e25_trade_metrics",
    f"WITH {bars_cte()}{DOWN_SIG}{trades_sql('sig', 'tr', 'direction')}{metrics_sql('tr', 'm', 'symbol, direction')} SELECT symbol, direction, {metric_cols()} FROM m",
)
def _(spark, d):
    return keys(E.trade_metrics(down_trades(spark, d), ["symbol", "direction"]))


RANKS = """, dd AS (SELECT DISTINCT symbol, session_date FROM bars), rk AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY session_date) - 1 AS rank,
    count(*) OVER (PARTITION BY symbol) AS n FROM dd),
  sp AS (SELECT *, rank < least(greatest(1, CAST(floor(n * 0.7) AS BIGINT)), greatest(1, n - 1)) AS is_train,
    least(35, greatest(20, n // 2)) AS f0 FROM rk),
  days AS (SELECT *, CASE WHEN rank >= f0 AND least(12, n - (f0 + (rank - f0) // 12 * 12)) >= 6 THEN (rank - f0) // 12 END AS fold FROM sp)"""


@query("e26_chronological_split", f"WITH {bars_cte()}{RANKS} SELECT symbol, CAST(session_date AS VARCHAR) AS session_date, CAST(rank AS BIGINT) AS rank, is_train, CAST(fold AS BIGINT) AS fold FROM days")
def _(spark, d):
    days = E.session_ranks(hourly(spark, d)).withColumns({"is_train": E.train_flag(), "fold": E.fold_id()})
    return keys(days.select("symbol", "session_date", "rank", "is_train", "fold"))


MINE = R.MiningParams(target=0.5, stop=0.3, hold=4, cooldown=1, cost=0.001)
LONG_FEATURES = " UNION ALL ".join(
    f"SELECT symbol, session_date, bar_index, is_train, {i} AS fi, '{f}' AS feature, {f} AS v FROM ft" for i, f in enumerate(X.MINING_FEATURES)
)
QLIST = "[" + ", ".join(str(q) for q in R.LOW_QUANTILES + R.HIGH_QUANTILES) + "]"
CONDITIONS = MINING_BODY + RANKS + f""", ft AS (SELECT o.*, is_train FROM out o JOIN days USING (symbol, session_date)),
  lf AS (SELECT * FROM ({LONG_FEATURES}) WHERE v IS NOT NULL),
  qs AS (SELECT symbol, fi, feature, quantile_cont(v, {QLIST}) AS q, count(*) AS n, count(DISTINCT v) AS nd FROM lf WHERE is_train GROUP BY ALL),
  cond AS (SELECT symbol, fi, feature, fi * 6 + i - 1 AS position, i > 3 AS up, q[i] AS threshold FROM qs, (SELECT unnest(range(1, 7)) AS i) WHERE n >= 30 AND nd >= 8)"""


@query("e27_quantile_conditions", f"WITH {bars_cte()}{CONDITIONS} SELECT symbol, feature, CAST(position AS BIGINT) AS position, up, {r('threshold', 'threshold', 5)} FROM cond")
def _(spark, d):
    train = R.with_split(features(spark, d)).filter("is_train")
    out = R.quantile_conditions(train, X.MINING_FEATURES).select("symbol", "cond.*")
    return out.select("symbol", "feature", F.col("position").cast("bigint").alias("position"), "up", rnd("threshold", 5).alias("threshold"))


PARAM = "0.5 AS target, 0.3 AS stop, 4 AS hold, 1 AS cooldown, 1000000 AS cap"
SCORE = (
    "test_total_net_return * 8 + least(train_total_net_return, test_total_net_return) * 4 + test_win_rate_wilson_lower + least(test_profit_factor, 5) * 0.18"
    " + least(train_profit_factor, 5) * 0.05 - abs(train_win_rate - test_win_rate) - abs(test_trades_per_active_day - 2.5) * 0.08"
)
ONE_SCORE = (
    "total_net_return * 12 + win_rate_wilson_lower + least(profit_factor, 5) * 0.23 - abs(trades_per_active_day - 2.5) * 0.08"
)
SINGLES = (
    CONDITIONS
    + f""", dirs AS (SELECT * FROM (VALUES ('long', 0), ('short', 100000)) v(direction, off)),
  single AS (SELECT symbol, direction, position + off AS rule_id, fi, feature, up, threshold FROM cond, dirs),
  ssig AS MATERIALIZED (SELECT f.symbol, f.session_date, f.bar_index, rule_id, direction, {PARAM} FROM lf f JOIN single s ON f.symbol = s.symbol AND f.fi = s.fi
    AND CASE WHEN up THEN v >= threshold ELSE v <= threshold END WHERE is_train)"""
    + trades_sql("ssig", "str", "rule_id")
    + metrics_sql("str", "sm", "symbol, rule_id")
)


@query(
    "e28_single_rule_scores",
    f"WITH {bars_cte()}{SINGLES} SELECT symbol, CAST(rule_id AS BIGINT) AS rule_id, trades, {r('total_net_return', 'total_net_return', 5)}, {r(ONE_SCORE, 'score', 5)} FROM sm WHERE trades >= 12",
)
def _(spark, d):
    split = R.with_split(features(spark, d))
    train = split.filter("is_train")
    singles = R.single_rules(R.quantile_conditions(train, X.MINING_FEATURES))
    m = R.evaluate_rules(R.mining_base(train, X.MINING_FEATURES, MINE), singles, MINE).filter(F.col("trades") >= 12)
    return m.select(
        "symbol", F.col("rule_id").cast("bigint").alias("rule_id"), "trades", rnd("total_net_return", 5).alias("total_net_return"), rnd(R.rule_score("", ""), 5).alias("score")
    )


SEEDS = (
    SINGLES
    + f""", ss AS (SELECT m.symbol, s.direction, m.rule_id, fi, feature, up, threshold, row_number() OVER (PARTITION BY m.symbol, s.direction ORDER BY round({ONE_SCORE}, 9) DESC, m.rule_id) AS place
    FROM sm m JOIN single s ON s.symbol = m.symbol AND s.rule_id = m.rule_id WHERE trades >= 12),
  seed AS (SELECT * FROM ss WHERE place <= 10),
  raw_rules AS (SELECT symbol, direction, place * 100 AS o, [{{'fi': fi, 'feature': feature, 'up': up, 'threshold': threshold}}] AS conds, feature || up || round(threshold, 8) AS key FROM seed
    UNION ALL SELECT a.symbol, a.direction, 10000 + a.place * 100 + b.place, [{{'fi': a.fi, 'feature': a.feature, 'up': a.up, 'threshold': a.threshold}}, {{'fi': b.fi, 'feature': b.feature, 'up': b.up, 'threshold': b.threshold}}],
      a.feature || a.up || round(a.threshold, 8) || '&' || b.feature || b.up || round(b.threshold, 8)
    FROM seed a JOIN seed b ON a.symbol = b.symbol AND a.direction = b.direction AND a.place < b.place AND a.feature <> b.feature),
  num_rules AS (SELECT *, row_number() OVER (PARTITION BY symbol, direction ORDER BY o) - 1 AS pos, row_number() OVER (PARTITION BY symbol, direction, key ORDER BY o) AS dup FROM raw_rules),
  rules AS MATERIALIZED (SELECT symbol, direction, pos + CASE direction WHEN 'long' THEN 0 ELSE 100000 END AS rule_id, conds FROM num_rules WHERE dup = 1)"""
)


@query(
    "d14_rule_pairs",
    f"WITH {bars_cte()}{SEEDS} SELECT symbol, direction, CAST(rule_id AS BIGINT) AS rule_id, array_to_string(list_transform(conds, lambda c: c.feature), ' & ') AS features FROM rules",
)
def _(spark, d):
    split = R.with_split(features(spark, d))
    train = split.filter("is_train")
    singles = materialise(R.single_rules(R.quantile_conditions(train, X.MINING_FEATURES)), "singles")
    first = R.evaluate_rules(R.mining_base(train, X.MINING_FEATURES, MINE), singles, MINE)
    out = R.seed_rules(singles, first, MINE)
    text = F.array_join(F.transform("conds", lambda c: c["feature"]), " & ")
    return out.select("symbol", "direction", F.col("rule_id").cast("bigint").alias("rule_id"), text.alias("features"))


def rule_signal_sql(rules: str, tag: str, where: str) -> str:
    return f""", {tag}_x AS (SELECT symbol, direction, rule_id, len(conds) AS nc, unnest(conds) AS c FROM {rules}),
  {tag} AS MATERIALIZED (SELECT f.symbol, f.session_date, f.bar_index, x.rule_id, x.direction, f.is_train, {PARAM} FROM lf f JOIN {tag}_x x ON f.symbol = x.symbol AND f.fi = x.c.fi
    AND CASE WHEN x.c.up THEN f.v >= x.c.threshold ELSE f.v <= x.c.threshold END {where} GROUP BY f.symbol, f.session_date, f.bar_index, x.rule_id, x.direction, f.is_train, nc HAVING count(*) = nc)"""


def side_by_side(metrics: str, group: str) -> str:
    cols = ", ".join(f"a.{m} AS train_{m}, b.{m} AS test_{m}" for m in E.METRICS)
    return f"SELECT {group}, {cols} FROM (SELECT * FROM {metrics} WHERE is_train) a JOIN (SELECT * FROM {metrics} WHERE NOT is_train) b USING ({group})"


MINED = (
    SEEDS
    + rule_signal_sql("rules", "rsig", "")
    + trades_sql("rsig", "rtr", "rule_id, is_train")
    + metrics_sql("rtr", "rm", "symbol, rule_id, is_train")
    + f""", bs AS (SELECT *, {SCORE} AS score, CASE WHEN train_total_net_return > 0 AND test_total_net_return > 0 THEN
      CASE WHEN train_profit_factor >= 1.15 AND test_profit_factor >= 1.15 THEN 'candidate' ELSE 'experiment' END ELSE 'reject' END AS status0
      FROM ({side_by_side('rm', 'symbol, rule_id')}) WHERE train_trades >= 12 AND test_trades >= 5),
  ranked AS MATERIALIZED (SELECT bs.*, direction, conds, row_number() OVER (PARTITION BY symbol, direction ORDER BY round(score, 9) DESC, rule_id) AS place FROM bs JOIN rules USING (symbol, rule_id)),
  sds AS (SELECT symbol, fi, coalesce(stddev_samp(v), 0) AS sd FROM lf WHERE is_train GROUP BY ALL),
  nx AS (SELECT symbol, direction, rule_id, k, m, unnest(conds) AS c FROM ranked, (VALUES (0, 0.0), (1, 1.0), (2, -1.0)) v(k, m) WHERE place <= 10),
  nrules AS (SELECT nx.symbol, direction, rule_id * 3 + k AS rule_id, list({{'fi': c.fi, 'feature': c.feature, 'up': c.up, 'threshold': c.threshold + sd * 0.1 * CASE WHEN c.up THEN m ELSE -m END}}) AS conds
    FROM nx JOIN sds ON sds.symbol = nx.symbol AND sds.fi = nx.c.fi GROUP BY nx.symbol, direction, rule_id, k)"""
    + rule_signal_sql("nrules", "nsig", "WHERE NOT f.is_train")
    + trades_sql("nsig", "ntr", "rule_id")
    + metrics_sql("ntr", "nm", "symbol, rule_id")
    + """, nr AS (SELECT symbol, rule_id // 3 AS rule_id, count(*) FILTER (trades > 0 AND total_net_return > 0 AND profit_factor >= 1) AS pn FROM nm GROUP BY ALL),
  mined AS (SELECT r.*, CASE WHEN place <= 10 THEN coalesce(pn, 0) END AS positive_neighbors FROM ranked r LEFT JOIN nr USING (symbol, rule_id))"""
)


@query(
    "e28_mined_rules",
    f"""WITH {bars_cte()}{MINED} SELECT symbol, direction, CAST(rule_id AS BIGINT) AS rule_id, CAST(place AS BIGINT) AS place, array_to_string(list_transform(conds, lambda c: c.feature), ' & ') AS features,
    train_trades, test_trades, {r('train_total_net_return', 'train_total_net_return', 5)}, {r('test_total_net_return', 'test_total_net_return', 5)}, {r('score', 'score', 5)},
    CASE WHEN place <= 10 AND status0 = 'candidate' AND positive_neighbors < 2 THEN 'experiment' ELSE status0 END AS status FROM mined""",
)
def _(spark, d):
    m = R.mine_rules(features(spark, d), p=MINE)
    text = F.array_join(F.transform("conds", lambda c: c["feature"]), " & ")
    return m.select(
        "symbol", "direction", F.col("rule_id").cast("bigint").alias("rule_id"), F.col("place").cast("bigint").alias("place"), text.alias("features"), "train_trades", "test_trades",
        *[rnd(c, 5).alias(c) for c in ("train_total_net_return", "test_total_net_return", "score")], "status",
    )


@query(
    "e29_threshold_stability",
    f"WITH {bars_cte()}{MINED} SELECT symbol, CAST(rule_id AS BIGINT) AS rule_id, CAST(positive_neighbors AS BIGINT) AS positive_neighbors, {r('positive_neighbors / 3.0', 'positive_neighbor_rate')} FROM mined WHERE place <= 10",
)
def _(spark, d):
    m = R.mine_rules(features(spark, d), p=MINE).filter(F.col("place") <= 10)
    return m.select(
        "symbol", F.col("rule_id").cast("bigint").alias("rule_id"), F.col("positive_neighbors").cast("bigint").alias("positive_neighbors"),
        rnd("positive_neighbor_rate").alias("positive_neighbor_rate"),
    )


# --- fixed rules ------------------------------------------------------------------------------

FIXED = [
    {"id": "low-range", "direction": "long", "conditions": [("range_pos_10", "<=", 0.3)], "target": 0.5, "stop": 0.3, "hold": 4, "cooldown": 1, "cap": 3},
    {"id": "high-range", "direction": "short", "conditions": [("range_pos_10", ">=", 0.7), ("upper_wick_ratio", "<=", 0.6)], "target": 0.5, "stop": 0.3, "hold": 6, "cooldown": 2, "cap": 2},
]
FIXED_SIG = """, fsig AS (SELECT o.symbol, session_date, bar_index, 0 AS rule_id, 'long' AS direction, 0.5 AS target, 0.3 AS stop, 4 AS hold, 1 AS cooldown, 3 AS cap, rank, n FROM out o JOIN rk USING (symbol, session_date) WHERE range_pos_10 <= 0.3
    UNION ALL SELECT o.symbol, session_date, bar_index, 1, 'short', 0.5, 0.3, 6, 2, 2, rank, n FROM out o JOIN rk USING (symbol, session_date) WHERE range_pos_10 >= 0.7 AND upper_wick_ratio <= 0.6)"""
FIXED_TR = MINING_BODY + RANKS + FIXED_SIG + trades_sql("fsig", "ftr", "rule_id, rank, n")


@query(
    "e35_frozen_validation",
    f"""WITH {bars_cte()}{FIXED_TR}{metrics_sql('ftr', 'fm', 'symbol, rule_id')},
    fb AS (SELECT *, CASE WHEN least(7, n - rank // 7 * 7) >= 5 THEN rank // 7 END AS block FROM ftr), fbb AS (SELECT * FROM fb WHERE block IS NOT NULL)
    {metrics_sql('fbb', 'bm', 'symbol, rule_id, block')}, ps AS (SELECT symbol, rule_id, count(*) FILTER (trades > 0 AND total_net_return > 0 AND profit_factor >= 1) AS positive_blocks FROM bm GROUP BY ALL),
    nb AS (SELECT symbol, count(DISTINCT CASE WHEN least(7, n - rank // 7 * 7) >= 5 THEN rank // 7 END) AS blocks FROM rk GROUP BY symbol)
    SELECT nb.symbol, CAST(v.rule_id AS BIGINT) AS rule_id, name, v.direction, {", ".join(f"coalesce({m}, 0) AS {m}" if m in COUNTS else r(f"coalesce({m}, 0)", m) for m in E.METRICS)}, coalesce(positive_blocks, 0) AS positive_blocks, blocks,
    {r('coalesce(positive_blocks, 0) * 1.0 / blocks', 'positive_block_rate')} FROM nb CROSS JOIN (VALUES (0, 'low-range', 'long'), (1, 'high-range', 'short'), (2, 'never', 'long')) v(rule_id, name, direction)
    LEFT JOIN fm ON fm.symbol = nb.symbol AND fm.rule_id = v.rule_id LEFT JOIN ps ON ps.symbol = nb.symbol AND ps.rule_id = v.rule_id""",
)
def _(spark, d):
    df = features(spark, d)
    never = {"id": "never", "direction": "long", "conditions": [("range_pos_10", "<=", -1.0)]}  # a rule without trades stays in the report
    out = R.validate_fixed(df, R.fixed_rules(spark, df.select("symbol").distinct(), [*FIXED, never]), block_sessions=7)
    return keys(out.drop("sessions"))


@query(
    "d12_named_segments",
    f"""WITH {bars_cte()}{FIXED_TR}, seg AS (SELECT t.*, name AS segment FROM ftr t JOIN (VALUES ('early', DATE '2024-01-01', DATE '2024-01-10'), ('middle', DATE '2024-01-08', DATE '2024-01-20')) s(name, a, b)
      ON session_date BETWEEN a AND b){metrics_sql('seg', 'gm', 'symbol, rule_id, segment')}
    SELECT symbol, CAST(rule_id AS BIGINT) AS rule_id, segment, trades, {r('total_net_return', 'total_net_return')} FROM gm""",
)
def _(spark, d):
    df = features(spark, d)
    t = R.fixed_trades(df, R.fixed_rules(spark, df.select("symbol").distinct(), FIXED))
    seg = J.named_segments(t, "session_date", [("early", "2024-01-01", "2024-01-10"), ("middle", "2024-01-08", "2024-01-20")])
    m = E.trade_metrics(seg, ["symbol", "rule_id", "segment"])
    return keys(m.select("symbol", "rule_id", "segment", "trades", "total_net_return"))


@query(
    "d17_signal_overlap",
    f"""WITH {bars_cte()}{MINING_BODY}, s AS (SELECT symbol, coalesce(range_pos_10 <= 0.5, false) AS a, coalesce(volume_ratio_20 >= 1, false) AS b FROM out),
    c AS (SELECT symbol, count(*) FILTER (a) AS left_bars, count(*) FILTER (b) AS right_bars, count(*) FILTER (a AND b) AS both_bars, count(*) FILTER (a OR b) AS u FROM s GROUP BY symbol)
    SELECT symbol, left_bars, right_bars, both_bars, {r('coalesce(both_bars * 1.0 / nullif(left_bars, 0), 0)', 'overlap_vs_left')},
    {r('coalesce(both_bars * 1.0 / nullif(right_bars, 0), 0)', 'overlap_vs_right')}, {r('coalesce(both_bars * 1.0 / nullif(u, 0), 0)', 'jaccard')} FROM c""",
)
def _(spark, d):
    df = X.volume_and_volatility(X.bar_returns(hourly(spark, d)))
    return keys(R.signal_overlap(df, F.col("range_pos_10") <= 0.5, F.col("volume_ratio_20") >= 1))


TUNE_SPECS = [dict(r, conditions=r["conditions"]) for r in FIXED]
GRID_SQL = "(VALUES " + ", ".join(f"({i}, {t}, {s}, {h}, {c}, {k})" for i, (t, s, h, c, k) in enumerate(R.EXIT_GRID)) + ") g(grid, target, stop, hold, cooldown, cap)"
XSCORE = "total_net_return * 8 + least(profit_factor, 4) * 0.25 + win_rate_wilson_lower - abs(trades_per_active_day - 2.5) * 0.08 - largest_day_abs_pnl_share * 0.2"


@query(
    "e33_exit_tuning",
    f"""WITH {bars_cte()}{MINING_BODY}{RANKS}, base0 AS (SELECT symbol, session_date, bar_index, 0 AS rule_id, 'long' AS direction FROM out WHERE range_pos_10 <= 0.3
      UNION ALL SELECT symbol, session_date, bar_index, 1, 'short' FROM out WHERE range_pos_10 >= 0.7 AND upper_wick_ratio <= 0.6),
    tsig AS MATERIALIZED (SELECT b.*, g.* FROM base0 b JOIN days USING (symbol, session_date), {GRID_SQL} WHERE is_train)
    {trades_sql('tsig', 'ttr', 'rule_id, grid')}{metrics_sql('ttr', 'tm', 'symbol, rule_id, grid')},
    best AS (SELECT * FROM (SELECT *, {XSCORE} AS score, row_number() OVER (PARTITION BY symbol, rule_id ORDER BY round({XSCORE}, 9) DESC, grid) AS k FROM tm WHERE trades >= 20) WHERE k = 1),
    esig AS (SELECT b.*, g.target, g.stop, g.hold, g.cooldown, g.cap FROM base0 b JOIN days USING (symbol, session_date) JOIN best USING (symbol, rule_id) JOIN {GRID_SQL} ON g.grid = best.grid WHERE NOT is_train)
    {trades_sql('esig', 'etr', 'rule_id')}{metrics_sql('etr', 'em', 'symbol, rule_id')}
    SELECT symbol, CAST(rule_id AS BIGINT) AS rule_id, CAST(best.grid AS BIGINT) AS train_grid, best.trades AS train_trades, {r('best.total_net_return', 'train_total_net_return')}, coalesce(em.trades, 0) AS test_trades,
    {r('coalesce(em.total_net_return, 0)', 'test_total_net_return')} FROM best LEFT JOIN em USING (symbol, rule_id)""",
)
def _(spark, d):
    df = features(spark, d)
    specs = R.fixed_rules(spark, df.select("symbol").distinct(), TUNE_SPECS).withColumn("neighbor_rate", F.lit(1.0))
    out = R.tune_exits(df, specs.drop("ex", "name")).withColumnRenamed("grid", "train_grid").filter("train_trades IS NOT NULL")
    return keys(out.select("symbol", "rule_id", "train_grid", "train_trades", "train_total_net_return", "test_trades", "test_total_net_return"))


@query("e34_tuned_mined_rules")
def _(spark, d):
    df = features(spark, d)
    out = R.tune_mined(df, R.mine_rules(df, p=MINE))
    return keys(out.select("symbol", "rule_id", "direction", "status", "posture", "place", "neighbor_rate", "train_trades", "test_trades", "block_rate"))


# --- families ---------------------------------------------------------------------------------


def variant_sql(k: int, v: FM.Variant) -> str:
    """Signal predicate of a variant over the ``fam`` CTE."""
    p, up = v.params, v.direction == "long"
    gt = ">" if up else "<"
    if v.family == "opening_range_breakout":
        lvl = f"or_{'high' if up else 'low'}_{p['opening_minutes']}"
        cond = f"close {gt} {lvl} AND pc {'<=' if up else '>='} {lvl} AND session_minute BETWEEN {p['opening_minutes']} AND 240 AND opening_relative_volume_15 >= {p['opening_relative_volume_min']} AND abs(gap_pct) >= {p['gap_min']} AND ema9 {gt} ema21"
    elif v.family == "late_day_intraday_momentum":
        cond = f"session_minute >= 360 AND session_minute < 363 AND fr * {1 if up else -1} >= {p['opening_return_min']} AND realized_vol_20 >= vm"
    elif v.family == "liquidity_exhaustion_reversal":
        loc = "bb_percent_b <= 0.1 AND rsi6 <= 40" if up else "bb_percent_b >= 0.9 AND rsi6 >= 60"
        cond = f"{loc} AND volume_z_20 >= {p['volume_z_min']} AND session_minute BETWEEN 18 AND 330" + (f" AND macd_hist_delta_1 {gt} 0" if p["confirmation"] else "")
    elif v.family == "vwap_reclaim":
        x = "close >= vwap AND pc < pv" if up else "close <= vwap AND pc > pv"
        rsi = f"rsi14 <= {p['rsi_bound']}" if up else f"rsi14 >= {100 - p['rsi_bound']}"
        cond = f"{x} AND {rsi} AND ema9_slope_3bar {gt} 0 AND volume_ratio_20 >= {p['volume_min']} AND session_minute BETWEEN 18 AND 300"
    elif v.family == "bollinger_squeeze_breakout":
        x = "close > ph" if up else "close < pl"
        cond = f"tight_{int(p['squeeze_quantile'] * 100)} AND {x} AND ema9 {gt} ema21 AND volume_ratio_20 >= {p['volume_min']} AND session_minute BETWEEN 30 AND 300"
    else:
        x = "close >= ema9 AND pc < pe" if up else "close <= ema9 AND pc > pe"
        lo, hi = (42, 65) if up else (35, 58)
        cond = f"ema9 {gt} ema21 AND ema21 {gt} ema50 AND {x} AND rsi14 BETWEEN {lo} AND {hi} AND volume_ratio_20 >= {p['volume_min']} AND session_minute BETWEEN 30 AND 300"
    return (
        f"SELECT symbol, session_date, bar_index, {k} AS variant, '{v.direction}' AS direction, {v.target} AS target, {v.stop} AS stop, {v.hold} AS hold, "
        f"{v.cooldown} AS cooldown, {v.cap} AS cap FROM fam WHERE {cond}"
    )


VARIANTS = FM.variant_grid()
FAMILY_BODY = (
    MINING_BODY.replace("close / (sum((high", f"{ema_sql('close', '(2.0 / 51)', W)} AS ema50, sum((high + low + close) / 3 * volume) OVER ({W}) / nullif(sum(volume) OVER ({W}), 0) AS vwap, close / (sum((high", 1)
    + f""", fa AS (SELECT *, max(CASE WHEN bar_index < 5 THEN high END) OVER ({DAY}) AS or_high_15, min(CASE WHEN bar_index < 5 THEN low END) OVER ({DAY}) AS or_low_15,
    max(CASE WHEN bar_index < 10 THEN high END) OVER ({DAY}) AS or_high_30, min(CASE WHEN bar_index < 10 THEN low END) OVER ({DAY}) AS or_low_30,
    arg_max(close, bar_index) FILTER (bar_index < 10) OVER ({DAY}) / nullif(arg_min(open, bar_index) OVER ({DAY}), 0) - 1 AS fr,
    (bb_upper20 - bb_lower20) / nullif(bb_mid20, 0) AS bw, lag(close) OVER ({W}) AS pc, lag(vwap) OVER ({W}) AS pv, lag(ema9) OVER ({W}) AS pe,
    CASE WHEN count(realized_vol_20) OVER ({W}) >= 20 THEN quantile_cont(realized_vol_20, 0.5) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS vm,
    CASE WHEN count(high) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) >= 8 THEN max(high) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS ph,
    CASE WHEN count(low) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) >= 8 THEN min(low) OVER ({W} ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) END AS pl FROM out),
  fb1 AS (SELECT *, CASE WHEN count(bw) OVER q >= 30 THEN quantile_cont(bw, 0.2) OVER q END AS s20, CASE WHEN count(bw) OVER q >= 30 THEN quantile_cont(bw, 0.3) OVER q END AS s30
    FROM fa WINDOW q AS ({W} ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)),
  fam AS MATERIALIZED (SELECT *, lag(bw) OVER ({W}) <= lag(s20) OVER ({W}) AS tight_20, lag(bw) OVER ({W}) <= lag(s30) OVER ({W}) AS tight_30 FROM fb1),
  vsig AS MATERIALIZED ({" UNION ALL ".join(variant_sql(k, v) for k, v in enumerate(VARIANTS))})"""
)


@query("e30_family_signals", f"WITH {bars_cte(3)}{FAMILY_BODY} SELECT {KEY_SQL}, CAST(variant AS BIGINT) AS variant, direction FROM vsig")
def _(spark, d):
    out = FM.family_signals(fine_features(spark, d), VARIANTS)
    return keys(out.select("symbol", "session_date", "bar_index", "variant", "direction"))


VT = FAMILY_BODY + RANKS + ", wsig AS (SELECT v.*, is_train, fold FROM vsig v JOIN days USING (symbol, session_date))" + trades_sql("wsig", "vt", "variant, is_train")
FOLDS = (
    ", vf AS (SELECT t.*, d.fold FROM vt t JOIN days d USING (symbol, session_date) WHERE d.fold IS NOT NULL)"
    + metrics_sql("vf", "vfm", "symbol, variant, fold")
    + """, fc AS (SELECT symbol, count(DISTINCT fold) AS fold_count FROM days GROUP BY symbol),
    wf AS (SELECT symbol, variant, count(*) FILTER (trades > 0 AND total_net_return > 0 AND profit_factor >= 1) AS positive_folds, sum(total_net_return) AS fold_net_return FROM vfm GROUP BY ALL)"""
)


@query(
    "e31_walk_forward",
    f"WITH {bars_cte(3)}{VT}{FOLDS} SELECT symbol, CAST(variant AS BIGINT) AS variant, positive_folds, fold_count, {r('fold_net_return', 'fold_net_return')}, {r('positive_folds * 1.0 / fold_count', 'positive_fold_rate')} FROM wf JOIN fc USING (symbol)",
)
def _(spark, d):
    df = fine_features(spark, d)
    return keys(FM.walk_forward(FM.variant_trades(df, VARIANTS), FM.fold_counts(df)))


VNAMES = "(VALUES " + ", ".join(f"({k}, '{v.id}', '{v.family}', '{v.direction}')" for k, v in enumerate(VARIANTS)) + ") g(variant, id, family, direction)"
EVAL = (
    VT
    + FOLDS
    + metrics_sql("vt", "vm2", "symbol, variant, is_train")
    + f""", sy AS (SELECT DISTINCT symbol FROM bars),
    ev0 AS (SELECT sy.symbol, g.*, {", ".join(f"coalesce(a.{m}, 0) AS train_{m}, coalesce(b.{m}, 0) AS test_{m}" for m in E.METRICS)},
      coalesce(positive_folds * 1.0 / fold_count, 0) AS positive_fold_rate
      FROM sy CROSS JOIN {VNAMES} LEFT JOIN (SELECT * FROM vm2 WHERE is_train) a ON a.symbol = sy.symbol AND a.variant = g.variant
      LEFT JOIN (SELECT * FROM vm2 WHERE NOT is_train) b ON b.symbol = sy.symbol AND b.variant = g.variant
      LEFT JOIN wf ON wf.symbol = sy.symbol AND wf.variant = g.variant LEFT JOIN fc ON fc.symbol = sy.symbol),
    ev1 AS (SELECT *, test_total_net_return * 8 + least(train_total_net_return, test_total_net_return) * 4 + least(test_profit_factor, 4) * 0.18 + test_win_rate_wilson_lower
      + positive_fold_rate * 0.5 - abs(test_trades_per_active_day - 2.5) * 0.08 - greatest(0, test_largest_day_abs_pnl_share - 0.25) - abs(train_win_rate - test_win_rate) AS score,
      train_trades >= 20 AND test_trades >= 12 AND train_total_net_return > 0 AND test_total_net_return > 0 AND train_profit_factor >= 1 AND test_profit_factor >= 1.2 AND positive_fold_rate >= 0.5 AS robust,
      CASE WHEN train_trades >= 20 AND test_trades >= 12 AND train_total_net_return > 0 AND test_total_net_return > 0 AND train_profit_factor >= 1.15 AND test_profit_factor >= 1.2 AND positive_fold_rate >= 0.75
        AND test_trades_per_active_day <= 4 AND test_largest_day_abs_pnl_share <= 0.35 THEN 'candidate'
        WHEN train_total_net_return > 0 AND test_total_net_return > 0 AND positive_fold_rate >= 0.5 THEN 'experiment' ELSE 'reject' END AS st0 FROM ev0),
    ev2 AS (SELECT *, avg(CAST(robust AS INTEGER)) OVER (PARTITION BY symbol, family, direction) AS family_stability FROM ev1),
    ev AS (SELECT *, CASE WHEN st0 = 'candidate' AND family_stability < 0.3 THEN 'experiment' ELSE st0 END AS status FROM ev2)"""
)


@query(
    "e32_variant_evaluation",
    f"WITH {bars_cte(3)}{EVAL} SELECT symbol, id, train_trades, test_trades, {r('test_total_net_return', 'test_total_net_return')}, {r('score', 'score')}, status, robust, {r('family_stability', 'family_stability')} FROM ev",
)
def _(spark, d):
    out = FM.evaluate_variants(fine_features(spark, d), VARIANTS)
    return keys(out.select("symbol", "id", "train_trades", "test_trades", "test_total_net_return", "score", "status", "robust", "family_stability"))


@query(
    "e32_family_summary",
    f"WITH {bars_cte(3)}{EVAL} SELECT symbol, family, direction, count(*) AS variants, count(*) FILTER (robust) AS robust_variants, first(id ORDER BY round(score, 9) DESC, variant) AS best_variant_id FROM ev GROUP BY ALL",
)
def _(spark, d):
    return FM.family_summary(FM.evaluate_variants(fine_features(spark, d), VARIANTS)).drop("robust_variant_rate")


PROFILE = """, pd AS (SELECT symbol, session_date, count(*) AS bars, sum(close * volume) AS value FROM out GROUP BY ALL),
  p1 AS (SELECT symbol, count(*) AS sessions, quantile_cont(bars, 0.5) AS mb, quantile_cont(value, 0.5) AS mv FROM pd GROUP BY symbol),
  p2 AS (SELECT symbol, quantile_cont(close, 0.5) AS mp, coalesce(quantile_cont(atr14_pct, 0.5), 0) AS ma, coalesce(quantile_cont(atr14_pct, 0.75), 0) AS ha FROM out GROUP BY symbol)"""


@query(
    "e36_research_profile",
    f"""WITH {bars_cte()}{atr_ctes()}{PROFILE} SELECT symbol, sessions, {r('mb', 'median_bars_per_session')}, {r('mv', 'median_daily_dollar_value')}, {r('mp', 'median_price')}, {r('ma', 'median_atr_pct')},
    {r('ha', 'high_volatility_atr_pct')}, sessions >= 60 AND mb >= 120 AND mv >= 5e6 AS eligible,
    CAST((sessions < 60)::INT + (mb < 120)::INT + (mv < 5e6)::INT AS BIGINT) AS reason_count FROM p1 JOIN p2 USING (symbol)""",
)
def _(spark, d):
    out = FM.research_profile(atr_bars(spark, d)).withColumn("reason_count", F.size("reasons").cast("bigint")).drop("reasons")
    return keys(out)


@query(
    "e37_cross_symbol_comparison",
    f"""WITH {bars_cte(3)}{EVAL}, g AS (SELECT id, family, direction, count(*) AS covered, count(*) FILTER (robust) AS k, count(*) FILTER (test_trades >= 12 AND test_total_net_return > 0) AS positive_test_symbols,
      quantile_cont(test_total_net_return, 0.5) AS mr, min(test_total_net_return) AS wr, quantile_cont(test_profit_factor, 0.5) AS mf, quantile_cont(test_trades_per_active_day, 0.5) AS mt, max(test_trades_per_active_day) AS xt FROM ev GROUP BY ALL)
    SELECT id, covered, k AS robust_symbols, positive_test_symbols, {r('mr', 'median_test_return')}, {r('wr', 'worst_test_return')}, {r('mf', 'median_test_profit_factor')},
      CASE WHEN covered < 2 THEN 'insufficient_cross_ticker_sample' WHEN k = covered AND mf >= 1.2 AND xt <= 4 THEN 'portable_candidate' WHEN k >= ceil(covered * 2.0 / 3) THEN 'portable_experiment'
      WHEN k = 1 THEN 'ticker_specific' ELSE 'reject' END AS portability FROM g""",
)
def _(spark, d):
    df = fine_features(spark, d)
    # every symbol of the small test table counts as eligible here; the profile's floor is tested on its own
    profile = df.select("symbol").distinct().withColumn("eligible", F.lit(True))
    out = FM.compare_symbols(FM.evaluate_variants(df, VARIANTS), profile)
    return keys(out.select("id", "covered", "robust_symbols", "positive_test_symbols", "median_test_return", "worst_test_return", "median_test_profit_factor", "portability"))


@query("e38_research_run")
def _(spark, d):
    bars = B.resample(event_quotes(table(spark, d, "events")), B.ALL_DAY_HOURLY)
    out = run_research(bars, params=MINE)
    tuned = out["tuned"].select(F.concat("symbol", F.lit(" "), "direction", F.lit(" "), "rule").alias("id"), F.col("test_trades").alias("covered"), F.col("status").alias("portability"), rnd("test_total_net_return").alias("portable_score"))
    compared = out["comparison"].select("id", "covered", "portability", rnd("portable_score").alias("portable_score"))
    return compared.withColumn("kind", F.lit("variant")).unionByName(tuned.withColumn("kind", F.lit("mined")))


# --- predicates ---------------------------------------------------------------------------------


def rule_bars(spark, d, conditions):
    names = ["range_pos_10", "volume_ratio_20"]
    df = X.volume_and_volatility(X.bar_returns(hourly(spark, d)))
    rules = R.fixed_rules(spark, df.select("symbol").distinct(), [{"id": "rule", "direction": "long", "conditions": conditions}], names)
    out = R.rule_signals(df.select(*X.SESSION, "bar_index", R.feature_array(names)), rules)
    return keys(out.select(*X.SESSION, "bar_index"))


@query("c01_threshold_predicate", f"WITH {bars_cte()}{vol_ctes()} SELECT {KEY_SQL} FROM out WHERE range_pos_10 <= 0.3")
def _(spark, d):
    return rule_bars(spark, d, [("range_pos_10", "<=", 0.3)])


@query("c02_rule_conjunction", f"WITH {bars_cte()}{vol_ctes()} SELECT {KEY_SQL} FROM out WHERE range_pos_10 <= 0.3 AND volume_ratio_20 >= 1")
def _(spark, d):
    return rule_bars(spark, d, [("range_pos_10", "<=", 0.3), ("volume_ratio_20", ">=", 1.0)])


@query("d13_variants_on_bars", f"WITH {bars_cte(3)}{FAMILY_BODY} SELECT {KEY_SQL}, count(*) AS variants FROM vsig GROUP BY ALL")
def _(spark, d):
    out = FM.family_signals(fine_features(spark, d), VARIANTS).groupBy(*X.SESSION, "bar_index").agg(F.count(F.lit(1)).alias("variants"))
    return keys(out)
