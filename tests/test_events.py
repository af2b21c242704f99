"""Event backtest, metrics, mining, families and tuning against plain loops."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.operators import families as FM
from tidemark.operators import rules as R

SCHEMA = "symbol string, session_date date, bar_index int, open double, high double, low double, close double, rsi6 double"


def random_bars(spark, seed=1, days=4, bars=40, step=2.0):
    rng = random.Random(seed)
    rows = []
    for d in range(days):
        price = 100.0
        for i in range(bars):
            o = price
            price = max(5.0, price + rng.uniform(-step, step))
            if rng.random() < 0.03:
                o = 0.0  # an unusable entry price
            rows.append(("A", dt.date(2026, 1, 5) + dt.timedelta(days=d), i, o, max(o, price) + rng.random(), min(o or price, price) - rng.random(), price, rng.uniform(0, 100)))
    return spark.createDataFrame(rows, SCHEMA), rows


def plain_trades(rows, signal, long, target, stop, hold, cooldown, cap):
    """Bar-by-bar walk over each day."""
    out = []
    days = {}
    for r in rows:
        days.setdefault(r[1], []).append(r)
    for day, bars in sorted(days.items()):
        i, taken = 0, 0
        while i < len(bars) - 1:
            if cap is not None and taken >= cap:
                break
            entry = bars[i + 1][3]
            if not signal(bars[i]) or not entry or entry <= 0:
                i += 1
                continue
            last = min(len(bars) - 1, i + 1 + hold)
            price, reason, at = bars[last][6] or entry, "time", last
            for k in range(i + 1, last + 1):
                low, high = bars[k][5] or entry, bars[k][4] or entry
                bad = low <= entry * (1 - stop) if long else high >= entry * (1 + stop)
                good = high >= entry * (1 + target) if long else low <= entry * (1 - target)
                if bad or good:
                    side = (-stop if bad else target) if long else (stop if bad else -target)
                    price, reason, at = entry * (1 + side), "stop" if bad else "target", k
                    break
            gross = price / entry - 1 if long else entry / price - 1
            out.append((day, bars[i][2], at, reason, round(gross - 0.001, 10)))
            taken += 1
            i = at + 1 + cooldown
    return out


@pytest.mark.parametrize("long", [True, False])
@pytest.mark.parametrize("hold,cooldown,cap,seed", [(7, 2, None, 1), (3, 0, 2, 2), (12, 4, 3, 3)])
def test_backtest_matches_plain_walk(spark, long, hold, cooldown, cap, seed):
    df, rows = random_bars(spark, seed)
    signals = E.with_path(df, hold).filter("rsi6 <= 45")
    t = E.backtest(signals, [], "long" if long else "short", target=0.015, stop=0.008, hold=hold, cooldown=cooldown, cap=cap)
    got = sorted((r.session_date, r.bar_index, r.exit_index, r.exit_reason, round(r.net_return, 10)) for r in t.collect())
    assert got == sorted(plain_trades(rows, lambda b: b[7] <= 45, long, 0.015, 0.008, hold, cooldown, cap))
    assert got


def test_long_signal_fixture(spark):
    rows = [("A", dt.date(2026, 1, 5), i, 100.0, 103.0 if i > 2 else 100.5, 99.9, 100.2, 10.0 if i == 1 else 50.0) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    m = E.trade_metrics(E.backtest(E.with_path(df, 7).filter("rsi6 <= 20"), [], target=0.015, stop=0.008), ["symbol"]).first()
    assert (m.trades, m.winning_trades, m.trades_per_active_day) == (1, 1, 1.0)
    assert m.total_net_return > 0 and m.profit_factor == float("inf")


def test_short_signal_fixture(spark):
    rows = [("A", dt.date(2026, 1, 5), i, 100.0, 100.1, 97.0 if i > 2 else 99.8, 99.9, 90.0 if i == 1 else 50.0) for i in range(6)]
    df = spark.createDataFrame(rows, SCHEMA)
    m = E.trade_metrics(E.backtest(E.with_path(df, 7).filter("rsi6 >= 80"), [], "short", target=0.015, stop=0.008), ["symbol"]).first()
    assert (m.trades, m.winning_trades) == (1, 1) and m.total_net_return > 0


def test_metrics_by_hand(spark):
    rows = [("A", dt.date(2026, 1, 5), 1, 0.02, "target"), ("A", dt.date(2026, 1, 5), 9, -0.01, "stop"), ("A", dt.date(2026, 1, 6), 2, -0.03, "stop"), ("A", dt.date(2026, 1, 7), 2, 0.01, "time")]
    t = spark.createDataFrame(rows, "symbol string, session_date date, bar_index int, net_return double, exit_reason string")
    m = E.trade_metrics(t, ["symbol"]).first()
    assert m.trades == 4 and m.winning_trades == 2 and m.active_days == 3 and m.profitable_days == 2
    assert m.profit_factor == pytest.approx(0.03 / 0.04)
    assert m.max_drawdown == pytest.approx(-0.04)
    assert m.median_net_return == pytest.approx(0.0)
    assert m.largest_day_abs_pnl_share == pytest.approx(0.03 / 0.05)


def test_walk_forward_folds(spark):
    days = [("A", dt.date(2026, 1, 1) + dt.timedelta(days=i)) for i in range(52)]
    df = spark.createDataFrame(days, "symbol string, session_date date")
    folds = E.session_ranks(df).withColumn("fold", E.fold_id()).groupBy("fold").count().collect()
    # 26 training sessions, two folds of 12, and a rest of two that is too short
    assert {r.fold: r["count"] for r in folds} == {None: 28, 0: 12, 1: 12}


def mining_bars(spark):
    rows = []
    for d in range(12):
        for i in range(12):
            hot = i in (2, 7)
            after = i in (4, 9)
            rows.append(("A", dt.date(2026, 1, 5) + dt.timedelta(days=d), i, 100.0, 102.5 if after else 100.4, 99.8, 100.0 + 0.01 * d, 10.0 + d * 0.1 if hot else 50.0 + i))
    return spark.createDataFrame(rows, SCHEMA)


def test_mining_finds_the_planted_rule(spark):
    p = R.MiningParams(min_train_trades=5, min_test_trades=2)
    mined = R.mine_rules(mining_bars(spark), ["rsi6"], p)
    rows = mined.orderBy("direction", "place").collect()
    assert rows and rows[0].direction == "long"
    best = rows[0]
    assert best.train_total_net_return > 0 and best.test_total_net_return > 0
    assert best.positive_neighbor_rate is not None and best.rule.startswith("rsi6 <= ")


def test_too_few_trades_cannot_be_tuned(spark):
    rows = [("A", dt.date(2026, 1, 5) + dt.timedelta(days=d), i, 100.0, 100.5, 99.5, 100.0, 10.0 if i == 2 else 60.0) for d in range(2) for i in range(8)]
    df = spark.createDataFrame(rows, SCHEMA)
    specs = R.fixed_rules(spark, df.select("symbol").distinct(), [{"id": "r", "direction": "long", "conditions": [("rsi6", "<=", 20)]}], ["rsi6"])
    out = R.tune_exits(df, specs.withColumn("neighbor_rate", F.lit(1.0)).drop("ex", "name"), ["rsi6"]).first()
    assert out.status == "reject" and out.train_trades is None


def test_overlap_fixture(spark):
    df = spark.createDataFrame([("A", 1, 1), ("A", 2, 0), ("A", 3, 1)], "symbol string, x int, y int")
    o = R.signal_overlap(df, F.col("x") >= 2, F.col("y") >= 1).first()
    assert o.both_bars == 1 and o.jaccard == pytest.approx(1 / 3)


FAMILY = {
    "volume_ratio_20": 2.0, "opening_relative_volume_15": 2.0, "gap_pct": 0.02, "ema9": 2.0, "ema21": 1.0, "ema50": 0.5, "bb_upper20": None, "bb_lower20": None, "bb_mid20": None, "realized_vol_20": None,
    "bb_percent_b": None, "rsi6": 50.0, "rsi14": 50.0, "volume_z_20": 0.0, "macd_hist_delta_1": 0.0, "vwap": 1.0, "ema9_slope_3bar": 0.0,
}


def family_bars(spark, rows, **extra):
    df = spark.createDataFrame(rows, "symbol string, session_date date, bar_index int, session_minute int, open double, high double, low double, close double")
    return df.withColumns({k: F.lit(v).cast("double") for k, v in {**FAMILY, **extra}.items()})


def test_breakout_waits_for_the_range(spark):
    closes = [10.0, 10.4, 10.1, 10.3, 10.2, 11.0, 11.2]
    rows = [("A", dt.date(2026, 1, 5), i, i * 3, c, 10.5 if i < 5 else c + 0.1, c - 0.1, c) for i, c in enumerate(closes)]
    v = [x for x in FM.variant_grid() if x.family == "opening_range_breakout" and x.direction == "long" and x.params["opening_minutes"] == 15]
    hits = FM.family_signals(family_bars(spark, rows), v).select("bar_index").distinct().collect()
    assert [r.bar_index for r in hits] == [5]


def test_late_day_has_one_trigger(spark):
    rows = [("A", dt.date(2026, 1, 5), i, i * 3 + 2, 10.0, 10.6, 9.9, 10.0 + min(i, 9) * 0.05) for i in range(121)]
    v = [x for x in FM.variant_grid() if x.family == "late_day_intraday_momentum" and x.direction == "long"][:1]
    hits = FM.family_signals(family_bars(spark, rows, realized_vol_20=0.01), v).join(family_bars(spark, rows).select("bar_index", "session_minute"), "bar_index").collect()
    assert [r.session_minute for r in hits] == [362]


def evaluated(spark, rows):
    cols = "symbol string, id string, family string, direction string, robust boolean, test_trades bigint, test_total_net_return double, test_profit_factor double, test_trades_per_active_day double"
    return spark.createDataFrame(rows, cols)


def test_portability_classes(spark):
    rows = [(s, "v", "f", "long", True, 15, 0.05, 1.5, 2.0) for s in "ABC"] + [(s, "w", "f", "long", s == "A", 15, 0.05 if s == "A" else -0.01, 1.5, 2.0) for s in "ABC"]
    profile = spark.createDataFrame([(s, True) for s in "ABC"], "symbol string, eligible boolean")
    out = {r.id: r for r in FM.compare_symbols(evaluated(spark, rows), profile).collect()}
    assert out["v"].portability == "portable_candidate" and out["v"].robust_symbols == 3
    assert out["w"].portability == "ticker_specific"
    fewer = spark.createDataFrame([("A", True), ("B", False), ("C", False)], "symbol string, eligible boolean")
    out = {r.id: r for r in FM.compare_symbols(evaluated(spark, rows), fewer).collect()}
    assert out["v"].covered == 1 and out["v"].portability == "insufficient_cross_ticker_sample"


def test_grid_sizes():
    assert len(FM.variant_grid()) == 48 and len({v.id for v in FM.variant_grid()}) == 48
    assert len(R.EXIT_GRID) == 108
