"""Two-leg rotation between a long and an inverse symbol on a signal symbol's RSI.

A pair's day is an independent ordered fold over at most one point per minute, so days of all
pairs and strategies run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.numeric import div
from tidemark.operators.features import simple_rsi


@dataclass(frozen=True)
class Strategy:
    """RSI bounds, optional take-profit on the long leg, and money per leg."""

    id: str
    buy: float = 20.0
    sell: float = 80.0
    take_profit: float | None = None
    notional: float = 1000.0


STRATEGIES = (Strategy("rsi_extreme", take_profit=0.04), Strategy("rsi_rotation"))


def three_way_points(points: DataFrame, pairs: Sequence[tuple[str, str, str, str]]) -> DataFrame:
    """Times at which the signal, long and short symbol of a pair all have a price.

    ``points``: ``symbol, ts, close``; ``pairs``: ``(pair_id, signal, long, short)`` from
    configuration. One aggregate on ``(pair, time)`` replaces the two joins.
    """
    roles = F.array(
        *[F.struct(F.lit(p).alias("pair_id"), F.lit(role).alias("role"), F.lit(sym).alias("sym")) for p, *syms in pairs for role, sym in zip(("signal", "long", "short"), syms)]
    )
    tagged = points.withColumn("r", F.explode(F.filter(roles, lambda r: r["sym"] == F.col("symbol"))))

    def price(role: str) -> Column:
        return F.max(F.when(F.col("r.role") == role, F.col("close"))).alias(f"{role}_price")

    out = tagged.groupBy(F.col("r.pair_id").alias("pair_id"), "ts").agg(price("signal"), price("long"), price("short"))
    return out.dropna(subset=["signal_price", "long_price", "short_price"])


def bucket_rsi(points: DataFrame, period: int = 6, minutes: int = 3, lag_bucket: bool = False) -> DataFrame:
    """RSI of each m-minute bucket of a symbol from the buckets' last closes.

    The value belongs to the whole bucket, as in the original rule; ``lag_bucket`` gives a bucket
    the value of the previous one instead, which removes the look-ahead inside it.
    """
    closes = points.groupBy("symbol", S.time_bucket("ts", minutes).alias("bucket")).agg(F.max_by("close", "ts").alias("close"))
    out = simple_rsi(closes, period, ("symbol",), "bucket")
    if lag_bucket:
        out = out.withColumn("rsi", F.lag("rsi").over(Window.partitionBy("symbol").orderBy("bucket")))
    return out.select("symbol", "bucket", "rsi")


def rotation_points(points: DataFrame, pairs: Sequence[tuple[str, str, str, str]], period: int = 6, minutes: int = 3, lag_bucket: bool = False) -> DataFrame:
    """Three-way points with the bucket's RSI and estimated bid and ask of the tradable legs."""
    signal_of = F.element_at(F.create_map(*[x for p, s, _, _ in pairs for x in (F.lit(p), F.lit(s))]), F.col("pair_id"))
    df = three_way_points(points, pairs).withColumns({"symbol": signal_of, "bucket": S.time_bucket("ts", minutes), "session_date": F.to_date("ts")})
    df = df.join(bucket_rsi(points, period, minutes, lag_bucket), ["symbol", "bucket"], "left")
    quotes = {}
    for leg in ("long", "short"):
        quotes[f"{leg}_bid"] = S.estimated_bid(F.col(f"{leg}_price"))
        quotes[f"{leg}_ask"] = S.estimated_ask(F.col(f"{leg}_price"))
    return df.withColumns(quotes).drop("symbol")


def decision_nodes(points: DataFrame) -> DataFrame:
    """Number of the point's bucket within the day, and whether it opens a new one."""
    w = Window.partitionBy("pair_id", "session_date").orderBy("ts")
    new = F.coalesce(F.col("bucket") != F.lag("bucket").over(w), F.lit(True))
    df = points.withColumn("new_decision_node", new)
    return df.withColumn("decision_index", F.sum(F.col("new_decision_node").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def strategy_literal(strategies: Sequence[Strategy]) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(s.id).alias("strategy_id"), F.lit(s.buy).alias("buy"), F.lit(s.sell).alias("sell"), F.lit(s.take_profit).cast("double").alias("take"), F.lit(s.notional).alias("notional"),
            )
            for s in strategies
        ]
    )


def ledger_state(points: DataFrame, strategies: Sequence[Strategy] = STRATEGIES) -> DataFrame:
    """Fold each ``(pair, date, strategy)`` to its closed trades, open legs and last quotes."""
    p = F.struct("ts", "rsi", "long_bid", "long_ask", "short_bid", "short_ask")
    days = points.groupBy("pair_id", "session_date").agg(F.array_sort(F.collect_list(p)).alias("points"))
    df = days.withColumn("s", F.explode(strategy_literal(strategies)))
    ts_type = points.schema["ts"].dataType.simpleString()
    trade = f"struct<leg:string,entry_time:{ts_type},exit_time:{ts_type},entry_price:double,exit_price:double,reason:string>"
    nothing, no_time = F.lit(None).cast("double"), F.lit(None).cast(ts_type)
    start = F.struct(
        nothing.alias("long"), no_time.alias("long_at"), nothing.alias("short"), no_time.alias("short_at"), F.array().cast(f"array<{trade}>").alias("trades")
    )
    s = lambda f: F.col(f"s.{f}")

    def step(a: Column, q: Column) -> Column:
        known = q["rsi"].isNotNull()
        take = F.coalesce(known & s("take").isNotNull() & (q["long_bid"] / a["long"] - 1 >= s("take")), F.lit(False))
        buy = F.coalesce(known & ~take & (q["rsi"] <= s("buy")), F.lit(False))
        sell = F.coalesce(known & ~take & ~buy & (q["rsi"] >= s("sell")), F.lit(False))
        close_long = (take | sell) & a["long"].isNotNull()
        close_short = buy & a["short"].isNotNull()

        def closed(leg: str, cond: Column, reason: Column) -> Column:
            return F.when(
                cond,
                F.struct(
                    F.lit(leg).alias("leg"), a[f"{leg}_at"].alias("entry_time"), q["ts"].alias("exit_time"), a[leg].alias("entry_price"), q[f"{leg}_bid"].alias("exit_price"), reason.alias("reason")
                ),
            )

        done = F.filter(
            F.array(
                closed("long", close_long, F.when(take, "profit_take").otherwise("overbought")), closed("short", close_short, F.lit("oversold"))
            ),
            lambda t: t.isNotNull(),
        )
        open_long, open_short = buy & a["long"].isNull(), sell & a["short"].isNull()
        return F.struct(
            F.when(close_long, nothing).when(open_long, q["long_ask"]).otherwise(a["long"]).alias("long"),
            F.when(close_long, no_time).when(open_long, q["ts"]).otherwise(a["long_at"]).alias("long_at"),
            F.when(close_short, nothing).when(open_short, q["short_ask"]).otherwise(a["short"]).alias("short"),
            F.when(close_short, no_time).when(open_short, q["ts"]).otherwise(a["short_at"]).alias("short_at"),
            F.concat(a["trades"], done).alias("trades"),
        )

    out = df.withColumn("state", F.aggregate("points", start, step)).withColumn("last", F.element_at("points", -1))
    return out.select(
        "pair_id", "session_date", "s.strategy_id", "s.notional", F.size("points").alias("point_count"), F.size(F.filter("points", lambda q: q["rsi"].isNotNull())).alias("rsi_ready_count"), "state", "last"
    )


def rotation_ledger(state: DataFrame) -> DataFrame:
    """Closed trades with profit on the leg's notional."""
    t = state.select("pair_id", "session_date", "strategy_id", "notional", F.posexplode("state.trades").alias("trade_no", "t"))
    ret = div("exit_price", "entry_price") - 1
    return t.select("pair_id", "session_date", "strategy_id", "notional", "trade_no", "t.*").withColumn("return_pct", ret).withColumn("pnl", ret * F.col("notional"))


def daily_results(state: DataFrame) -> DataFrame:
    """Realised and unrealised profit per day, marked at the last point's bids, and the outcome."""
    pnl = lambda exit_, entry: (exit_ / entry - 1) * F.col("notional")
    zero = F.lit(0.0)
    realised = F.aggregate("state.trades", zero, lambda acc, t: acc + pnl(t["exit_price"], t["entry_price"]))
    wins = F.size(F.filter("state.trades", lambda t: t["exit_price"] > t["entry_price"]))
    legs = {leg: F.col(f"state.{leg}") for leg in ("long", "short")}
    open_pnl = sum((F.coalesce(pnl(F.col(f"last.{leg}_bid"), e), zero) for leg, e in legs.items()), zero)
    open_notional = sum((F.when(e.isNotNull(), F.col("notional")).otherwise(zero) for e in legs.values()), zero)
    df = state.select(
        "pair_id", "session_date", "strategy_id", "notional", "point_count", "rsi_ready_count", F.size("state.trades").alias("trade_count"), wins.alias("winning_trades"), realised.alias("realized_pnl"),
        open_pnl.alias("unrealized_pnl"), open_notional.alias("open_notional"),
    )
    df = df.withColumn("final_pnl", F.col("realized_pnl") + F.col("unrealized_pnl"))
    cents = F.round("final_pnl", 2)
    return df.withColumns(
        {"outcome": F.when(cents > 0, "win").when(cents < 0, "loss").otherwise("flat"), "return_pct": div("final_pnl", "notional")}
    )


def period_summary(daily: DataFrame) -> DataFrame:
    """Day counts and rates, totals, best and worst day per pair and strategy."""
    day = F.col("outcome")
    order = F.date_diff(F.col("session_date"), F.lit("1970-01-01").cast("date"))
    out = daily.groupBy("pair_id", "strategy_id").agg(
        F.count(F.lit(1)).alias("day_count"),
        F.count_if(day == "win").alias("winning_days"),
        F.count_if(day == "loss").alias("losing_days"),
        F.count_if(day == "flat").alias("flat_days"),
        F.sum("final_pnl").alias("total_pnl"),
        F.sum("realized_pnl").alias("realized_pnl"),
        F.sum("unrealized_pnl").alias("unrealized_pnl"),
        F.sum("open_notional").alias("open_notional"),
        F.sum("trade_count").alias("trade_count"),
        F.sum("winning_trades").alias("winning_trades"),
        F.max_by("session_date", F.struct("final_pnl", (-order).alias("o"))).alias("best_day"),
        F.max("final_pnl").alias("best_pnl"),
        F.min_by("session_date", F.struct("final_pnl", order.alias("o"))).alias("worst_day"),
        F.min("final_pnl").alias("worst_pnl"),
    )
    c = F.col

    def rate(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))

    return out.withColumns(
        {
            "day_win_rate": rate(c("winning_days"), c("winning_days") + c("losing_days")),
            "trade_win_rate": rate(c("winning_trades"), c("trade_count")),
            "average_daily_pnl": c("total_pnl") / c("day_count"),
            "trades_per_day": rate(c("trade_count"), c("day_count")),
            "open_return_pct": rate(c("unrealized_pnl"), c("open_notional")),
        }
    )


def trade_markers(state: DataFrame, points: DataFrame) -> DataFrame:
    """Buy and sell marks of closed and open legs with the RSI at their time."""
    sides = F.array(
        F.struct(F.lit("buy").alias("type"), F.col("t.entry_time").alias("ts"), F.col("t.entry_price").alias("price"), F.lit("ask").alias("quote_side")),
        F.struct(F.lit("sell").alias("type"), F.col("t.exit_time").alias("ts"), F.col("t.exit_price").alias("price"), F.lit("bid").alias("quote_side")),
    )
    base = ["pair_id", "session_date", "strategy_id"]
    closed = state.select(*base, F.explode("state.trades").alias("t")).select(*base, F.col("t.leg").alias("leg"), F.explode(sides).alias("m")).select(*base, "leg", "m.*")
    legs = F.array(*[F.struct(F.lit(leg).alias("leg"), F.col(f"state.{leg}_at").alias("ts"), F.col(f"state.{leg}").alias("price")) for leg in ("long", "short")])
    still = state.select(*base, F.explode(F.filter(legs, lambda x: x["ts"].isNotNull())).alias("o"))
    opened = still.select(*base, "o.leg", F.lit("buy").alias("type"), "o.ts", "o.price", F.lit("ask").alias("quote_side"))
    return closed.unionByName(opened).join(points.select("pair_id", "ts", "rsi"), ["pair_id", "ts"], "left")


def keep_last(rows: DataFrame, keys: Sequence[str], n: int, order: str = "ts") -> DataFrame:
    """The last ``n`` rows per key (a retention rule; planned as a group limit before the exchange)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return rows.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= n).drop("__k")
