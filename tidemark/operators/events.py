"""First-touch, non-overlapping event backtest and trade metrics.

A signal carries the short path of the next bars, its exit is an expression over that path, and
the non-overlap rule is an ordered fold over one session's signals. Sessions are independent,
so the work spreads over ``(symbol, session_date, rule)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import div, or_default, wilson_lower
from tidemark.operators.features import SESSION, session_window

NO_CAP = 1_000_000

METRICS = [
    "trades",
    "winning_trades",
    "win_rate",
    "win_rate_wilson_lower",
    "average_net_return",
    "median_net_return",
    "total_net_return",
    "profit_factor",
    "max_drawdown",
    "active_days",
    "profitable_days",
    "profitable_day_rate",
    "trades_per_active_day",
    "target_rate",
    "stop_rate",
    "largest_day_abs_pnl_share",
]


def with_path(bars: DataFrame, max_hold: int) -> DataFrame:
    """Add ``path``: the next ``max_hold + 1`` bars of the session, entry bar first."""
    step = F.struct(
        F.col("bar_index").alias("i"), F.col("open").alias("o"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("close").alias("c")
    )
    return bars.withColumn("path", F.collect_list(step).over(session_window().rowsBetween(1, 1 + max_hold)))


def tradable() -> Column:
    """The next bar exists and opens above zero."""
    return (F.size("path") > 0) & F.coalesce(F.get(F.col("path"), 0)["o"] > 0, F.lit(False))


def exit_of(direction: Column, target: Column, stop: Column, hold: Column, cost: Column) -> Column:
    """Exit of a signal with a ``path``: stop before target inside a bar, else the close after ``hold`` bars."""
    path = F.slice(F.col("path"), F.lit(1), hold.cast("int") + 1)
    entry = F.get(F.col("path"), 0)["o"]
    up = direction == "long"
    stop_price = F.when(up, entry * (1 - stop)).otherwise(entry * (1 + stop))
    target_price = F.when(up, entry * (1 + target)).otherwise(entry * (1 - target))

    def low(b: Column) -> Column:
        return or_default(b["l"], entry)

    def high(b: Column) -> Column:
        return or_default(b["h"], entry)

    def stopped(b: Column) -> Column:
        return F.when(up, low(b) <= stop_price).otherwise(high(b) >= stop_price)

    def reached(b: Column) -> Column:
        return F.when(up, high(b) >= target_price).otherwise(low(b) <= target_price)

    hit = F.get(F.filter(path, lambda b: stopped(b) | reached(b)), 0)
    last = F.element_at(path, -1)
    reason = F.when(hit.isNull(), "time").when(stopped(hit), "stop").otherwise("target")
    price = F.when(hit.isNull(), or_default(last["c"], entry)).when(stopped(hit), stop_price).otherwise(target_price)
    gross = F.when(up, price / entry - 1).otherwise(F.try_divide(entry, price) - 1)
    return F.struct(
        F.get(F.col("path"), 0)["i"].alias("entry_index"),
        F.coalesce(hit["i"], last["i"]).alias("exit_index"),
        entry.alias("entry_price"),
        price.alias("exit_price"),
        gross.alias("gross_return"),
        (gross - cost).alias("net_return"),
        reason.alias("exit_reason"),
    )


TRADE = ["entry_index", "exit_index", "entry_price", "exit_price", "gross_return", "net_return", "exit_reason"]


def non_overlapping(signals: DataFrame, keys: Sequence[str], cooldown: str = "cooldown", cap: str = "cap") -> DataFrame:
    """Greedy choice per session and rule: a signal counts when the last trade and its cooldown are over.

    ``signals`` has ``symbol, session_date, bar_index, *keys``, the exit struct ``x`` and the
    columns named by ``cooldown`` and ``cap``. A session holds a few hundred bars at most.
    """
    one = F.struct("bar_index", "x")
    grouped = signals.groupBy(*SESSION, *keys).agg(
        F.array_sort(F.collect_list(one)).alias("s"), F.first(cooldown).alias("__cool"), F.first(cap).alias("__cap")
    )
    start = F.struct(F.lit(0).cast("int").alias("free"), F.slice("s", 1, 0).alias("kept"))

    def step(acc: Column, sig: Column) -> Column:
        take = (sig["bar_index"] >= acc["free"]) & (F.size(acc["kept"]) < F.col("__cap"))
        nxt = F.struct(
            (sig["x"]["exit_index"] + 1 + F.greatest(F.lit(0), F.col("__cool"))).cast("int").alias("free"),
            F.concat(acc["kept"], F.array(sig)).alias("kept"),
        )
        return F.when(take, nxt).otherwise(acc)

    kept = F.aggregate("s", start, step, lambda acc: acc["kept"])
    out = grouped.select(*SESSION, *keys, F.explode(kept).alias("t"))
    return out.select(*SESSION, *keys, F.col("t.bar_index").alias("bar_index"), *[F.col(f"t.x.{c}").alias(c) for c in TRADE])


def backtest(
    signals: DataFrame,
    keys: Sequence[str],
    direction: Column | str = "long",
    target: float = 0.015,
    stop: float = 0.008,
    hold: int = 7,
    cost: float = 0.001,
    cooldown: int = 2,
    cap: int | None = None,
) -> DataFrame:
    """Trades of signal bars that carry a ``path`` (see :func:`with_path`), one exit rule for all."""
    side = F.lit(direction) if isinstance(direction, str) else direction
    x = exit_of(side, F.lit(target), F.lit(stop), F.lit(hold), F.lit(cost))
    rows = signals.filter(tradable()).select(
        *SESSION, "bar_index", *keys, x.alias("x"), F.lit(cooldown).alias("cooldown"), F.lit(NO_CAP if cap is None else cap).alias("cap")
    )
    return non_overlapping(rows, keys)


def trade_metrics(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts, win rate, returns, profit factor, drawdown and day statistics per key.

    One exchange on ``keys``; the cumulative and per-day windows and the aggregate reuse it.
    """
    order = ["session_date", "bar_index"]
    run = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    day = Window.partitionBy(*keys, "session_date")
    day_first = Window.partitionBy(*keys, "session_date").orderBy("bar_index")
    net = F.col("net_return")
    df = trades.withColumns(
        {"__cum": F.sum(net).over(run), "__day": F.sum(net).over(day), "__first": F.row_number().over(day_first) == 1}
    )
    df = df.withColumn("__peak", F.greatest(F.lit(0.0), F.max("__cum").over(run)))
    once = F.when(F.col("__first"), F.col("__day"))
    agg = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trades"),
        F.count_if(net > 0).alias("winning_trades"),
        F.avg(net).alias("average_net_return"),
        F.percentile(net, F.lit(0.5)).alias("median_net_return"),
        F.sum(net).alias("total_net_return"),
        F.sum(F.when(net > 0, net)).alias("__gain"),
        F.sum(F.when(net < 0, net)).alias("__loss"),
        F.least(F.lit(0.0), F.min(F.col("__cum") - F.col("__peak"))).alias("max_drawdown"),
        F.count(once).alias("active_days"),
        F.count_if(once > 0).alias("profitable_days"),
        F.sum(F.abs(once)).alias("__abs"),
        F.max(F.abs(once)).alias("__big"),
        F.avg((F.col("exit_reason") == "target").cast("double")).alias("target_rate"),
        F.avg((F.col("exit_reason") == "stop").cast("double")).alias("stop_rate"),
    )
    pf = (
        F.when(F.col("__loss").isNotNull(), F.coalesce("__gain", F.lit(0.0)) / F.abs("__loss"))
        .when(F.col("__gain").isNotNull(), F.lit(float("inf")))
        .otherwise(0.0)
    )
    return agg.withColumns(
        {
            "win_rate": div("winning_trades", "trades"),
            "win_rate_wilson_lower": wilson_lower("winning_trades", "trades"),
            "profit_factor": pf,
            "profitable_day_rate": div("profitable_days", "active_days"),
            "trades_per_active_day": div("trades", "active_days"),
            "largest_day_abs_pnl_share": F.coalesce(div("__big", "__abs"), F.lit(0.0)),
        }
    ).select(*keys, *METRICS)


def fill_metrics(df: DataFrame, prefix: str = "") -> DataFrame:
    """Zeros where a rule had no trades (after a left join)."""
    return df.fillna(0, subset=[f"{prefix}{m}" for m in METRICS if f"{prefix}{m}" in df.columns])


def prefixed(metrics: DataFrame, prefix: str) -> DataFrame:
    return metrics.select(*[F.col(c).alias(f"{prefix}{c}") if c in METRICS else F.col(c) for c in metrics.columns])


# --- session splits -----------------------------------------------------------------------


def session_ranks(bars: DataFrame) -> DataFrame:
    """``symbol, session_date, rank, sessions``: position of each session of a symbol (one row per day)."""
    days = bars.select(*SESSION).distinct()
    w = Window.partitionBy("symbol")
    return days.withColumns(
        {"rank": F.row_number().over(w.orderBy("session_date")) - 1, "sessions": F.count(F.lit(1)).over(w)}
    )


def train_flag(train_fraction: float = 0.7) -> Column:
    n = F.col("sessions")
    split = F.least(
        F.greatest(F.lit(1).cast("bigint"), F.floor(n * F.lit(train_fraction))), F.greatest(F.lit(1).cast("bigint"), n - 1)
    )
    return F.col("rank") < split


def fold_id(fold_sessions: int = 12, least: int = 6) -> Column:
    """Walk-forward fold of a session; null in the initial training span and in a short last fold."""
    n = F.col("sessions")
    first = F.least(F.lit(35).cast("bigint"), F.greatest(F.lit(20).cast("bigint"), F.floor(n / 2)))
    fold = F.floor((F.col("rank") - first) / fold_sessions)
    size = F.least(F.lit(fold_sessions).cast("bigint"), n - (first + fold * fold_sessions))
    return F.when((F.col("rank") >= first) & (size >= least), fold.cast("int"))


def block_id(block_sessions: int, least: int) -> Column:
    """Consecutive session block; null in a last block shorter than ``least``."""
    block = F.floor(F.col("rank") / block_sessions)
    size = F.least(F.lit(block_sessions).cast("bigint"), F.col("sessions") - block * block_sessions)
    return F.when(size >= least, block.cast("int"))
