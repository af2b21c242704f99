"""Causal bar features per session, and the latest-bar indicator panel.

Everything per session shares one exchange on ``(symbol, session_date)`` and one sort; the
cross-session volume medians use a second one on ``(symbol, bar_index)`` over narrow rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import div, pct_diff
from tidemark.functions.smoothing import ewm_columns, ewm_dense, rsi_from
from tidemark.operators import panel

SESSION = ("symbol", "session_date")

# The features offered to rule mining.
MINING_FEATURES = [
    "rsi6",
    "rsi14",
    "kdj_k",
    "kdj_j",
    "bb_percent_b",
    "bb_z",
    "vwap_dev",
    "ret_1bar",
    "ret_3bar",
    "ret_5bar",
    "ema9_ema21_spread_pct",
    "ema9_slope_3bar",
    "macd_hist",
    "macd_hist_delta_1",
    "atr14_pct",
    "volume_ratio_20",
    "volume_z_20",
    "relative_volume_time_20",
    "opening_relative_volume_15",
    "gap_pct",
    "range_pos_10",
    "lower_wick_ratio",
    "upper_wick_ratio",
]


def session_window():
    return Window.partitionBy(*SESSION).orderBy("bar_index")


def last_n(n: int, w=None):
    return (w or session_window()).rowsBetween(-(n - 1), 0)


def running(w=None):
    return (w or session_window()).rowsBetween(Window.unboundedPreceding, 0)


def full(n: int, x: Column | str, agg, w=None) -> Column:
    """Rolling aggregate that is null until n non-null values are in the frame."""
    frame = last_n(n, w)
    return F.when(F.count(x).over(frame) == n, agg(x).over(frame))


# Each feature group is a list of layers. A layer is a dict of columns that may use the layers
# before it, so groups can be merged layer by layer: all windows of a layer share one sort and
# one window operator. Names that start with "__" are dropped at the end.
Layers = list[dict[str, Column]]


def with_layers(df: DataFrame, *groups: Layers) -> DataFrame:
    for depth in range(max(len(g) for g in groups)):
        merged: dict[str, Column] = {}
        for g in groups:
            if depth < len(g):
                merged |= g[depth]
        if merged:
            df = df.withColumns(merged)
    return df.drop(*[c for c in df.columns if c.startswith("__")])


def candle_layers() -> Layers:
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return [
        {
            "body_pct": div(c - o, o),
            "range_pct": div(h - l, c),
            "upper_wick_ratio": div(h - F.greatest(o, c), h - l),
            "lower_wick_ratio": div(F.least(o, c) - l, h - l),
        }
    ]


def vwap_layers() -> Layers:
    h, l, c, v = (F.col(x) for x in ("high", "low", "close", "volume"))
    value = F.when(F.col("turnover") > 0, F.col("turnover")).otherwise((h + l + c) / 3 * v)
    return [{"vwap": div(F.sum(value).over(running()), F.sum(v).over(running()))}, {"vwap_dev": pct_diff("close", "vwap")}]


def return_layers(lags=(1, 2, 3, 5, 10)) -> Layers:
    w = session_window()
    return [{f"ret_{k}bar": pct_diff(F.col("close"), F.lag("close", k).over(w)) for k in lags}]


def sma_layers(periods=(5, 10, 20, 50)) -> Layers:
    return [
        {f"sma{n}": full(n, "close", F.avg) for n in periods},
        {f"close_sma{n}_pct": pct_diff("close", f"sma{n}") for n in periods},
    ]


def ema_layers() -> Layers:
    pos, run, w = F.col("bar_index"), running(), session_window()
    return [
        {f"ema{n}": ewm_dense(F.col("close"), 2 / (n + 1), run, pos) for n in (5, 9, 21, 50)},
        {
            "ema9_ema21_spread_pct": pct_diff("ema9", "ema21"),
            "ema21_ema50_spread_pct": pct_diff("ema21", "ema50"),
            "ema9_slope_3bar": pct_diff(F.col("ema9"), F.lag("ema9", 3).over(w)),
            "ema21_slope_3bar": pct_diff(F.col("ema21"), F.lag("ema21", 3).over(w)),
        },
    ]


def rsi_layers(periods=(6, 14)) -> Layers:
    pos, run, w = F.col("bar_index"), running(), session_window()
    smooth = {
        f"__{side}{n}": ewm_dense(F.greatest(F.col("__delta") * sign, F.lit(0.0)), 1 / n, run, pos, start=1)
        for n in periods
        for side, sign in (("gain", 1.0), ("loss", -1.0))
    }
    return [
        {"__delta": F.col("close") - F.lag("close").over(w)},
        smooth,
        {f"rsi{n}": rsi_from(F.col(f"__gain{n}"), F.col(f"__loss{n}")) for n in periods},
    ]


def kdj_layers() -> Layers:
    """Unseeded KDJ(9): a flat range has no RSV, and the smoother bridges the gap.

    K keeps the decay of old weight over missing rows (see :func:`ewm_columns`); K itself has no
    gaps after its first value, so D is the plain smoother started there.
    """
    alpha = 1 / 3
    w, run, i = session_window(), running(), F.col("bar_index")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rsv, prev = F.col("__rsv"), F.col("__prev")
    old = F.pow(F.lit(1 - alpha), (i - prev).cast("double"))
    share = F.when(prev.isNull(), 1.0).otherwise(1.0 - F.col("__keep"))
    step = (i - F.col("__first")).cast("double")
    weight = F.when(step == 0, 1.0).otherwise(alpha) * F.pow(F.lit(1 - alpha), -step)
    return [
        {"__lo9": full(9, "low", F.min), "__hi9": full(9, "high", F.max)},
        {"__rsv": div(F.col("close") - F.col("__lo9"), F.col("__hi9") - F.col("__lo9")) * 100},
        {
            "__prev": F.last(F.when(rsv.isNotNull(), i), True).over(before),
            "__first": F.min(F.when(rsv.isNotNull(), i)).over(run),
        },
        {"__keep": F.when(rsv.isNotNull(), F.when(prev.isNull(), 1.0).otherwise(old / (old + alpha)))},
        {"__log": F.sum(F.log("__keep")).over(run)},
        {"kdj_k": F.exp("__log") * F.sum(share * rsv * F.exp(-F.col("__log"))).over(run)},
        {"kdj_d": F.pow(F.lit(1 - alpha), step) * F.sum(F.col("kdj_k") * weight).over(run)},
        {"kdj_j": 3 * F.col("kdj_k") - 2 * F.col("kdj_d")},
    ]


def macd_layers() -> Layers:
    pos, run, w = F.col("bar_index"), running(), session_window()
    fast, slow = (ewm_dense(F.col("close"), 2 / (n + 1), run, pos) for n in (12, 26))
    return [
        {"macd_dif": fast - slow},
        {"macd_dea": ewm_dense(F.col("macd_dif"), 2 / 10, run, pos)},
        {"macd_hist": F.col("macd_dif") - F.col("macd_dea")},
        {f"macd_hist_delta_{k}": F.col("macd_hist") - F.lag("macd_hist", k).over(w) for k in (1, 3)},
    ]


def bollinger_layers() -> Layers:
    mid, sd = F.col("bb_mid20"), F.col("__bbsd")
    return [
        {"bb_mid20": full(20, "close", F.avg), "__bbsd": full(20, "close", F.stddev_samp)},
        {
            "bb_upper20": mid + 2 * sd,
            "bb_lower20": mid - 2 * sd,
            "bb_z": div(F.col("close") - mid, sd),
            "bb_percent_b": div(F.col("close") - (mid - 2 * sd), (mid + 2 * sd) - (mid - 2 * sd)),
        },
    ]


def simple_rsi(df: DataFrame, period: int, keys, order: str, out: str = "rsi", price: str = "close") -> DataFrame:
    """RSI from plain means of the last ``period`` moves; null until they exist, two decimals."""
    w = Window.partitionBy(*keys).orderBy(order)
    frame = last_n(period, w)
    df = df.withColumn("__d", F.col(price) - F.lag(price).over(w))
    gain = F.avg(F.greatest(F.col("__d"), F.lit(0.0))).over(frame)
    loss = F.avg(F.greatest(-F.col("__d"), F.lit(0.0))).over(frame)
    value = F.when(F.count("__d").over(frame) == period, F.bround(rsi_from(gain, loss), 2))
    return df.withColumn(out, value).drop("__d")


def seeded_kdj(df: DataFrame, keys, order: str, period: int = 9, in_blocks: bool = True) -> DataFrame:
    """KDJ with K = D = 50 before the first full window; RSV is 50 on a flat range."""
    w = Window.partitionBy(*keys).orderBy(order)
    df = df.withColumns({"__lo": F.min("low").over(last_n(period, w)), "__hi": F.max("high").over(last_n(period, w)), "__n": F.row_number().over(w)})
    rsv = F.when(F.col("__hi") <= F.col("__lo"), F.lit(50.0)).otherwise(
        div(F.col("close") - F.col("__lo"), F.col("__hi") - F.col("__lo")) * 100
    )
    df = df.withColumn("__rsv", F.when(F.col("__n") >= period, rsv))
    df = ewm_columns(df, {"kdj_k": ("__rsv", 1 / 3)}, keys, order, seed=50.0, in_blocks=in_blocks)
    df = ewm_columns(df, {"kdj_d": ("kdj_k", 1 / 3)}, keys, order, seed=50.0, in_blocks=in_blocks)
    return df.withColumn("kdj_j", 3 * F.col("kdj_k") - 2 * F.col("kdj_d")).drop("__lo", "__hi", "__rsv", "__n")


def true_range(w) -> Column:
    prev = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr_layers() -> Layers:
    return [
        {"true_range": true_range(session_window())},
        {"atr14": full(14, "true_range", F.avg)},
        {"atr14_pct": div("atr14", "close")},
    ]


def volume_layers() -> Layers:
    """Realised volatility, volume ratio and z-score, on-balance volume and range position; uses ``ret_1bar``."""
    w = session_window()
    step = F.coalesce(F.signum(F.col("close") - F.lag("close").over(w)), F.lit(0.0))
    return [
        {
            "volume_avg20": full(20, "volume", F.avg),
            "__vsd": full(20, "volume", F.stddev_samp),
            "__signed": step * F.col("volume"),
            "__lo10": full(10, "low", F.min),
            "__hi10": full(10, "high", F.max),
        },
        {
            "realized_vol_10": full(10, "ret_1bar", F.stddev_samp),
            "realized_vol_20": full(20, "ret_1bar", F.stddev_samp),
            "volume_ratio_20": div("volume", "volume_avg20"),
            "volume_z_20": div(F.col("volume") - F.col("volume_avg20"), "__vsd"),
            "obv": F.sum("__signed").over(running()),
            "range_pos_10": div(F.col("close") - F.col("__lo10"), F.col("__hi10") - F.col("__lo10")),
        },
        {"obv_slope_5": div(F.col("obv") - F.lag("obv", 5).over(w), "volume_avg20")},
    ]


def opening_layers(bars: int = 5) -> Layers:
    """High and low of the first bars, written on every bar of the session, with distances."""
    day = Window.partitionBy(*SESSION)
    first = F.col("bar_index") < bars
    return [
        {"or15_high": F.max(F.when(first, F.col("high"))).over(day), "or15_low": F.min(F.when(first, F.col("low"))).over(day)},
        {"dist_or_high": pct_diff("close", "or15_high"), "dist_or_low": pct_diff("close", "or15_low")},
    ]


def extreme_layers() -> Layers:
    return [
        {"day_high_so_far": F.max("high").over(running()), "day_low_so_far": F.min("low").over(running())},
        {"dist_day_high": pct_diff("close", "day_high_so_far"), "dist_day_low": pct_diff("close", "day_low_so_far")},
    ]


def clock_layers(session_length: int = 390) -> Layers:
    angle = F.lit(2 * math.pi / session_length) * F.col("session_minute")
    return [{"time_sin": F.sin(angle), "time_cos": F.cos(angle)}]


def candle_geometry(df: DataFrame) -> DataFrame:
    """Body, range and wick shares of each bar."""
    return with_layers(df, candle_layers())


def session_vwap(df: DataFrame) -> DataFrame:
    """Running volume-weighted price of the session and the close's distance from it."""
    return with_layers(df, vwap_layers())


def bar_returns(df: DataFrame) -> DataFrame:
    """Returns over 1, 2, 3, 5 and 10 bars."""
    return with_layers(df, return_layers())


def moving_averages(df: DataFrame) -> DataFrame:
    """SMA 5/10/20/50 and the close's distance from them."""
    return with_layers(df, sma_layers())


def exponential_averages(df: DataFrame) -> DataFrame:
    """EMA 5/9/21/50, their spreads and three-bar slopes."""
    return with_layers(df, ema_layers())


def wilder_rsi(df: DataFrame) -> DataFrame:
    """RSI 6 and 14 from smoothed gains and losses."""
    return with_layers(df, rsi_layers())


def kdj(df: DataFrame) -> DataFrame:
    """Unseeded K, D and J."""
    return with_layers(df, kdj_layers())


def macd(df: DataFrame) -> DataFrame:
    """MACD 12/26/9 with one- and three-bar changes of the histogram."""
    return with_layers(df, macd_layers())


def bollinger(df: DataFrame) -> DataFrame:
    """Bollinger bands (20, 2) with z-score and percent-b."""
    return with_layers(df, bollinger_layers())


def average_true_range(df: DataFrame) -> DataFrame:
    """True range, ATR 14 and its share of the close."""
    return with_layers(df, atr_layers())


def volume_and_volatility(df: DataFrame) -> DataFrame:
    """See :func:`volume_layers`."""
    return with_layers(df, volume_layers())


def opening_range(df: DataFrame) -> DataFrame:
    """See :func:`opening_layers`."""
    return with_layers(df, opening_layers())


def session_extremes(df: DataFrame) -> DataFrame:
    """High and low of the session so far, and the distances from them."""
    return with_layers(df, extreme_layers())


def time_of_day(df: DataFrame, session_length: int = 390) -> DataFrame:
    """Sine and cosine of the minute of the session."""
    return with_layers(df, clock_layers(session_length))


def session_summary(bars: DataFrame) -> DataFrame:
    """One row per session: open, close, extremes and the volume of the first five bars."""
    return bars.groupBy(*SESSION).agg(
        F.min_by("open", "bar_index").alias("session_open"),
        F.max_by("close", "bar_index").alias("session_close"),
        F.max("high").alias("session_high"),
        F.min("low").alias("session_low"),
        F.sum(F.when(F.col("bar_index") < 5, F.col("volume"))).alias("opening_volume"),
    )


def prior_median(volume: str, w) -> Column:
    """Median of up to 20 earlier rows, null below five."""
    frame = w.rowsBetween(-20, -1)
    return F.when(F.count(volume).over(frame) >= 5, F.percentile(volume, F.lit(0.5)).over(frame))


def cross_session_daily(bars: DataFrame) -> DataFrame:
    """Per-session values that look at earlier sessions (a few hundred rows per symbol and year)."""
    w = Window.partitionBy("symbol").orderBy("session_date")
    prior = {c: F.lag(c).over(w) for c in ("session_close", "session_high", "session_low")}
    days = session_summary(bars).withColumns(
        {
            "prior_close": prior["session_close"],
            "prior_session_range_pct": div(prior["session_high"] - prior["session_low"], prior["session_close"]),
            "opening_relative_volume_15": div("opening_volume", prior_median("opening_volume", w)),
        }
    )
    return days.withColumn("gap_pct", pct_diff("session_open", "prior_close")).select(
        *SESSION, "prior_close", "prior_session_range_pct", "gap_pct", "opening_relative_volume_15"
    )


def same_time_volume(bars: DataFrame) -> DataFrame:
    """Volume against the median of the prior 20 sessions at the same bar."""
    w = Window.partitionBy("symbol", "bar_index").orderBy("session_date")
    return bars.withColumn("relative_volume_time_20", div("volume", prior_median("volume", w)))


def add_cross_session(bars: DataFrame) -> DataFrame:
    return same_time_volume(bars).join(cross_session_daily(bars), list(SESSION), "left")


def feature_matrix(bars: DataFrame, session_length: int = 390) -> DataFrame:
    """All features of a resampled bar table in as many window passes as the deepest group has layers."""
    groups = [
        candle_layers(), vwap_layers(), return_layers(), sma_layers(), ema_layers(), rsi_layers(), kdj_layers(), macd_layers(),
        bollinger_layers(), atr_layers(), volume_layers(), opening_layers(), extreme_layers(), clock_layers(session_length),
    ]
    return with_layers(add_cross_session(bars), *groups)


# --- latest-bar panel -----------------------------------------------------------------


def attach_vwap(points: DataFrame) -> DataFrame:
    """Session VWAP of minute points; rows without volume keep the running value. Six decimals."""
    w = Window.partitionBy("symbol", "session_date").orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    used = F.col("volume") > 0
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    value = F.when(F.col("turnover") > 0, F.col("turnover")).otherwise(typical * F.col("volume"))
    ratio = div(F.sum(F.when(used, value)).over(w), F.sum(F.when(used, F.col("volume"))).over(w))
    return points.withColumn("vwap", F.when(used, F.bround(ratio, 6)).otherwise(ratio))


def volume_profile(df: DataFrame, w) -> DataFrame:
    """Volume against the mean and deviation of the 20 earlier rows, with a state label."""
    frame = w.rowsBetween(-20, -1)
    earlier = F.when(F.col("volume") >= 0, F.col("volume"))
    df = df.withColumns({"__avg": F.avg(earlier).over(frame), "__sd": F.stddev_samp(earlier).over(frame)})
    df = df.withColumns(
        {
            "__ratio": F.when(F.col("__avg") > 0, div("volume", "__avg")),
            "volume_z": F.bround(div(F.col("volume") - F.col("__avg"), "__sd"), 2),
        }
    )
    state = (
        F.when(F.col("__ratio").isNull(), "unknown").when(F.col("__ratio") >= 2.0, "spike").when(F.col("__ratio") <= 0.5, "dry").otherwise("normal")
    )
    return df.withColumns(
        {"volume_avg20": F.bround("__avg", 2), "volume_ratio": F.bround("__ratio", 2), "volume_state": state}
    ).drop("__avg", "__sd", "__ratio")


def panel_columns(points: DataFrame, opening_rows: int = 15, dense: bool = False) -> DataFrame:
    """Every panel indicator on every minute point of ``symbol, ts, OHLCV, turnover``.

    Series run across sessions per symbol, except VWAP and the opening range. ``dense`` marks
    short inputs (a polled tail), where smoothing needs no block restart. Whoever needs the latest point only takes ``latest_panel``,
    which never brings a symbol's minutes together.
    """
    keys, w = ("symbol",), Window.partitionBy("symbol").orderBy("ts")
    day = Window.partitionBy("symbol", "session_date").orderBy("ts")
    whole_day = Window.partitionBy("symbol", "session_date")
    df = attach_vwap(points.withColumn("session_date", F.to_date("ts")))
    df = simple_rsi(df, 14, keys, "ts", out="rsi14")
    df = seeded_kdj(df, keys, "ts", in_blocks=not dense)
    df = ewm_columns(df, {"ema9": ("close", 2 / 10), "ema21": ("close", 2 / 22)}, keys, "ts", in_blocks=not dense)
    df = df.withColumns(
        {
            "__n": F.row_number().over(w),
            "__dn": F.row_number().over(day),
            "__rows": F.count(F.lit(1)).over(day.rowsBetween(Window.unboundedPreceding, 0)),
            "__tr": true_range(w),
        }
    )
    df = volume_profile(df, w)
    opening = F.col("__dn") <= opening_rows
    df = df.withColumns(
        {
            "return_1m": F.bround(pct_diff(F.col("close"), F.lag("close", 1).over(w)), 6),
            "return_5m": F.bround(pct_diff(F.col("close"), F.lag("close", 5).over(w)), 6),
            "return_15m": F.bround(pct_diff(F.col("close"), F.lag("close", 15).over(w)), 6),
            "vwap_deviation": F.bround(pct_diff("close", "vwap"), 6),
            "slope9": F.bround(pct_diff(F.col("ema9"), F.lag("ema9", 5).over(w)), 6),
            "ema_spread": F.bround(pct_diff("ema9", "ema21"), 6),
            "atr": F.when(F.col("__n") >= 2, F.avg("__tr").over(last_n(14, w))),
            "recent_low": F.min("low").over(last_n(5, w)),
            "or_high": F.max(F.when(opening, F.col("high"))).over(whole_day),
            "or_low": F.min(F.when(opening, F.col("low"))).over(whole_day),
            "or_forming": F.col("__dn") < max(2, opening_rows),
        }
    )
    short = F.col("__n") < 9
    df = df.withColumns({k: F.when(~short, F.bround(k, 2)) for k in ("kdj_k", "kdj_d", "kdj_j")})
    df = df.withColumns({"atr_pct": div("atr", "close")})
    slope = F.coalesce("slope9", F.lit(0.0))
    df = df.withColumns(
        {
            "ema_state": F.when((F.col("ema9") > F.col("ema21")) & (slope > 0), "bullish")
            .when((F.col("ema9") < F.col("ema21")) & (slope < 0), "bearish")
            .otherwise("mixed"),
            "or_state": F.when(F.col("or_forming"), "forming")
            .when(F.col("close") > F.col("or_high"), "above")
            .when(F.col("close") < F.col("or_low"), "below")
            .otherwise("inside"),
            "atr_state": F.when(F.col("atr_pct").isNull(), "unknown")
            .when(F.col("atr_pct") < 0.001, "compressed")
            .when(F.col("atr_pct") > 0.006, "wide")
            .otherwise("tradable"),
        }
    )
    return df.drop("__n", "__dn", "__rows", "__tr", "or_forming")


def rule_checks(df: DataFrame) -> DataFrame:
    """Six checks with status and score, their sum, the bias level, label and tags."""
    c, v, low = F.col("close"), F.col("vwap"), F.col("recent_low")
    rsi, k, d, j = F.col("rsi14"), F.col("kdj_k"), F.col("kdj_d"), F.col("kdj_j")
    ratio, z = F.col("volume_ratio"), F.col("volume_z")
    known = v.isNotNull() & low.isNotNull()
    hold = F.coalesce((c > v) & (low >= v * 0.997), F.lit(False))
    lost = F.coalesce((c < v) & (low < v), F.lit(False))
    confirmed = F.coalesce(ratio >= 1.3, F.lit(False)) | F.coalesce(z >= 1.0, F.lit(False))
    dry = F.coalesce(ratio <= 0.55, F.lit(False))
    hot = F.coalesce(rsi >= 72, F.lit(False)) | F.coalesce((k >= 82) & (j >= 95), F.lit(False))
    cold = F.coalesce(rsi <= 28, F.lit(False)) | F.coalesce((k <= 18) & (j <= 8), F.lit(False))
    ema, rng, atr = F.col("ema_state"), F.col("or_state"), F.col("atr_state")

    def check(name: str, *cases, default):
        status = score = None
        for cond, (s, p) in cases:
            status = F.when(cond, s) if status is None else status.when(cond, s)
            score = F.when(cond, p) if score is None else score.when(cond, p)
        return F.struct(
            F.lit(name).alias("id"), status.otherwise(default[0]).alias("status"), score.otherwise(default[1]).alias("score")
        )

    rules = F.array(
        check("vwap_hold", (~known, ("pending", 0)), (hold, ("pass", 2)), (lost, ("fail", -2)), default=("watch", 0)),
        check("ema_stack", (ema == "bullish", ("pass", 2)), (ema == "bearish", ("fail", -2)), default=("watch", 0)),
        check(
            "opening_range",
            (rng == "above", ("pass", 1)),
            (rng == "below", ("fail", -1)),
            (rng == "inside", ("watch", 0)),
            default=("pending", 0),
        ),
        check("volume_confirm", (confirmed, ("pass", 1)), (dry, ("fail", -1)), default=("watch", 0)),
        check("momentum_extreme", (hot, ("warn", -1)), (cold, ("watch", 1)), default=("pass", 0)),
        check("atr_space", (atr == "compressed", ("watch", -1)), (atr == "wide", ("watch", 0)), default=("pass", 0)),
    )
    over = F.coalesce(rsi >= 70, F.lit(False)) | F.coalesce((k >= 80) & (d >= 75) & (j >= 90), F.lit(False))
    under = F.coalesce(rsi <= 30, F.lit(False)) | F.coalesce((k <= 20) & (d <= 25) & (j <= 10), F.lit(False))
    spike = F.col("volume_state") == "spike"
    df = df.withColumn("rules", rules)
    df = df.withColumn("bias_score", F.aggregate("rules", F.lit(0), lambda acc, r: acc + r["score"]))
    s = F.col("bias_score")
    tags = F.array(
        F.when(over, "overbought"),
        F.when(under, "oversold"),
        F.when(spike, "volume_spike").when(F.col("volume_state") == "dry", "low_volume"),
    )
    return df.withColumns(
        {
            "bias": F.when(s >= 4, "strong_long_bias")
            .when(s >= 2, "long_bias")
            .when(s <= -4, "strong_short_bias")
            .when(s <= -2, "short_bias")
            .otherwise("neutral"),
            "label": F.when(over & spike, "overbought_volume")
            .when(under & spike, "oversold_reversal_watch")
            .when(over, "overbought")
            .when(under, "oversold")
            .when(spike, "volume_spike")
            .otherwise("neutral"),
            "tags": F.filter(tags, lambda t: t.isNotNull()),
        }
    )


def latest_panel(points: DataFrame, opening_rows: int = 15) -> DataFrame:
    """Indicator panel and checks of the latest point of each symbol, from summaries of its sessions."""
    return rule_checks(panel.latest_panel(points, opening_rows))
