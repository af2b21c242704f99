"""Turning zones: candidates, merging, expansion, bar labels and the features that precede them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import div, or_default
from tidemark.operators.features import MINING_FEATURES, SESSION, session_window
from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import materialise


def turn_candidates(bars: DataFrame, window_bars: int = 5, prominence_atr: float = 2.0, tolerance_atr: float = 0.18) -> DataFrame:
    """Bars at the extreme of a centred window that stand out on both sides; bars that are both drop out."""
    w, n = session_window(), window_bars
    around, left, right = w.rowsBetween(-n, n), w.rowsBetween(-n, -1), w.rowsBetween(1, n)
    atr = or_default("atr14", F.greatest(F.col("close") * 0.001, F.col("high") - F.col("low")))
    df = bars.withColumns(
        {
            "atr": atr,
            "__n": F.count(F.lit(1)).over(Window.partitionBy(*SESSION)),
            "__top": F.max("high").over(around),
            "__floor": F.min("low").over(around),
            "__up": F.least(F.col("high") - F.min("low").over(left), F.col("high") - F.min("low").over(right)),
            "__down": F.least(F.max("high").over(left) - F.col("low"), F.max("high").over(right) - F.col("low")),
        }
    ).filter((F.col("bar_index") >= n) & (F.col("bar_index") < F.col("__n") - n))
    tol = F.greatest(F.col("atr") * tolerance_atr, F.col("close") * 0.0001)
    up, down = div("__up", "atr"), div("__down", "atr")
    peak = (F.col("high") >= F.col("__top") - tol) & (up >= prominence_atr)
    trough = (F.col("low") <= F.col("__floor") + tol) & (down >= prominence_atr)
    peak, trough = F.coalesce(peak, F.lit(False)), F.coalesce(trough, F.lit(False))
    return df.filter(peak != trough).select(
        *SESSION,
        "bar_index",
        F.when(peak, "peak").otherwise("trough").alias("kind"),
        F.when(peak, F.col("high")).otherwise(F.col("low")).alias("price"),
        "atr",
        F.when(peak, up).otherwise(down).alias("strength"),
    )


def merge_candidates(candidates: DataFrame, merge_gap_bars: int = 2, tolerance_atr: float = 0.18) -> DataFrame:
    """Runs of near candidates of one kind and price become zones, numbered per session."""
    w = session_window()
    prev = F.lag(F.struct("kind", "bar_index", "price", "atr")).over(w)
    df = candidates.withColumn("__p", prev)
    same = (
        (F.col("kind") == F.col("__p.kind"))
        & (F.col("bar_index") - F.col("__p.bar_index") <= merge_gap_bars + 1)
        & (F.abs(F.col("price") - F.col("__p.price")) <= F.greatest(F.col("__p.atr"), F.col("atr")) * tolerance_atr)
    )
    df = df.withColumn("__new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    df = df.withColumn("sequence", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    # a peak is represented by its highest bar, a trough by its lowest, the first one on ties
    signed = F.when(F.col("kind") == "peak", -F.col("price")).otherwise(F.col("price"))
    return (
        df.groupBy(*SESSION, "sequence", "kind")
        .agg(
            F.min("bar_index").alias("start_index"),
            F.max("bar_index").alias("end_index"),
            F.min(F.struct(signed.alias("s"), "bar_index", "price")).alias("__rep"),
            F.max("strength").alias("strength"),
        )
        .select(
            *SESSION,
            "sequence",
            "kind",
            "start_index",
            "end_index",
            F.col("__rep.bar_index").alias("representative_index"),
            F.col("__rep.price").alias("price"),
            "strength",
        )
    )


def expand_zones(zones: DataFrame, bars: DataFrame, tolerance_atr: float = 0.18) -> DataFrame:
    """Grow each zone over adjacent bars whose price stays within tolerance of its representative.

    The session's bars travel as one short array, so no zone-by-bar rows are produced.
    """
    path = bars.groupBy(*SESSION).agg(
        F.collect_list(F.struct(F.col("bar_index").alias("i"), F.col("high").alias("h"), F.col("low").alias("l"), F.col("atr14").alias("a"))).alias("__bars"),
        F.max("bar_index").alias("__last"),
    )
    df = zones.join(path, list(SESSION))
    rep_atr = F.get(F.filter("__bars", lambda b: b["i"] == F.col("representative_index")), 0)["a"]
    df = df.withColumn("__tol", F.greatest(F.coalesce(rep_atr, F.lit(0.0)) * tolerance_atr, F.abs("price") * 0.0001))

    def outside(b: Column) -> Column:
        p = F.when(F.col("kind") == "peak", b["h"]).otherwise(b["l"])
        return p.isNull() | (F.abs(p - F.col("price")) > F.col("__tol"))

    left = F.array_max(F.transform(F.filter("__bars", lambda b: (b["i"] < F.col("start_index")) & outside(b)), lambda b: b["i"]))
    right = F.array_min(F.transform(F.filter("__bars", lambda b: (b["i"] > F.col("end_index")) & outside(b)), lambda b: b["i"]))
    df = df.withColumns(
        {"start_index": F.coalesce(left + 1, F.lit(0)), "end_index": F.coalesce(right - 1, F.col("__last"))}
    )
    return df.withColumns(
        {
            "duration_bars": F.col("end_index") - F.col("start_index") + 1,
            "zone_id": F.concat_ws("-", F.col("session_date").cast("string"), "kind", F.col("sequence").cast("string")),
        }
    ).drop("__bars", "__last", "__tol")


def turning_zones(bars: DataFrame, window_bars: int = 5, prominence_atr: float = 2.0, tolerance_atr: float = 0.18, merge_gap_bars: int = 2) -> DataFrame:
    merged = merge_candidates(turn_candidates(bars, window_bars, prominence_atr, tolerance_atr), merge_gap_bars, tolerance_atr)
    return expand_zones(merged, bars, tolerance_atr)


def label_bars(bars: DataFrame, zones: DataFrame) -> DataFrame:
    """Zone and pivot labels on bars; where zones overlap the later one wins."""
    per = zones.groupBy(*SESSION).agg(
        F.array_sort(
            F.collect_list(F.struct((-F.col("sequence")).alias("k"), "kind", "zone_id", "start_index", "end_index", "representative_index", "strength"))
        ).alias("__z")
    )
    df = bars.join(per, list(SESSION), "left")
    i = F.col("bar_index")
    zone = F.get(F.filter("__z", lambda z: i.between(z["start_index"], z["end_index"])), 0)
    pivot = F.get(F.filter("__z", lambda z: z["representative_index"] == i), 0)
    return df.withColumns({"__zone": zone, "__pivot": pivot}).select(
        *bars.columns,
        F.coalesce("__zone.kind", F.lit("none")).alias("turn_zone"),
        F.col("__zone.zone_id").alias("turn_zone_id"),
        F.col("__zone.start_index").alias("turn_zone_start"),
        F.col("__zone.end_index").alias("turn_zone_end"),
        F.coalesce("__pivot.kind", F.lit("none")).alias("pivot_label"),
        F.col("__pivot.strength").alias("pivot_strength"),
    )


def label_turning_zones(bars: DataFrame, **params) -> DataFrame:
    return label_bars(bars, turning_zones(bars, **params))


def event_differences(labelled: DataFrame, event: str, features=None, lead_bars: int = 1) -> DataFrame:
    """Medians of each feature ``lead_bars`` before the pivots against all bars, per symbol."""
    features = list(features or MINING_FEATURES)
    w = session_window()
    lead = max(0, int(lead_bars))
    pairs = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.col(f).alias("value"), F.lag(f, lead).over(w).alias("before")) for f in features]
    )
    long = labelled.select("symbol", (F.col("pivot_label") == event).alias("hit"), pairs.alias("p")).select("symbol", "hit", F.explode("p").alias("p"))
    before = F.when(F.col("hit"), F.col("p.before"))
    long = materialise(long.select("symbol", F.col("p.feature").alias("feature"), F.col("p.value").alias("value"), before.alias("before")), "event-values")
    spread = long.groupBy("symbol", "feature").agg(F.stddev_samp("value").alias("__sd"))
    both = long.select("symbol", "feature", F.explode(F.array(F.struct(F.lit("event").alias("kind"), F.col("before").alias("v")), F.struct(F.lit("base").alias("kind"), F.col("value").alias("v")))).alias("x"))
    medians = exact_quantiles(both.select("symbol", "feature", "x.kind", "x.v"), ["symbol", "feature", "kind"], [0.5]).withColumn("m", F.col("q")[0])

    def of(kind: str, column: str):
        return F.max(F.when(F.col("kind") == kind, F.col(column)))

    stats = medians.groupBy("symbol", "feature").agg(of("event", "total").alias("event_count"), of("base", "total").alias("__base"), of("event", "m").alias("event_median"), of("base", "m").alias("baseline_median"))
    stats = stats.join(spread, ["symbol", "feature"])
    gap = F.coalesce(div(F.col("event_median") - F.col("baseline_median"), "__sd"), F.lit(0.0))
    return (
        stats.filter((F.col("event_count") >= 5) & (F.col("__base") >= 20))
        .withColumn("standardized_difference", gap)
        .select("symbol", "feature", "event_count", "event_median", "baseline_median", "standardized_difference")
    )
