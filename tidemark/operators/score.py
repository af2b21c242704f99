"""Composite score: latest metric per key, eight components, penalties, grade."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.numeric import div, round_even
from tidemark.operators.rank import latest_items

# Points taken off per missing dimension.
PENALTIES = {
    "market_cap": 5,
    "pe_ttm": 3,
    "quarterly_revenue_yoy": 6,
    "financial_quality": 4,
    "backlog_or_rpo": 8,
    "insider_ownership": 3,
    "institutional_holder_signal": 2,
}
COMPONENTS = (
    "eligibility", "valuation", "growth_quality", "order_quality", "ownership_alignment", "financial_quality", "attention_flow", "information_quality",
)


def latest_metrics(items: DataFrame) -> DataFrame:
    """Newest value of every evidence key per ticker; a newer null hides an older value.

    ``items``: ``ticker, created_at, place, evidence MAP``. Entries are reduced per key before
    the map is rebuilt, so the map is as small as the number of keys.
    """
    entries = items.select("ticker", "created_at", "place", F.explode("evidence").alias("k", "v"))
    newest = entries.groupBy("ticker", "k").agg(F.max_by("v", F.struct("created_at", (-F.col("place")).alias("p"))).alias("v"))
    pair = F.when(F.col("v").isNotNull(), F.struct("k", "v"))
    return newest.groupBy("ticker").agg(F.map_from_entries(F.collect_list(pair)).alias("metrics"))


def raw(key: str) -> Column:
    return F.try_element_at(F.col("metrics"), F.lit(key))


def num(key: str) -> Column:
    return raw(key).try_cast("double")


def first_truthy(a: str, b: str) -> Column:
    """Value of ``a`` unless missing or 0, else of ``b``."""
    return F.coalesce(F.nullif(num(a), F.lit(0.0)), num(b))


def ladder(x: Column, *steps: tuple[float, float], default: float = 0.0) -> Column:
    """Points of the first ``x >= bound`` step; the default applies to any other known value."""
    out = None
    for bound, points in steps:
        out = F.when(x >= bound, float(points)) if out is None else out.when(x >= bound, float(points))
    return F.when(x.isNotNull(), out.otherwise(float(default))).otherwise(0.0)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), x))


def eligibility() -> Column:
    cap = num("market_cap")
    return (
        F.when(cap.isNull(), 0.0).when(cap.between(5e8, 4e9), 14.0).when((cap >= 3e8) & (cap < 5e8), 9.0).when((cap > 4e9) & (cap <= 8e9), 7.0)
        .when((cap > 8e9) & (cap <= 1.5e10), 3.0).otherwise(1.0)
    )


def valuation() -> Column:
    pe = num("pe_ttm")
    return F.when((pe > 0) & (pe <= 20), 12.0).when((pe > 20) & (pe <= 30), 9.0).when((pe > 30) & (pe <= 45), 4.0).otherwise(0.0)


def growth_quality() -> Column:
    yoy, rec, inv = num("quarterly_revenue_yoy"), num("receivables_yoy"), num("inventory_yoy")
    score = ladder(yoy, (0.5, 16), (0.25, 13), (0.1, 7))
    score = score + F.when(yoy.isNotNull() & rec.isNotNull(), F.when(rec <= yoy + 0.15, 3.0).otherwise(-2.0)).otherwise(0.0)
    score = score + F.when(yoy.isNotNull() & inv.isNotNull(), F.when(inv <= yoy + 0.2, 2.0).otherwise(-2.0)).otherwise(0.0)
    return clip(score, 0, 20)


def order_quality() -> Column:
    zero = F.lit(0.0)
    backlog, rpo = F.coalesce(num("backlog_mentions"), zero), F.coalesce(num("rpo_mentions"), zero)
    amount, total, defence = first_truthy("backlog_largest_amount", "largest_amount"), num("government_contract_total_value"), num("government_contract_dod_value")
    cover = div(amount, num("revenue"))
    score = ladder(backlog + rpo, (20, 9), (8, 7), (1, 4)) + F.when(rpo > 0, 3.0).otherwise(0.0)
    score = score + F.when(amount.isNotNull(), 4.0).otherwise(0.0) + ladder(cover, (2, 4), (1, 2))
    score = score + F.when(F.coalesce(num("government_contract_award_count"), zero) >= 1, 2.0).otherwise(0.0)
    score = score + ladder(total, (1e8, 4), (2.5e7, 3), (5e6, 1)) + ladder(defence, (1e7, 1))
    return F.least(F.lit(20.0), score)


def ownership_alignment() -> Column:
    insider = first_truthy("insider_ownership", "proxy_management_ownership")
    holder = first_truthy("large_holder_max_percent", "proxy_top_holder_percent")
    net, managers = num("insider_net_purchase_value"), num("institutional_13f_manager_count")
    score = ladder(insider, (0.05, 6), (0.02, 3), default=1) + ladder(num("institutional_ownership"), (0.65, 4), (0.4, 2)) + ladder(holder, (0.1, 3), (0.05, 2))
    score = score + F.when(net > 0, 3.0).when(net < -2e6, -2.0).otherwise(0.0)
    score = score + F.when(managers.isNotNull(), F.least(F.lit(2.0), managers)).otherwise(0.0)
    return clip(score, 0, 14)


def financial_quality() -> Column:
    net, fcf = num("net_margin"), num("free_cash_flow_margin")
    liabilities, debt = num("liabilities_to_assets"), num("debt_to_assets")
    score = ladder(num("gross_margin"), (0.35, 4), (0.2, 2)) + ladder(num("operating_margin"), (0.15, 4), (0.08, 2))
    score = score + F.when(net >= 0.1, 3.0).when(net > 0, 1.0).when(net.isNotNull(), -2.0).otherwise(0.0)
    score = score + F.when(fcf >= 0.08, 3.0).when(fcf >= 0, 1.0).when(fcf.isNotNull(), -2.0).otherwise(0.0)
    score = score + F.when(liabilities <= 0.55, 2.0).when(liabilities > 0.75, -1.0).otherwise(0.0)
    score = score + F.when(debt <= 0.25, 2.0).when(debt > 0.5, -1.0).otherwise(0.0)
    return clip(score, 0, 16)


def attention_flow() -> Column:
    ratio, flow, ret = num("large_buy_sell_ratio"), num("large_net_flow_20d"), num("return_20d")
    label = F.coalesce(raw("attention_flow_label"), F.lit(""))
    score = F.when(ratio >= 1.8, 4.0).when(ratio >= 1.3, 3.0).when(ratio >= 1.05, 1.0).when(ratio < 0.8, -2.0).otherwise(0.0)
    score = score + F.when(flow > 0, 1.0).when(flow < 0, -1.0).otherwise(0.0)
    pressure = F.coalesce(F.when(ratio.isNotNull(), ratio >= 1.05).otherwise(flow > 0), F.lit(False))
    score = score + (
        F.when(pressure & ret.between(-0.08, 0.12), 3.0).when(pressure & (ret <= 0.20), 1.0).when(ret >= 0.45, -7.0).when(ret >= 0.30, -5.0)
        .when(ret >= 0.20, -3.0).when(ret < -0.20, -1.0).otherwise(0.0)
    )
    score = score + F.when(label == "quiet_accumulation", 1.0).when(label.isin("crowded_momentum", "distribution_risk"), -2.0).otherwise(0.0)
    return F.when(ratio.isNull() & flow.isNull() & ret.isNull(), 0.0).otherwise(clip(score, -8, 8))


def information_quality() -> Column:
    """Reads ``source_count`` and ``top_importance``."""
    return F.least(F.lit(8.0), F.col("source_count") * 1.2) + F.least(F.lit(4.0), F.coalesce("top_importance", F.lit(0.0)) / 25)


def missing_dimensions() -> Column:
    def absent(*keys: str) -> Column:
        out = F.lit(True)
        for k in keys:
            out = out & raw(k).isNull()
        return out

    signal = F.coalesce(F.nullif(num("backlog_mentions"), F.lit(0.0)), F.nullif(num("rpo_mentions"), F.lit(0.0)))
    tests = {
        "market_cap": absent("market_cap"),
        "pe_ttm": absent("pe_ttm"),
        "quarterly_revenue_yoy": absent("quarterly_revenue_yoy"),
        "financial_quality": absent("gross_margin", "operating_margin"),
        "backlog_or_rpo": signal.isNull(),
        "insider_ownership": absent("insider_ownership", "proxy_management_ownership"),
        "institutional_holder_signal": absent("institutional_ownership", "institutional_13f_manager_count", "large_holder_max_percent"),
    }
    return F.filter(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]), lambda m: m.isNotNull())


def penalty(missing: Column) -> Column:
    table = F.create_map(*[x for k, v in PENALTIES.items() for x in (F.lit(k), F.lit(v))])
    return F.aggregate(missing, F.lit(0), lambda acc, m: acc + F.coalesce(F.try_element_at(table, m), F.lit(1)))


def component_scores(metrics: DataFrame) -> DataFrame:
    """Add the eight component columns to ``metrics, source_count, top_importance``."""
    return metrics.withColumns(
        {
            "eligibility": eligibility(),
            "valuation": valuation(),
            "growth_quality": growth_quality(),
            "order_quality": order_quality(),
            "ownership_alignment": ownership_alignment(),
            "financial_quality": financial_quality(),
            "attention_flow": attention_flow(),
            "information_quality": information_quality(),
        }
    )


def item_coverage(items: DataFrame) -> DataFrame:
    return items.groupBy("ticker").agg(
        F.count_distinct(F.nullif("source_key", F.lit(""))).alias("source_count"), F.max("importance_score").alias("top_importance")
    )


def explanation() -> Column:
    cap, yoy = num("market_cap"), num("quarterly_revenue_yoy")
    mentions = F.coalesce(num("backlog_mentions"), F.lit(0.0)) + F.coalesce(num("rpo_mentions"), F.lit(0.0))
    return F.concat_ws(
        " ",
        F.format_string("%s scores %.1f.", F.upper("ticker"), F.col("total_score")),
        F.when(cap.isNotNull(), F.concat(F.lit("Market cap about "), S.money_text(cap), F.lit("."))),
        F.when(yoy.isNotNull(), F.concat(F.lit("Quarterly revenue change "), S.percent_text(yoy), F.lit("."))),
        F.when(mentions > 0, F.format_string("%.0f order mentions in filings.", mentions)),
        F.when(F.size("missing_dimensions") > 0, F.concat(F.lit("Missing: "), F.array_join("missing_dimensions", ", "), F.lit("."))),
    )


def grade(total: Column) -> Column:
    return F.when(total >= 80, "A").when(total >= 65, "B").when(total >= 45, "C").otherwise("D")


def score_items(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Score of every ticker from all its items, or its ``limit`` latest."""
    recent = latest_items(items, limit)
    df = component_scores(item_coverage(recent).join(latest_metrics(recent), "ticker", "left"))
    df = df.withColumn("missing_dimensions", missing_dimensions())
    gross = sum((F.col(c) for c in COMPONENTS), F.lit(0.0))
    df = df.withColumn("__total", clip(gross - penalty(F.col("missing_dimensions")), 0, 100))
    df = df.withColumns({"grade": grade(F.col("__total")), "total_score": round_even("__total", 2)})
    df = df.withColumn("explanation", explanation())
    return df.withColumns({c: round_even(c, 2) for c in COMPONENTS}).drop("__total")
