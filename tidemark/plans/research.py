"""The whole research run over a bar table, for one or all symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import families as FM
from tidemark.operators import features as X
from tidemark.operators import rules as R
from tidemark.operators import zones as Z
from tidemark.session import materialise


def run_research(bars: DataFrame, mining: bool = True, session_length: int = 390, params: R.MiningParams = R.MiningParams()) -> dict[str, DataFrame]:
    """Features, zones, mined and tuned rules, variant evaluation and symbol comparison.

    The labelled feature table is written once and read by every later step with column pruning.
    """
    labelled = materialise(Z.label_turning_zones(X.feature_matrix(bars, session_length)), "features")
    out = {
        "features": labelled,
        "turn_counts": labelled.groupBy("symbol", "pivot_label").agg(F.count(F.lit(1)).alias("bars")),
        "profile": FM.research_profile(labelled),
        "before_trough": Z.event_differences(labelled, "trough"),
        "before_peak": Z.event_differences(labelled, "peak"),
    }
    if mining:
        mined = materialise(R.mine_rules(labelled, p=params), "mined")
        out["mined"] = mined
        out["tuned"] = R.tune_mined(labelled, mined)
    variants = FM.variant_grid()
    trades = materialise(FM.variant_trades(labelled, variants), "variant-trades")
    evaluated = materialise(FM.evaluate_variants(labelled, variants, trades=trades), "variants")
    out["variants"] = evaluated
    out["families"] = FM.family_summary(evaluated)
    out["comparison"] = FM.compare_symbols(evaluated, out["profile"])
    return out
