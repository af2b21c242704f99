"""Threshold-rule mining, exit tuning and frozen-rule validation for all symbols at once.

Rules are rows: an array of conditions ``(feature position, up, threshold)`` per rule, grouped
into one array per symbol and joined to the bars on the symbol. A bar keeps only the rules it
satisfies, so nothing grows with rules x bars except true signals.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators import events as E
from tidemark.operators.features import MINING_FEATURES, SESSION
from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import materialise

DIRECTIONS = ("long", "short")


@dataclass(frozen=True)
class MiningParams:
    train_fraction: float = 0.7
    target: float = 0.015
    stop: float = 0.008
    hold: int = 7
    cost: float = 0.001
    cooldown: int = 2
    min_train_trades: int = 12
    min_test_trades: int = 5
    max_seeds: int = 10
    stability_top: int = 10
    keep: int | None = None
    min_values: int = 30
    min_distinct: int = 8


# Quantiles of the "at most" and "at least" conditions.
LOW_QUANTILES = (0.1, 0.2, 0.3)
HIGH_QUANTILES = (0.7, 0.8, 0.9)

# Exit grid, nested in this order.
EXIT_GRID = list(itertools.product((0.01, 0.015, 0.02), (0.006, 0.008, 0.01), (5, 8, 12), (2, 4), (2, 3)))
#: Longest hold of a frozen rule, in bars; the path that a bar carries is as long.
LONGEST_HOLD = 20


# --- conditions ---------------------------------------------------------------------------


def with_split(features: DataFrame, train_fraction: float = 0.7) -> DataFrame:
    """Add ``rank, sessions, is_train``; the session table has one row per symbol and day."""
    days = E.session_ranks(features).withColumn("is_train", E.train_flag(train_fraction))
    return features.join(days, list(SESSION))


def quantile_conditions(train: DataFrame, names: Sequence[str], min_values: int = 30, min_distinct: int = 8) -> DataFrame:
    """Candidate conditions per symbol: ``symbol, cond(position, fi, feature, up, threshold)``, thresholds by ``exact_quantiles``."""
    pairs = F.array(*[F.struct(F.lit(i).alias("fi"), F.col(n).alias("v")) for i, n in enumerate(names)])
    values = train.select("symbol", F.explode(pairs).alias("p")).select("symbol", "p.fi", "p.v")
    qs = LOW_QUANTILES + HIGH_QUANTILES
    stats = exact_quantiles(values, ["symbol", "fi"], qs)
    stats = stats.filter((F.col("total") >= min_values) & (F.col("different") >= min_distinct))
    feature = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("fi") + 1)
    conds = F.transform(
        "q",
        lambda v, i: F.struct(
            (F.col("fi") * len(qs) + i).alias("position"),
            F.col("fi").alias("fi"),
            feature.alias("feature"),
            (i >= len(LOW_QUANTILES)).alias("up"),
            v.alias("threshold"),
        ),
    )
    return stats.select("symbol", F.explode(conds).alias("cond"))


def feature_spread(train: DataFrame, names: Sequence[str]) -> DataFrame:
    """Sample deviation of each feature per symbol as one array."""
    sds = train.groupBy("symbol").agg(*[F.stddev_samp(n).alias(f"__{i}") for i, n in enumerate(names)])
    return sds.select("symbol", F.array(*[F.coalesce(f"__{i}", F.lit(0.0)) for i in range(len(names))]).alias("spread"))


def holds(feats: Column, cond: Column) -> Column:
    """Condition on a feature array; a missing value never matches."""
    v = F.element_at(feats, cond["fi"] + 1)
    return F.coalesce(F.when(cond["up"], v >= cond["threshold"]).otherwise(v <= cond["threshold"]), F.lit(False))


def condition_text(cond: Column) -> Column:
    t = cond["threshold"]
    number = (
        F.when(F.abs(t) >= 100, F.format_string("%.1f", t)).when(F.abs(t) >= 1, F.format_string("%.2f", t)).otherwise(F.format_string("%.4f", t))
    )
    return F.concat(cond["feature"], F.when(cond["up"], " >= ").otherwise(" <= "), number)


def rule_text(conds: Column) -> Column:
    return F.array_join(F.transform(conds, condition_text), " & ")


def rules_by_symbol(rules: DataFrame) -> DataFrame:
    """``symbol, rule_id, direction, conds`` to one rule array per symbol (a bounded list)."""
    return rules.groupBy("symbol").agg(F.collect_list(F.struct("rule_id", "direction", "conds")).alias("rules"))


def rule_signals(base: DataFrame, rules: DataFrame) -> DataFrame:
    """Bars of ``base`` (with ``feats``) repeated for each rule of their symbol that they satisfy."""
    joined = base.join(rules_by_symbol(rules), "symbol")
    true_rules = F.filter("rules", lambda r: F.forall(r["conds"], lambda c: holds(F.col("feats"), c)))
    out = joined.withColumn("__r", F.explode(F.transform(true_rules, lambda r: F.struct(r["rule_id"].alias("rule_id"), r["direction"].alias("direction")))))
    return out.select(*base.columns, "__r.rule_id", "__r.direction")


def feature_array(names: Sequence[str]) -> Column:
    return F.array(*[F.col(n) for n in names]).alias("feats")


# --- scores -------------------------------------------------------------------------------


def rule_score(train: str, test: str) -> Column:
    tr, te = (lambda m: F.col(f"{train}{m}")), (lambda m: F.col(f"{test}{m}"))
    return (
        te("total_net_return") * 8
        + F.least(tr("total_net_return"), te("total_net_return")) * 4
        + te("win_rate_wilson_lower")
        + F.least(te("profit_factor"), F.lit(5.0)) * 0.18
        + F.least(tr("profit_factor"), F.lit(5.0)) * 0.05
        - F.abs(tr("win_rate") - te("win_rate"))
        - F.abs(te("trades_per_active_day") - 2.5) * 0.08
    )


def rule_status() -> Column:
    both = (F.col("train_total_net_return") > 0) & (F.col("test_total_net_return") > 0)
    strong = (F.col("train_profit_factor") >= 1.15) & (F.col("test_profit_factor") >= 1.15)
    return F.when(both & strong, "candidate").when(both, "experiment").otherwise("reject")


def positive(prefix: str = "") -> Column:
    """Traded, made money and has a profit factor of at least 1."""
    return (F.col(f"{prefix}trades") > 0) & (F.col(f"{prefix}total_net_return") > 0) & (F.col(f"{prefix}profit_factor") >= 1.0)


# --- mining -------------------------------------------------------------------------------


def mining_base(split: DataFrame, names: Sequence[str], p: MiningParams) -> DataFrame:
    """Tradable bars with their feature array and the exits of both directions."""
    sides = {
        f"x_{d}": E.exit_of(F.lit(d), F.lit(p.target), F.lit(p.stop), F.lit(p.hold), F.lit(p.cost)) for d in DIRECTIONS
    }
    df = E.with_path(split, p.hold).filter(E.tradable())
    return df.select(*SESSION, "bar_index", "is_train", feature_array(names), *[x.alias(n) for n, x in sides.items()])


def evaluate_rules(base: DataFrame, rules: DataFrame, p: MiningParams) -> DataFrame:
    """Trade metrics per ``symbol, rule_id, is_train``."""
    x = F.when(F.col("direction") == "long", F.col("x_long")).otherwise(F.col("x_short"))
    signals = rule_signals(base, rules).select(
        *SESSION, "bar_index", "is_train", "rule_id", x.alias("x"), F.lit(p.cooldown).alias("cooldown"), F.lit(E.NO_CAP).alias("cap")
    )
    trades = E.non_overlapping(signals, ["rule_id", "is_train"])
    return E.trade_metrics(trades, ["symbol", "rule_id", "is_train"])


def single_rules(conditions: DataFrame) -> DataFrame:
    """Each condition as a rule in both directions; ids follow feature and quantile order."""
    sides = F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), F.lit(100_000 * k).alias("o")) for k, d in enumerate(DIRECTIONS)]))
    df = conditions.select("symbol", "cond", sides.alias("s"))
    return df.select("symbol", (F.col("s.o") + F.col("cond.position")).alias("rule_id"), F.col("s.direction").alias("direction"), F.array("cond").alias("conds"))


def seed_rules(singles: DataFrame, metrics: DataFrame, p: MiningParams) -> DataFrame:
    """The best single conditions per symbol and direction, and all their pairs over different features.

    At most ``max_seeds`` conditions reach the pairing, so a symbol gets at most
    ``seeds + seeds*(seeds-1)/2`` rules per direction.
    """
    scored = metrics.filter(F.col("is_train") & (F.col("trades") >= p.min_train_trades)).withColumn("score", rule_score("", ""))
    w = Window.partitionBy("symbol", "direction").orderBy(F.desc(F.round("score", 9)), "rule_id")
    best = (
        scored.select("symbol", "rule_id", "score")
        .join(singles, ["symbol", "rule_id"])
        .withColumn("place", F.row_number().over(w))
        .filter(F.col("place") <= max(1, p.max_seeds))
    )
    seeds = best.groupBy("symbol", "direction").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("conds")[0].alias("c")))), lambda s: s["c"]).alias("s")
    )
    ones = F.transform("s", lambda a: F.array(a))
    twos = F.flatten(
        F.transform(
            "s",
            lambda a, i: F.transform(
                F.filter("s", lambda b, j: (j > i) & (b["feature"] != a["feature"])), lambda b: F.array(a, b)
            ),
        )
    )
    def rule_key(conds: Column) -> Column:
        return F.array_join(
            F.transform(conds, lambda c: F.concat_ws("|", c["feature"], c["up"].cast("string"), F.round(c["threshold"], 8).cast("string"))), "&"
        )

    df = seeds.withColumn("rules", F.concat(ones, twos))
    df = df.withColumn("keys", F.transform("rules", rule_key))
    numbered = df.select("symbol", "direction", F.posexplode("rules").alias("position", "conds"), "keys")
    first = F.array_position("keys", F.get(F.col("keys"), F.col("position"))) == F.col("position") + 1
    offset = F.when(F.col("direction") == DIRECTIONS[0], 0).otherwise(100_000)
    return numbered.filter(first).select("symbol", (offset + F.col("position")).alias("rule_id"), "direction", "conds")


def side_by_side(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Train and test metrics of each key in one row (null where a side is missing); the trades behind them are worked out once."""
    both = metrics.groupBy(*keys).agg(
        F.first(F.when(F.col("is_train"), F.struct(*E.METRICS)), True).alias("__train"), F.first(F.when(~F.col("is_train"), F.struct(*E.METRICS)), True).alias("__test")
    )
    return both.select(*keys, *[F.col(f"__{side}.{m}").alias(f"{side}_{m}") for side in ("train", "test") for m in E.METRICS])


def train_and_test(metrics: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Train and test metrics side by side for keys that have both."""
    return side_by_side(metrics, keys).filter("train_trades IS NOT NULL AND test_trades IS NOT NULL")


def neighbour_rules(candidates: DataFrame, spread: DataFrame) -> DataFrame:
    """Each rule as is, tighter and looser by a tenth of the feature's deviation."""
    steps = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).alias("m")) for k, m in enumerate((0.0, 1.0, -1.0))]))
    df = candidates.join(spread, "symbol").select("symbol", "rule_id", "direction", "conds", "spread", steps.alias("n"))

    def moved(c: Column) -> Column:
        delta = F.element_at("spread", c["fi"] + 1) * 0.1 * F.when(c["up"], F.col("n.m")).otherwise(-F.col("n.m"))
        return F.struct(
            c["position"].alias("position"), c["fi"].alias("fi"), c["feature"].alias("feature"), c["up"].alias("up"), (c["threshold"] + delta).alias("threshold")
        )

    return df.select("symbol", (F.col("rule_id") * 3 + F.col("n.k")).alias("rule_id"), "direction", F.transform("conds", moved).alias("conds"))


def mine_rules(features: DataFrame, names: Sequence[str] = MINING_FEATURES, p: MiningParams = MiningParams()) -> DataFrame:
    """Mined rules of every symbol in both directions, best first.

    The prepared bars and the small rule tables between the stages are written to the shared
    folder: each later stage reads them instead of repeating the windows.
    """
    split = with_split(features, p.train_fraction)
    train = split.filter("is_train")
    base = materialise(mining_base(split, names, p), "mining-base")
    singles = materialise(single_rules(quantile_conditions(train, names, p.min_values, p.min_distinct)), "single-rules")
    first = evaluate_rules(base.filter("is_train"), singles, p)
    rules = materialise(seed_rules(singles, first, p), "seed-rules")
    both = train_and_test(evaluate_rules(base, rules, p), ["symbol", "rule_id"])
    both = both.filter((F.col("train_trades") >= p.min_train_trades) & (F.col("test_trades") >= p.min_test_trades))
    w = Window.partitionBy("symbol", "direction").orderBy(F.desc(F.round("score", 9)), "rule_id")
    ranked = (
        both.join(rules, ["symbol", "rule_id"])
        .withColumns({"score": rule_score("train_", "test_"), "status": rule_status()})
        .withColumn("place", F.row_number().over(w))
    )
    # rules past the kept ones are looked at only where the stability check needs them
    ranked = materialise(ranked if p.keep is None else ranked.filter(F.col("place") <= max(p.keep, p.stability_top)), "ranked-rules")
    top = ranked.filter(F.col("place") <= p.stability_top)
    near = evaluate_rules(base.filter("NOT is_train"), neighbour_rules(top, feature_spread(train, names)), p)
    rate = near.groupBy("symbol", F.floor(F.col("rule_id") / 3).cast("int").alias("rule_id")).agg(
        F.count_if(positive()).alias("positive_neighbors")
    )
    out = ranked.join(rate, ["symbol", "rule_id"], "left")
    in_top = F.col("place") <= p.stability_top
    neighbours = F.when(in_top, F.coalesce("positive_neighbors", F.lit(0)))
    out = out.withColumn("positive_neighbors", neighbours).withColumn("positive_neighbor_rate", F.col("positive_neighbors") / 3)
    weak = in_top & (F.col("status") == "candidate") & (F.col("positive_neighbor_rate") < 2 / 3)
    out = out.withColumns({"status": F.when(weak, "experiment").otherwise(F.col("status")), "rule": rule_text(F.col("conds"))})
    return out if p.keep is None else out.filter(F.col("place") <= p.keep)


# --- tuning and validation ----------------------------------------------------------------


def execution_score(prefix: str = "") -> Column:
    m = lambda x: F.col(f"{prefix}{x}")
    return (
        m("total_net_return") * 8
        + F.least(m("profit_factor"), F.lit(4.0)) * 0.25
        + m("win_rate_wilson_lower")
        - F.abs(m("trades_per_active_day") - 2.5) * 0.08
        - m("largest_day_abs_pnl_share") * 0.2
    )


def grid_literal(cost: float) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(i).alias("grid"), F.lit(t).alias("target"), F.lit(s).alias("stop"), F.lit(h).alias("hold"), F.lit(c).alias("cooldown"),
                F.lit(k).alias("cap"), F.lit(cost).alias("cost"),
            )
            for i, (t, s, h, c, k) in enumerate(EXIT_GRID)
        ]
    )


def execute(signals: DataFrame, keys: Sequence[str], execution: str = "ex") -> DataFrame:
    """Trades of signals whose exit parameters sit in the struct column ``execution``."""
    g = lambda f: F.col(f"{execution}.{f}")
    x = E.exit_of(F.col("direction"), g("target"), g("stop"), g("hold"), g("cost"))
    rows = signals.select(*SESSION, "bar_index", *keys, x.alias("x"), g("cooldown").alias("cooldown"), g("cap").alias("cap"))
    return E.non_overlapping(rows, keys)


def tune_exits(features: DataFrame, specs: DataFrame, names: Sequence[str] = MINING_FEATURES, train_fraction: float = 0.7, cost: float = 0.001, min_trades: int = 20) -> DataFrame:
    """Best exit of the grid per rule by its train score, with test and block evidence.

    ``specs``: ``symbol, rule_id, direction, conds, neighbor_rate``. The grid runs on the train
    sessions only; the chosen exit then runs once over everything.
    """
    longest = max(h for _, _, h, _, _ in EXIT_GRID)
    split = with_split(features, train_fraction)
    bars = E.with_path(split, longest).filter(E.tradable())
    bars = bars.select(*SESSION, "bar_index", "is_train", "rank", "sessions", feature_array(names), "path")
    signals = materialise(rule_signals(bars, specs.select("symbol", "rule_id", "direction", "conds")), "rule-signals")

    # the exit depends on target, stop and hold only: each is worked out once on the path, and narrow rows are exploded
    plans = list(dict.fromkeys((t, s, h) for t, s, h, _, _ in EXIT_GRID))
    exits = F.transform(
        F.array(*[F.struct(F.lit(t).alias("target"), F.lit(s).alias("stop"), F.lit(h).alias("hold")) for t, s, h in plans]),
        lambda g: E.exit_of(F.col("direction"), g["target"], g["stop"], g["hold"], F.lit(cost)),
    )
    which = F.array(*[F.struct(F.lit(i).alias("grid"), F.lit(plans.index((t, s, h)) + 1).alias("exit"), F.lit(c).alias("cooldown"), F.lit(k).alias("cap")) for i, (t, s, h, c, k) in enumerate(EXIT_GRID)])
    grid = signals.filter("is_train").select(*SESSION, "bar_index", "rule_id", exits.alias("exits"))
    grid = grid.withColumn("g", F.explode(which)).select(*SESSION, "bar_index", "rule_id", "g.grid", F.element_at("exits", F.col("g.exit")).alias("x"), "g.cooldown", "g.cap")
    keys = ["symbol", "rule_id", "grid"]
    scored = E.trade_metrics(E.non_overlapping(grid, ["rule_id", "grid"]), keys).filter(F.col("trades") >= min_trades)
    best = scored.withColumn("score", execution_score()).groupBy("symbol", "rule_id").agg(
        F.max_by(F.struct("grid", "score", *E.METRICS), F.struct(F.round("score", 9).alias("s"), (-F.col("grid")).alias("g"))).alias("b")
    )
    best = materialise(best.select("symbol", "rule_id", "b.*"), "best-exits")

    chosen = signals.join(best.select("symbol", "rule_id", "grid"), ["symbol", "rule_id"])
    chosen = chosen.withColumn("ex", F.element_at(grid_literal(cost), F.col("grid") + 1)).withColumn("block", E.block_id(14, 10))
    trades = execute(chosen, ["rule_id", "is_train", "block"])
    test = E.prefixed(E.trade_metrics(trades.filter("NOT is_train"), ["symbol", "rule_id"]), "test_")
    per_block = E.trade_metrics(trades.filter("block IS NOT NULL"), ["symbol", "rule_id", "block"])
    days = E.session_ranks(features).withColumn("block", E.block_id(14, 10))
    blocks = days.filter("block IS NOT NULL").groupBy("symbol").agg(F.count_distinct("block").alias("blocks"), F.max("block").alias("last_block"))
    block_stats = (
        per_block.join(blocks, "symbol")
        .groupBy("symbol", "rule_id")
        .agg(
            F.count_if(positive()).alias("positive_blocks"),
            F.max(F.when(F.col("block") == F.col("last_block"), F.col("total_net_return"))).alias("last_block_return"),
        )
    )
    out = (
        specs.select("symbol", "rule_id", "direction", "conds", "neighbor_rate")
        .join(E.prefixed(best, "train_"), ["symbol", "rule_id"], "left")
        .join(test, ["symbol", "rule_id"], "left")
        .join(block_stats, ["symbol", "rule_id"], "left")
        .join(blocks, "symbol", "left")
    )
    out = E.fill_metrics(out, "test_").fillna(0, subset=["positive_blocks", "last_block_return", "blocks"])
    out = out.withColumn("block_rate", F.coalesce(F.try_divide(F.col("positive_blocks").cast("double"), F.col("blocks")), F.lit(0.0)))
    c = F.col
    common = (
        (c("train_total_net_return") > 0) & (c("test_total_net_return") > 0) & (c("test_profitable_day_rate") >= 0.55)
        & c("test_trades_per_active_day").between(0.5, 3.5) & (c("test_largest_day_abs_pnl_share") <= 0.35) & (c("neighbor_rate") >= 2 / 3)
    )

    def level(train_n: int, test_n: int, pf: float, rate: float) -> Column:
        return (
            common & (c("train_trades") >= train_n) & (c("test_trades") >= test_n) & (c("train_profit_factor") >= pf)
            & (c("test_profit_factor") >= pf) & (c("block_rate") >= rate)
        )

    status = F.when(level(30, 12, 1.3, 0.75), "candidate").when(level(20, 10, 1.15, 0.6), "watch").otherwise("reject")
    out = out.withColumn("status", status)
    rising = c("last_block_return") > 0
    posture = (
        F.when((c("status") == "candidate") & rising, "enabled_for_paper_validation")
        .when((c("status") == "watch") & rising, "watch_sample_size")
        .when(c("status") != "reject", "watch_current_regime")
        .otherwise("reject")
    )
    return out.withColumns({"posture": posture, "rule": rule_text(c("conds"))}).drop("last_block")


def rules_to_tune(mined: DataFrame, pool: int | None = None, keep: int | None = None) -> DataFrame:
    """Mined rules worth tuning: positive on both sides and stable; the first ``keep`` per symbol by score out of the first ``pool``, if given."""
    w = Window.partitionBy("symbol").orderBy(F.desc(F.round("score", 9)), "rule_id")
    listed = mined if pool is None else mined.withColumn("pool_place", F.row_number().over(w)).filter(F.col("pool_place") <= pool)
    good = (
        (F.col("train_total_net_return") > 0) & (F.col("test_total_net_return") > 0) & (F.coalesce("positive_neighbor_rate", F.lit(0.0)) >= 2 / 3)
    )
    kept = listed.filter(good).withColumn("tune_place", F.row_number().over(w))
    kept = kept if keep is None else kept.filter(F.col("tune_place") <= keep)
    return kept.select("symbol", "rule_id", "direction", "conds", F.col("positive_neighbor_rate").alias("neighbor_rate"), "tune_place")


def tune_mined(features: DataFrame, mined: DataFrame, names: Sequence[str] = MINING_FEATURES) -> DataFrame:
    """Tuned rules of each symbol, ranked by status and then test return."""
    tuned = tune_exits(features, materialise(rules_to_tune(mined), "tune-specs"), names)
    level = F.when(F.col("status") == "candidate", 2).when(F.col("status") == "watch", 1).otherwise(0)
    w = Window.partitionBy("symbol").orderBy(level.desc(), F.desc_nulls_last("test_total_net_return"), "rule_id")
    return tuned.withColumn("place", F.row_number().over(w))


def fixed_rules(spark: SparkSession, symbols: DataFrame, rules: Sequence[dict], names: Sequence[str] = MINING_FEATURES) -> DataFrame:
    """Configured rules applied to every symbol: ``id, direction, conditions [(feature, op, threshold)]`` and exits."""

    if any(int(r.get("hold", 7)) > LONGEST_HOLD for r in rules):
        raise ValueError(f"a rule holds longer than {LONGEST_HOLD} bars")

    def literal(k: int, r: dict) -> Column:
        conds = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"), F.lit(names.index(f)).alias("fi"), F.lit(f).alias("feature"), F.lit(op == ">=").alias("up"),
                    F.lit(float(t)).alias("threshold"),
                )
                for i, (f, op, t) in enumerate(r["conditions"])
            ]
        )
        ex = F.struct(
            F.lit(float(r.get("target", 0.015))).alias("target"), F.lit(float(r.get("stop", 0.008))).alias("stop"), F.lit(int(r.get("hold", 7))).alias("hold"),
            F.lit(int(r.get("cooldown", 2))).alias("cooldown"), F.lit(int(r.get("cap", E.NO_CAP))).alias("cap"), F.lit(float(r.get("cost", 0.001))).alias("cost"),
        )
        return F.struct(F.lit(k).alias("rule_id"), F.lit(r["id"]).alias("name"), F.lit(r["direction"]).alias("direction"), conds.alias("conds"), ex.alias("ex"))

    table = F.array(*[literal(k, r) for k, r in enumerate(rules)])
    return symbols.select("symbol", F.explode(table).alias("r")).select("symbol", "r.*")


def fixed_trades(features: DataFrame, rules: DataFrame, names: Sequence[str] = MINING_FEATURES, block_sessions: int = 20) -> DataFrame:
    """Trades of frozen rules (holds of ``LONGEST_HOLD`` bars at most) with the block of their session."""
    days = E.session_ranks(features).withColumn("block", E.block_id(max(1, block_sessions), max(5, block_sessions // 2)))
    bars = E.with_path(features, LONGEST_HOLD).filter(E.tradable()).join(days, list(SESSION))
    bars = bars.select(*SESSION, "bar_index", "block", feature_array(names), "path")
    signals = rule_signals(bars, rules).join(rules.select("symbol", "rule_id", "ex"), ["symbol", "rule_id"])
    return execute(signals, ["rule_id", "block"])


def validate_fixed(features: DataFrame, rules: DataFrame, names: Sequence[str] = MINING_FEATURES, block_sessions: int = 20) -> DataFrame:
    """Full-range metrics, block count and positive block rate of frozen rules."""
    trades = materialise(fixed_trades(features, rules, names, block_sessions), "fixed-trades")
    full = E.trade_metrics(trades, ["symbol", "rule_id"])
    per_block = E.trade_metrics(trades.filter("block IS NOT NULL"), ["symbol", "rule_id", "block"])
    good = per_block.groupBy("symbol", "rule_id").agg(F.count_if(positive()).alias("positive_blocks"))
    days = E.session_ranks(features).withColumn("block", E.block_id(max(1, block_sessions), max(5, block_sessions // 2)))
    blocks = days.groupBy("symbol").agg(F.count_distinct("block").alias("blocks"), F.count(F.lit(1)).alias("sessions"))
    out = rules.select("symbol", "rule_id", "name", "direction").join(full, ["symbol", "rule_id"], "left")
    out = out.join(good, ["symbol", "rule_id"], "left").join(blocks, "symbol", "left")
    out = E.fill_metrics(out).fillna(0, subset=["positive_blocks", "blocks"])
    return out.withColumn(
        "positive_block_rate", F.coalesce(F.try_divide(F.col("positive_blocks").cast("double"), F.col("blocks")), F.lit(0.0))
    )


def signal_overlap(features: DataFrame, left: Column, right: Column) -> DataFrame:
    """How many bars two signals share, per symbol."""
    a, b = F.coalesce(left, F.lit(False)), F.coalesce(right, F.lit(False))
    out = features.groupBy("symbol").agg(
        F.count_if(a).alias("left_bars"), F.count_if(b).alias("right_bars"), F.count_if(a & b).alias("both_bars"), F.count_if(a | b).alias("any_bars")
    )

    def share(x: str) -> Column:
        return F.coalesce(F.try_divide(F.col("both_bars").cast("double"), F.col(x)), F.lit(0.0))

    return out.withColumns(
        {"overlap_vs_left": share("left_bars"), "overlap_vs_right": share("right_bars"), "jaccard": share("any_bars")}
    ).drop("any_bars")
