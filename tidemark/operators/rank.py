"""Ranking, search, timelines and run monitoring over the evidence store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import round_even
from tidemark.operators.merge import latest_per_key
from tidemark.session import materialise

SCORE_ORDER = ("scored_at", "run_id")


def sector_group() -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif("industry", blank), F.nullif("sector", blank), F.lit("Unclassified"))


def latest_scores(scores: DataFrame) -> DataFrame:
    return latest_per_key(scores, ["ticker"], list(SCORE_ORDER))


def scored_companies(scores: DataFrame, companies: DataFrame) -> DataFrame:
    """Latest score of each ticker with its company and sector group."""
    return latest_scores(scores).join(companies, "ticker").withColumn("sector_group", sector_group())


def matches_query(query: str) -> Column:
    """Case-blind match on five columns; ``%`` and ``_`` in the query stay wildcards."""
    clean = query.strip()
    if not clean:
        return F.lit(True)
    pattern = f"%{clean.upper()}%"
    hit = F.lit(False)
    for c in ("ticker", "code", "name", "sector", "industry"):
        hit = hit | F.coalesce(F.col(c), F.lit("")).ilike(pattern)
    return hit


def rank_filter(min_score: float, query: str, sector: str) -> Column:
    cond = (F.col("total_score") >= min_score) & matches_query(query)
    return cond & (F.col("sector_group") == sector.strip()) if sector.strip() else cond


def by_score() -> list[Column]:
    return [F.desc("total_score"), F.desc("scored_at"), F.asc("ticker")]


def ranked_scores(latest: DataFrame, min_score: float = 0, limit: int = 100, query: str = "", sector: str = "") -> DataFrame:
    """The best ``limit`` candidates (a top-k report: one bounded list leaves each task)."""
    return latest.filter(rank_filter(min_score, query, sector)).orderBy(*by_score()).limit(limit)


def top_per_sector(latest: DataFrame, per_sector: int = 5, min_score: float = 0, query: str = "", sector: str = "") -> DataFrame:
    """Top-k per sector; a query returns all matches, ranked.

    The rank filter is planned as a group limit before the exchange, so a sector with a third
    of all rows sends k rows per task.
    """
    if per_sector < 1:
        raise ValueError("per_sector must be at least 1")
    w = Window.partitionBy("sector_group").orderBy(*by_score())
    ranked = latest.filter(rank_filter(min_score, query, sector)).withColumn("sector_rank", F.row_number().over(w))
    return ranked if query.strip() else ranked.filter(F.col("sector_rank") <= per_sector)


def sector_rollup(latest: DataFrame) -> DataFrame:
    return latest.groupBy(F.col("sector_group").alias("sector")).agg(
        F.count(F.lit(1)).alias("candidate_count"), F.max("total_score").alias("best_score")
    )


def grouped_by_sector(latest: DataFrame, listed: int | None = None) -> DataFrame:
    """Count and best score of every sector over all candidates, with its candidates, best first; only the ``listed`` best of all if that is given."""
    item = F.struct((-F.col("total_score")).alias("k"), "ticker")
    chosen = latest if listed is None else ranked_scores(latest, limit=listed)
    named = chosen.groupBy(F.col("sector_group").alias("sector")).agg(F.array_sort(F.collect_list(item)).alias("__items"))
    out = sector_rollup(latest).join(named.withColumnRenamed("sector", "__sector"), F.col("sector").eqNullSafe(F.col("__sector")), "left")
    names = F.coalesce(F.transform("__items", lambda x: x["ticker"]), F.array().cast("array<string>"))
    return out.withColumn("candidates", names).drop("__items", "__sector")


def search_scores(latest: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Literal search over ticker, code and name with the rank inside the whole sector; the ``limit`` best hits.

    Hits and other rows are put in order together, range by range: a row's rank is its place in its range's sector behind
    the sector's rows in the ranges before. Rows that are no hit carry their order only, no sector meets in one
    task and nothing is sent to every task.
    """
    q = query.strip()
    low = q.lower()
    if limit < 1:
        raise ValueError("limit must be at least 1")
    fields = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("ticker", "code", "name")}
    hit = F.lit(False)
    for f in fields.values():
        hit = hit | F.contains(f, F.lit(low))
    level = F.when(F.upper("ticker") == q.upper(), 0)
    for i, f in enumerate(fields.values(), start=1):
        level = level.when(f.startswith(low), i)
    order = [F.asc("sector_group"), *by_score()]
    marked = F.when(hit & F.lit(q != ""), F.struct(*latest.columns, level.otherwise(4).alias("match_level"))).alias("__hit")
    rows = latest.select("sector_group", "total_score", "scored_at", "ticker", marked)
    n = int(latest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = materialise(dealt.select("sector_group", "__hit", F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__at")), "search-order")
    # one row for each range and each sector that begins in it
    parts = dealt.groupBy("sector_group", "__range").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("sector_group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.withColumn("__before", before).select(F.col("sector_group").alias("__sector"), F.col("__range").alias("__of"), "__first", "__before")
    hits = dealt.where(F.col("__hit").isNotNull())
    met = hits.join(parts, (F.col("__range") == F.col("__of")) & F.col("sector_group").eqNullSafe(F.col("__sector")))
    found = met.select("__hit.*", (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias("sector_rank"))
    return found.orderBy("match_level", *by_score()).limit(limit)


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("event_date"), F.desc("created_at"), F.desc("importance_score"), F.desc("item_id")]


def timeline(items: DataFrame, min_importance: float = 0, dimension: str | None = None, limit: int = 100) -> DataFrame:
    """Per ticker the newest ``limit`` items after dropping repeats of the same story."""
    keep = items.filter(F.col("importance_score") >= min_importance)
    if dimension:
        keep = keep.filter(F.col("dimension") == dimension)
    keep = keep.withColumn("source_url", F.coalesce("source_url", F.lit("")))
    story = ["ticker", "dimension", "source_key", "title", "event_date", "source_url"]
    unique = latest_per_key(keep, story, ["created_at", "importance_score", "item_id"])
    w = Window.partitionBy("ticker").orderBy(*newest_first())
    return unique.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def latest_items(items: DataFrame, limit: int | None = None) -> DataFrame:
    """Items numbered per ticker by event date, then creation; the ``limit`` latest if that is given."""
    w = Window.partitionBy("ticker").orderBy(F.desc_nulls_last("event_date"), F.desc("created_at"), F.desc("item_id"))
    placed = items.withColumn("place", F.row_number().over(w))
    return placed if limit is None else placed.filter(F.col("place") <= limit)


def latest_in_dimension(items: DataFrame, dimension: str) -> DataFrame:
    return latest_per_key(items.filter(F.col("dimension") == dimension), ["ticker"], ["created_at", "item_id"])


def upcoming_events(events: DataFrame, limit: int = 80) -> DataFrame:
    w = Window.partitionBy("ticker").orderBy(F.asc_nulls_last("event_date"), F.desc("importance_score"), F.desc("created_at"), F.asc("title"))
    return events.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def latest_runs(runs: DataFrame) -> DataFrame:
    """Latest run of every ticker named in the run's ticker array."""
    per = runs.select(F.explode("tickers").alias("ticker"), "run_id", "status", F.coalesce("finished_at", "started_at").alias("at"))
    return latest_per_key(per, ["ticker"], ["at", "run_id"])


def regime_history(reports: DataFrame, limit: int = 20) -> DataFrame:
    """Newest reports with the text field from the snapshot and whether advice is present."""
    return (
        reports.select(
            "report_id",
            "report_date",
            "session_label",
            F.get_json_object("snapshot", "$.as_of").alias("as_of"),
            (F.size("advice") > 0).alias("has_advice"),
            "updated_at",
        )
        .orderBy(F.desc("report_date"), F.desc("updated_at"), F.desc("report_id"))
        .limit(limit)
    )


def run_counts(rows: DataFrame, group: str, at: str) -> DataFrame:
    return rows.groupBy("run_id", F.col(group).alias("key")).agg(
        F.count(F.lit(1)).alias("item_count"), F.count_distinct("ticker").alias("ticker_count"), F.max(at).alias("latest_at")
    )


def run_monitor(items: DataFrame, scores: DataFrame, observations: DataFrame) -> DataFrame:
    """The four roll-ups of a run in one long table: by dimension, score, observation type and source."""
    parts = [
        run_counts(items, "dimension", "created_at").withColumn("kind", F.lit("dimension")),
        run_counts(scores.withColumn("__all", F.lit("score")), "__all", "scored_at").withColumn("kind", F.lit("score")),
        run_counts(observations, "observation_type", "fetched_at").withColumn("kind", F.lit("observation")),
        run_counts(observations, "source_key", "fetched_at").withColumn("kind", F.lit("source")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    is_error = (F.col("kind") == "observation") & F.col("key").endswith("_error")
    return out.withColumn("error_count", F.when(is_error, F.col("item_count")).otherwise(0))


def run_progress(runs: DataFrame, counts: DataFrame, registry: Column) -> DataFrame:
    """Completed and expected slots of each run from the registry, its flags and the roll-ups.

    ``registry`` is an array of structs ``source_key, flag, default_enabled, dimensions``.
    """

    def requested(s: Column) -> Column:
        flag = F.try_element_at("config", s["flag"]).try_cast("boolean")
        return F.when(s["flag"] == "", s["default_enabled"]).otherwise(F.coalesce(flag, s["default_enabled"]))

    dims = F.array_distinct(F.flatten(F.transform(F.filter(registry, requested), lambda s: s["dimensions"])))
    base = runs.select(
        "run_id",
        F.upper("status").alias("status"),
        F.size("tickers").cast("bigint").alias("total"),
        F.explode(F.concat(dims, F.array(F.lit("score")))).alias("key"),
    )
    seen = counts.filter(F.col("kind").isin("dimension", "score")).select("run_id", "key", "ticker_count", "item_count")
    slot = F.coalesce("ticker_count", F.lit(0))
    slot = F.when(F.col("total") > 0, F.least(slot, F.col("total"))).otherwise(slot)
    out = (
        base.join(seen, ["run_id", "key"], "left")
        .groupBy("run_id")
        .agg(
            F.first("status").alias("status"),
            F.first("total").alias("total"),
            F.sum(slot).alias("completed_slots"),
            F.sum("total").alias("expected_slots"),
        )
    )
    share = F.coalesce(F.try_divide(F.col("completed_slots") * 100.0, F.col("expected_slots")), F.lit(0.0))
    share = F.when(F.col("status") == "DONE", F.greatest(share, F.lit(100.0))).otherwise(share)
    return out.withColumn("percent", round_even(F.least(share, F.lit(100.0)), 1))
