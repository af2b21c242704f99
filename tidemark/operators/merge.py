"""Keyed merges of the evidence store.

Each merge is a union of the stored and the incoming rows followed by an aggregate per key, so mostly
copies of a hot key are folded on the map side (observations are shuffled once instead, see ``together``) and no key is ever collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import col


def stable_hash(*parts: Column | str) -> Column:
    """SHA-256 over the parts, each followed by a NUL character."""
    pieces = []
    for p in parts:
        pieces += [F.coalesce(col(p).cast("string"), F.lit("")), F.lit("\0")]
    return F.sha2(F.concat(*pieces), 256)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The row with the greatest ``order`` tuple of each key."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__row"))
    return newest.select(*keys, "__row.*")


def upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows replace stored rows of the same key; ``version`` orders repeated incoming rows."""
    both = existing.withColumn("__side", F.lit(0)).unionByName(incoming.withColumn("__side", F.lit(1)))
    return latest_per_key(both, keys, ["__side", "version"]).drop("__side")


CONTENT = ("ticker", "source_key", "observation_type", "raw_hash")


def packed(rows: DataFrame) -> DataFrame:
    """``raw_hash`` as bytes, a SHA-256 in hex as half as many; the first byte tells them from other texts."""
    h = F.col("raw_hash")
    return rows.withColumn("raw_hash", F.when(h.rlike("^[0-9a-f]{64}$"), F.concat(F.lit(b"\x01"), F.unhex(h))).otherwise(F.concat(F.lit(b"\x00"), F.encode(h, "UTF-8"))))


def unpacked(rows: DataFrame) -> DataFrame:
    h, rest = F.col("raw_hash"), F.substring("raw_hash", 2, 2**31 - 1)
    return rows.withColumn("raw_hash", F.when(F.substring(h, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(rest))).otherwise(F.decode(rest, "UTF-8")))


def together(rows: DataFrame) -> DataFrame:
    """All rows of a content in one task and packed: the one shuffle that the aggregates by entry and by content need.

    A task sorts its rows and folds them one by one, so a content seen often takes time but no memory.
    """
    return packed(rows).repartition(*CONTENT)


def _sightings(observations: DataFrame) -> DataFrame:
    order = F.struct("fetched_at", "run_id")
    entries = observations.select("*", F.explode_outer("metadata").alias("entry", "value"))
    rows = entries.select(*CONTENT, "entry", F.struct(order.alias("at"), F.col("value").alias("value")).alias("newest"), F.struct("fetched_at", "run_id", "title", "source_url").alias("first"), order.alias("last"))
    return _merged(rows)


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*CONTENT, "entry").agg(F.max("newest").alias("newest"), F.min("first").alias("first"), F.max("last").alias("last"))


def _observations(merged: DataFrame) -> DataFrame:
    pair = F.when(F.col("entry").isNotNull(), F.struct("entry", "newest.value"))
    out = merged.groupBy(*CONTENT).agg(F.map_from_entries(F.array_sort(F.collect_list(pair))).alias("metadata"), F.min("first").alias("first"), F.max("last").alias("last"))
    return out.select(*CONTENT, "first.title", "first.source_url", "last.run_id", "last.fetched_at", "metadata")


def sightings(observations: DataFrame) -> DataFrame:
    """One row per content key and metadata entry: its last value, and the first and last sighting; a mergeable state."""
    return unpacked(_sightings(together(observations.select(*CONTENT, "fetched_at", "run_id", "title", "source_url", "metadata"))))


def merge_sightings(rows: DataFrame) -> DataFrame:
    """Any union of ``sightings`` to one row per content key and entry; the order in which parts are merged does not matter."""
    return unpacked(_merged(together(rows)))


def observations_of(rows: DataFrame) -> DataFrame:
    """Any union of ``sightings`` to one observation per content key."""
    return unpacked(_observations(_merged(together(rows))))


def merge_observations(observations: DataFrame) -> DataFrame:
    """Stored and incoming observations to one row per content key.

    Title and address come from the first sighting, run and fetch time from the last, and
    metadata entries merge with the last value winning. Entries are reduced per metadata key
    first, so a content with millions of sightings stays one small map.
    """
    return unpacked(_observations(_sightings(together(observations.select(*CONTENT, "fetched_at", "run_id", "title", "source_url", "metadata")))))


def merge_companies(versions: DataFrame, text: Sequence[str] = ("name", "sector", "industry", "code")) -> DataFrame:
    """Per ticker the newest non-empty value of each text column and the newest market."""

    def newest(c: str) -> Column:
        value = F.nullif(F.col(c), F.lit(""))
        return F.max_by(value, F.when(value.isNotNull(), F.col("version"))).alias(c)

    return versions.groupBy("ticker").agg(
        F.max_by("market", "version").alias("market"), *[newest(c) for c in text], F.max("version").alias("version")
    )


def watchlist(actions: DataFrame) -> DataFrame:
    """``ticker, action (watch/unwatch), note, at`` to the watched tickers with first time and last note."""
    gone = actions.groupBy("ticker").agg(F.max(F.when(F.col("action") == "unwatch", F.col("at"))).alias("gone"))
    alive = actions.join(gone, "ticker").filter(F.col("gone").isNull() | (F.col("at") > F.col("gone")))
    return alive.groupBy("ticker").agg(F.min("at").alias("watched_at"), F.max_by("note", "at").alias("note"))


def merge_events(*groups: DataFrame) -> DataFrame:
    """Union of event groups; per ``(ticker, event_date, title, source_key)`` the best confidence, then
    importance; an earlier group wins ties."""
    parts = [g.withColumn("__group", F.lit(-i)) for i, g in enumerate(groups)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    order = ["confidence_score", "importance_score", "__group"]
    return latest_per_key(union, ["ticker", "event_date", "title", "source_key"], order).drop("__group")
