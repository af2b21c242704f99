"""Bar normalisation and resampling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import finite, or_default


@dataclass(frozen=True)
class SessionSpec:
    """Session start (minute of day), length in minutes and bar width in minutes."""

    start_minute: int = 570
    length: int = 390
    interval: int = 3


REGULAR = SessionSpec()
# All-day sessions for round-the-clock series.
ALL_DAY_HOURLY = SessionSpec(0, 1440, 60)
ALL_DAY_FINE = SessionSpec(0, 1440, 3)

PRICE_COLUMNS = ("open", "high", "low", "close", "volume", "turnover")
TIME_ALIASES = ("time_key", "time", "datetime", "date")


def _first_text(df: DataFrame, names) -> Column:
    present = [F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def normalise_bars(df: DataFrame, zero_is_missing: bool = False) -> DataFrame:
    """Raw quote rows to ``symbol, ts, open, high, low, close, volume, turnover``.

    Time comes from the first present alias, rows without a close are dropped, and open
    (also when 0), high and low fall back to the close. ``zero_is_missing`` extends the zero
    rule to high and low, which the resampler uses.
    """

    def number(name: str) -> Column:
        if name not in df.columns:
            return F.lit(None).cast("double")
        return finite(F.col(name).try_cast("double"))

    close = number("close")
    plain = {n: F.coalesce(number(n), close) for n in ("high", "low")}
    if zero_is_missing:
        plain = {n: or_default(number(n), close) for n in ("high", "low")}
    ts = F.col("ts") if "ts" in df.columns else _first_text(df, TIME_ALIASES).try_cast("timestamp_ntz")
    return df.select(
        F.col("symbol"),
        ts.alias("ts"),
        or_default(number("open"), close).alias("open"),
        plain["high"].alias("high"),
        plain["low"].alias("low"),
        close.alias("close"),
        number("volume").alias("volume"),
        number("turnover").alias("turnover"),
    ).filter(F.col("close").isNotNull())


def session_columns(df: DataFrame, spec: SessionSpec = REGULAR) -> DataFrame:
    """Add ``session_date`` and ``session_minute`` and keep rows inside the session."""
    minute = F.hour("ts") * 60 + F.minute("ts") - F.lit(spec.start_minute)
    return (
        df.filter(F.col("ts").isNotNull())
        .withColumns({"session_date": F.to_date("ts"), "session_minute": minute})
        .filter((F.col("session_minute") >= 0) & (F.col("session_minute") < spec.length))
    )


def resample(df: DataFrame, spec: SessionSpec = REGULAR) -> DataFrame:
    """Minute rows to bars of ``spec.interval`` minutes per ``(symbol, session_date)``.

    The aggregate combines on the map side, so a symbol with very many rows sends only one
    partial row per bar and task.
    """
    rows = session_columns(normalise_bars(df, zero_is_missing=True), spec)
    bars = (
        rows.withColumn("bucket", F.floor(F.col("session_minute") / spec.interval).cast("int"))
        .groupBy("symbol", "session_date", "bucket")
        .agg(
            F.max("ts").alias("ts"),
            F.max("session_minute").alias("session_minute"),
            F.min_by("open", "ts").alias("open"),
            F.max("high").alias("high"),
            F.min("low").alias("low"),
            F.max_by("close", "ts").alias("close"),
            F.sum(F.coalesce("volume", F.lit(0.0))).alias("volume"),
            F.sum(F.coalesce("turnover", F.lit(0.0))).alias("turnover"),
            F.count(F.lit(1)).alias("source_rows"),
        )
    )
    w = Window.partitionBy("symbol", "session_date").orderBy("bucket")
    return bars.withColumn("bar_index", F.row_number().over(w) - 1)
