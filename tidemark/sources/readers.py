"""File readers for bars and watchlists, and the CSV, JSON and parquet sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import let, round_even
from tidemark.session import materialise


def read_bars(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Bar files of many symbols; CSV has a header, and values stay text until they are normalised."""
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return reader.format(fmt).load(path)


def csv_cells(line: Column) -> Column:
    """Cells of one CSV line; a quoted cell may hold commas and doubled quotes, but no line break."""
    cells = F.split(line, r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1)
    return F.transform(cells, lambda c: let(F.trim(c), lambda t: F.when(t.startswith('"'), F.replace(F.regexp_replace(t, '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(t)))


def read_watchlist(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of watchlists, whose format each file decides for itself: one per line with ``#`` comments, or a CSV's ``ticker`` (else first) column.

    A file is a CSV when its first line that is neither blank nor a comment has a comma. Lines are rows, so a list may be of any
    length and files may come by a glob of both kinds; only each file's first line is sent to all tasks.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at")
    )
    # a line's place is read twice, so it is written once
    kept = materialise(lines.where((F.trim("value") != "") & ~F.trim("value").startswith("#")), "watchlist-lines")
    first = kept.groupBy("file").agg(F.min(F.struct("at", "value")).alias("first"))
    head = csv_cells(F.regexp_replace("first.value", "^\ufeff", ""))
    column = F.greatest(F.array_position(F.transform(head, lambda h: F.lower(h)), "ticker"), F.lit(1)).cast("int") - 1
    files = first.select("file", F.col("first.at").alias("head"), F.when(F.contains("first.value", F.lit(",")), column).alias("column"))
    rows = kept.join(F.broadcast(files), "file").where(F.col("column").isNull() | (F.col("at") != F.col("head")))
    symbol = F.when(F.col("column").isNotNull(), F.trim(F.get(csv_cells(F.col("value")), F.col("column")))).otherwise(F.trim("value"))
    return rows.select(symbol.alias("symbol")).filter(F.col("symbol") != "")


def write_screen(results: DataFrame, path: str) -> None:
    """Screen results as CSV (lists joined by ``; ``, ratios as percent) and JSON."""
    flat = results
    for f in results.schema.fields:
        if isinstance(f.dataType, T.ArrayType):
            flat = flat.withColumn(f.name, F.array_join(f.name, "; "))
    for c in ("institutional_ownership", "insider_ownership", "quarterly_revenue_yoy"):
        if c in flat.columns:
            flat = flat.withColumn(f"{c}_pct", round_even(F.col(c) * 100, 2)).drop(c)
    flat.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    results.write.mode("overwrite").json(f"{path}/json")


def write_research(outputs: dict[str, DataFrame], path: str) -> None:
    """Research outputs as parquet; the feature table is partitioned by symbol."""
    for name, df in outputs.items():
        writer = df.write.mode("overwrite")
        if name == "features":
            writer = writer.partitionBy("symbol")
        writer.parquet(f"{path}/{name}")
