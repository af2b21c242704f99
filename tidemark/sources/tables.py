"""Adapters from the generic tables of a data folder to the schemas the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out evenly to all cores, for costly work on each row of a small file that one task would read."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def event_quotes(events: DataFrame) -> DataFrame:
    """Event rows as minute quotes: symbol = type, price = value, volume = ``k`` of the props."""
    return events.select(
        F.col("event_type").alias("symbol"),
        F.col("ts"),
        F.col("value").alias("close"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
    )


def daily_closes(orders: DataFrame) -> DataFrame:
    """Orders as daily bars: symbol = priority, one bar per order date.

    Open, high, low and close are the first, highest, lowest and last price of the day by
    order key; volume is the number of orders.
    """
    price = F.col("o_totalprice")
    return (
        orders.groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("session_date"))
        .agg(
            F.min_by(price, F.col("o_orderkey")).alias("open"),
            F.max(price).alias("high"),
            F.min(price).alias("low"),
            F.max_by(price, F.col("o_orderkey")).alias("close"),
            F.count(F.lit(1)).cast("double").alias("volume"),
        )
    )


# --- evidence-store tables derived from the generic ones ----------------------------------


def companies(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as companies; accounts in debt have no industry, so their sector is used."""
    c = table(spark, folder, "customer")
    return c.select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"),
        F.concat(F.lit("US.C"), F.col("c_custkey").cast("string")).alias("code"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("sector"),
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("industry"),
        F.col("c_acctbal").alias("balance"),
    )


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as score rows of the ordering customer."""
    o = table(spark, folder, "orders")
    return o.select(
        F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.col("o_orderkey").alias("run_id"),
        F.round(F.col("o_totalprice") / 5000, 2).alias("total_score"),
        F.col("o_orderpriority").alias("model_version"),
        F.col("o_orderdate").alias("scored_at"),
    )


def items(spark: SparkSession, folder: str) -> DataFrame:
    """Events as information items of a user; the day is the event date, purchases have none."""
    e = table(spark, folder, "events")
    return e.select(
        F.col("event_id").alias("item_id"),
        F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("ticker"),
        F.col("event_type").alias("dimension"),
        F.concat(F.lit("s"), F.get_json_object("props", "$.k")).alias("source_key"),
        F.col("event_type").alias("title"),
        F.lit(None).cast("string").alias("source_url"),
        F.when(F.col("event_type") != "purchase", F.to_date("ts")).alias("event_date"),
        F.col("ts").alias("created_at"),
        F.round(F.col("value") / 5, 2).alias("importance_score"),
        F.col("value"),
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Line items as raw observations of a part, repeated over orders."""
    return observation_rows(table(spark, folder, "lineitem"))


def observation_rows(lines: DataFrame) -> DataFrame:
    return lines.select(
        F.col("l_orderkey").alias("run_id"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("ticker"),
        F.concat(F.lit("s"), F.col("l_linenumber").cast("string")).alias("source_key"),
        F.when(F.col("l_returnflag") == "R", "fetch_error").otherwise(F.concat(F.lit("fetch_"), F.lower("l_linestatus"))).alias("observation_type"),
        F.col("l_returnflag").alias("title"),
        F.col("l_linestatus").alias("source_url"),
        F.col("l_shipdate").alias("fetched_at"),
        F.create_map(F.concat(F.lit("f"), F.col("l_returnflag")), F.col("l_quantity").cast("int").cast("string")).alias("metadata"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as collection runs over one to five supplier symbols."""
    o = table(spark, folder, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "DONE").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED")
    cust = F.col("o_custkey").cast("int")
    tickers = F.transform(F.sequence(F.lit(0), cust % 5), lambda i: F.concat(F.lit("S"), ((cust + i) % 100).cast("string")))
    return o.select(
        F.col("o_orderkey").alias("run_id"),
        tickers.alias("tickers"),
        status.alias("status"),
        F.col("o_orderdate").alias("started_at"),
        F.when(status == "DONE", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("finished_at"),
        F.create_map(F.lit("with_flags"), (F.col("o_orderpriority") < F.lit("3")).cast("string")).alias("config"),
    )
