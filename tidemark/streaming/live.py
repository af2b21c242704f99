"""Live bars, panels, rotation and ingest as Structured Streaming jobs.

All jobs read a stream of the same row schemas as the batch operators, write to files with a
checkpoint in the shared folder, and call the batch operators where state is a table.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators import features as X
from tidemark.operators import panel as P
from tidemark.operators.merge import CONTENT, merge_observations, merge_sightings, observations_of, packed, sightings, stable_hash, unpacked
from tidemark.operators.rotation import Strategy
from tidemark.session import shared_dir


def table_stream(spark: SparkSession, folder: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream over the files of a parquet table (a folder of files, or a single file)."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    # a glob lets the file source take a single file as well as a folder
    return reader.parquet(path[:-1] + "[t]")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def live_bars(quotes: DataFrame, minutes: int = 3, delay: str = "10 minutes") -> DataFrame:
    """m-minute bars per symbol in event time; rows later than ``delay`` are dropped."""
    ts = quotes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    span = F.window("ts", f"{minutes} minutes")
    bars = ts.groupBy("symbol", span.alias("w")).agg(
        F.min_by("close", "ts").alias("open"), F.max("close").alias("high"), F.min("close").alias("low"), F.max_by("close", "ts").alias("close"), F.sum("volume").alias("volume"),
        F.count(F.lit(1)).alias("source_rows"),
    )
    return bars.select("symbol", F.col("w.start").alias("bar_start"), F.col("w.end").alias("bar_end"), "open", "high", "low", "close", "volume", "source_rows")


def run_to_files(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Process everything available, write parquet files and read them back."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/data").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/data")


def run_batches(stream: DataFrame, path: str, handle) -> None:
    """Process everything available with ``handle(batch, batch_id)``."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


class StreamLog:
    """Tables of a stream under ``path``, and numbered versions that say which of them hold; a version is written last."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._files = self._hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self, folder: str, prefix: str) -> list[int]:
        where = self._hadoop.Path(f"{self.path}/{folder}")
        if not self._files.exists(where):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(where)]
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())

    def _written(self, folder: str, prefix: str) -> list[int]:
        return [n for n in self._numbers(folder, prefix) if self._files.exists(self._hadoop.Path(f"{self.path}/{folder}/{prefix}{n}/_SUCCESS"))]

    def _read_version(self, number: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/versions/v{number}").first()[0])

    def _write_version(self, number: int, version: dict) -> None:
        self.spark.createDataFrame([(json.dumps(version),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/versions/v{number}")


#: Stands for no time: before all others.
NO_TIME = -(2**63)


class PanelLog(StreamLog):
    """State of the live panel behind every batch: a table of the symbols' states and the points that may still be held.

    A batch's points are one table that is not written again until the open ones are merged; of them a point is held if it is later than its
    symbol's ``until``. A batch that is repeated starts from the version before it and replaces what it wrote, so tables are deleted only
    once that version does not name them.
    """

    POINTS = "symbol string, at long, day int, open double, high double, low double, close double, volume double, turnover double"
    STATES = "symbol string, taken string, until long, late long"
    PANELS = f"{P.SUMMARY}, at long, open double, high double, low double, close double, volume double, turnover double, rows long, late long, taken string, until long"

    def __init__(self, spark: SparkSession, path: str, opening_rows: int, delay: str, most_open: int = 4):
        super().__init__(spark, path)
        self.opening_rows, self.most_open, self.delay_ms = opening_rows, most_open, int(pd.Timedelta(delay) / pd.Timedelta("1ms"))

    def _before(self, batch_id: int) -> dict:
        done = [n for n in self._written("versions", "v") if n < batch_id]
        return self._read_version(done[-1]) if done else {"watermark": 0, "points": [], "states": None}

    def _states(self, name: str | None) -> DataFrame:
        reader = self.spark.read.schema(self.STATES)
        return reader.parquet(f"{self.path}/states/{name}") if name else self.spark.createDataFrame([], self.STATES)

    def _points(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(self.POINTS).parquet(*[f"{self.path}/points/{n}" for n in names])

    def _held(self, names: list[str], states: DataFrame) -> DataFrame:
        """Points of the symbols in ``states`` that are later than what their state has taken."""
        s = states.select(F.col("symbol").alias("__symbol"), F.col("until").alias("__until"))
        points = self._points(names)
        return points.join(s, points["symbol"].eqNullSafe(s["__symbol"])).where(F.col("__until").isNull() | (F.col("at") > F.col("__until"))).drop("__symbol", "__until")

    def _drop_unnamed(self, version: dict) -> None:
        for folder, named in (("points", version["points"]), ("states", [version["states"]]), ("touched", [])):
            where = self._hadoop.Path(f"{self.path}/{folder}")
            for status in self._files.listStatus(where) if self._files.exists(where) else []:
                if status.getPath().getName() not in named:
                    self._files.delete(status.getPath(), True)

    def add(self, batch: DataFrame, batch_id: int) -> None:
        before, own = self._before(batch_id), f"b{batch_id}"
        self._drop_unnamed(before)
        number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c)
        batch.select(
            "symbol", F.coalesce(F.unix_micros("ts"), F.lit(NO_TIME)).alias("at"), F.coalesce(F.unix_date(F.to_date("ts")), F.lit(-(2**31))).alias("day"), *map(number, P.VALUES)
        ).write.mode("overwrite").parquet(f"{self.path}/points/{own}")
        fresh, states = self._points([own]).select("symbol", "at"), self._states(before["states"])

        # the states of the symbols that came, with the late rows counted
        old = states.select(F.col("symbol").alias("__symbol"), "taken", "until", F.col("late").alias("__late"))
        seen = fresh.join(old.drop("taken", "__late"), fresh["symbol"].eqNullSafe(old["__symbol"]), "left").groupBy("symbol").agg(F.count_if(F.col("at") <= F.col("until")).alias("late"))
        touched = seen.join(old, seen["symbol"].eqNullSafe(old["__symbol"]), "left").select("symbol", "taken", "until", (F.col("late") + F.coalesce("__late", F.lit(0))).alias("late"))
        touched.write.mode("overwrite").parquet(f"{self.path}/touched/{own}")
        touched = self.spark.read.schema(self.STATES).parquet(f"{self.path}/touched/{own}")

        names = [*[n for n in before["points"] if n != own], own]
        live = self._held(names, touched).withColumn("ready", F.col("at") <= F.lit(before["watermark"] * 1000))
        self._fold(P.segments(live, self.opening_rows), touched).write.mode("overwrite").parquet(f"{self.path}/data/{own}")
        done = self.spark.read.schema(self.PANELS).parquet(f"{self.path}/data/{own}").select(F.col("symbol").alias("__symbol"), F.col("taken").alias("__taken"), F.col("until").alias("__until"))

        moved = touched.join(done, touched["symbol"].eqNullSafe(done["__symbol"]), "left").select("symbol", F.coalesce("__taken", "taken").alias("taken"), F.coalesce("__until", "until").alias("until"), "late")
        rest = states.join(touched.select(F.col("symbol").alias("__symbol")), F.col("symbol").eqNullSafe(F.col("__symbol")), "left_anti")
        moved.unionByName(rest).write.mode("overwrite").parquet(f"{self.path}/states/{own}")
        if len(names) > self.most_open:
            self._held(names, self._states(own)).write.mode("overwrite").parquet(f"{self.path}/points/{own}-merged")
            names = [f"{own}-merged"]
        newest = fresh.where(F.col("at") > NO_TIME).agg(F.max("at")).first()[0]
        watermark = before["watermark"] if newest is None else max(before["watermark"], newest // 1000 - self.delay_ms)
        self._write_version(batch_id, {"watermark": watermark, "points": names, "states": own})

    def _fold(self, segments: DataFrame, touched: DataFrame) -> DataFrame:
        """A row for every symbol: its panel's summary, and its state behind the ready rows."""
        opening_rows, columns = self.opening_rows, [c.split()[0] for c in self.PANELS.split(", ")]

        def fold(frame: pd.DataFrame) -> pd.DataFrame:
            symbol, taken, until, late = (frame[c].iloc[0] for c in ("__symbol", "taken", "until", "late"))
            symbol = symbol if isinstance(symbol, str) else None
            done, until = json.loads(taken) if isinstance(taken, str) else P.new_state(), json.loads(until) if isinstance(until, str) else None
            frame, last = frame.sort_values("place"), None
            for moves in frame.loc[frame["ready"], "moves"]:
                last = json.loads(moves)
                P.add_segment(done, last, opening_rows)
                until = last["last"][0]
            now = copy.deepcopy(done)
            for moves in frame.loc[~frame["ready"], "moves"]:
                last = json.loads(moves)
                P.add_segment(now, last, opening_rows)
            out = P.summary_frame([P.summary_of(symbol, now)])
            for c, v in zip(("at", *P.VALUES), last["last"]):
                out[c] = v
            out["rows"], out["late"], out["taken"], out["until"] = now["n"], late, json.dumps(done), pd.array([until], "Int64")
            return out[columns]

        # ``until`` goes as text: a long with nulls would come as a double
        s = touched.select(F.col("symbol").alias("__symbol"), "taken", F.col("until").cast("string").alias("until"), "late")
        return segments.join(s, segments["symbol"].eqNullSafe(s["__symbol"])).drop("symbol").groupBy("__symbol").applyInPandas(fold, self.PANELS)

    def panels(self) -> DataFrame:
        """Summaries behind every batch so far."""
        reader = self.spark.read.schema(self.PANELS)
        out = reader.parquet(f"{self.path}/data/*") if self._written("versions", "v") else self.spark.createDataFrame([], self.PANELS)
        time = F.when(F.col("at") > NO_TIME, F.timestamp_micros("at"))
        return out.withColumn("ts", time).drop("at", "taken", "until")


def live_panel(points: DataFrame, path: str, opening_rows: int = 15, delay: str = "30 minutes") -> DataFrame:
    """Indicator panel of every symbol that a batch has points of, one row a batch and symbol with its ``rows`` so far.

    The state of a symbol is that of ``operators.panel``: its averages, its last 21 rows and its session's sums, however long its
    history. Points that the watermark (``delay`` behind the newest) has not passed are held in a table beside it, so they may come in any
    order; they count in every panel. Older ones are dropped and counted in ``late``. Points of one symbol and time count each.
    """
    columns = ["symbol", "ts", *P.VALUES]
    log = PanelLog(points.sparkSession, f"{path}/log", opening_rows, delay)
    typed = points.select(*[F.col(c).cast("timestamp" if c == "ts" else "string" if c == "symbol" else "double") for c in columns])
    run_batches(typed, path, log.add)
    return X.rule_checks(P.panel_from_summary(log.panels().withColumn("session_date", F.to_date("ts")), opening_rows))


def newest_panel(panels: DataFrame) -> DataFrame:
    """The panel after the most rows of every symbol."""
    rest = [c for c in panels.columns if c not in ("symbol", "rows")]
    return panels.groupBy("symbol").agg(F.max_by(F.struct(*rest), "rows").alias("p")).select("symbol", "p.*")


TRADE = T.StructType(
    [
        T.StructField("pair_id", T.StringType()),
        T.StructField("session_date", T.DateType()),
        T.StructField("leg", T.StringType()),
        T.StructField("entry_time", T.TimestampType()),
        T.StructField("exit_time", T.TimestampType()),
        T.StructField("entry_price", T.DoubleType()),
        T.StructField("exit_price", T.DoubleType()),
        T.StructField("reason", T.StringType()),
    ]
)
POSITIONS = T.StructType(
    [
        T.StructField("long", T.DoubleType()),
        T.StructField("long_at", T.TimestampType()),
        T.StructField("short", T.DoubleType()),
        T.StructField("short_at", T.TimestampType()),
    ]
)


def rotation_step(legs: dict, q, strategy: Strategy) -> list[dict]:
    """Apply one point to the open legs and return the trades it closes."""
    if q.rsi is None or q.rsi != q.rsi:
        return []
    closed = []

    def close(leg: str, price: float, reason: str) -> None:
        if legs.get(leg) is not None:
            price_in, at = legs.pop(leg)
            closed.append({"leg": leg, "entry_time": at, "exit_time": q.ts, "entry_price": price_in, "exit_price": price, "reason": reason})

    held = legs.get("long")
    if strategy.take_profit is not None and held is not None and q.long_bid / held[0] - 1 >= strategy.take_profit:
        close("long", q.long_bid, "profit_take")
    elif q.rsi <= strategy.buy:
        close("short", q.short_bid, "oversold")
        legs.setdefault("long", (q.long_ask, q.ts))
    elif q.rsi >= strategy.sell:
        close("long", q.long_bid, "overbought")
        legs.setdefault("short", (q.short_ask, q.ts))
    return closed


def live_rotation(points: DataFrame, strategy: Strategy, delay: str = "1 day") -> DataFrame:
    """Closed trades as points arrive; the open legs of a pair's day are the state.

    Positions never cross days, so state and group are one pair's day; points later than
    ``delay`` are dropped and a day's state leaves once the watermark has passed the day.
    """
    day_ms = 86_400_000

    def update(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        legs = {}
        if state.exists:
            saved = state.get
            for leg, price, at in (("long", saved[0], saved[1]), ("short", saved[2], saved[3])):
                if price is not None:
                    legs[leg] = (price, at)
        rows = pd.concat(list(frames)).sort_values("ts")
        out = [{"pair_id": key[0], "session_date": key[1], **t} for q in rows.itertuples(index=False) for t in rotation_step(legs, q, strategy)]
        long, short = legs.get("long", (None, None)), legs.get("short", (None, None))
        state.update((long[0], long[1], short[0], short[1]))
        over = int(pd.Timestamp(key[1]).timestamp() * 1000) + 2 * day_ms
        if over > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(over)
        yield pd.DataFrame(out, columns=[f.name for f in TRADE.fields])

    typed = points.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    timeout = GroupStateTimeout.EventTimeTimeout
    return typed.groupBy("pair_id", "session_date").applyInPandasWithState(update, TRADE, POSITIONS, "append", timeout)


class IngestLog(StreamLog):
    """Observations as a log of deltas over a base table, both dealt to hash buckets of the content key.

    A batch becomes one delta of ``sightings`` under its id, so a repeated batch replaces itself. Compaction merges the open deltas into the
    buckets that they touch and leaves the other buckets' files where they are; the list of each bucket's version is written last, under a
    new number, so a reader or a lost driver sees the state before or after. A read merges the base with the open deltas only.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, most_deltas: int = 4):
        super().__init__(spark, path)
        self.buckets, self.most_deltas = buckets, most_deltas

    def state(self) -> dict:
        """Version of every bucket's files in the base, and the last batch that they hold."""
        done = self._written("versions", "v")
        if not done:
            return {"number": 0, "upto": -1, "buckets": {}}
        return self._read_version(done[-1])

    def open_deltas(self, state: dict) -> list[int]:
        return [n for n in self._written("deltas", "b") if n > state["upto"]]

    def _bucket(self):
        return F.pmod(F.xxhash64(*CONTENT), F.lit(self.buckets)).cast("int").alias("bucket")

    def append(self, observations: DataFrame, batch_id: int) -> None:
        state = self.state()
        if batch_id <= state["upto"]:
            return  # a batch that was compacted before the stream noted it
        packed(sightings(observations).select("*", self._bucket())).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/deltas/b{batch_id}")
        if len(self.open_deltas(state)) >= self.most_deltas:
            self.compact()

    def _parts(self, state: dict, deltas: list[int], buckets: list[int] | None = None) -> DataFrame | None:
        """Base buckets (those asked for, or all) and deltas, not yet merged."""
        stored = [f"{self.path}/base/v{v}/bucket={b}" for b, v in state["buckets"].items() if buckets is None or int(b) in buckets]
        frames = [self.spark.read.parquet(*stored)] if stored else []
        frames += [self.spark.read.parquet(f"{self.path}/deltas/b{n}").drop("bucket") for n in deltas]
        out = None
        for f in frames:
            f = unpacked(f) if f.schema["raw_hash"].dataType == T.BinaryType() else f  # older files hold the text
            out = f if out is None else out.unionByName(f)
        return out

    def compact(self) -> list[int]:
        """Merges the open deltas into the base; returns the buckets that were written anew."""
        state = self.state()
        deltas = self.open_deltas(state)
        if not deltas:
            return []
        touched = sorted({int(s.getPath().getName().split("=")[1]) for n in deltas for s in self._files.listStatus(self._hadoop.Path(f"{self.path}/deltas/b{n}")) if "=" in s.getPath().getName()})
        number = state["number"] + 1
        if touched:
            merged = merge_sightings(self._parts(state, deltas, touched))
            packed(merged.select("*", self._bucket()).repartition("bucket", F.xxhash64(*CONTENT) % 4)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/base/v{number}")
        following = {"number": number, "upto": deltas[-1], "buckets": {**state["buckets"], **{str(b): number for b in touched}}}
        self._write_version(number, following)
        for n in deltas:
            self._files.delete(self._hadoop.Path(f"{self.path}/deltas/b{n}"), True)
        return touched

    def read(self) -> DataFrame | None:
        state = self.state()
        parts = self._parts(state, self.open_deltas(state))
        return None if parts is None else observations_of(parts)


def live_ingest(observations: DataFrame, path: str, parts: tuple[str, ...] = ("ticker", "source_key", "observation_type", "title", "source_url"), buckets: int = 16, most_deltas: int = 4) -> DataFrame:
    """Merge a stream of observations by the hash of their content; a content that is seen again is refreshed.

    Every batch is one delta of an ``IngestLog``, late and repeated rows included: the first sighting by time keeps
    title and address, the last one gives run, time and metadata values, whatever the batch borders were.
    """
    spark = observations.sparkSession
    log = IngestLog(spark, f"{path}/log", buckets, most_deltas)

    def handle(batch: DataFrame, batch_id: int) -> None:
        log.append(batch.withColumn("raw_hash", stable_hash(*parts)), batch_id)

    run_batches(observations, path, handle)
    stored = log.read()
    return merge_observations(spark.createDataFrame([], observations.schema).withColumn("raw_hash", stable_hash(*parts))) if stored is None else stored
