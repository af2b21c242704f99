"""The panel from session summaries, and its stream, against the plain window form over all rows."""

from __future__ import annotations

import copy
import datetime as dt
import json
import pathlib
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators import panel as P
from tidemark.streaming import live as L

SCHEMA = "symbol string, ts timestamp, open double, high double, low double, close double, volume double, turnover double"
SKIPPED = {"session_date"}


def points(seed: int, nulls: bool, days=(1, 40, 3, 1, 1, 12, 9, 8, 60, 5, 7)):
    """Sessions of very different length; some rows without a price, a volume or a turnover."""
    rng = random.Random(seed)
    rows = []
    for symbol in ("long", "short", "flat", "one"):
        price = 50.0
        for d, n in enumerate({"long": days, "short": days[:4], "flat": days[:6], "one": (1,)}[symbol]):
            at = dt.datetime(2024, 3, 1, 9, 30) + dt.timedelta(days=d)
            for i in range(n):
                price = price if symbol == "flat" else max(1.0, price * (1 + rng.gauss(0, 0.004)))
                high, low = (price, price) if symbol == "flat" else (price * 1.002, price * 0.997)
                row = [symbol, at + dt.timedelta(minutes=i), price, high, low, price, float(rng.randrange(0, 500)), rng.choice([0.0, None, price * 100])]
                if nulls and rng.random() < 0.15:
                    row[rng.choice([3, 4, 5, 6])] = None
                rows.append(tuple(row))
    return rows


def plain(df):
    full = X.rule_checks(X.panel_columns(df))
    rest = [c for c in full.columns if c != "symbol"]
    return full.groupBy("symbol").agg(F.max_by(F.struct(*rest), "ts").alias("p")).select("symbol", "p.*")


def same(got, want, columns):
    assert got.keys() == want.keys()
    for symbol, row in want.items():
        for c in columns:
            a, b = got[symbol][c], row[c]
            if isinstance(b, float) and a is not None:
                assert a == pytest.approx(b, rel=1e-9, abs=1e-9), (symbol, c)
            else:
                assert a == b, (symbol, c, a, b)


def by_symbol(df):
    return {r["symbol"]: r.asDict() for r in df.collect()}


@pytest.mark.parametrize("seed,nulls", [(1, False), (2, False), (3, True), (4, True)])
def test_summaries_equal_the_windows_over_all_rows(spark, seed, nulls):
    df = spark.createDataFrame(points(seed, nulls), SCHEMA)
    want = plain(df)
    same(by_symbol(X.latest_panel(df)), by_symbol(want), [c for c in want.columns if c not in SKIPPED])


def test_no_points(spark):
    assert X.latest_panel(spark.createDataFrame([], SCHEMA)).count() == 0


def test_symbols_do_not_meet_with_all_their_minutes(spark):
    plan = P.summaries(spark.createDataFrame(points(1, False), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line or "Window[" in line or "Window [" in line]
    assert windows and all("day" in line.split("windowspecdefinition(", 1)[1].split(",")[1] for line in windows)


def test_every_batch_gives_the_panel_of_the_rows_so_far(spark, tmp_path):
    """Three batches, a restart between them, rows out of order inside the delay, and a late one."""
    rows = sorted(points(5, True), key=lambda r: r[1])
    cut = [0, len(rows) // 3, len(rows) // 2, len(rows)]
    parts = [rows[a:b] for a, b in zip(cut, cut[1:])]
    early = [parts[1].pop(0) for _ in range(1)]  # comes one batch after its time, still inside the delay
    parts[2] = parts[2] + early
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    for i, part in enumerate(parts):
        part = sorted(part, key=lambda r: hash((r[0], r[1].minute)))
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        got = L.newest_panel(L.live_panel(stream, path, delay="30 days"))
        so_far = spark.createDataFrame([r for p in parts[: i + 1] for r in p], SCHEMA)
        want = plain(so_far)
        same(by_symbol(got), by_symbol(want), [c for c in want.columns if c not in SKIPPED])
    shutil.rmtree(path)


def test_rows_behind_the_watermark_are_counted_as_late(spark, tmp_path):
    rows = sorted((r for r in points(6, False) if r[0] == "long"), key=lambda r: r[1])
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    for part in (rows[:60], rows[60:120], [rows[0]] + rows[120:]):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        got = L.newest_panel(L.live_panel(spark.readStream.schema(SCHEMA).parquet(source), path, delay="10 minutes"))
    out = by_symbol(got)["long"]
    same({"long": out}, by_symbol(plain(spark.createDataFrame(rows, SCHEMA))), ["ema9", "ema21", "kdj_k", "kdj_d", "vwap", "atr", "rsi14", "bias_score"])
    assert out["late"] == 1


def stepped(batches, delay_ms, opening_rows=15):
    """The live panel in plain Python: every row is held by symbol and stepped; panel summaries of every batch."""
    states, watermark, out = {}, 0, []
    epoch = dt.datetime(1970, 1, 1)
    for rows in batches:
        came = {}
        for symbol, ts, *values in rows:
            at = L.NO_TIME if ts is None else (ts - epoch) // dt.timedelta(microseconds=1)
            came.setdefault(symbol, []).append([at, -(2**31) if ts is None else at // 86_400_000_000, *values])
        for symbol, new in came.items():
            s = states.setdefault(symbol, {"taken": P.new_state(), "held": [], "until": None, "late": 0})
            late = [r for r in new if s["until"] is not None and r[0] <= s["until"]]
            s["late"] += len(late)
            live = sorted([r for r in [*s["held"], *new] if s["until"] is None or r[0] > s["until"]], key=lambda r: (r[0], [(v is not None, v or 0.0) for v in r[2:]]))
            ready, s["held"] = [r for r in live if r[0] <= watermark * 1000], [r for r in live if r[0] > watermark * 1000]
            s["until"] = ready[-1][0] if ready else s["until"]

            def take(state, r):
                P.day_step(state, r[1], (r[0], *r[3:7]), r[7], opening_rows)
                P.step(state, (r[0], *r[3:7]))

            for r in ready:
                take(s["taken"], r)
            now = copy.deepcopy(s["taken"])
            for r in s["held"]:
                take(now, r)
            if live:
                at, _, *values = live[-1]
                out.append({**P.summary_of(symbol, now), "at": at, **dict(zip(P.VALUES, values)), "rows": now["n"], "late": s["late"]})
        times = [r[1] for r in rows if r[1] is not None]
        if times:
            watermark = max(watermark, (max(times) - epoch) // dt.timedelta(milliseconds=1) - delay_ms)
    return out


def agree(got, want):
    key = lambda r: (r["symbol"] or "", r["rows"], r["late"], r["at"])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
        for c, v in b.items():
            exact = v is None or isinstance(v, (str, int, list))
            assert a[c] == (v if exact else pytest.approx(v, rel=1e-9, abs=1e-9)), (b["symbol"], c, a[c], v)


def drawn(seed, n, symbols, spread):
    """Ticks in rough order of time: ties, nulls in every column, symbols that pause."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        symbol = rng.choices([*symbols, None], [30, 20, 10, 1, 1][: len(symbols)] + [1])[0]
        at = dt.datetime(2024, 3, 1, 20) + dt.timedelta(seconds=20 * (i + rng.randrange(-spread, spread + 1)) // 30 * 30)
        price = 50 + rng.gauss(0, 2)
        row = [symbol, None if rng.random() < 0.005 else at, price, price + 1, price - 1, price, float(rng.randrange(0, 50)), rng.choice([0.0, None, price * 10])]
        for c in (3, 4, 5, 6):
            if rng.random() < 0.08:
                row[c] = None
        rows.append(tuple(row))
    return rows


@pytest.mark.parametrize("delay,ms,opening", [("2 minutes", 120_000, 15), ("3 hours", 10_800_000, 4)])
def test_batches_equal_a_step_by_step_panel(spark, tmp_path, delay, ms, opening):
    """Seven batches, so open points are merged; late rows, ties, missing times and symbols, a symbol that pauses, a batch that is repeated."""
    rows = drawn(7, 1400, ["a", "b", "c", "d"], 8)
    batches = [rows[i * 200 : (i + 1) * 200] for i in range(7)]
    batches[2] = [r for r in batches[2] if r[0] != "b"]
    log = L.PanelLog(spark, f"{tmp_path}/log", opening, delay)
    for i, batch in enumerate(batches):
        for _ in range(2 if i in (0, 5) else 1):
            log.add(spark.createDataFrame(batch, SCHEMA), i)
    got = [r.asDict() for r in spark.read.schema(log.PANELS).parquet(f"{log.path}/data/*").collect()]
    want = stepped(batches, ms, opening)
    assert max(r["late"] for r in want) > 0
    agree(got, want)
    assert len(log._before(7)["points"]) <= log.most_open


def test_an_empty_batch_and_no_batch(spark, tmp_path):
    rows = drawn(3, 60, ["a"], 2)
    log = L.PanelLog(spark, f"{tmp_path}/log", 15, "2 minutes")
    assert log.panels().count() == 0
    for i, batch in enumerate([[], rows[:30], [], rows[30:]]):
        log.add(spark.createDataFrame(batch, SCHEMA), i)
    agree([r.asDict() for r in spark.read.schema(log.PANELS).parquet(f"{log.path}/data/*").collect()], stepped([rows[:30], rows[30:]], 120_000))


def test_one_file_of_a_symbol_is_not_held_by_one_task(spark, tmp_path):
    """All points come before there is a watermark; no segment has most of them, no state grows with them."""
    rng, rows = random.Random(2), []
    for i in range(30_000):
        price = 50 + rng.gauss(0, 2)
        rows.append(("a", dt.datetime(2024, 3, 1, 20) + dt.timedelta(seconds=i), price, price + 1, price - 1, None if 9000 < i < 13_500 or rng.random() < 0.1 else price, float(rng.randrange(0, 50)), 0.0))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    path = f"{tmp_path}/out"
    got = L.newest_panel(L.live_panel(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), path))
    want = plain(df)
    columns = [c for c in want.columns if c not in SKIPPED]
    same(by_symbol(got), by_symbol(want), columns)

    files = [f for f in pathlib.Path(path).rglob("*") if f.is_file() and "checkpoint" in f.parts]
    assert sum(f.stat().st_size for f in files) < 100_000  # the stream's own state has no points
    points = df.select("symbol", F.lit(False).alias("ready"), F.unix_micros("ts").alias("at"), F.unix_date(F.to_date("ts")).alias("day"), *P.VALUES)
    found = [(len(r["moves"]), json.loads(r["moves"])["rows"]) for r in P.segments(points).collect()]
    assert sum(n for _, n in found) == len(rows) and max(n for _, n in found) < len(rows) / 2
    assert max(size for size, _ in found) < 10_000
