"""Latest indicator panel of every symbol from mergeable summaries of its sessions.

A session becomes one row: its first and last rows, its sums, and for everything between them the affine map by which it moves the
recursive averages (``y -> a*y + b``, and one over two values for K and D). The maps of a symbol's sessions, in order, are applied
one after another, so no task ever holds a symbol's minutes: rows meet per (symbol, session), then one row a session meets per
symbol. A stream (``streaming.live.live_panel``) deals its rows to ranges of symbol and time and makes a segment of every run of a
symbol in a range, with the same maps but over any number of days; both end in ``panel_from_summary``.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.numeric import div, pct_diff
from tidemark.functions.smoothing import rsi_from

#: Rows of the longest look-back (20 earlier volumes and the row itself), of the KDJ range, and of the slope.
KEPT, RANGE, LAG = 21, 9, 5
#: Weights of the two averages and of K and D.
FAST, SLOW, THIRD = 2 / 10, 2 / 22, 1 / 3

POINT = "ts timestamp, high double, low double, close double, volume double"
SUMMARY = (
    "symbol string, n long, session_rows long, ema9 double, ema21 double, ema9_before double, kdj_k double, kdj_d double, value_sum double, volume_sum double, "
    "or_high double, or_low double, highs array<double>, lows array<double>, closes array<double>, volumes array<double>"
)


# --- one state, stepped by rows or moved by whole segments -------------------------------------


def _number(x) -> float | None:
    return None if x is None or (isinstance(x, float) and math.isnan(x)) else float(x)


def new_state() -> dict:
    return {"n": 0, "y": [None, None], "gap": [0, 0], "k": None, "d": None, "k_gap": 0, "rows": [], "fast": [], "day": None, "day_rows": 0, "value": None, "volume": None, "high": None, "low": None}


def _average(y: float | None, gap: int, x: float | None, alpha: float) -> tuple[float | None, int]:
    """One step of an average; missing rows let the old weight decay, as the batch smoother does."""
    if x is None:
        return y, gap + 1
    if y is None:
        return x, 1
    old = (1 - alpha) ** gap
    share = old / (old + alpha)
    return share * y + (1 - share) * x, 1


def _range_position(rows: list) -> float | None:
    """Place of the last close in the range of ``RANGE`` rows; 50 on a flat range."""
    lows = [r[2] for r in rows[-RANGE:] if r[2] is not None]
    highs = [r[1] for r in rows[-RANGE:] if r[1] is not None]
    if not lows or not highs:
        return None
    low, high = min(lows), max(highs)
    if high <= low:
        return 50.0
    return None if rows[-1][3] is None else (rows[-1][3] - low) / (high - low) * 100


def _kd_step(s: dict, rsv: float | None) -> None:
    if s["k"] is None:
        if rsv is None:
            return
        s["k"], s["k_gap"] = (1 - THIRD) * 50.0 + THIRD * rsv, 1
        s["d"] = (1 - THIRD) * 50.0 + THIRD * s["k"]
        return
    s["k"], s["k_gap"] = _average(s["k"], s["k_gap"], rsv, THIRD)
    s["d"] = (1 - THIRD) * s["d"] + THIRD * s["k"]


def step(s: dict, row: tuple) -> None:
    """One more row (ts, high, low, close, volume) of the symbol: averages and the kept rows."""
    row = (row[0], *map(_number, row[1:5]))
    s["n"] += 1
    s["rows"] = [*s["rows"], row][-KEPT:]
    for i, alpha in enumerate((FAST, SLOW)):
        s["y"][i], s["gap"][i] = _average(s["y"][i], s["gap"][i], row[3], alpha)
    s["fast"] = [*s["fast"], s["y"][0]][-(LAG + 1) :]
    _kd_step(s, _range_position(s["rows"]) if s["n"] >= RANGE else None)


def day_step(s: dict, day, row: tuple, turnover: float | None, opening_rows: int) -> None:
    """The session's own sums for one more row; a new day starts them anew."""
    if s["day"] != day:
        s |= {"day": day, "day_rows": 0, "value": None, "volume": None, "high": None, "low": None}
    s["day_rows"] += 1
    high, low, close, volume, turnover = map(_number, (*row[1:5], turnover))
    if s["day_rows"] <= opening_rows:
        s["high"] = high if s["high"] is None else s["high"] if high is None else max(s["high"], high)
        s["low"] = low if s["low"] is None else s["low"] if low is None else min(s["low"], low)
    if volume is not None and volume > 0:
        value = turnover if turnover is not None and turnover > 0 else None if None in (high, low, close) else (high + low + close) / 3 * volume
        s["volume"] = (s["volume"] or 0.0) + volume
        if value is not None:
            s["value"] = (s["value"] or 0.0) + value


def _move(s: dict, between: dict) -> None:
    """The rows between a session's first and last ones, as one map of every average."""
    for i, name in enumerate(("fast", "slow")):
        m = between[name]
        if m["first"] is None:
            s["gap"][i] += between["rows"]
            continue
        y, _ = _average(s["y"][i], s["gap"][i] + m["lead"], m["first"], (FAST, SLOW)[i])
        s["y"][i], s["gap"][i] = m["a"] * y + m["b"], m["gap"]
    m = between["kd"]
    if m["first"] is None:
        for _ in range(between["rows"]):
            _kd_step(s, None)
        return
    for _ in range(m["lead"]):
        _kd_step(s, None)
    _kd_step(s, m["first"])
    k, d = s["k"], s["d"]
    s["k"], s["d"], s["k_gap"] = m["a"] * k + m["b"], m["c"] * k + m["e"] * d + m["f"], m["gap"]


def add_session(s: dict, session: dict) -> None:
    """Moves a symbol's state over one session."""
    head, tail = [tuple(r) for r in session["head"]], [tuple(r) for r in session["tail"]]
    for row in head:
        step(s, row)
    rest = session["rows"] - len(head)
    if rest:
        between, last = rest - min(rest, LAG), min(rest, LAG)
        if between:
            _move(s, session["between"])
            s["n"] += between
            s["fast"] = [s["y"][0]]
        rows = [(r[0], *map(_number, r[1:5])) for r in tail]
        s["rows"] = [*s["rows"], *rows[: len(rows) - last][-between:]][-KEPT:] if between else s["rows"]
        for row in rows[len(rows) - last :]:
            step(s, row)
    s |= {"day": session["day"], "day_rows": session["rows"], "value": _number(session["value"]), "volume": _number(session["volume"]), "high": _number(session["or_high"]), "low": _number(session["or_low"])}


def summary_of(symbol: str, s: dict) -> dict:
    column = lambda i: [r[i] for r in s["rows"]]
    before = s["fast"][-(LAG + 1)] if len(s["fast"]) > LAG else None
    return {
        "symbol": symbol, "n": s["n"], "session_rows": s["day_rows"], "ema9": s["y"][0], "ema21": s["y"][1], "ema9_before": before, "kdj_k": s["k"], "kdj_d": s["d"], "value_sum": s["value"], "volume_sum": s["volume"],
        "or_high": s["high"], "or_low": s["low"], "highs": column(1), "lows": column(2), "closes": column(3), "volumes": column(4),
    }


def summary_frame(rows: Iterable[dict]) -> pd.DataFrame:
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    kinds = {c.split()[0]: {"double": "float64", "long": "int64"}.get(c.split()[1], "object") for c in SUMMARY.split(", ")}
    return pd.DataFrame([[r[c] for c in names] for r in rows], columns=names).astype(kinds)


# --- sessions ----------------------------------------------------------------------------------


def _average_map(alpha: float) -> Column:
    """Start of a map: nothing seen. ``first`` is the first value, ``lead`` the rows before it, then ``y = a*y0 + b``."""
    return F.struct(F.lit(None).cast("double").alias("first"), F.lit(0).alias("lead"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0).alias("gap"))


def _share(m: Column, alpha: float) -> Column:
    old = F.pow(F.lit(1 - alpha), m["gap"].cast("double"))
    return old / (old + F.lit(alpha))


def _average_next(m: Column, x: Column, alpha: float) -> Column:
    share, begun = _share(m, alpha), m["first"].isNotNull()
    seen = x.isNotNull()
    return F.struct(
        F.coalesce(m["first"], x).alias("first"),
        F.when(begun | seen, m["lead"]).otherwise(m["lead"] + 1).alias("lead"),
        F.when(begun & seen, share * m["a"]).otherwise(m["a"]).alias("a"),
        F.when(begun & seen, share * m["b"] + (1 - share) * x).otherwise(m["b"]).alias("b"),
        F.when(seen, F.lit(1)).when(begun, m["gap"] + 1).otherwise(F.lit(0)).alias("gap"),
    )


def _kd_map() -> Column:
    none = F.lit(None).cast("double")
    return F.struct(none.alias("first"), F.lit(0).alias("lead"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("c"), F.lit(1.0).alias("e"), F.lit(0.0).alias("f"), F.lit(0).alias("gap"))


def _kd_next(m: Column, x: Column) -> Column:
    """``K = a*K0 + b`` and ``D = c*K0 + e*D0 + f`` behind the first value; D follows K in every row."""
    plain = _average_next(m, x, THIRD)
    begun = m["first"].isNotNull()
    beta = F.lit(1 - THIRD)
    return F.struct(
        plain["first"].alias("first"), plain["lead"].alias("lead"), plain["a"].alias("a"), plain["b"].alias("b"),
        F.when(begun, beta * m["c"] + THIRD * plain["a"]).otherwise(m["c"]).alias("c"),
        F.when(begun, beta * m["e"]).otherwise(m["e"]).alias("e"),
        F.when(begun, beta * m["f"] + THIRD * plain["b"]).otherwise(m["f"]).alias("f"),
        plain["gap"].alias("gap"),
    )


def sessions(points: DataFrame, opening_rows: int = 15) -> DataFrame:
    """One row per (symbol, day): first ``RANGE - 1`` and last ``KEPT`` rows, sums, and the maps of the rows between. One exchange, on the session."""
    s = Window.partitionBy("symbol", "day").orderBy("ts")
    df = points.select("symbol", F.to_date("ts").alias("day"), F.col("ts").cast("timestamp").alias("ts"), *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume", "turnover")])
    lo, hi = F.min("low").over(s.rowsBetween(1 - RANGE, 0)), F.max("high").over(s.rowsBetween(1 - RANGE, 0))
    df = df.withColumns({"lo": lo, "hi": hi, "at": F.row_number().over(s), "rows": F.count(F.lit(1)).over(Window.partitionBy("symbol", "day"))})
    rsv = F.when(F.col("hi") <= F.col("lo"), F.lit(50.0)).otherwise(div(F.col("close") - F.col("lo"), F.col("hi") - F.col("lo")) * 100)
    point = F.struct("ts", "high", "low", "close", "volume")
    middle = (F.col("at") >= RANGE) & (F.col("at") <= F.col("rows") - LAG)
    opening, used = F.col("at") <= opening_rows, F.col("volume") > 0
    value = F.when(F.col("turnover") > 0, F.col("turnover")).otherwise((F.col("high") + F.col("low") + F.col("close")) / 3 * F.col("volume"))
    grouped = df.groupBy("symbol", "day").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sort_array(F.collect_list(F.when(F.col("at") < RANGE, point))).alias("head"),
        F.sort_array(F.collect_list(F.when(F.col("at") > F.col("rows") - KEPT, point))).alias("tail"),
        F.sort_array(F.collect_list(F.when(middle, F.struct("ts", "close", rsv.alias("rsv"))))).alias("middle"),
        F.sum(F.when(used, value)).alias("value"),
        F.sum(F.when(used, F.col("volume"))).alias("volume"),
        F.max(F.when(opening, F.col("high"))).alias("or_high"),
        F.min(F.when(opening, F.col("low"))).alias("or_low"),
    )
    start = F.struct(_average_map(FAST).alias("fast"), _average_map(SLOW).alias("slow"), _kd_map().alias("kd"))
    between = F.aggregate(
        "middle", start, lambda m, r: F.struct(_average_next(m["fast"], r["close"], FAST).alias("fast"), _average_next(m["slow"], r["close"], SLOW).alias("slow"), _kd_next(m["kd"], r["rsv"]).alias("kd"))
    )
    maps = F.struct(F.size("middle").alias("rows"), between["fast"].alias("fast"), between["slow"].alias("slow"), between["kd"].alias("kd"))
    return grouped.select("symbol", "day", "rows", "head", "tail", maps.alias("between"), "value", "volume", "or_high", "or_low")


def summaries(points: DataFrame, opening_rows: int = 15) -> DataFrame:
    """State of every symbol behind its last session: a fold over one row a session."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        s = new_state()
        for session in frame.sort_values("day").to_dict("records"):
            add_session(s, {**session, "head": [tuple(r.values()) for r in session["head"]], "tail": [tuple(r.values()) for r in session["tail"]], "between": _plain(session["between"])})
        return summary_frame([summary_of(frame["symbol"].iloc[0], s)])

    return sessions(points, opening_rows).groupBy("symbol").applyInPandas(fold, SUMMARY)


def _plain(between: dict) -> dict:
    return {k: ({**v, "first": _number(v["first"])} if isinstance(v, dict) else int(v)) for k, v in between.items()}


# --- segments: consecutive rows of a symbol, of any number and any days -------------------------------

#: Columns of a point in the order that ranks points of one time; ``at`` is in microseconds, ``day`` the day's number.
VALUES = ["open", "high", "low", "close", "volume", "turnover"]
SEGMENT = "symbol string, ready boolean, place long, moves string"
#: Rows that are folded at once (few enough for products of weights not to vanish) and the least factor of a map.
BLOCK, LEAST = 1000, 5e-324


def _fold_average(m: dict, x: np.ndarray, alpha: float) -> None:
    """Moves the map of an average over a block; NaN is a missing row."""
    seen = np.flatnonzero(x == x)
    if not len(seen):
        m["lead" if m["first"] is None else "gap"] += len(x)
        return
    gaps = np.diff(seen, prepend=-m["gap"])
    end = len(x) - int(seen[-1])
    if m["first"] is None:
        m["first"], m["lead"] = float(x[seen[0]]), m["lead"] + int(seen[0])
        seen, gaps = seen[1:], gaps[1:]
    m["gap"] = end
    old = (1 - alpha) ** gaps.astype(float)
    share = old / (old + alpha)
    later = np.cumprod(np.append(share, 1.0)[::-1])[::-1]  # what is left of a row behind the block, of the start first
    m["b"] = float(later[0] * m["b"] + np.sum((1 - share) * x[seen] * later[1:]))
    m["a"] = max(float(later[0] * m["a"]), LEAST)


def _fold_kd(m: dict, values: list, known: list) -> None:
    """Moves the map of K and D over a block; D follows K in every row behind the first value."""
    first, a, b, c, e, f, gap, beta = m["first"], m["a"], m["b"], m["c"], m["e"], m["f"], m["gap"], 1 - THIRD
    for x, seen in zip(values, known):
        if first is None:
            if seen:
                first, gap = x, 1
            else:
                m["lead"] += 1
            continue
        if seen:
            old = beta**gap
            share = old / (old + THIRD)
            a, b, gap = share * a, share * b + (1 - share) * x, 1
        else:
            gap += 1
        c, e, f = beta * c + THIRD * a, beta * e, beta * f + THIRD * b
    m |= {"first": first, "a": max(a, LEAST), "b": b, "c": c, "e": max(e, LEAST), "f": f, "gap": gap}


class Segment:
    """What consecutive rows of a symbol do to its state, whatever that is: taken piece by piece, of which the last rows are kept."""

    def __init__(self, opening_rows: int):
        self.opening_rows, self.rows, self.mapped = opening_rows, 0, RANGE - 1
        self.head, self.at, self.kept = [], np.empty(0, "int64"), np.empty((0, len(VALUES)))
        self.day, self.day_rows, self.value, self.volume, self.opening = None, 0, None, None, []
        average = {"first": None, "lead": 0, "a": 1.0, "b": 0.0, "gap": 0}
        self.between = {"rows": 0, "fast": dict(average), "slow": dict(average), "kd": {**average, "c": 0.0, "e": 1.0, "f": 0.0}}

    def add(self, at: np.ndarray, day: np.ndarray, values: np.ndarray) -> None:
        """The next rows, in order; a missing value is NaN."""
        self._add_day(day, values)
        if len(self.head) < RANGE - 1:
            self.head += _points(at, values)[: RANGE - 1 - len(self.head)]
        at, values = np.concatenate([self.at, at]), np.concatenate([self.kept, values])
        self.rows += len(at) - len(self.at)
        start = self.rows - len(at)  # place of the first of these rows in the segment
        if self.rows - LAG > self.mapped:
            self._map(values, self.mapped - start, self.rows - LAG - start)
            self.mapped = self.rows - LAG
        self.at, self.kept = at[-KEPT:].copy(), values[-KEPT:].copy()

    def _add_day(self, day: np.ndarray, values: np.ndarray) -> None:
        """Sums of the segment's last day and its first rows in the segment."""
        last = int(day[-1])
        if last != self.day:
            self.day, self.day_rows, self.value, self.volume, self.opening = last, 0, None, None, []
        rows = values[np.searchsorted(day, last) :]
        self.day_rows += len(rows)
        self.opening += [[_number(h), _number(w)] for h, w in rows[: max(0, self.opening_rows - len(self.opening)), 1:3].tolist()]
        rows = rows[rows[:, 4] > 0]
        if len(rows):
            self.volume = (self.volume or 0.0) + float(rows[:, 4].sum())
            value = np.where(rows[:, 5] > 0, rows[:, 5], (rows[:, 1] + rows[:, 2] + rows[:, 3]) / 3 * rows[:, 4])
            value = value[value == value]
            if len(value):
                self.value = (self.value or 0.0) + float(value.sum())

    def _map(self, values: np.ndarray, begin: int, end: int) -> None:
        high, low, close = values[:end, 1], values[:end, 2], values[begin:end, 3]
        hi, lo = high[begin:], low[begin:]
        for k in range(1, RANGE):
            hi, lo = np.fmax(hi, high[begin - k : end - k]), np.fmin(lo, low[begin - k : end - k])
        flat = hi <= lo
        known = flat | ((hi == hi) & (lo == lo) & (close == close))
        with np.errstate(divide="ignore", invalid="ignore"):
            rsv = np.where(flat, 50.0, (close - lo) / (hi - lo) * 100)
        for i in range(0, end - begin, BLOCK):
            _fold_average(self.between["fast"], close[i : i + BLOCK], FAST)
            _fold_average(self.between["slow"], close[i : i + BLOCK], SLOW)
        _fold_kd(self.between["kd"], rsv.tolist(), known.tolist())
        self.between["rows"] += end - begin

    def moves(self) -> str:
        last = [int(self.at[-1]), *map(_number, self.kept[-1].tolist())]
        return json.dumps(
            {"rows": self.rows, "head": self.head, "tail": _points(self.at, self.kept), "between": self.between, "day": self.day, "day_rows": self.day_rows, "value": self.value, "volume": self.volume, "opening": self.opening, "last": last}
        )


def _points(at: np.ndarray, values: np.ndarray) -> list[list]:
    """Time, high, low, close and volume of rows."""
    return [[t, *map(_number, v)] for t, v in zip(at.tolist(), values[:, 1:5].tolist())]


def add_segment(s: dict, segment: dict, opening_rows: int) -> None:
    """Moves a symbol's state over one segment; the segment's last day may have begun before it."""
    day = {k: s[k] for k in ("day", "day_rows", "value", "volume", "high", "low")}
    add_session(s, {**segment, "or_high": None, "or_low": None})
    if day["day"] != segment["day"]:
        day = {"day": segment["day"], "day_rows": 0, "value": None, "volume": None, "high": None, "low": None}
    for high, low in segment["opening"][: max(0, opening_rows - day["day_rows"])]:
        day["high"] = high if day["high"] is None else day["high"] if high is None else max(day["high"], high)
        day["low"] = low if day["low"] is None else day["low"] if low is None else min(day["low"], low)
    day["day_rows"] += segment["day_rows"]
    for k in ("value", "volume"):
        if segment[k] is not None:
            day[k] = (day[k] or 0.0) + segment[k]
    s |= day


def segments(points: DataFrame, opening_rows: int = 15) -> DataFrame:
    """A row for every run of a symbol's rows in a range of the order by symbol, ``at`` and values, ``ready`` rows apart; ``place`` orders them.

    ``points`` has symbol, ready, at, day and the values; a symbol's ready rows must be its earliest. The rows are dealt to ranges, so no task
    holds a symbol's rows, and a task holds one Arrow batch of its range.
    """

    def runs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, number, key, segment, out = TaskContext.get().partitionId(), 0, None, None, []
        for frame in frames:
            names, ready = [x if isinstance(x, str) else None for x in frame["symbol"]], frame["ready"].tolist()
            at, day, values = frame["at"].to_numpy("int64"), frame["day"].to_numpy("int64"), frame[VALUES].to_numpy("float64")
            keys = list(zip(names, ready))
            borders = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for i, j in zip(borders, [*borders[1:], len(keys)]):
                if segment is None or keys[i] != key:
                    if segment is not None:
                        out.append((*key, (part << 33) + number, segment.moves()))
                    key, number, segment = keys[i], number + 1, Segment(opening_rows)
                segment.add(at[i:j], day[i:j], values[i:j])
                if len(out) == BLOCK:
                    yield pd.DataFrame(out, columns=["symbol", "ready", "place", "moves"])
                    out = []
        if segment is not None:
            out.append((*key, (part << 33) + number, segment.moves()))
        yield pd.DataFrame(out, columns=["symbol", "ready", "place", "moves"])

    order = ["symbol", "at", *VALUES]
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = points.select("symbol", "ready", "at", "day", *VALUES).repartitionByRange(n, *order).sortWithinPartitions(*order)
    return dealt.mapInPandas(runs, SEGMENT)


# --- panel of a summary ------------------------------------------------------------------------


def _back(name: str, k: int) -> Column:
    """Value ``k`` rows before the last one, null where there is none."""
    return F.try_element_at(F.col(name), F.lit(-1 - k))


def _mean(items: Column) -> Column:
    known = F.filter(items, lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(known) > 0, total / F.size(known))


def _deviation(items: Column, mean: Column) -> Column:
    known = F.filter(items, lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    return F.when(F.size(known) > 1, F.sqrt(total / (F.size(known) - 1)))


def _last(items: Column, k: int) -> Column:
    return F.slice(items, F.greatest(F.lit(1), F.size(items) - k + 1), F.lit(k))


def panel_from_summary(newest: DataFrame, opening_rows: int = 15) -> DataFrame:
    """All panel columns of rows that hold a symbol's last point beside its summary."""
    closes, highs, lows, volumes = (F.col(c) for c in ("closes", "highs", "lows", "volumes"))
    places = F.sequence(F.lit(1), F.size(closes))
    at = lambda items, i: F.try_element_at(items, i)
    steps = F.transform(places, lambda i: F.when(i > 1, at(closes, i) - at(closes, F.greatest(i - 1, F.lit(1)))))
    ranges = F.transform(
        places,
        lambda i: F.greatest(
            at(highs, i) - at(lows, i),
            F.when(i > 1, F.abs(at(highs, i) - at(closes, F.greatest(i - 1, F.lit(1))))),
            F.when(i > 1, F.abs(at(lows, i) - at(closes, F.greatest(i - 1, F.lit(1))))),
        ),
    )
    earlier = F.filter(F.slice(volumes, F.lit(1), F.size(volumes) - 1), lambda v: v >= 0)
    used = F.col("volume") > 0
    ratio = div("value_sum", "volume_sum")
    df = newest.withColumns({"__steps": _last(steps, 14), "__ranges": _last(ranges, 14), "__earlier": earlier, "vwap": F.when(used, F.bround(ratio, 6)).otherwise(ratio)})
    df = df.withColumns({"__avg": _mean(F.col("__earlier"))})
    df = df.withColumns({"__sd": _deviation(F.col("__earlier"), F.col("__avg")), "__ratio": F.when(F.col("__avg") > 0, div("volume", "__avg"))})
    full = F.size(F.filter("__steps", lambda x: x.isNotNull())) == 14
    gain, loss = _mean(F.transform("__steps", lambda x: F.greatest(x, F.lit(0.0)))), _mean(F.transform("__steps", lambda x: F.greatest(-x, F.lit(0.0))))
    state = F.when(F.col("__ratio").isNull(), "unknown").when(F.col("__ratio") >= 2.0, "spike").when(F.col("__ratio") <= 0.5, "dry").otherwise("normal")
    short = F.col("n") < RANGE
    df = df.withColumns(
        {
            "rsi14": F.when(full, F.bround(rsi_from(gain, loss), 2)),
            "volume_avg20": F.bround("__avg", 2),
            "volume_ratio": F.bround("__ratio", 2),
            "volume_z": F.bround(div(F.col("volume") - F.col("__avg"), "__sd"), 2),
            "volume_state": state,
            "kdj_j": F.when(~short, F.bround(3 * F.col("kdj_k") - 2 * F.col("kdj_d"), 2)),
            "return_1m": F.bround(pct_diff(F.col("close"), _back("closes", 1)), 6),
            "return_5m": F.bround(pct_diff(F.col("close"), _back("closes", 5)), 6),
            "return_15m": F.bround(pct_diff(F.col("close"), _back("closes", 15)), 6),
            "vwap_deviation": F.bround(pct_diff("close", "vwap"), 6),
            "slope9": F.bround(pct_diff("ema9", "ema9_before"), 6),
            "ema_spread": F.bround(pct_diff("ema9", "ema21"), 6),
            "atr": F.when(F.col("n") >= 2, _mean(F.col("__ranges"))),
            "recent_low": F.array_min(_last(lows, 5)),
        }
    )
    df = df.withColumns({"kdj_k": F.when(~short, F.bround("kdj_k", 2)), "kdj_d": F.when(~short, F.bround("kdj_d", 2)), "atr_pct": div("atr", "close")})
    slope = F.coalesce("slope9", F.lit(0.0))
    df = df.withColumns(
        {
            "ema_state": F.when((F.col("ema9") > F.col("ema21")) & (slope > 0), "bullish").when((F.col("ema9") < F.col("ema21")) & (slope < 0), "bearish").otherwise("mixed"),
            "or_state": F.when(F.col("session_rows") < max(2, opening_rows), "forming").when(F.col("close") > F.col("or_high"), "above").when(F.col("close") < F.col("or_low"), "below").otherwise("inside"),
            "atr_state": F.when(F.col("atr_pct").isNull(), "unknown").when(F.col("atr_pct") < 0.001, "compressed").when(F.col("atr_pct") > 0.006, "wide").otherwise("tradable"),
        }
    )
    return df.drop("__steps", "__ranges", "__earlier", "__avg", "__sd", "__ratio", "n", "session_rows", "ema9_before", "value_sum", "volume_sum", "highs", "lows", "closes", "volumes")


def newest_points(points: DataFrame) -> DataFrame:
    """The latest point of every symbol (ties: the largest row), combined before the exchange."""
    rest = [c for c in points.columns if c not in ("symbol", "ts")]
    newest = points.groupBy("symbol").agg(F.max(F.struct("ts", *rest)).alias("p"))
    return newest.select("symbol", "p.*").withColumn("session_date", F.to_date("ts"))


def latest_panel(points: DataFrame, opening_rows: int = 15) -> DataFrame:
    """Indicator panel of the latest point of each symbol, all sessions taken into account."""
    return panel_from_summary(newest_points(points).join(summaries(points, opening_rows), "symbol"), opening_rows)
