"""SQL fragments shared by the oracle texts."""

from __future__ import annotations


def bars_cte(interval: int = 60, name: str = "bars") -> str:
    """CTE list that resamples the events table to bars of ``interval`` minutes."""
    return f"""quotes AS (
  SELECT event_type AS symbol, ts, value AS close, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS volume,
         CAST(ts AS DATE) AS session_date, CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS session_minute
  FROM events),
{name} AS (
  SELECT symbol, session_date, CAST(bucket AS INTEGER) AS bucket, ts, session_minute, open, high, low, close, volume,
         0.0 AS turnover, source_rows,
         CAST(row_number() OVER (PARTITION BY symbol, session_date ORDER BY bucket) - 1 AS INTEGER) AS bar_index
  FROM (SELECT symbol, session_date, session_minute // {interval} AS bucket, max(ts) AS ts,
               max(session_minute) AS session_minute, arg_min(close, ts) AS open, max(close) AS high,
               min(close) AS low, arg_max(close, ts) AS close, sum(volume) AS volume, count(*) AS source_rows
        FROM quotes GROUP BY ALL))"""


def daily_cte(name: str = "days") -> str:
    """CTE that turns orders into daily bars per priority."""
    return f"""{name} AS (
  SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS session_date,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low,
         arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY ALL)"""


def ema_sql(x: str, alpha: str, window: str) -> str:
    """Recursive smoother over the rows of a window frame, skipping leading nulls."""
    return (
        f"list_reduce(list_concat([NULL::DOUBLE], list(CAST({x} AS DOUBLE)) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), "
        f"lambda a, v: CASE WHEN a IS NULL THEN v ELSE a * (1.0 - {alpha}) + v * {alpha} END)"
    )


def gap_ewm_sql(x: str, alpha: str, window: str, seed: str | None = None) -> str:
    """Smoother whose old weight keeps decaying over missing rows (value and weight as state)."""
    first = f"{{'v': CAST({seed} AS DOUBLE), 'w': 1.0::DOUBLE}}" if seed else "{'v': NULL::DOUBLE, 'w': 1.0::DOUBLE}"
    rows = f"list({{'v': CAST({x} AS DOUBLE), 'w': 1.0::DOUBLE}}) OVER ({window} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    step = (
        f"CASE WHEN a.v IS NULL THEN {{'v': b.v, 'w': 1.0::DOUBLE}} "
        f"WHEN b.v IS NULL THEN {{'v': a.v, 'w': a.w * (1.0 - {alpha})}} "
        f"ELSE {{'v': (a.w * (1.0 - {alpha}) * a.v + {alpha} * b.v) / (a.w * (1.0 - {alpha}) + {alpha}), 'w': 1.0::DOUBLE}} END"
    )
    if seed:
        # a seeded series starts at its first value, so leading gaps do not decay the seed
        step = step.replace(f"'w': a.w * (1.0 - {alpha})}}", "'w': a.w}")
    return f"(list_reduce(list_concat([{first}], {rows}), lambda a, b: {step})).v"


def binary(expr: str, alias: str, digits: int) -> str:
    """Double rounded on its binary value, without a negative zero."""
    return f"CAST(printf('%.{digits}f', CAST({expr} AS DOUBLE)) AS DOUBLE) + 0.0 AS {alias}"


def r(expr: str, alias: str, digits: int = 6) -> str:
    """Rounded double with an alias and without a negative zero."""
    return f"CASE WHEN round({expr}, {digits}) = 0 THEN 0.0 ELSE round({expr}, {digits}) END AS {alias}"
