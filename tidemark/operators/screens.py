"""Screens over a company table: filters with their order, whole by default."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bounds of the market screen and of the universe screen.
MARKET = {"market_cap": (5e8, 4e9), "trailing_pe": (5, 30)}
UNIVERSE = {"market_cap": (5e8, 1e10), "institutional_ownership": (0.3, None), "insider_ownership": (0.05, None), "quarterly_revenue_yoy": (0.1, None), "trailing_pe": (0.01, 90)}


def within(bounds: dict[str, tuple[float | None, float | None]]) -> Column:
    """All columns inside their bounds (inclusive; None is open); an unknown value is outside."""
    cond = F.lit(True)
    for name, (low, high) in bounds.items():
        cond = cond if low is None else cond & (F.col(name) >= low)
        cond = cond if high is None else cond & (F.col(name) <= high)
    return F.coalesce(cond, F.lit(False))


def _screen(rows: DataFrame, bounds: dict, order: list[Column], limit: int | None) -> DataFrame:
    kept = rows.where(within(bounds)).dropDuplicates(["ticker"])
    return kept if limit is None else kept.orderBy(*order, "ticker").limit(limit)


def market_screen(rows: DataFrame, bounds: dict = MARKET, limit: int | None = None) -> DataFrame:
    """Companies inside the bounds, one row a ticker; with ``limit`` the smallest by market value (ties: by ticker)."""
    return _screen(rows, bounds, [F.asc("market_cap")], limit)


def universe_screen(rows: DataFrame, bounds: dict = UNIVERSE, limit: int | None = None) -> DataFrame:
    """Companies inside the bounds, one row a ticker; with ``limit`` the fastest growing (ties: by ticker)."""
    return _screen(rows, bounds, [F.desc("quarterly_revenue_yoy")], limit)
