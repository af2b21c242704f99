"""Null-safe arithmetic columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, null when either side is null or b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def pct_diff(a: Column | str, b: Column | str) -> Column:
    """a / b - 1 under the rules of :func:`div`."""
    return div(a, b) - F.lit(1.0)


def growth(latest: Column | str, prior: Column | str) -> Column:
    """(latest - prior) / |prior|, null on a null or zero base."""
    return div(col(latest) - col(prior), F.abs(col(prior)))


def finite(c: Column | str) -> Column:
    """NaN and infinities become null."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), F.lit(None)).otherwise(c)


def or_default(c: Column | str, default: Column) -> Column:
    """Value unless it is null or 0."""
    return F.coalesce(F.nullif(col(c), F.lit(0.0)), default)


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Rounded double without a negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)


def _even(x: Column, digits: int) -> tuple[Column, Column]:
    """|x| in units of 10**-digits, rounded half to even on the binary value, and whether that is exact.

    The product with 10**(digits + 1) is taken with its rounding error (Dekker's splitting), so a
    value whose shortest decimal form ends in 5 is still seen on its own side of the tie.
    """
    m = float(10 ** (digits + 1))
    split = float(2**27 + 1)
    m_high = split * m - (split * m - m)
    m_low = m - m_high

    def units(a: Column) -> Column:
        def with_product(p: Column) -> Column:
            def with_high(high: Column) -> Column:
                low = a - high
                error = ((high * m_high - p) + high * m_low + low * m_high) + low * m_low
                tens = F.floor(p / 10)
                rest = p - tens * 10 - 5
                tie = (rest == 0) & (error == 0)
                up = (rest > 0) | ((rest == 0) & (error > 0)) | (tie & (F.pmod(tens, F.lit(2)) == 1))
                return tens + up.cast("bigint")

            return let(a * split - (a * split - a), with_high)

        return let(a * m, with_product)

    size = F.abs(x)
    return let(size, units), (size * m) < float(2**52)


def round_even(c: Column | str, digits: int) -> Column:
    """Rounded to ``digits`` as Python's ``round`` does: to nearest on the binary value, ties to even."""

    def rounded(x: Column) -> Column:
        units, exact = _even(x, digits)
        value = units / F.lit(float(10**digits))
        return F.when(x.isNull() | F.isnan(x), x).when(exact, F.when(x < 0, -value).otherwise(value)).otherwise(F.bround(x, digits))

    return let(col(c).cast("double"), rounded)


def fixed_text(c: Column | str, digits: int, grouped: bool = False) -> Column:
    """``digits`` decimals of the binary value, ties to even, optionally with thousands separators."""
    pattern = "%,d" if grouped else "%d"
    scale = 10**digits

    def text(x: Column) -> Column:
        units, exact = _even(x, digits)

        def shown(n: Column) -> Column:
            whole = F.format_string(pattern, F.floor(n / scale))
            return F.concat(whole, F.lit("."), F.lpad((n % scale).cast("string"), digits, "0")) if digits else whole

        sign = F.when(x < 0, "-").otherwise("")
        return F.when(exact, F.concat(sign, let(units, shown))).otherwise(F.format_string(f"%{',' if grouped else ''}.{digits}f", x))

    return let(col(c).cast("double"), lambda x: F.when(x.isNotNull(), text(x)))


def sum_present(*cols: Column | str) -> Column:
    """Sum of the non-null inputs, null only when all are null."""
    values = F.array(*[col(c).cast("double") for c in cols])
    present = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda acc, x: acc + x))


def wilson_lower(wins: Column | str, total: Column | str, z: float = 1.96) -> Column:
    """Lower bound of the Wilson score interval, floored at 0; 0 without observations."""
    n = col(total).cast("double")
    p = div(wins, n)
    z2 = z * z
    centre = p + z2 / (F.lit(2.0) * F.nullif(n, F.lit(0.0)))
    margin = z * F.sqrt(div(p * (1 - p) + div(F.lit(z2 / 4), n), n))
    bound = F.greatest(F.lit(0.0), div(centre - margin, 1 + div(F.lit(z2), n)))
    return F.coalesce(bound, F.lit(0.0))
