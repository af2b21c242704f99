"""Exponential smoothing as prefix sums.

The recursion ``y[t] = b*y[t-1] + a*x[t]`` (b = 1 - a) unrolls to
``y[t] = b^t * (x[0] + sum_{0<i<=t} a * x[i] * b^-i)``: one running sum per output. It stays in
the window operator next to the rolling means, needs no Python and no array state. Weights
grow as ``b^-i``, so :func:`ewm_dense` is for short series (a session); :func:`ewm_columns`
restarts the weights in blocks and handles gaps, for series of any length.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# exp(-BLOCK) is far below double precision, so only the previous block matters to the next.
BLOCK = 300.0


def ewm_dense(x: Column, alpha: float, running, position: Column, start: int = 0) -> Column:
    """Smoother of a series that is non-null from row ``start`` on.

    ``running`` is the window from the first row to the current one and ``position`` the
    0-based row number in it. The first observation seeds the average.
    """
    beta = 1.0 - alpha
    step = (position - F.lit(start)).cast("double")
    weight = F.when(step == 0, F.lit(1.0)).otherwise(F.lit(alpha)) * F.pow(F.lit(beta), -step)
    return F.pow(F.lit(beta), step) * F.sum(F.when(step >= 0, x * weight)).over(running)


def ewm_columns(
    df: DataFrame,
    specs: dict[str, tuple[str, float]],
    keys: Sequence[str],
    order: str,
    seed: float | None = None,
    in_blocks: bool = True,
) -> DataFrame:
    """Add ``out = ewm(x, alpha)`` for each ``out: (x, alpha)`` in ``specs``.

    Without ``seed`` the first non-null value starts the average; with it the average starts
    at ``seed`` before the first value. Over a gap of missing rows the old weight keeps
    decaying and is renormalised at the next value; a missing row repeats the last average.
    ``in_blocks=False`` drops the block restart for short series.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    kept = df.columns
    df = df.withColumn("__pos", F.row_number().over(w).cast("double"))
    df = df.withColumns(
        {f"__prev_{o}": F.last(F.when(F.col(x).isNotNull(), F.col("__pos")), True).over(before) for o, (x, _) in specs.items()}
    )

    def keep_share(out: str, x: str, alpha: float) -> Column:
        prev = F.col(f"__prev_{out}")
        old = F.pow(F.lit(1.0 - alpha), F.col("__pos") - prev)
        first = F.lit(1.0) if seed is None else F.lit(1.0 - alpha)
        return F.when(F.col(x).isNotNull(), F.when(prev.isNull(), first).otherwise(old / (old + F.lit(alpha))))

    df = df.withColumns({f"__c_{o}": keep_share(o, x, a) for o, (x, a) in specs.items()})
    df = df.withColumns({f"__l_{o}": F.sum(F.log(F.col(f"__c_{o}"))).over(upto) for o in specs})
    if in_blocks:
        df = df.withColumns({f"__b_{o}": F.floor(-F.col(f"__l_{o}") / BLOCK) for o in specs})
    else:
        df = df.withColumns({f"__b_{o}": F.lit(0) for o in specs})

    def term(out: str, x: str) -> Column:
        c = F.col(f"__c_{out}")
        share = F.when(F.col(f"__prev_{out}").isNull() & F.lit(seed is None), F.lit(1.0)).otherwise(1.0 - c)
        return share * F.col(x) * F.exp(-(F.col(f"__l_{out}") + BLOCK * F.col(f"__b_{out}")))

    local = {}
    for o, (x, _) in specs.items():
        frame = upto
        if in_blocks:
            frame = Window.partitionBy(*keys, f"__b_{o}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        level = F.exp(F.col(f"__l_{o}") + BLOCK * F.col(f"__b_{o}"))
        value = level * F.sum(term(o, x)).over(frame)
        if seed is not None:
            value = value + F.when(F.col(f"__b_{o}") == 0, F.lit(seed) * F.exp(F.col(f"__l_{o}"))).otherwise(0.0)
        local[f"__y_{o}"] = value
    df = df.withColumns(local)
    if not in_blocks:
        return df.select(*[c for c in kept if c not in specs], *[F.col(f"__y_{o}").alias(o) for o in specs])
    df = df.withColumns({f"__n_{o}": F.lead(f"__b_{o}").over(w) for o in specs})
    carry = {
        f"__e_{o}": F.last(
            F.when(F.col(f"__n_{o}") != F.col(f"__b_{o}"), F.struct(F.col(f"__y_{o}").alias("y"), F.col(f"__l_{o}").alias("l"))),
            True,
        ).over(before)
        for o in specs
    }
    df = df.withColumns(carry)
    final = [
        (
            F.col(f"__y_{o}")
            + F.coalesce(F.col(f"__e_{o}.y") * F.exp(F.col(f"__l_{o}") - F.col(f"__e_{o}.l")), F.lit(0.0))
        ).alias(o)
        for o in specs
    ]
    return df.select(*[c for c in kept if c not in specs], *final)


def rsi_from(gain: Column, loss: Column) -> Column:
    """Relative strength from smoothed gain and loss: 100 without losses, 50 when flat or unknown."""
    value = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + F.try_divide(gain, loss))
    return F.when(loss > 0, value).when(gain > 0, F.lit(100.0)).otherwise(F.lit(50.0))


def max_dense_rows(alpha: float) -> int:
    """Longest series :func:`ewm_dense` can hold before its weights leave the double range."""
    return int(600 / -math.log(1.0 - alpha))
