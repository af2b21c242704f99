"""Exact quantiles of hot keys without a buffer of their values.

A sketch proposes a narrow bracket around every wanted rank, exact counts between the brackets' edges say in which gap each rank really
lies, and only the distinct values of those gaps are put in order. The sketch decides how much is ordered, never the result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import materialise

#: Inverse of the sketch's rank error, and distance of a bracket's edges from the wanted rank.
ACCURACY, MARGIN = 10_000, 1e-3


def exact_quantiles(rows: DataFrame, keys: Sequence[str], qs: Sequence[float], value: str = "v") -> DataFrame:
    """Per key: ``q`` (one value for each of ``qs``, linear between ranks), ``total`` and ``different`` (numbers of values and distinct values).

    Null and NaN values are left out; a key without values gives no row. Equal values are counted before they are
    moved, and a key's values meet nowhere: they are dealt out by value, and a gap holds about ``2 * MARGIN`` of a key's values.
    """
    keys = list(keys)
    known = rows.select(*keys, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    counted = materialise(known.groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("n")), "quantile-values")
    around = sorted({min(1.0, max(0.0, q + side * MARGIN)) for q in qs for side in (-1, 1)})
    edges = known.groupBy(*keys).agg(F.percentile_approx("v", F.array(*[F.lit(p) for p in around]), F.lit(ACCURACY)).alias("edges"))
    edges = materialise(edges.select(*keys, F.array_sort(F.array_distinct("edges")).alias("edges")), "quantile-edges")
    placed = counted.join(edges, keys).select(*keys, "v", "n", F.size(F.filter("edges", lambda e: e < F.col("v"))).alias("gap"))
    gaps = placed.groupBy(*keys, "gap").agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("values"))
    by_key = gaps.groupBy(*keys).agg(F.sum("held").alias("total"), F.sum("values").alias("different"), F.sort_array(F.collect_list(F.struct("gap", "held"))).alias("gaps"))
    starts = F.transform(
        "gaps", lambda g, i: F.struct(g["gap"].alias("gap"), F.aggregate(F.slice("gaps", F.lit(1), i), F.lit(0).cast("long"), lambda acc, x: acc + x["held"]).alias("first"), g["held"].alias("held"))
    )
    position = lambda q: F.lit(float(q)) * (F.col("total") - 1)
    ranks = F.array_distinct(F.array(*[f(position(q)).cast("long") for q in qs for f in (F.floor, F.ceil)]))
    by_key = by_key.select(*keys, "total", "different", starts.alias("starts"), ranks.alias("ranks"))
    wanted = F.filter(
        F.transform("starts", lambda s: F.struct(s["gap"].alias("gap"), s["first"].alias("first"), F.filter("ranks", lambda r: (r >= s["first"]) & (r < s["first"] + s["held"])).alias("ranks"))),
        lambda s: F.size(s["ranks"]) > 0,
    )
    by_key = materialise(by_key.select(*keys, "total", "different", wanted.alias("wanted")), "quantile-ranks")
    cells = by_key.select(*keys, F.explode("wanted").alias("w")).select(*keys, "w.gap", "w.first", "w.ranks")
    order = Window.partitionBy(*keys, "gap").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.join(cells, [*keys, "gap"]).withColumn("before", F.col("first") + F.coalesce(F.sum("n").over(order), F.lit(0)))
    met = inside.select(*keys, "v", F.explode(F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("n")))).alias("rank"))
    found = met.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))
    out = by_key.select(*keys, "total", "different").join(found, keys)

    def between(q: float):
        low, high = F.floor(position(q)).cast("long"), F.ceil(position(q)).cast("long")
        a, b = F.element_at("at", low), F.element_at("at", high)
        return F.when(a == b, a).otherwise((high - position(q)) * a + (position(q) - low) * b)

    return out.select(*keys, F.array(*[between(q) for q in qs]).alias("q"), "total", "different")
