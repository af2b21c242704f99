"""Exact quantiles against NumPy, with a hot key, ties, few values and a poor sketch."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.operators import quantiles as Q

QS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


def data():
    rng = random.Random(3)
    rows = [("hot", 0, rng.gauss(0, 1)) for _ in range(6000)]
    rows += [("hot", 1, float(rng.randrange(5))) for _ in range(3000)]
    rows += [("small", 0, rng.choice([-1e300, 1e-300, 0.0, -0.5, 1e300])) for _ in range(11)]
    rows += [("one", 0, 7.0), ("same", 0, 2.5), ("same", 0, 2.5), ("two", 0, 1.0), ("two", 0, 2.0)]
    return rows + [("hot", 0, None), ("nothing", 0, None), ("nothing", 1, float("nan"))]


@pytest.mark.parametrize("accuracy,margin", [(Q.ACCURACY, Q.MARGIN), (10, 1e-3), (10_000, 0.2)])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy, margin):
    monkeypatch.setattr(Q, "ACCURACY", accuracy)
    monkeypatch.setattr(Q, "MARGIN", margin)
    rows = data()
    got = Q.exact_quantiles(spark.createDataFrame(rows, "s string, f int, v double"), ["s", "f"], QS).collect()
    groups = {}
    for s, f, v in rows:
        if v is not None and v == v:
            groups.setdefault((s, f), []).append(v)
    assert {(r.s, r.f) for r in got} == set(groups)
    for r in got:
        own = groups[r.s, r.f]
        assert (r.total, r.different) == (len(own), len(set(own)))
        assert r.q == pytest.approx(np.quantile(own, QS).tolist(), rel=1e-12, abs=1e-12)


def test_no_task_orders_a_hot_key(spark):
    """With a good sketch the gaps that are put in order hold a small part of a key's values."""
    df = spark.range(40_000).selectExpr("'hot' AS s", "xxhash64(id) / 1e15 AS v")
    out = Q.exact_quantiles(df, ["s"], [0.3, 0.7])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and out.count() == 1
    cells = df.selectExpr("percentile_approx(v, array(0.299, 0.301), 10000) AS e").first().e
    assert df.where(f"v BETWEEN {cells[0]} AND {cells[1]}").count() < 400


def test_nothing(spark):
    assert Q.exact_quantiles(spark.createDataFrame([], "s string, v double"), ["s"], [0.5]).count() == 0
