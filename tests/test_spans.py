"""Match places, snippets and amounts in column expressions against Python's own matches; joins of frequent keys."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import textscan as TS
from tidemark.operators import joins as J
from tidemark.operators import text as TX

WORDS = ["backlog", "Backlog", "rpo", "RPOs", "deferred", "revenue", "$12.5 million", "3,000", "bn", "contract  liability", "é😀", "\n", "7%", "8.25 %", "owned", "x"]


def texts():
    rng = random.Random(9)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 90))) for _ in range(120)]
    return out + [None, "", "backlog", "backlogbacklog", "backlog " * 3000, "no match", "7%7%", " 9 %"]


def python_spans(text, patterns):
    out = []
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text or "", re.IGNORECASE):
            g = m.groups() + (None, None)
            out.append((k, m.start(), m.end(), g[0], g[1]))
    return out


@pytest.mark.parametrize("patterns", [[TX.PERCENT], list(TX.AMOUNT_PATTERNS)])
def test_spans_equal_pythons(spark, patterns):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "id int, t string").select("id", TS.match_spans("t", patterns).alias("s"))
    got = {r.id: [tuple(x) for x in r.s] for r in df.collect()}
    assert got == {i: python_spans(t, patterns) for i, t in rows}


def python_snippets(text, terms, radius=220, most=4, spacing=80):
    kept = []
    for term in terms:
        for m in re.finditer(TS.term_pattern(term), text, re.IGNORECASE):
            a = max(0, m.start() - radius)
            if len(kept) < most and all(abs(k - a) >= spacing for k, _, _ in kept):
                kept.append((a, m.start(), m.end()))
    return [text[max(0, s - radius) : e + radius].strip(" ") for _, s, e in kept]


@pytest.mark.parametrize("radius", [220, 15])
def test_snippets_equal_a_loop(spark, radius):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "id int, t string").select("id", TX.snippets("t", radius=radius).alias("s"))
    assert {r.id: r.s for r in df.collect()} == {i: python_snippets(t or "", TX.ORDER_TERMS, radius) for i, t in rows}


def test_text_scans_have_no_python_worker(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "t string")
    for column in (TX.snippets("t"), TX.amounts("t"), TX.ownership_percents("t"), TX.amount_summary(TX.amounts("t"))):
        plan = df.select(column.alias("c"))._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_frequent_keys_are_dealt_out_and_nothing_is_lost(spark, block):
    left = [("hot", i) for i in range(50)] + [("warm", i) for i in range(9)] + [("only left", 1), ("one", 1), ("one", 1), (None, 3)]
    right = [("hot", f"r{i}") for i in range(40)] + [("warm", "w")] + [("only right", "x"), ("one", "y"), (None, "z")]
    got = J.spread_join(spark.createDataFrame(left, "key string, a int"), spark.createDataFrame(right, "key string, b string"), "key", block)
    want = sorted((k, a, b) for k, a in left for j, b in right if k is not None and k == j)
    assert sorted(tuple(r) for r in got.select("key", "a", "b").collect()) == want


def test_issuer_matches_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(J, "KEY_ROWS", 4)
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "omega"]
    issuers = [" ".join(rng.choice(words[:3] if rng.random() < 0.6 else words) for _ in range(rng.randrange(1, 5))) for _ in range(60)] + ["t7 solo"]
    companies = [(f"T{i}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 4)))) for i in range(40)] + [("T0", "alpha omega"), ("E", "")]
    got = J.issuer_matches(spark.createDataFrame([(i,) for i in issuers], "issuer string"), spark.createDataFrame(companies, "ticker string, name string"))
    want = set()
    for i in set(issuers):
        for t, n in companies:
            own, other = set(n.split()), set(i.split())
            if (len(own) == 1 and own <= other) or len(own & other) >= 2 or t.lower() in other:
                want.add((i, t))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
