"""Keywords by index against a loop, and with ten thousand keywords."""

from __future__ import annotations

import random

from tidemark.operators import joins as J

TABLE = {"A": ["license", "http", "e"], "B": ["@", "copy right", " the ", "--"], "C": ["Ünïcode", "x.y", "the the", " ", "  ", "\n"], "N": ["", None], "D": ["th", "a"]}


def texts():
    rng = random.Random(1)
    words = ["license", "licenses", "sublicensed", "https://a.b", "The", "the", "them", "copy", "right", "copyright", "@", "x.y", "ünïcode", "--", "-", "q", "\n"]
    return [(i, rng.choice([" ", "  ", ""]).join(rng.choice(words) for _ in range(rng.randrange(0, 12)))) for i in range(150)] + [(500, None), (501, ""), (None, "the license")]


def test_index_equals_a_loop(spark):
    rows = texts()
    events = spark.createDataFrame([(i, t, "x") for i, t in rows], "id long, text string, part string")
    got = J.keyword_matches_by_index(events, "id", "text", J.keyword_table(spark, TABLE))
    assert got.columns == ["id", "text", "part", "symbol", "matched_keywords"]
    want = {(i, s): [k for k in ks if k and k.lower() in t.lower()] for i, t in rows if i is not None and t is not None for s, ks in TABLE.items()}
    assert {(r.id, r.symbol): r.matched_keywords for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_ten_thousand_keywords(spark):
    rng = random.Random(2)
    make = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(4, 8)))
    keywords = {f"S{i}": [make(), f"{make()} {make()}"] for i in range(5000)}
    all_words = [w for ks in keywords.values() for k in ks for w in k.split()]
    rows = [(i, " ".join(rng.choice(all_words) for _ in range(20))) for i in range(200)]
    got = J.keyword_matches_by_index(spark.createDataFrame(rows, "id long, text string"), "id", "text", J.keyword_table(spark, keywords))
    want = {(i, s): hit for i, t in rows for s, ks in keywords.items() if (hit := [k for k in ks if k in t])}
    assert {(r.id, r.symbol): r.matched_keywords for r in got.collect()} == want
    assert J.keyword_matches_by_index(spark.createDataFrame([], "id long, text string"), "id", "text", J.keyword_table(spark, keywords)).count() == 0
