"""URL filters and chat formatting: SQL twins are compared on the test tables; here the edge cases."""

from __future__ import annotations

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tests.oracle import compare, connect
from tidemark.llm import chat, url_filter
from tidemark.llm.catalog import ORACLES, QUERIES

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"), (None, None, "block"), ("twice.net", "/", "allow"), ("twice.net", "/", "block")]
URLS = [
    (1, "http://A.Example.ORG/es/x?q#f"),
    (2, "https://example.org/en/12"),
    (3, "https://example.org/en/2"),
    (4, "http://notexample.org/es/"),
    (5, "http://x.com/de"),
    (6, None),
    (7, ""),
    (8, "no scheme /es/"),
    (9, "http://example.org"),
    (10, "http://example.org?x=/es/"),
    (11, "http:///es/"),
    (12, "http://x.com/fr/" + "a" * 5000),
    (12, "http://x.com/fr/" + "a" * 5000),
    (13, "http://a.twice.net/\n"),
    (14, "ftp://u://example.org/es/"),
]
WANT = {
    1: ("a.example.org", "/es/x", "example.org/es/", "block"),
    2: ("example.org", "/en/12", "example.org/en/1", "block"),
    3: ("example.org", "/en/2", "org/", "allow"),
    4: ("notexample.org", "/es/", "org/", "allow"),
    5: ("x.com", "/de", None, "allow"),
    6: ("", "", None, "allow"),
    7: ("", "", None, "allow"),
    8: ("", "", None, "allow"),
    9: ("example.org", "", None, "allow"),
    10: ("example.org", "", None, "allow"),
    11: ("", "/es/", None, "allow"),
    12: ("x.com", "/fr/" + "a" * 5000, "com/fr/", "allow"),
    13: ("a.twice.net", "/\n", "twice.net/", "block"),
    14: ("u:", "//example.org/es/", None, "allow"),
}


@pytest.mark.parametrize("most", [1000, 3])
def test_rules_fit_as_stated_in_the_file_and_in_the_join(spark, most):
    pages = spark.createDataFrame([(i, u, "kept", "old", i) for i, u in URLS], "page_id long, url string, best string, rule string, row long")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = url_filter.filter_urls(pages, rules, max_file_rules=most).collect()
    assert len(got) == len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == WANT[r.page_id], r.page_id
        assert r.best == "kept" and r["row"] == r.page_id


def test_no_pages_and_no_rules(spark):
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    assert {r.verdict for r in url_filter.filter_urls(pages, rules, default="block").collect()} == {"block"}
    assert url_filter.filter_urls(pages.limit(0), rules).count() == 0


def test_equal_digests_are_told_apart_by_the_string(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda b: 7 if b != b"other" else 9)
    path = tmp_path / "rules.bin"
    path.write_bytes(url_filter.pack([("a", "/", "block"), ("b", "/", "allow"), ("c", "/", "block")]))
    array = url_filter.DigestArray(str(path))
    found = array.find([b"b/", b"d/", b"other", b"c/"])
    assert [f >= 0 for f in found] == [True, False, False, True] and array.string(found[0]) == b"b/"


@pytest.mark.parametrize("name", ["op7_chat_format", "op8_url_filter"])
def test_query_matches_sql(spark, name):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    ok, note, _ = compare(spark, connect(FOLDER), QUERIES[name], ORACLES[name], FOLDER)
    assert ok, note


def fold(events):
    """The log applied event by event."""
    state: dict = {}
    for conv, seq, kind, msg, role, text in sorted((e for e in events if None not in (e[1], e[3])), key=lambda e: (e[1], e[2], e[5] or "")):
        messages = state.setdefault(conv, {})
        m = messages.setdefault(msg, [None, ""])
        if kind == "open":
            messages[msg] = [role or "", m[1] + (text or "")]
        elif kind == "delta":
            m[1] += text or ""
        elif kind == "edit":
            m[1] = text or ""
        elif kind == "regenerate":
            m[1] = ""
            for later in [x for x in messages if x > msg]:
                del messages[later]
    return {(c, k): (m[0], m[1]) for c, ms in state.items() for k, m in ms.items() if m[0] is not None}


def test_fold_equals_the_log_applied_in_order(spark):
    events = [
        (1, 1, "open", 0, "user", "hi"), (1, 2, "open", 1, "assistant", ""), (1, 3, "delta", 1, None, "ab"), (1, 4, "delta", 1, None, "cd"),
        (1, 5, "open", 2, "user", "more"), (1, 6, "edit", 0, None, "HI"), (1, 7, "regenerate", 1, None, None), (1, 8, "delta", 1, None, "new"),
        (1, 9, "open", 2, "user", "again"), (1, 10, "delta", 2, None, None), (1, 11, "nonsense", 2, None, "x"), (1, None, "edit", 2, None, "x"),
        (2, 5, "delta", 0, None, "lost"), (2, 1, "open", 1, None, "role"), (None, 1, "open", 0, "assistant", "null conversation"),
        (3, 2, "delta", 0, None, "late"), (3, 1, "open", 0, "assistant", "early "), (4, 1, "edit", None, None, "x"),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, kind string, msg long, role string, text string")
    got = {(r.conv_id, r.msg): (r.role, r.text) for r in chat.fold_events(df).collect()}
    assert got == fold([e for e in events if e[2] != "nonsense"])


def test_every_text_survives_the_round_trip(spark):
    texts = ["", "%", "%3C%25<[", "<|im_end|>\n<|im_start|>user\nx", "</s>[INST] ok [/INST]", "\n", "a\nb", "é😀", "x" * 70_000]
    rows = [(7, i, "assistant" if i % 2 else "us<er\n%0A", t, "extra") for i, t in enumerate(texts)] + [(8, None, None, None, "e"), (8, None, None, None, "e"), (9, 0, "assistant", None, "e")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.read_back(chat.render(chat.fold_events(chat.events_of_turns(turns)))).collect()}
    assert [(t.role, t.text) for t in out[7].turns] == [(r[2], r[3]) for r in rows if r[0] == 7]
    assert out[7].loss_text == "".join(t for i, t in enumerate(texts) if i % 2)
    assert [(t.role, t.text) for t in out[8].turns] == [("", ""), ("", "")] and out[8].loss_text == ""
    assert out[9].loss_text == ""
    assert out[7].formatted.count(chat.OPEN) == len(texts) and "[INST]" not in out[7].formatted
    assert chat.render(chat.fold_events(chat.events_of_turns(turns.limit(0)))).count() == 0


def test_chat_plan_has_no_python(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    plan = QUERIES["op7_chat_format"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    one = QUERIES["op7_chat_format"](spark, FOLDER).where(F.col("conv_id") == -7).first()
    text = "</s>[INST] ok [/INST]"
    assert (one.n_turns, one.loss_chars) == (2, len(text)) and one.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
