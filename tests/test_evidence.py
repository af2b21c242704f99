"""Parsers, text scans, fundamentals, score, merges, rotation and streams on small inputs."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.operators import facts as FA
from tidemark.operators import joins as J
from tidemark.operators import merge as M
from tidemark.operators import rotation as RO
from tidemark.operators import score as SC
from tidemark.operators import text as TX
from tidemark.sources import filings as FI
from tidemark.sources import pages as PG
from tidemark.sources import readers as RD
from tidemark.streaming import live as L


def one(spark, col, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols))
    return df.select(col.alias("x")).first().x


def test_form4_and_malformed(spark):
    good = """<?xml version="1.0"?><ownershipDocument><issuer><issuerTradingSymbol>ABC</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName> Jane </rptOwnerName></reportingOwnerId></reportingOwner>
    <nonDerivativeTable><nonDerivativeTransaction><transactionDate><value>2026-01-02</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionAmounts>
    <transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode>
    </transactionAmounts></nonDerivativeTransaction><nonDerivativeTransaction><transactionAmounts><transactionShares><value>5</value></transactionShares></transactionAmounts></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"""
    df = spark.createDataFrame([(1, "ABC", good), (2, "ABC", "<ownershipDocument><nonDerivativeTable>")], "filing_no int, ticker string, xml string")
    rows = FI.form4_transactions(df).orderBy("position").collect()
    assert [(r.owner, r.value) for r in rows] == [("Jane", 250.0), ("Jane", None)]


def test_13f_namespaces_and_value_scale(spark):
    xml = '<n1:informationTable xmlns:n1="urn:x"><n1:infoTable><n1:nameOfIssuer>ACME CORP</n1:nameOfIssuer><n1:cusip>1</n1:cusip><n1:value>12</n1:value><n1:shrsOrPrnAmt><n1:sshPrnamt>7</n1:sshPrnamt><n1:sshPrnamtType>SH</n1:sshPrnamtType></n1:shrsOrPrnAmt></n1:infoTable></n1:informationTable>'
    r = FI.holdings_13f(spark.createDataFrame([("m", xml)], "manager string, xml string")).first()
    assert (r.name_of_issuer, r.value_usd, r.shares, r.share_type) == ("ACME CORP", 12000.0, 7.0, "SH")


def test_13g_class_percent(spark):
    assert one(spark, FI.class_percents("x"), x="<a><b:classPercent xmlns:b='u'>11.0</b:classPercent></a>") == [pytest.approx(0.11)]
    assert one(spark, FI.class_percents("x"), x="<a><classPercent>11.0</classPercent>") == []


def facts_json(rows, tag="Revenues"):
    return json.dumps({"facts": {"us-gaap": {tag: {"units": {"USD": rows}}}}})


def q(start, end, val, fp="Q1", fy=2025, form="10-Q", filed="2025-05-01"):
    return {"form": form, "fp": fp, "fy": fy, "start": start, "end": end, "val": val, "filed": filed}


def test_quarterly_growth_ignores_year_to_date(spark):
    rows = [q("2024-01-01", "2024-03-31", 100, fy=2024), q("2025-01-01", "2025-03-31", 150), q("2024-10-01", "2025-03-31", 400)]
    facts = FI.flatten_facts(spark.createDataFrame([("c", facts_json(rows))], "cik string, facts_json string"))
    r = FA.revenue_growth(facts).first()
    assert r.revenue_yoy == pytest.approx(0.5) and r.period_type == "quarterly"


def test_annual_growth_when_no_quarters(spark):
    rows = [q("2023-01-01", "2023-12-31", 100, "FY", 2023, "20-F"), q("2024-01-01", "2024-12-31", 150, "FY", 2024, "20-F")]
    doc = json.dumps({"facts": {"ifrs-full": {"Revenue": {"units": {"USD": rows}}}}})
    r = FA.revenue_growth(FI.flatten_facts(spark.createDataFrame([("c", doc)], "cik string, facts_json string"))).first()
    assert r.revenue_yoy == pytest.approx(0.5) and r.period_type == "annual"


def test_financial_quality_ratios(spark):
    period = ("2025-01-01", "2025-03-31")
    tags = {
        "Revenues": [q("2024-01-01", "2024-03-31", 100, fy=2024), q(*period, 150)],
        "NetIncomeLoss": [q(*period, 30)],
        "NetCashProvidedByUsedInOperatingActivities": [q(*period, 40)],
        "PaymentsToAcquirePropertyPlantAndEquipment": [q(*period, 10)],
        "Assets": [q(None, "2025-03-31", 1000)],
        "LongTermDebtNoncurrent": [q(None, "2025-03-31", 300)],
    }
    doc = json.dumps({"facts": {"us-gaap": {t: {"units": {"USD": r}} for t, r in tags.items()}}})
    r = FA.financial_quality(FI.flatten_facts(spark.createDataFrame([("c", doc)], "cik string, facts_json string"))).first()
    assert r.net_margin == pytest.approx(0.2) and r.free_cash_flow_margin == pytest.approx(0.2) and r.debt_to_assets == pytest.approx(0.3)


def test_latest_filings_match_schedule_names(spark):
    doc = {"filings": {"recent": {"form": ["SCHEDULE 13G/A", "8-K"], "accessionNumber": ["a", "b"], "filingDate": ["2026-01-01", "2026-01-02"], "primaryDocument": ["x", "y"]}}}
    rows = FI.latest_filings(spark.createDataFrame([("1", json.dumps(doc))], "cik string, submissions_json string"), ("SC 13G/A",), 5).collect()
    assert [(r.accession, r.form) for r in rows] == [("a", "SCHEDULE 13G/A")]


HTML = """<table><tr><td>h</td></tr>
<tr><td></td><td><a href="http://www.sec.gov/f">2026-01-02</a></td><td>2026-01-01</td><td><a>ABC</a></td><td><a href="/insider/x">Doe &amp; Co</a></td><td>CEO</td><td>P - Purchase</td><td>$10.00</td><td>+2,000</td><td>5,000</td><td>+1%</td><td>+$20,000</td></tr>
<tr><td>M</td><td>d</td><td>d</td><td>ABC</td><td>n</td><td>t</td><td>S - Sale</td><td>$6</td><td>-2,000</td><td>1</td><td>x</td><td>-$12,000</td></tr>
<tr><td>D</td><td>d</td><td>d</td><td>ABC</td><td>n</td><td>t</td><td>A - Grant</td><td>$6</td><td>2</td><td>1</td><td>x</td><td>$9,000</td></tr>
<tr><td>D</td><td>d</td><td>d</td><td>XYZ</td><td>n</td><td>t</td><td>P - Purchase</td><td>$6</td><td>2</td><td>1</td><td>x</td><td>$9,000</td></tr></table>"""


def test_insider_table(spark):
    t = PG.insider_transactions(spark.createDataFrame([("abc", HTML)], "ticker string, html string"), site="https://s").cache()
    rows = t.orderBy("row_no").collect()
    assert len(rows) == 3 and rows[0].insider_name == "Doe & Co" and rows[0].insider_url == "https://s/insider/x" and rows[0].sec_form4_url.endswith("/f")
    r = FA.insider_rollup(t).first()
    assert (r.open_market_count, r.purchase_value, r.sale_value, r.net_purchase_value) == (2, 20000.0, 12000.0, 8000.0)


def test_page_extract(spark):
    html = '<html><head><title>Acme &amp; Co</title><meta name="description" content="Makes things"></head><body><script>x</script><!-- y --><p>Won a contract &eacute;t&eacute;.</p></body></html>'
    r = PG.extract_pages(spark.createDataFrame([(1, html)], "id int, html string")).first()
    assert (r.title, r.description) == ("Acme & Co", "Makes things")
    assert r.text.endswith("Won a contract été.") and len(r.text_checksum) == 64
    assert [h.term for h in one(spark, TX.highlights("x"), x=r.text)] == ["contract"]


def test_term_counts_and_amounts(spark):
    text = "Our backlog grew. Remaining performance obligations rose and RPO doubled."
    c = one(spark, TX.term_counts("x"), x=text)
    assert c.backlog_mentions == 1 and c.rpo_mentions == 3
    a = one(spark, TX.amounts("x"), x="The backlog stands at $1.2 billion; of that, remaining performance obligations came to $450 million.")
    assert {1.2e9, 4.5e8} <= {i.value for i in a}
    assert one(spark, TX.amounts("x"), x="backlog of $12") == []


def test_snippets_keep_distance(spark):
    text = "backlog " + "x" * 50 + " backlog " + "y" * 600 + " backlog end"
    s = one(spark, TX.snippets("x", ("backlog",), radius=20), x=text)
    assert len(s) == 2 and s[0].startswith("backlog") and s[1].endswith("end")


def test_ownership_texts(spark):
    assert one(spark, TX.ownership_section("x"), x="Nothing here 5%.") == ""
    text = "Security ownership of management. All directors and executive officers as a group own shares worth 6.7% in total."
    section = one(spark, TX.ownership_section("x"), x=text)
    assert one(spark, TX.group_percent("x"), x=section) == pytest.approx(0.067)
    rows = one(spark, TX.ownership_rows("x"), x=section)
    assert [r.percent for r in rows] == [pytest.approx(0.067)]
    assert one(spark, TX.ownership_rows("x"), x="The board proposal needs the vote of 50% of shares outstanding today.") == []
    assert one(spark, TX.ownership_percents("x"), x="beneficially owned 7.5% and 7.5% of class") == [pytest.approx(0.075)]


def test_names_and_awards(spark):
    assert one(spark, S.company_tokens("x"), x="The Acme 5 Holdings, Inc. B") == ["ACME", "5"]
    awards = spark.createDataFrame([("A", "Acme Space LLC", 12e6), ("A", "Other Corp", 5e6)], "ticker string, recipient_name string, award_amount double")
    out = J.match_awards(awards, spark.createDataFrame([("A", "Acme Space Inc")], "ticker string, name string")).collect()
    assert [(r.award_amount, r.recipient_match_score) for r in out] == [(12e6, 1.0)]


def test_issuer_match_needs_two_words(spark):
    issuers = spark.createDataFrame([("ROCKET ENERGY CORP",), ("ROCKET LAB CORP CLASS A",), ("RKLB HOLD",)], "issuer string")
    companies = spark.createDataFrame([("RKLB", "Rocket Lab Corp")], "ticker string, name string")
    assert {r.issuer for r in J.issuer_matches(issuers, companies).collect()} == {"ROCKET LAB CORP CLASS A", "RKLB HOLD"}


def test_hard_screen(spark):
    cols = "ticker string, market_cap double, institutional_ownership double, insider_ownership double, quarterly_revenue_yoy double, trailing_pe double, backlog_mentions int, rpo_mentions int"
    df = spark.createDataFrame([("A", 1e9, 0.7, 0.06, 0.4, 18.0, 3, 1), ("B", 1e9, 0.7, 0.06, 0.4, 18.0, 0, 0)], cols)
    out = {r.ticker: r for r in df.select("ticker", *[c.alias(n) for n, c in S.hard_screen().items()]).collect()}
    assert out["A"].passed and out["A"].score > 80
    assert out["B"].financial_passed and not out["B"].passed and len(out["B"].failures) == 1


ITEMS = "ticker string, item_id bigint, event_date date, created_at string, source_key string, importance_score double, evidence map<string,string>"


def test_score_grade_a(spark):
    ev = [
        {"market_cap": "1e9", "pe_ttm": "15"},
        {"quarterly_revenue_yoy": "0.6", "gross_margin": "0.4", "operating_margin": "0.2", "net_margin": "0.15", "free_cash_flow_margin": "0.1", "debt_to_assets": "0.1", "liabilities_to_assets": "0.4"},
        {"backlog_mentions": "12", "rpo_mentions": "9", "largest_amount": "5e8", "revenue": "2e8"},
        {"insider_ownership": "0.08", "institutional_ownership": "0.7"},
    ]
    rows = [("A", i, dt.date(2026, 1, 1), f"2026-01-0{i + 1}", f"s{i}", 90.0, e) for i, e in enumerate(ev)]
    r = SC.score_items(spark.createDataFrame(rows, ITEMS)).first()
    assert r.total_score >= 80 and r.grade == "A" and r.missing_dimensions == []


def test_newer_null_hides_older_value(spark):
    rows = [("A", 1, dt.date(2026, 1, 1), "2026-01-01", "s", 1.0, {"pe_ttm": "15", "pb": "2"}), ("A", 2, dt.date(2026, 1, 2), "2026-01-02", "s", 1.0, {"pe_ttm": None})]
    df = spark.createDataFrame(rows, ITEMS).withColumn("place", F.lit(1))
    assert SC.latest_metrics(df).first().metrics == {"pb": "2"}


def test_observation_merge_keeps_first_title_and_last_run(spark):
    rows = [(1, "A", "s", "t", "h", "first", "u", dt.datetime(2026, 1, 1), {"a": "1", "b": "1"}), (2, "A", "s", "t", "h", "later", "v", dt.datetime(2026, 1, 2), {"b": "2"})]
    df = spark.createDataFrame(rows, "run_id int, ticker string, source_key string, observation_type string, raw_hash string, title string, source_url string, fetched_at timestamp, metadata map<string,string>")
    r = M.merge_observations(df).first()
    assert (r.title, r.run_id, r.metadata) == ("first", 2, {"a": "1", "b": "2"})


def test_timetable_and_event_merge(spark):
    doc = json.dumps({"abc": [{"event_date": "2020-01-01", "title": "old"}, {"event_date": "2030-01-01", "title": "new", "confidence_score": 60}]})
    ev = FI.timetable_events(spark.createDataFrame([(doc,)], "config_json string"), F.lit("2026-01-01").cast("date"))
    assert [(r.ticker, r.title) for r in ev.collect()] == [("ABC", "new")]
    better = ev.withColumn("confidence_score", F.lit(90.0))
    assert M.merge_events(ev, better).first().confidence_score == 90.0


def pts(spark, rows):
    cols = "pair_id string, session_date date, ts timestamp_ntz, rsi double, long_price double, short_price double"
    df = spark.createDataFrame([("p", t.date(), t, *r) for t, *r in rows], cols)
    return df.withColumns({f"{leg}_{side}": F.col(f"{leg}_price") for leg in ("long", "short") for side in ("bid", "ask")})


def test_rotation_two_days(spark):
    day = lambda d, m: dt.datetime(2026, 6, d, 9, 30 + m)
    points = pts(spark, [(day(15, 0), 10.0, 100.0, 50.0), (day(15, 1), 90.0, 110.0, 50.0), (day(16, 0), 10.0, 100.0, 50.0), (day(16, 1), 90.0, 90.0, 50.0)])
    state = RO.ledger_state(points, (RO.Strategy("r"),))
    daily = RO.daily_results(state).orderBy("session_date").collect()
    assert [d.outcome for d in daily] == ["win", "loss"]
    s = RO.period_summary(RO.daily_results(state)).first()
    assert s.day_win_rate == 0.5 and s.trade_count == 2


def test_profit_take_comes_first(spark):
    t = lambda m: dt.datetime(2026, 6, 15, 9, 30 + m)
    points = pts(spark, [(t(0), 10.0, 100.0, 50.0), (t(1), 10.0, 105.0, 50.0), (t(2), 50.0, 105.0, 50.0)])
    ledger = RO.rotation_ledger(RO.ledger_state(points, (RO.Strategy("x", take_profit=0.04),))).collect()
    assert [(r.reason, round(r.pnl, 6)) for r in ledger] == [("profit_take", 50.0)]


def test_missing_weekdays(spark):
    df = spark.createDataFrame([("p", dt.date(2026, 6, 16)), ("p", dt.date(2026, 6, 18))], "k string, d date")
    assert [r.day for r in J.missing_weekdays(df, "k", "d").collect()] == [dt.date(2026, 6, 17)]


def test_launch_matching(spark):
    docs = [
        json.dumps({"id": "1", "name": "Electron", "net": "2030-01-01T00:00:00Z", "status": {"abbrev": "Go"}, "launch_service_provider": {"name": "Rocket Lab"}}),
        json.dumps({"id": "2", "name": "Old", "net": "2020-01-01T00:00:00Z", "status": {"abbrev": "Success"}, "launch_service_provider": {"name": "Rocket Lab"}}),
    ]
    ev = FI.normalise_launches(spark.createDataFrame([(d,) for d in docs], "launch_json string"))
    now = F.lit("2026-01-01").cast("timestamp")
    keep = ev.filter(J.still_relevant(F.col("net").cast("timestamp"), F.col("status"), now))
    out = J.keyword_matches(keep, F.col("match_text"), {"RKLB": ["rocket lab", "zzz"]}).collect()
    assert [(r.launch_id, r.symbol, r.matched_keywords) for r in out] == [("1", "RKLB", ["rocket lab"])]


def test_watchlist_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ABC\n# note\n\n DEF \n")
    (tmp_path / "b.csv").write_text("name,ticker\nx,GHI\ny,\n")
    assert {r.symbol for r in RD.read_watchlist(spark, str(tmp_path / "a.txt")).collect()} == {"ABC", "DEF"}
    assert {r.symbol for r in RD.read_watchlist(spark, str(tmp_path / "b.csv")).collect()} == {"GHI"}
    (tmp_path / "c.txt").write_text("\n# one, two\n\nJKL\n MNO \n")
    (tmp_path / "d.csv").write_text('\r\nname,Ticker,x\r\n"Smith, ""J""",PQR,1\r\n,,\r\nplain, STU ,2\r\n')
    (tmp_path / "e.csv").write_text("")
    both = RD.read_watchlist(spark, str(tmp_path / "[c-e]*"))
    assert {r.symbol for r in both.collect()} == {"JKL", "MNO", "PQR", "STU"}


def test_one_long_watchlist_is_read_in_parts(spark, tmp_path):
    (tmp_path / "long.csv").write_text("# list\n\nname,ticker\n" + "".join(f"n{i},S{i}\n" for i in range(3000)) + "name,ticker\n")
    (tmp_path / "long.txt").write_text("".join(f"T{i}\n" for i in range(3000)))
    sizes = {"spark.sql.files.maxPartitionBytes": "4096", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in sizes}
    try:
        for k, v in sizes.items():
            spark.conf.set(k, v)
        got = RD.read_watchlist(spark, str(tmp_path / "long.*"))
        assert got.rdd.getNumPartitions() > 4
        assert sorted(r.symbol for r in got.collect()) == sorted([f"S{i}" for i in range(3000)] + [f"T{i}" for i in range(3000)] + ["ticker"])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_missing_weekdays_shuffle_only_the_days_present(spark):
    d = dt.date
    rows = [(1, d(2026, 6, 12)), (1, d(2026, 6, 18)), (1, d(2026, 6, 18)), (None, d(2026, 6, 15)), (None, d(2026, 6, 17)), (2, d(2026, 6, 15)), (3, None), (1, None)]
    out = J.missing_weekdays(spark.createDataFrame(rows, "k int, d date"), "k", "d")
    assert sorted((r.k or 0, r.day.day) for r in out.collect()) == [(0, 15), (0, 16), (0, 17), (1, 15), (1, 16), (1, 17)]
    assert "LeftAnti" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_late_rows_are_dropped_from_live_bars(spark, tmp_path):
    def part(name, rows):
        spark.createDataFrame(rows, "symbol string, ts timestamp, close double, volume double").coalesce(1).write.parquet(str(tmp_path / "in.parquet" / name))

    base = dt.datetime(2026, 1, 5, 9, 30)
    part("p1", [("A", base + dt.timedelta(minutes=m), 10.0 + m, 1.0) for m in range(30)])
    schema = spark.read.parquet(str(tmp_path / "in.parquet" / "p1")).schema

    def stream():
        return spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in.parquet"))

    out = str(tmp_path / "out")
    first = L.run_to_files(L.live_bars(stream(), 3, "1 minutes"), out).count()
    part("p2", [("A", base + dt.timedelta(minutes=1), 99.0, 1.0), ("A", base + dt.timedelta(minutes=60), 11.0, 1.0)])
    after = L.run_to_files(L.live_bars(stream(), 3, "1 minutes"), out)
    assert first > 0 and after.filter(F.col("high") == 99.0).count() == 0
    assert after.count() > first


def test_stream_and_batch_rotation_agree(spark):
    import random

    rng = random.Random(5)
    rows, strategy = [], RO.Strategy("x", take_profit=0.02)
    for d in (15, 16):
        for m in range(60):
            rows.append((dt.datetime(2026, 6, d, 10, m), None if m < 3 else rng.uniform(0, 100), rng.uniform(90, 110), rng.uniform(40, 60)))
    points = pts(spark, rows)
    batch = {(str(r.session_date), r.leg, r.reason, round(r.exit_price, 9)) for r in RO.rotation_ledger(RO.ledger_state(points, (strategy,))).collect()}
    legs, live, day = {}, set(), None
    for r in points.orderBy("ts").collect():
        if r.session_date != day:
            day, legs = r.session_date, {}
        for t in L.rotation_step(legs, r, strategy):
            live.add((str(day), t["leg"], t["reason"], round(t["exit_price"], 9)))
    assert batch == live and batch


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_rounding_equals_the_binary_value(spark, digits):
    import random

    from tidemark.functions.numeric import fixed_text, round_even

    rng = random.Random(digits)
    values = [s * v for v in (0.0, 0.5, 1.5, 2.5, 0.05, 0.15, 0.25, 0.35, 749.15, 2.675, 1.005, 0.125, 999.95, 1e15, 123456789012.345, 1e-9) for s in (1, -1)]
    values += [rng.randrange(10**6) / 10 ** rng.randrange(1, 5) for _ in range(400)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    got = df.select("v", fixed_text("v", digits).alias("t"), fixed_text("v", digits, True).alias("g"), round_even("v", digits).alias("r")).collect()
    for r in got:
        if r.v is None:
            assert r.t is None and r.r is None
        elif abs(r.v) * 10 ** (digits + 1) < 2**52:
            assert r.t.lstrip("-") == f"{abs(r.v):.{digits}f}" and r.g.lstrip("-") == f"{abs(r.v):,.{digits}f}" and (r.v >= 0 or r.t[0] == "-")
            assert r.r == round(r.v, digits)


def test_nothing_is_cut_off(spark):
    from tidemark.operators import daily, facts, rank, score

    text = " ".join(f"backlog of ${i} million;" + " filler" * 30 for i in range(1, 21))
    a = one(spark, TX.amount_summary(TX.amounts("x", least=0)), x=text)
    assert a.amount_mentions >= 20 and a.largest_amount == 2e7
    days = spark.range(600).selectExpr("'S' AS symbol", "date_add(DATE'2020-01-01', CAST(id AS INT)) AS session_date", "CAST(CASE id WHEN 301 THEN 1 WHEN 402 THEN 9999 ELSE 100 END AS DOUBLE) AS close")
    t = daily.price_trend(days).first()
    assert (t.point_count, t.min_close, t.max_close) == (600, 1.0, 9999.0)
    items = spark.range(300).selectExpr("'T' AS ticker", "id AS item_id", "date_add(DATE'2020-01-01', CAST(id AS INT)) AS event_date", "date_add(DATE'2020-01-01', CAST(id AS INT)) AS created_at", "map(concat('k', id), CAST(id AS STRING)) AS evidence")
    assert len(score.latest_metrics(rank.latest_items(items)).first().metrics) == 300
    holdings = spark.range(20).selectExpr("concat('m', id) AS manager", "id AS manager_no", "'Alpha Beta Corp' AS name_of_issuer", "CAST(1 AS DOUBLE) AS value_usd", "CAST(2 AS DOUBLE) AS shares")
    h = facts.holdings_rollup(holdings, spark.createDataFrame([("AB", "Alpha Beta Inc")], "ticker string, name string")).first()
    assert (h.matched_manager_count, h.total_value_usd, h.total_shares) == (20, 20.0, 40.0)
    rows = spark.range(250).selectExpr("concat('T', id) AS ticker", "'X' AS sector_group", "CAST(id AS DOUBLE) AS total_score", "DATE'2020-01-01' AS scored_at", "'n' AS name", "'c' AS code")
    s = rank.grouped_by_sector(rows).first()
    assert s.candidate_count == 250 and len(s.candidates) == 250 and s.candidates[0] == "T249"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_and_pages_are_parsed_once(spark):
    xml = "<ownershipDocument><nonDerivativeTable><nonDerivativeTransaction><transactionCoding><transactionCode>P</transactionCode></transactionCoding></nonDerivativeTransaction></nonDerivativeTable></ownershipDocument>"
    filings = spark.range(2).selectExpr("id AS filing_no", "concat('T', id) AS ticker", f"concat('{xml}', substr('', id)) AS xml")
    rolled = FA.form4_rollup(FI.form4_transactions(filings))
    assert plan_of(rolled).count("from_xml(") == 1
    assert sorted((r.ticker, r.transaction_count, len(r.transactions)) for r in rolled.collect()) == [("T0", 1, 1), ("T1", 1, 1)]
    page = "<table><tr>" + "".join(f"<td> <b>{c}</b> &amp;\u00a0{c}</td>" if c != "T" else "<td>T</td>" for c in "abcTefghijkl") + "</tr></table>"
    pages = spark.createDataFrame([("T", page), ("U", page), ("T", None)], "ticker string, html string")
    rows = PG.insider_transactions(pages)
    assert plan_of(rows).count("<td[^>]*>(.*?)</td>") == 1 and plan_of(rows).count("<[^>\u0001]+>") == 1
    assert [(r.ticker, r.row_no, r.transaction_flags, r.ownership_delta) for r in rows.collect()] == [("T", 0, "a & a", "k & k")]


def test_listed_transactions_are_the_first(spark):
    rows = [("T", n, p, "A" if n % 2 else "D", f"d{n}{p}", "P", 1.0, 2.0, 2.0) for n in range(3) for p in range(2)] + [(None, 9, 0, "A", "x", "P", 1.0, 1.0, 1.0)]
    t = spark.createDataFrame(rows, "ticker string, filing_no int, position int, acquired_disposed string, transaction_date string, transaction_code string, shares double, price double, value double")
    whole, short = FA.form4_rollup(t).collect(), FA.form4_rollup(t, listed=3).collect()
    assert [x.transaction_date for x in whole[0].transactions] == ["d00", "d01", "d10", "d11", "d20", "d21"] and len(whole) == 1
    assert [x.transaction_date for x in short[0].transactions] == ["d00", "d01", "d10"] and short[0].transaction_count == 6


def test_observations_are_shuffled_once(spark):
    h = "0123456789abcdef" * 4
    rows = [("A", "s", "t", h, 1, 1, "one", None, {"a": "1"}), ("A", "s", "t", h, 2, 2, "two", "u", {"a": "2", "b": "3"}), ("A", "s", "t", h.upper(), 1, 1, "x", None, None), ("A", "s", "t", None, 1, 1, "y", None, None), ("A", "s", "t", "", 1, 1, "z", None, {})]
    obs = spark.createDataFrame(rows, "ticker string, source_key string, observation_type string, raw_hash string, run_id int, fetched_at int, title string, source_url string, metadata map<string,string>")
    merged = M.merge_observations(obs)
    assert plan_of(merged).count("Exchange hashpartitioning") == 1
    got = {r.raw_hash: (r.title, r.run_id, r.metadata) for r in merged.collect()}
    assert got == {h: ("one", 2, {"a": "2", "b": "3"}), h.upper(): ("x", 1, {}), None: ("y", 1, {}), "": ("z", 1, {})}


def test_proxy_texts_are_scanned_by_all_cores(spark, tmp_path):
    from tidemark.plans.catalog_evidence import proxy_texts

    part = spark.range(40).selectExpr("id AS p_partkey", "'red bolt' AS p_name", "'Brand#1' AS p_brand", "'SMALL' AS p_type", "7 AS p_size", "900.0D AS p_retailprice")
    part.coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    texts = proxy_texts(spark, str(tmp_path))
    assert texts.rdd.getNumPartitions() >= 8 and texts.count() == 40


def test_holdings_of_one_token_set_are_matched_once(spark):
    names = ["Red Bolt Corp", "RED bolt", "Blue Nut", None, "zz corp", "Red zz Nut"]
    held = [(f"m{i % 4}", i % 4, n, float(i), 1.0 if i % 3 else None) for i, n in enumerate(names * 5)]
    companies = [("A", "Red Bolt Inc"), ("A", "Blue Nut Inc"), ("A", "Blue Nut Inc"), ("ZZ", "Green Cap"), ("B", "bolt RED"), ("C", None), (None, "Nut Blue"), ("D", "Red")]
    holdings = spark.createDataFrame(held, "manager string, manager_no int, name_of_issuer string, value_usd double, shares double")
    frame = spark.createDataFrame(companies, "ticker string, name string")
    pairs = [(r.issuer, r.ticker) for r in J.issuer_matches(holdings.selectExpr("name_of_issuer AS issuer"), frame).collect()]
    assert len(pairs) == len(set(pairs)) and ("zz corp", "ZZ") in pairs and ("Blue Nut", None) in pairs
    want = {}
    for issuer, ticker in pairs:
        for m, _, n, v, s in held:
            if n == issuer:
                managers, value, shares = want.get(ticker, (set(), 0.0, 0.0))
                want[ticker] = managers | {m}, value + v, shares + (s or 0.0)
    got = {r.ticker: (r.matched_manager_count, r.total_value_usd, r.total_shares) for r in FA.holdings_rollup(holdings, frame).collect()}
    assert got == {t: (len(m), v, s) for t, (m, v, s) in want.items()}
    plan = FA.holdings_rollup(holdings, frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "name_of_issuer" not in plan  # companies meet token sets, not every holding


def test_ingest_log_keeps_hashes_as_bytes_and_reads_older_text(spark, tmp_path):
    schema = "ticker string, source_key string, observation_type string, raw_hash string, run_id int, fetched_at int, title string, source_url string, metadata map<string,string>"
    h = "ab" * 32
    log = L.IngestLog(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([("A", "s", "t", h, 1, 1, "one", None, {"a": "1"})], schema), 0)
    assert dict(spark.read.parquet(str(tmp_path / "log/deltas/b0")).dtypes)["raw_hash"] == "binary"
    M.sightings(spark.createDataFrame([("A", "s", "t", h, 2, 2, "two", None, {"a": "2"})], schema)).select("*", log._bucket()).write.partitionBy("bucket").parquet(str(tmp_path / "log/deltas/b1"))
    assert [(r.raw_hash, r.title, r.run_id, r.metadata) for r in log.read().collect()] == [(h, "one", 2, {"a": "2"})]
    log.compact()
    assert [(r.raw_hash, r.title, r.run_id, r.metadata) for r in log.read().collect()] == [(h, "one", 2, {"a": "2"})]
