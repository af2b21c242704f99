"""Queries for scalar functions, screens, name matching and keyword matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions import scalars as S
from tidemark.functions.numeric import rnd
from tidemark.operators import joins as J
from tidemark.operators import screens as SC
from tidemark.plans.registry import query
from tidemark.plans.sqltext import r
from tidemark.sources.tables import table


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


@query(
    "a03_clean_number",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN NULL ELSE round(p_retailprice, 2) END AS value FROM part""",
)
def _(spark, d):
    p = table(spark, d, "part")
    text = (
        F.when(F.col("p_size") < 4, " N/A ").when(F.col("p_size") < 7, "--").when(F.col("p_size") < 10, "NaN")
        .when(F.col("p_size") < 20, F.concat(F.format_number("p_retailprice", 2), F.lit(" %")))
        .otherwise(F.concat(F.lit("$"), F.format_number("p_retailprice", 2)))
    )
    return p.select("p_partkey", S.clean_number(text).alias("value"))


@query("a04_ratio_scale", f"SELECT c_custkey, {r('CASE WHEN abs(c_acctbal / 1000) > 1.5 THEN c_acctbal / 100000 ELSE c_acctbal / 1000 END', 'ratio', 8)} FROM customer")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey", rnd(S.normalise_ratio(F.col("c_acctbal") / 1000), 8).alias("ratio"))


@query(
    "a22_quotes",
    f"""WITH q AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice / 1000 END AS p,
      CASE WHEN o_orderpriority < '3' THEN o_totalprice / 1001 END AS b, CASE WHEN o_orderkey % 10 < 8 THEN o_totalprice / 999 ELSE 0 END AS a FROM orders),
    s AS (SELECT *, coalesce(b > 0 AND a > 0 AND b <= a, false) AS sane, greatest(p * 0.0004, CASE WHEN p < 1 THEN 0.0001 ELSE 0.01 END) AS sp FROM q)
    SELECT o_orderkey, CASE WHEN p IS NULL THEN 'missing' WHEN sane THEN 'quote' ELSE 'estimated' END AS source,
    {r("CASE WHEN p IS NOT NULL THEN CASE WHEN sane THEN b ELSE greatest(0.0001, p - sp / 2) END END", "bid", 10)},
    {r("CASE WHEN p IS NOT NULL THEN CASE WHEN sane THEN a ELSE p + sp / 2 END END", "ask", 10)} FROM s""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    last = [F.lit(None).cast("double"), F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") / 1000)]
    bid = [F.when(F.col("o_orderpriority") < "3", F.col("o_totalprice") / 1001)]
    ask = [F.when(F.col("o_orderkey") % 10 < 8, F.col("o_totalprice") / 999).otherwise(0.0)]
    q = o.select("o_orderkey", S.quote(last, bid, ask).alias("q"))
    return q.select("o_orderkey", "q.source", rnd("q.bid", 10).alias("bid"), rnd("q.ask", 10).alias("ask"))


SCREEN_SQL = """sc AS (SELECT 'C' || c_custkey AS ticker, c_acctbal * 1e6 AS cap, c_acctbal / 12000 AS inst, c_nationkey / 200.0 AS own, (c_acctbal - 2000) / 10000 AS yoy,
  c_acctbal / 120 AS pe, c_nationkey AS mentions FROM customer)"""


#: Tests of the hard screen in order: column and rule as the messages name them.
SCREEN_RULES = (("market_cap", "5e+08..4e+09"), ("institutional_ownership", ">=0.65"), ("insider_ownership", ">=0.05"), ("quarterly_revenue_yoy", ">=0.25"), ("trailing_pe", "0..30"))


def screen_input(spark, d):
    b, n = F.col("c_acctbal"), F.col("c_nationkey")
    return table(spark, d, "customer").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"),
        (b * 1e6).alias("market_cap"),
        (b / 12000).alias("institutional_ownership"),
        (n / 200).alias("insider_ownership"),
        ((b - 2000) / 10000).alias("quarterly_revenue_yoy"),
        (b / 120).alias("trailing_pe"),
        n.alias("backlog_mentions"),
        F.lit(0).alias("rpo_mentions"),
    )


@query(
    "c03_hard_screen",
    f"""WITH {SCREEN_SQL}, t AS (SELECT *, cap BETWEEN 5e8 AND 4e9 AS t1, inst >= 0.65 AS t2, own >= 0.05 AS t3, yoy >= 0.25 AS t4, pe > 0 AND pe <= 30 AS t5 FROM sc)
    SELECT ticker, round(18 * t1::INT + 16 * t2::INT + 14 * t3::INT + 24 * t4::INT + 12 * t5::INT + CASE WHEN yoy > 0.25 THEN least(10, (yoy - 0.25) * 30) ELSE 0 END
      + CASE WHEN pe > 0 AND pe <= 20 THEN 4 ELSE 0 END + CASE WHEN mentions > 0 THEN 16 + least(6, mentions) ELSE 0 END, 2) AS score,
      CAST(t1::INT + t2::INT + t3::INT + t4::INT + t5::INT AS BIGINT) AS hard_pass_count, (t1 AND t2 AND t3 AND t4 AND t5 AND mentions > 0) AS passed,
      CAST(5 - (t1::INT + t2::INT + t3::INT + t4::INT + t5::INT) + CASE WHEN mentions > 0 THEN 0 ELSE 1 END AS BIGINT) AS failure_count,
      concat_ws('|', {", ".join(f"CASE WHEN t{i} THEN '{n} meets {x}' END" for i, (n, x) in enumerate(SCREEN_RULES, 1))}, CASE WHEN mentions > 0 THEN 'order terms in filings' END) AS positives,
      concat_ws('|', {", ".join(f"CASE WHEN NOT t{i} THEN '{n} misses {x}' END" for i, (n, x) in enumerate(SCREEN_RULES, 1))}, CASE WHEN mentions = 0 THEN 'order terms in filings' END) AS failures,
      concat_ws('|', CASE WHEN mentions = 0 THEN 'look for order terms in the latest report by hand' END, CASE WHEN mentions % 3 = 0 THEN 'fetch the latest filings and scan their text' END,
        CASE WHEN mentions % 2 = 0 THEN 'ratio repaired' END) AS next_steps FROM t""",
)
def _(spark, d):
    n = F.col("backlog_mentions")
    cols = S.hard_screen(filing_url=F.when(n % 3 == 1, "https://x/1").when(n % 3 == 2, "https://x/2").otherwise(" "), warnings=F.when(n % 2 == 0, F.array(F.lit("ratio repaired"))))
    out = screen_input(spark, d).select("ticker", *[c.alias(n) for n, c in cols.items()])
    said = [F.array_join(F.transform(c, lambda x: F.substring_index(x, ":", 1)), "|").alias(c) for c in ("positives", "failures", "next_steps")]
    return out.select("ticker", "score", F.col("hard_pass_count").cast("bigint").alias("hard_pass_count"), "passed", F.size("failures").cast("bigint").alias("failure_count"), *said)


@query(
    "c04_market_screen",
    f"WITH {SCREEN_SQL} SELECT ticker, {r('cap', 'market_cap', 2)} FROM sc WHERE cap BETWEEN 5e8 AND 4e9 AND pe BETWEEN 5 AND 30",
)
def _(spark, d):
    return SC.market_screen(screen_input(spark, d)).select("ticker", rnd("market_cap", 2).alias("market_cap"))


@query(
    "c05_common_stock",
    f"""WITH p AS (SELECT p_partkey, replace(upper(substr(p_name, 1, 5)), ' ', '.') AS ticker, upper(' ' || replace(replace(p_name, 'bolt', 'warrant'), 'anvil', 'ads') || ' ') AS name,
      CASE WHEN p_size < 10 THEN '' WHEN p_size < 30 THEN 'US_NYSE' ELSE 'US_OTC' END AS ex FROM part)
    SELECT p_partkey, ticker <> '' AND NOT regexp_matches(ticker, '[.$/-]') AND length(ticker) <= 5 AND (ex = '' OR ex IN ('US_NASDAQ', 'US_NYSE', 'US_AMEX'))
      AND len(list_filter({sql_list(S.EXCLUDED_NAME_TERMS)}, lambda t: contains(name, t))) = 0 AS is_common FROM p""",
)
def _(spark, d):
    p = table(spark, d, "part")
    ticker = F.replace(F.upper(F.substring("p_name", 1, 5)), F.lit(" "), F.lit("."))
    name = F.replace(F.replace("p_name", F.lit("bolt"), F.lit("warrant")), F.lit("anvil"), F.lit("ads"))
    exchange = F.when(F.col("p_size") < 10, "").when(F.col("p_size") < 30, "US_NYSE").otherwise("US_OTC")
    return p.select("p_partkey", S.is_common_stock(ticker, exchange, name).alias("is_common"))


@query(
    "c06_universe_screen",
    f"""WITH {SCREEN_SQL} SELECT ticker, {r('yoy', 'growth')} FROM sc WHERE cap BETWEEN 5e8 AND 1e10 AND inst >= 0.3 AND own >= 0.05 AND yoy >= 0.1 AND pe BETWEEN 0.01 AND 90""",
)
def _(spark, d):
    return SC.universe_screen(screen_input(spark, d)).select("ticker", rnd("quarterly_revenue_yoy").alias("growth"))


@query(
    "c07_cap_range",
    """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN 5e8 ELSE least(p_size * 20e6, p_size * 1e9 / 25) END AS low,
    CASE WHEN p_type = 'PROMO' THEN 1e10 ELSE greatest(p_size * 20e6, p_size * 1e9 / 25) END AS high FROM part""",
)
def _(spark, d):
    text = F.when(F.col("p_type") == "PROMO", "any size").otherwise(
        F.concat((F.col("p_size") / 25).cast("decimal(10,2)").cast("string"), F.lit(" b - "), (F.col("p_size") * 20).cast("string"), F.lit("M cap"))
    )
    out = table(spark, d, "part").select("p_partkey", S.market_cap_range(text).alias("x"))
    return out.select("p_partkey", rnd("x.low", 2).alias("low"), rnd("x.high", 2).alias("high"))


@query(
    "c08_money_units",
    f"""SELECT p_partkey, {r("p_retailprice * CASE p_type WHEN 'STANDARD' THEN 1e9 WHEN 'ECONOMY' THEN 1e6 WHEN 'MEDIUM' THEN 1e6 WHEN 'LARGE' THEN 1e3 ELSE 1 END", "value", 2)} FROM part""",
)
def _(spark, d):
    unit = F.when(F.col("p_type") == "STANDARD", "bn").when(F.col("p_type") == "ECONOMY", "mm").when(F.col("p_type") == "MEDIUM", "million").when(F.col("p_type") == "LARGE", "thousand").otherwise("")
    return table(spark, d, "part").select("p_partkey", rnd(S.money_value(F.format_number("p_retailprice", 2), unit), 2).alias("value"))


@query(
    "c09_signed_number",
    f"""SELECT p_partkey, {r("CASE p_type WHEN 'PROMO' THEN 0 WHEN 'SMALL' THEN -p_retailprice WHEN 'LARGE' THEN -p_retailprice ELSE p_retailprice END", "value", 2)} FROM part""",
)
def _(spark, d):
    n = F.format_number("p_retailprice", 2)
    text = (
        F.when(F.col("p_type") == "PROMO", "new").when(F.col("p_type") == "SMALL", F.concat(F.lit("-$"), n))
        .when(F.col("p_type") == "LARGE", F.concat(F.lit("("), n, F.lit(")"))).otherwise(F.concat(F.lit("+$"), n))
    )
    return table(spark, d, "part").select("p_partkey", rnd(S.signed_number(text), 2).alias("value"))


@query(
    "c10_money_text",
    """SELECT c_custkey, CASE WHEN abs(c_acctbal * 1000000.0) >= 1e9 THEN printf('$%.2fB', c_acctbal * 1000000.0 / 1e9) WHEN abs(c_acctbal * 1000000.0) >= 1e6 THEN printf('$%.1fM', c_acctbal * 1000000.0 / 1e6)
    ELSE '$' || format('{:,}', CAST(round_even(c_acctbal * 1000000.0, 0) AS BIGINT)) END AS cap_text, printf('%.1f%%', c_nationkey / 7.0 * 100) AS pct_text FROM customer""",
)
def _(spark, d):
    return table(spark, d, "customer").select(
        "c_custkey", S.money_text(F.col("c_acctbal") * 1000000.0).alias("cap_text"), S.percent_text(F.col("c_nationkey") / 7).alias("pct_text")
    )


@query(
    "c11_safe_ratios",
    f"""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, {r('l_quantity / nullif(l_discount, 0)', 'ratio')}, {r('(l_tax - l_discount) / nullif(abs(l_discount), 0)', 'growth')},
    {r('l_tax / nullif(l_discount, 0) - 1', 'pct_diff')} FROM lineitem""",
)
def _(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber"), rnd(N.div("l_quantity", "l_discount")).alias("ratio"),
        rnd(N.growth("l_tax", "l_discount")).alias("growth"), rnd(N.pct_diff("l_tax", "l_discount")).alias("pct_diff"),
    )


@query(
    "c12_sum_present",
    f"""WITH x AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS a, CASE WHEN o_orderpriority < '3' THEN 10.0 END AS b FROM orders)
    SELECT o_orderkey, {r('CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END', 'total')} FROM x""",
)
def _(spark, d):
    a = F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    b = F.when(F.col("o_orderpriority") < "3", 10.0)
    return table(spark, d, "orders").select("o_orderkey", rnd(N.sum_present(a, b)).alias("total"))


TOKENS_SQL = f"""list_filter(string_split(trim(regexp_replace(upper(NAME), '[^A-Z0-9]+', ' ', 'g')), ' '),
  lambda t: NOT list_contains({sql_list(S.COMPANY_SUFFIXES)}, t) AND (length(t) > 1 OR regexp_full_match(t, '[0-9]')))"""


def tokens_sql(expr: str) -> str:
    return TOKENS_SQL.replace("NAME", expr)


@query("c13_company_tokens", f"""SELECT p_partkey, array_to_string({tokens_sql("'The ' || p_name || ' ' || p_brand || ' Holdings, Inc.'")}, '|') AS tokens FROM part""")
def _(spark, d):
    name = F.concat(F.lit("The "), F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" Holdings, Inc."))
    return table(spark, d, "part").select("p_partkey", F.array_join(S.company_tokens(name), "|").alias("tokens"))


@query(
    "c14_search_query",
    f"""WITH n AS (SELECT p_partkey, CASE WHEN p_size < 5 THEN '' WHEN p_size < 8 THEN 'The Co' ELSE p_name || ' ' || p_brand || ' ' || p_type END AS name FROM part)
    SELECT p_partkey, coalesce(nullif(array_to_string(list_slice({tokens_sql('name')}, 1, 4), ' '), ''), nullif(trim(name), ''), 'P' || p_partkey) AS query FROM n""",
)
def _(spark, d):
    name = F.when(F.col("p_size") < 5, "").when(F.col("p_size") < 8, "The Co").otherwise(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    p = table(spark, d, "part").withColumn("name", name).withColumn("t", F.concat(F.lit("P"), F.col("p_partkey").cast("string")))
    return p.select("p_partkey", S.search_query("name", "t").alias("query"))


ISSUER_SQL = f"""list_filter(string_split(trim(regexp_replace(regexp_replace(lower(NAME), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), ' '),
  lambda t: t <> '' AND NOT list_contains({sql_list(S.ISSUER_STOP_WORDS)}, t))"""


def issuer_sql(expr: str) -> str:
    return ISSUER_SQL.replace("NAME", expr)


@query("c15_issuer_name", f"""SELECT p_partkey, array_to_string({issuer_sql("p_name || ' ' || p_brand || ' common stock'")}, ' ') AS issuer FROM part""")
def _(spark, d):
    name = F.concat(F.col("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" common stock"))
    return table(spark, d, "part").select("p_partkey", F.array_join(S.issuer_tokens(name), " ").alias("issuer"))


@query(
    "c17_time_bucket",
    "SELECT event_id, strftime(date_trunc('hour', ts) + to_minutes(CAST(minute(ts) // 7 * 7 AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS bucket FROM events",
)
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format(S.time_bucket("ts", 7), "yyyy-MM-dd HH:mm:ss").alias("bucket"))


@query(
    "c18_weekdays",
    """WITH s AS (SELECT o_custkey, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS b FROM orders GROUP BY 1),
    x AS (SELECT o_custkey, CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM s)
    SELECT o_custkey, count(*) AS weekdays, CAST(min(day) AS VARCHAR) AS first_day FROM x WHERE isodow(day) < 6 GROUP BY 1""",
)
def _(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.min(F.to_date("o_orderdate")).alias("a"), F.max(F.to_date("o_orderdate")).alias("b"))
    days = S.weekdays(F.col("a"), F.col("b"))
    return s.select("o_custkey", F.size(days).cast("bigint").alias("weekdays"), F.get(days, 0).cast("string").alias("first_day")).filter("weekdays > 0")


@query(
    "c21_wilson",
    f"""WITH g AS (SELECT l_partkey, count(*) FILTER (l_returnflag = 'R') AS w, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT l_partkey, {r('greatest(0, (w * 1.0 / n + 3.8416 / (2 * n) - 1.96 * sqrt((w * 1.0 / n * (1 - w * 1.0 / n) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n))', 'lower_bound')} FROM g""",
)
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("w"), F.count(F.lit(1)).alias("n"))
    return g.select("l_partkey", rnd(N.wilson_lower("w", "n")).alias("lower_bound"))


@query(
    "c22_fact_period",
    """WITH f AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE CAST(floor(o_totalprice) AS BIGINT) % 420 END AS days, CASE o_orderpriority WHEN '1-URGENT' THEN 'Q2' WHEN '2-HIGH' THEN 'FY' ELSE '' END AS fp,
      CASE o_orderpriority WHEN '3-MEDIUM' THEN 'CY2020Q3' WHEN '4-NOT SPECIFIED' THEN 'CY2020Q3I' ELSE 'CY2020' END AS frame FROM orders)
    SELECT o_orderkey, CASE WHEN days IS NOT NULL THEN days BETWEEN 60 AND 120 ELSE fp LIKE 'Q%' OR frame = 'CY2020Q3' END AS quarterly,
    CASE WHEN days IS NOT NULL THEN days BETWEEN 300 AND 400 ELSE fp = 'FY' OR frame = 'CY2020' END AS annual FROM f""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    day = F.to_date("o_orderdate")
    days = (F.floor("o_totalprice").cast("int") % 420)
    start = F.when(F.col("o_orderstatus") != "F", day.cast("string"))
    end = F.date_add(day, days).cast("string")
    fp = F.when(F.col("o_orderpriority") == "1-URGENT", "Q2").when(F.col("o_orderpriority") == "2-HIGH", "FY").otherwise("")
    frame = F.when(F.col("o_orderpriority") == "3-MEDIUM", "CY2020Q3").when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "CY2020Q3I").otherwise("CY2020")
    return o.select("o_orderkey", S.is_quarterly_fact(start, end, fp, frame).alias("quarterly"), S.is_annual_fact(start, end, fp, frame).alias("annual"))


@query(
    "c23_attention_label",
    """WITH a AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice / 250000 END AS ratio, o_totalprice - 200000 AS flow, (o_orderkey % 61) / 100.0 - 0.1 AS ret FROM orders),
    p AS (SELECT *, CASE WHEN ratio IS NOT NULL THEN ratio >= 1.2 ELSE flow > 0 END AS pr FROM a)
    SELECT o_orderkey, CASE WHEN pr AND ret <= 0.12 THEN 'quiet_accumulation' WHEN pr AND ret >= 0.30 THEN 'crowded_momentum' WHEN ratio < 0.9 AND ret >= 0.20 THEN 'distribution_risk' ELSE 'neutral' END AS label FROM p""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    ratio = F.when(F.col("o_orderstatus") != "F", F.col("o_totalprice") / 250000)
    return o.select("o_orderkey", S.attention_label(ratio, F.col("o_totalprice") - 200000, (F.col("o_orderkey") % 61) / 100 - 0.1).alias("label"))


def gate_sources():
    def source(key, scope, flag, default, keywords=(), tickers=(), provider=""):
        arr = lambda xs: S.literal_array(xs) if xs else F.array().cast("array<string>")
        return F.struct(
            F.lit(key).alias("source_key"), F.lit(scope).alias("scope"), F.lit(flag).alias("flag"), F.lit(default).alias("default_enabled"),
            arr(keywords).alias("keywords"), arr(tickers).alias("tickers"), F.lit(provider).alias("provider"),
        )

    return F.array(
        source("market", "base", "", True),
        source("flows", "optional", "with_flows", False),
        source("machines", "sector", "", True, ("machinery", "auto")),
        source("site", "ticker", "", True, (), ("C7",)),
        source("model_a", "base", "", True, provider="a"),
        source("model_b", "base", "", True, provider="b"),
    )


@query(
    "c24_source_gate",
    """SELECT c_custkey, array_to_string(list_filter(['market', CASE WHEN c_acctbal > 5000 THEN 'flows' END, CASE WHEN c_mktsegment IN ('MACHINERY', 'AUTOMOBILE') THEN 'machines' END,
      CASE WHEN c_custkey = 7 OR c_acctbal < 0 THEN 'site' END, 'model_b'], lambda x: x IS NOT NULL), ',') AS sources FROM customer""",
)
def _(spark, d):
    c = table(spark, d, "customer")
    config = F.create_map(F.lit("with_flows"), (F.col("c_acctbal") > 5000).cast("string"), F.lit("provider"), F.lit("b"))
    own = F.when(F.col("c_acctbal") < 0, F.array(F.lit("site"))).otherwise(F.array().cast("array<string>"))
    ticker = F.concat(F.lit("C"), F.col("c_custkey").cast("string"))
    keys = S.source_gate(gate_sources(), ticker, F.concat_ws(" ", "c_name", "c_mktsegment"), own, config)
    return c.select("c_custkey", F.array_join(keys, ",").alias("sources"))


@query(
    "c25_launch_scores",
    """SELECT o_orderkey, CAST(greatest(35, least(92, greatest(66, CASE WHEN o_orderstatus = 'P' THEN 66 ELSE least(90, o_orderkey % 101) END)
      + CASE o_orderpriority WHEN '1-URGENT' THEN 4 WHEN '2-HIGH' THEN -6 ELSE 0 END)) AS BIGINT) AS confidence,
    CAST(CASE WHEN o_orderstatus = 'O' AND o_custkey % 2 = 0 THEN 86 WHEN o_orderpriority = '5-LOW' THEN 82 ELSE 76 END AS BIGINT) AS importance,
    CASE WHEN o_orderstatus = 'P' THEN 'Launch window TBD' ELSE 'a - b' END AS window_label FROM orders""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    prob = F.when(F.col("o_orderstatus") != "P", F.col("o_orderkey") % 101)
    status = F.when(F.col("o_orderpriority") == "1-URGENT", "Go").when(F.col("o_orderpriority") == "2-HIGH", "TBD").otherwise("Hold")
    ticker = F.when(F.col("o_custkey") % 2 == 0, "RKLB").otherwise("C1")
    provider = F.when(F.col("o_orderstatus") == "O", "Rocket Lab USA").otherwise("Other")
    words = F.when(F.col("o_orderpriority") == "5-LOW", F.array(F.lit("Payload"))).otherwise(F.array(F.lit("orbit")))
    known = F.when(F.col("o_orderstatus") != "P", "a").otherwise("")
    return o.select(
        "o_orderkey", S.launch_confidence(prob, status).cast("bigint").alias("confidence"), S.launch_importance(ticker, provider, words).cast("bigint").alias("importance"),
        S.launch_window(known, F.lit("b"), F.lit("")).alias("window_label"),
    )


@query(
    "c26_signal_summary",
    """SELECT o_orderkey, CAST(least(95, 50 + 3 * (o_custkey % 20)) AS BIGINT) AS importance_score, CAST(CASE WHEN o_custkey % 20 > 0 THEN 8 ELSE 0 END AS BIGINT) AS sentiment_score,
    CAST(CASE WHEN o_custkey % 20 > 0 THEN 72 ELSE 55 END AS BIGINT) AS confidence_score FROM orders""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    n = F.col("o_custkey") % 20
    s = S.text_signal_summary(F.col("o_orderpriority"), n, F.lit(0), F.array(F.col("o_orderpriority")))
    out = o.select("o_orderkey", s.alias("s"))
    return out.select("o_orderkey", *[F.col(f"s.{c}").cast("bigint").alias(c) for c in ("importance_score", "sentiment_score", "confidence_score")])


@query(
    "c27_compact_evidence",
    """SELECT c_custkey, array_to_string(list_filter(['market_cap', CASE WHEN c_acctbal > 0 THEN 'pe_ttm' END, 'sector'], lambda x: x IS NOT NULL), ',') AS kept FROM customer""",
)
def _(spark, d):
    ev = F.create_map(
        F.lit("market_cap"), F.col("c_acctbal").cast("string"), F.lit("pe_ttm"), F.when(F.col("c_acctbal") > 0, "12").otherwise(F.lit(None).cast("string")),
        F.lit("colour"), F.lit("x"), F.lit("sector"), F.col("c_mktsegment"),
    )
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.map_keys(S.compact_evidence(ev)), ",").alias("kept"))


# --- matching joins -------------------------------------------------------------------------


def awards(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", "l_linestatus")
    names = table(spark, d, "part").select(F.col("p_partkey").alias("l_suppkey"), F.concat(F.col("p_name"), F.lit(" LLC")).alias("recipient_name"))
    return li.join(names, "l_suppkey").withColumn("ticker", F.concat(F.lit("P"), F.col("l_partkey").cast("string")))


def part_companies(spark, d):
    return table(spark, d, "part").select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.concat(F.col("p_name"), F.lit(" Group")).alias("name")
    )


AWARDS_SQL = f"""aw AS (SELECT l_orderkey, l_linenumber, 'P' || l_partkey AS ticker, l_extendedprice, l_returnflag, l_linestatus,
    {tokens_sql("r.p_name || ' LLC'")} AS rt, {tokens_sql("c.p_name || ' Group'")} AS ct, c.p_brand AS brand
    FROM lineitem JOIN part r ON r.p_partkey = l_suppkey JOIN part c ON c.p_partkey = l_partkey),
  am AS (SELECT *, CASE WHEN len(list_distinct(ct)) = 0 OR len(rt) = 0 THEN 0 ELSE len(list_intersect(list_distinct(ct), rt)) * 1.0 / len(list_distinct(ct)) END AS sc FROM aw)"""


@query("d08_award_matches", f"WITH {AWARDS_SQL} SELECT ticker, {r('sc', 'recipient_match_score', 3)}, count(*) AS awards, {r('sum(l_extendedprice)', 'amount', 2)} FROM am WHERE sc >= 0.45 GROUP BY ticker, sc")
def _(spark, d):
    m = J.match_awards(awards(spark, d), part_companies(spark, d))
    out = m.groupBy("ticker", "recipient_match_score").agg(F.count(F.lit(1)).alias("awards"), F.sum("l_extendedprice").alias("amount"))
    return out.withColumn("amount", rnd("amount", 2))


@query(
    "d09_issuer_matches",
    f"""WITH i AS (SELECT DISTINCT p_name || ' ' || p_type || ' Corp' AS issuer FROM part), it AS (SELECT issuer, list_distinct({issuer_sql('issuer')}) AS t FROM i),
    c AS (SELECT 'P' || p_partkey AS ticker, list_distinct({issuer_sql("p_name || ' ' || p_type || ' Inc'")}) AS t FROM part)
    SELECT issuer, ticker FROM it, c WHERE len(list_intersect(c.t, it.t)) >= least(2, greatest(1, len(c.t))) OR list_contains(it.t, lower(ticker))""",
)
def _(spark, d):
    p = table(spark, d, "part")
    issuers = p.select(F.concat("p_name", F.lit(" "), "p_type", F.lit(" Corp")).alias("issuer"))
    companies = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.concat("p_name", F.lit(" "), "p_type", F.lit(" Inc")).alias("name"))
    return J.issuer_matches(issuers, companies)


KEYWORDS = {"ALFA": ["license", "http"], "BETA": ["@", "copyright"], "GAMA": [" the ", "license"]}


@query(
    "d10_keyword_matches",
    " UNION ALL ".join(
        f"SELECT doc_id, '{s}' AS symbol, array_to_string(list_filter({sql_list(ks)}, lambda k: contains(lower(text), k)), ',') AS matched_keywords FROM documents "
        f"WHERE len(list_filter({sql_list(ks)}, lambda k: contains(lower(text), k))) > 0"
        for s, ks in KEYWORDS.items()
    ),
)
def _(spark, d):
    m = J.keyword_matches_by_index(table(spark, d, "documents"), "doc_id", "text", J.keyword_table(spark, KEYWORDS))
    return m.select("doc_id", "symbol", F.array_join("matched_keywords", ",").alias("matched_keywords"))


@query(
    "d11_relevant_events",
    """SELECT o_orderkey FROM orders WHERE NOT coalesce(o_orderdate < TIMESTAMP '1998-01-01' - INTERVAL 240 HOUR OR (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1998-01-01'), false)""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Success").otherwise("Go")
    return o.filter(J.still_relevant(F.col("o_orderdate"), status, F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"), 240)).select("o_orderkey")
