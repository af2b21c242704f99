"""Queries for document parsing, text scans, fundamentals, roll-ups and the composite score."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import rnd
from tidemark.functions.textscan import squeeze
from tidemark.operators import facts as FA
from tidemark.operators import joins as J
from tidemark.operators import score as SC
from tidemark.operators import text as TX
from tidemark.plans.catalog_scalars import AWARDS_SQL, awards, issuer_sql, part_companies, sql_list
from tidemark.plans.registry import query
from tidemark.plans.sqltext import binary, r
from tidemark.sources import filings as FI
from tidemark.sources import pages as PG
from tidemark.sources.tables import spread, table

# --- facts --------------------------------------------------------------------------------

TAG_OF = {
    ("A", "F"): "Revenues", ("A", "O"): "GrossProfit", ("N", "F"): "NetIncomeLoss", ("N", "O"): "Assets", ("R", "F"): "Liabilities", ("R", "O"): "InventoryNet",
}
TAG_SQL = "CASE " + " ".join(f"WHEN l_returnflag = '{f}' AND l_linestatus = '{s}' THEN '{t}'" for (f, s), t in TAG_OF.items()) + " END"
FACTS_SQL = f"""fq AS (SELECT 'S' || l_suppkey AS cik, {TAG_SQL} AS tag, date_trunc('quarter', l_shipdate) AS q, round(sum(l_extendedprice), 2) AS value FROM lineitem GROUP BY ALL),
  facts AS (SELECT cik, tag, CAST(CAST(q AS DATE) AS VARCHAR) AS start, CAST(CAST(q + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS VARCHAR) AS "end", year(q) AS fy, 'Q' || quarter(q) AS fp, value FROM fq)"""


def fact_documents(spark, d):
    """Quarterly sums per supplier as nested company-fact documents."""
    li = table(spark, d, "lineitem")
    tag = F.lit(None).cast("string")
    for (f, s), t in TAG_OF.items():
        tag = F.when((F.col("l_returnflag") == f) & (F.col("l_linestatus") == s), t).otherwise(tag)
    q = F.to_date(F.date_trunc("quarter", "l_shipdate"))
    sums = li.groupBy(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("cik"), tag.alias("tag"), q.alias("q")).agg(F.round(F.sum("l_extendedprice"), 2).alias("v"))
    end = F.date_sub(F.add_months("q", 3), 1)
    fact = F.struct(
        F.lit("10-Q").alias("form"), F.concat(F.lit("Q"), F.quarter("q").cast("string")).alias("fp"), F.year("q").alias("fy"), F.lit("").alias("frame"), F.col("q").cast("string").alias("start"),
        end.cast("string").alias("end"), F.date_add(end, 30).cast("string").alias("filed"), F.col("v").alias("val"),
    )
    # a supplier has at most one fact per tag and quarter, so these lists are bounded by the calendar
    per_tag = sums.groupBy("cik", "tag").agg(F.struct(F.create_map(F.lit("USD"), F.array_sort(F.collect_list(fact))).alias("units")).alias("body"))
    per_cik = per_tag.groupBy("cik").agg(F.map_from_entries(F.collect_list(F.struct("tag", "body"))).alias("tags"))
    return per_cik.select("cik", F.to_json(F.struct(F.create_map(F.lit("us-gaap"), "tags").alias("facts"))).alias("facts_json"))


def facts(spark, d):
    return FI.flatten_facts(fact_documents(spark, d))


@query("a08_flatten_facts", f"""WITH {FACTS_SQL} SELECT cik, tag, start, "end", CAST(fy AS BIGINT) AS fy, fp, {r('value', 'value', 2)} FROM facts""")
def _(spark, d):
    return facts(spark, d).select("cik", "tag", "start", "end", F.col("fy").cast("bigint").alias("fy"), "fp", rnd("value", 2).alias("value"))


YOY_SQL = f"""{FACTS_SQL}, rv AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY "end" DESC) AS n, first(fp) OVER (PARTITION BY cik ORDER BY "end" DESC) AS lfp, first(fy) OVER (PARTITION BY cik ORDER BY "end" DESC) AS lfy,
    count(*) OVER (PARTITION BY cik) AS cnt FROM facts WHERE tag = 'Revenues'),
  rg AS (SELECT cik, max(CASE WHEN n = 1 THEN value END) AS revenue, max(CASE WHEN n = 1 THEN "end" END) AS period_end,
    coalesce(arg_min(value, n) FILTER (n > 1 AND fp = lfp AND fy = lfy - 1), CASE WHEN max(cnt) >= 5 THEN max(CASE WHEN n = 5 THEN value END) ELSE max(CASE WHEN n = 2 THEN value END) END) AS prior
    FROM rv GROUP BY cik HAVING count(*) >= 2)"""


@query("d06_prior_year_match", f"""WITH {FACTS_SQL}, t AS (SELECT *, row_number() OVER (PARTITION BY cik, tag ORDER BY "end" DESC) AS n, first(fp) OVER (PARTITION BY cik, tag ORDER BY "end" DESC) AS lfp,
    first(fy) OVER (PARTITION BY cik, tag ORDER BY "end" DESC) AS lfy FROM facts)
    SELECT cik, tag, count(*) AS facts, {r('coalesce(arg_min(value, n) FILTER (n > 1 AND fp = lfp AND fy = lfy - 1), CASE WHEN count(*) >= 5 THEN max(CASE WHEN n = 5 THEN value END) ELSE max(CASE WHEN n = 2 THEN value END) END)', 'prior_value', 2)}
    FROM t GROUP BY cik, tag""")
def _(spark, d):
    return FA.prior_year_matches(facts(spark, d), ["cik", "tag"]).select("cik", "tag", "facts", rnd("prior_value", 2).alias("prior_value"))


@query("g01_revenue_growth", f"WITH {YOY_SQL} SELECT cik, period_end, {r('revenue', 'revenue', 2)}, {r('(revenue - prior) / abs(prior)', 'revenue_yoy')} FROM rg")
def _(spark, d):
    return FA.revenue_growth(facts(spark, d)).select("cik", "period_end", rnd("revenue", 2).alias("revenue"), rnd("revenue_yoy").alias("revenue_yoy"))


@query(
    "g02_statement_growth",
    f"""WITH m AS (SELECT o_orderpriority || '-' || o_orderstatus AS ticker, date_trunc('quarter', o_orderdate) AS q, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
    k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY q DESC) AS n FROM m)
    SELECT ticker, {r('(max(v) FILTER (n = 1) - max(v) FILTER (n = 5)) / abs(max(v) FILTER (n = 5))', 'revenue_yoy')} FROM k GROUP BY ticker""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    m = o.groupBy(F.concat_ws("-", "o_orderpriority", "o_orderstatus").alias("ticker"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("period")).agg(F.sum("o_totalprice").alias("revenue"))
    return FA.statement_growth(m).select("ticker", rnd("revenue_yoy").alias("revenue_yoy"))


@query(
    "g03_latest_facts",
    f"""WITH {FACTS_SQL} SELECT cik, {r("coalesce(arg_max(value, \"end\") FILTER (tag = 'Assets'), arg_max(value, \"end\") FILTER (tag = 'Liabilities'))", 'balance', 2)}, {r("arg_max(value, \"end\") FILTER (tag = 'InventoryNet')", 'inventory', 2)}
    FROM facts GROUP BY cik""",
)
def _(spark, d):
    out = FA.latest_facts(facts(spark, d), {"balance": ("Assets", "Liabilities"), "inventory": FA.INVENTORY_TAGS})
    return out.select("cik", rnd("balance", 2).alias("balance"), rnd("inventory", 2).alias("inventory"))


QUALITY_SQL = f"""{YOY_SQL}, pk AS (SELECT f.cik, max(value) FILTER (tag = 'GrossProfit' AND "end" = period_end) AS gp, max(value) FILTER (tag = 'NetIncomeLoss' AND "end" = period_end) AS ni,
    arg_max(value, "end") FILTER (tag = 'Assets') AS assets, arg_max(value, "end") FILTER (tag = 'Liabilities') AS liab, arg_max(value, "end") FILTER (tag = 'InventoryNet') AS inv,
    max(value) FILTER (tag = 'InventoryNet' AND "end" = (CAST(substr(period_end, 1, 4) AS INTEGER) - 1) || substr(period_end, 5)) AS invp FROM facts f JOIN rg ON rg.cik = f.cik GROUP BY f.cik)"""


@query(
    "g04_financial_quality",
    f"""WITH {QUALITY_SQL} SELECT cik, {r('(revenue - prior) / abs(prior)', 'revenue_yoy')}, {r('gp / revenue', 'gross_margin')}, {r('ni / revenue', 'net_margin')}, {r('liab / assets', 'liabilities_to_assets')},
    {r('(inv - invp) / abs(invp)', 'inventory_yoy')} FROM rg JOIN pk USING (cik)""",
)
def _(spark, d):
    out = FA.financial_quality(facts(spark, d))
    return out.select("cik", *[rnd(c).alias(c) for c in ("revenue_yoy", "gross_margin", "net_margin", "liabilities_to_assets", "inventory_yoy")])


@query(
    "d07_prior_year_value",
    f"""WITH {FACTS_SQL} SELECT a.cik, a.tag, a."end", {r('b.value', 'prior_value', 2)} FROM facts a LEFT JOIN facts b ON b.cik = a.cik AND b.tag = a.tag
    AND b."end" = (CAST(substr(a."end", 1, 4) AS INTEGER) - 1) || substr(a."end", 5)""",
)
def _(spark, d):
    f = facts(spark, d)
    prior = f.select("cik", "tag", F.col("end").alias("__end"), F.col("value").alias("prior_value"))
    now = f.withColumn("__end", FA.prior_year_end(F.col("end")))
    return now.join(prior, ["cik", "tag", "__end"], "left").select("cik", "tag", "end", rnd("prior_value", 2).alias("prior_value"))


# --- filings -------------------------------------------------------------------------------


def submissions(spark, d):
    """Orders of a customer as its filing list, newest first: parallel arrays in pages of one key range each."""
    o = table(spark, d, "orders")
    form = F.when(F.col("o_orderpriority") == "1-URGENT", "10-Q").when(F.col("o_orderpriority") == "2-HIGH", "SCHEDULE 13G/A").otherwise("8-K")
    row = F.struct((-F.col("o_orderkey")).alias("k"), form.alias("form"), F.concat(F.lit("acc"), F.col("o_orderkey").cast("string")).alias("a"), F.to_date("o_orderdate").cast("string").alias("dt"))
    page = -F.floor(F.col("o_orderkey") / 4096)
    per = o.groupBy(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("cik"), page.alias("page")).agg(F.array_sort(F.collect_list(row)).alias("l"))
    recent = F.struct(
        F.transform("l", lambda x: x["form"]).alias("form"), F.transform("l", lambda x: x["a"]).alias("accessionNumber"), F.transform("l", lambda x: x["dt"]).alias("filingDate"),
        F.transform("l", lambda x: F.concat(x["a"], F.lit(".htm"))).alias("primaryDocument"),
    )
    return per.select("cik", "page", F.to_json(F.struct(F.struct(recent.alias("recent")).alias("filings"))).alias("submissions_json"))


@query(
    "a09_latest_filings",
    """WITH f AS (SELECT 'C' || o_custkey AS cik, o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN '10-Q' WHEN '2-HIGH' THEN 'SCHEDULE 13G/A' ELSE '8-K' END AS form FROM orders),
    k AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY o_orderkey DESC) AS n FROM f WHERE form <> '8-K') SELECT cik, form, 'acc' || o_orderkey AS accession FROM k WHERE n <= 2""",
)
def _(spark, d):
    return FI.latest_filings(submissions(spark, d), ("10-Q", "SC 13G/A"), 2, page="page").select("cik", "form", "accession")


@query(
    "a10_unique_filings",
    """SELECT 'C' || l_suppkey AS cik, 'a' || l_orderkey AS accession, l_returnflag AS document, min(l_partkey * 10 + l_linenumber) AS position FROM lineitem GROUP BY ALL""",
)
def _(spark, d):
    li = table(spark, d, "lineitem").select(
        F.concat(F.lit("C"), F.col("l_suppkey").cast("string")).alias("cik"), F.concat(F.lit("a"), F.col("l_orderkey").cast("string")).alias("accession"),
        F.col("l_returnflag").alias("document"), (F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("position"),
    )
    return J.unique_filings(li)


def form4_documents(spark, d):
    """One ownership document per order line with two transactions: the line, and its tax as a small purchase."""
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"))

    def txn(shares, price, side):
        parts = [
            "<nonDerivativeTransaction><transactionDate><value>", F.to_date("l_shipdate").cast("string"), "</value></transactionDate><transactionCoding><transactionCode>", F.col("l_linestatus"),
            "</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>", shares.cast("string"), "</value></transactionShares><transactionPricePerShare><value>", price.cast("string"),
            "</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>", side, "</value></transactionAcquiredDisposedCode></transactionAmounts></nonDerivativeTransaction>",
        ]
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts])

    side = F.when(F.col("l_returnflag") == "R", F.lit("D")).otherwise(F.lit("A"))
    body = F.concat(
        F.lit('<?xml version="1.0"?><ownershipDocument><issuer><issuerTradingSymbol>'), "ticker",
        F.lit("</issuerTradingSymbol></issuer><reportingOwner><reportingOwnerId><rptOwnerName>Owner</rptOwnerName></reportingOwnerId></reportingOwner><nonDerivativeTable>"),
        txn(F.col("l_quantity"), F.col("l_extendedprice"), side), txn(F.lit(1), F.col("l_tax"), F.lit("A")), F.lit("</nonDerivativeTable></ownershipDocument>"),
    )
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("filing_no"), "ticker", body.alias("xml"))


@query(
    "a11_form4_rows",
    f"""SELECT o_orderkey AS filing_no, 'C' || o_custkey AS issuer, 2 * count(*) AS transactions, {r('sum(l_quantity * l_extendedprice + l_tax)', 'value', 2)}, {r("coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0)", 'disposed_shares', 2)}
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def _(spark, d):
    t = FI.form4_transactions(form4_documents(spark, d))
    out = t.groupBy("filing_no", "issuer").agg(
        F.count(F.lit(1)).alias("transactions"), F.sum("value").alias("value"), F.coalesce(F.sum(F.when(F.col("acquired_disposed") == "D", F.col("shares"))), F.lit(0.0)).alias("disposed_shares")
    )
    return out.select("filing_no", "issuer", "transactions", rnd("value", 2).alias("value"), rnd("disposed_shares", 2).alias("disposed_shares"))


@query(
    "g05_form4_rollup",
    f"""SELECT 'C' || o_custkey AS ticker, 2 * count(*) AS transaction_count, count(*) + count(*) FILTER (l_returnflag <> 'R') AS purchase_count, count(*) FILTER (l_returnflag = 'R') AS sale_count,
    {r("sum(l_tax) + coalesce(sum(l_quantity * l_extendedprice) FILTER (l_returnflag <> 'R'), 0) - coalesce(sum(l_quantity * l_extendedprice) FILTER (l_returnflag = 'R'), 0)", 'net_purchase_value', 2)},
    2 * count(*) AS listed, {r("sum(l_tax) + sum(l_quantity * l_extendedprice)", 'listed_value', 2)}, CAST(CAST(min(l_shipdate) AS DATE) AS VARCHAR) AS first_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
)
def _(spark, d):
    out = FA.form4_rollup(FI.form4_transactions(form4_documents(spark, d)))
    return out.select(
        "ticker", "transaction_count", "purchase_count", "sale_count", rnd("net_purchase_value", 2).alias("net_purchase_value"), F.size("transactions").cast("bigint").alias("listed"),
        rnd(F.aggregate("transactions", F.lit(0.0), lambda acc, t: acc + F.coalesce(t["value"], F.lit(0.0))), 2).alias("listed_value"), F.array_min(F.transform("transactions", lambda t: t["transaction_date"].cast("string"))).alias("first_date"),
    )


def holdings_documents(spark, d):
    """Each part as a one-row information table of its brand's manager (namespaced XML)."""
    p = table(spark, d, "part")
    row = F.concat(
        F.lit("<ns1:infoTable><ns1:nameOfIssuer>"), "p_name", F.lit(" "), "p_type", F.lit(" Corp</ns1:nameOfIssuer><ns1:cusip>"), F.col("p_partkey").cast("string"), F.lit("</ns1:cusip><ns1:value>"),
        F.col("p_retailprice").cast("string"), F.lit("</ns1:value><ns1:shrsOrPrnAmt><ns1:sshPrnamt>"), F.col("p_size").cast("string"),
        F.lit("</ns1:sshPrnamt><ns1:sshPrnamtType>SH</ns1:sshPrnamtType></ns1:shrsOrPrnAmt></ns1:infoTable>"),
    )
    docs = p.select(F.col("p_brand").alias("manager"), row.alias("x"))
    no = F.regexp_extract("manager", "[0-9]+", 0).cast("int")
    return docs.select("manager", no.alias("manager_no"), F.concat(F.lit('<ns1:informationTable xmlns:ns1="http://example.org/it">'), "x", F.lit("</ns1:informationTable>")).alias("xml"))


@query("a12_holdings_rows", f"SELECT p_brand AS manager, CAST(p_partkey AS VARCHAR) AS cusip, p_name || ' ' || p_type || ' Corp' AS name_of_issuer, {r('p_retailprice * 1000', 'value_usd', 2)}, {r('CAST(p_size AS DOUBLE)', 'shares', 2)} FROM part")
def _(spark, d):
    h = FI.holdings_13f(holdings_documents(spark, d))
    return h.select("manager", "cusip", "name_of_issuer", rnd("value_usd", 2).alias("value_usd"), rnd("shares", 2).alias("shares"))


@query(
    "g10_holdings_rollup",
    f"""WITH h AS (SELECT p_brand AS manager, p_name || ' ' || p_type || ' Corp' AS issuer, p_retailprice * 1000 AS v, p_size AS s FROM part),
    it AS (SELECT issuer, list_distinct({issuer_sql('issuer')}) AS t FROM (SELECT DISTINCT issuer FROM h)),
    c AS (SELECT 'P' || p_partkey AS ticker, list_distinct({issuer_sql("p_name || ' ' || p_type || ' Inc'")}) AS t FROM part),
    m AS (SELECT issuer, ticker FROM it, c WHERE len(list_intersect(c.t, it.t)) >= least(2, greatest(1, len(c.t))))
    SELECT ticker, count(DISTINCT manager) AS matched_manager_count, {r('sum(v)', 'total_value_usd', 2)}, {r('CAST(sum(s) AS DOUBLE)', 'total_shares', 2)} FROM h JOIN m USING (issuer) GROUP BY ticker""",
)
def _(spark, d):
    p = table(spark, d, "part")
    companies = p.select(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("ticker"), F.concat("p_name", F.lit(" "), "p_type", F.lit(" Inc")).alias("name"))
    out = FA.holdings_rollup(FI.holdings_13f(holdings_documents(spark, d)), companies)
    return out.select("ticker", "matched_manager_count", rnd("total_value_usd", 2).alias("total_value_usd"), rnd("total_shares", 2).alias("total_shares"))


def class_documents(spark, d):
    p = table(spark, d, "part")
    good = F.concat(F.lit("<e:doc xmlns:e=\"urn:x\"><e:classPercent>"), (F.col("p_size") / 4).cast("string"), F.lit("%</e:classPercent><e:row><e:classPercent> 11.0 </e:classPercent></e:row><e:classPercent>140</e:classPercent></e:doc>"))
    bad = F.concat(F.lit("<doc><classPercent>"), F.col("p_size").cast("string"), F.lit("</classPercent>"))
    return p.select(F.col("p_partkey"), F.concat(F.lit("P"), F.col("p_brand")).alias("ticker"), F.when(F.col("p_type") == "PROMO", bad).otherwise(good).alias("xml"))


CLASS_SQL = "SELECT p_partkey, 'P' || p_brand AS ticker, CASE WHEN p_type = 'PROMO' THEN [] WHEN p_size / 4.0 = 11 THEN [0.11] ELSE list_reverse_sort([p_size / 4.0 / 100, 0.11]) END AS percents FROM part"


@query("a13_class_percents", f"WITH x AS ({CLASS_SQL}) SELECT p_partkey, array_to_string(list_transform(percents, lambda v: printf('%.4f', v)), ',') AS percents FROM x")
def _(spark, d):
    out = class_documents(spark, d).select("p_partkey", FI.class_percents("xml").alias("p"))
    return out.select("p_partkey", F.array_join(F.transform("p", lambda v: F.format_string("%.4f", v)), ",").alias("percents"))


@query("g08_beneficial_rollup", f"WITH x AS ({CLASS_SQL}) SELECT ticker, count(*) AS filing_count, {r('max(percents[1])', 'max_reported_percent')} FROM x GROUP BY ticker")
def _(spark, d):
    docs = class_documents(spark, d)
    text = squeeze(F.regexp_replace("xml", "<[^>]+>", " "))
    both = F.array_distinct(F.concat(TX.ownership_percents(text), FI.class_percents("xml")))
    out = FA.beneficial_rollup(docs.select("ticker", both.alias("percents")))
    return out.select("ticker", "filing_count", rnd("max_reported_percent").alias("max_reported_percent"))


# --- pages ----------------------------------------------------------------------------------

ENT = "replace(replace(replace(replace(X, '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')"


def ent(x: str) -> str:
    return ENT.replace("X", x)


SQUEEZE = "trim(regexp_replace(X, '\\s+', ' ', 'g'))"
PAGE_SQL = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'),
  '<noscript[^>]*>.*?</noscript>', ' ', 'gis'), '<!--.*?-->', ' ', 'gs'), '<[^>]+>', ' ', 'g')"""


@query(
    "a20_page_extract",
    f"""WITH t AS (SELECT page_id, {SQUEEZE.replace('X', ent("regexp_replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is'), '<[^>]+>', ' ', 'g')"))} AS title, {SQUEEZE.replace('X', ent(PAGE_SQL))} AS text FROM pages)
    SELECT page_id, title, '' AS description, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_checksum FROM t""",
)
def _(spark, d):
    out = PG.extract_pages(table(spark, d, "pages"))
    return out.select("page_id", "title", "description", F.length("text").cast("bigint").alias("n_chars"), "text_checksum")


CLEAN_SQL = f"regexp_replace(regexp_replace(regexp_replace({ent('html')}, '<script.*?</script>', ' ', 'gis'), '<style.*?</style>', ' ', 'gis'), '<[^>]+>', ' ', 'g')"


@query("a21_clean_text", f"SELECT page_id, sha256({SQUEEZE.replace('X', CLEAN_SQL)}) AS text_hash FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(PG.clean_filing_text("html"), 256).alias("text_hash"))


def insider_pages(spark, d):
    """Each order line as a one-trade insider page of its customer."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    ticker = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    code = F.when(F.col("l_returnflag") == "A", "P - Purchase").when(F.col("l_returnflag") == "R", "S - Sale").otherwise("A - Grant")
    sign = F.when(F.col("l_returnflag") == "R", "-$").otherwise("+$")
    cells = [
        F.when(F.col("l_linestatus") == "O", "D").otherwise("M"), F.concat(F.lit("<a href=\"http://www.sec.gov/x\">"), F.to_date("l_shipdate").cast("string"), F.lit("</a>")), F.to_date("l_shipdate").cast("string"),
        F.concat(F.lit("<b>"), ticker, F.lit("</b>")), F.lit("<a href=\"/insider/1\">Doe &amp; Co</a>"), F.lit("CEO"), code, F.lit("$1.50"), F.lit("+10"), F.lit("100"), F.lit("5%"),
        F.concat(sign, F.format_number("l_extendedprice", 2)),
    ]
    tr = F.concat(F.lit("<tr>"), *[x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))], F.lit("</tr>"))
    html = F.concat(F.lit("<table><tr><td>short</td></tr>"), tr, F.lit("</table>"))
    return li.select(ticker.alias("ticker"), F.col("l_orderkey").alias("page"), html.alias("html"))


INSIDER_SQL = """ins AS (SELECT 'C' || o_custkey AS ticker, l_orderkey AS page, l_extendedprice AS v, CASE l_returnflag WHEN 'A' THEN 'P' WHEN 'R' THEN 'S' ELSE 'A' END AS code, l_linestatus = 'O' AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


@query(
    "a14_insider_rows",
    f"WITH {INSIDER_SQL} SELECT ticker, page, code AS trade_code, count(*) AS n, {r('sum(CASE WHEN code = ' + chr(39) + 'S' + chr(39) + ' THEN -v ELSE v END)', 'value', 2)}, 'Doe & Co' AS insider, 'https://x/insider/1' AS insider_url FROM ins GROUP BY ALL",
)
def _(spark, d):
    t = PG.insider_transactions(insider_pages(spark, d), site="https://x")
    out = t.groupBy("ticker", "page", "trade_code").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.max("insider_name").alias("insider"), F.max("insider_url").alias("insider_url"))
    return out.withColumn("value", rnd("value", 2))


@query(
    "g06_insider_rollup",
    f"""WITH {INSIDER_SQL} SELECT ticker, count(*) AS transaction_count, count(*) FILTER (code IN ('P', 'S') AND NOT flag) AS open_market_count,
    {r("coalesce(sum(v) FILTER (code = 'P' AND NOT flag), 0) - coalesce(sum(v) FILTER (code = 'S' AND NOT flag), 0)", 'net_purchase_value', 2)} FROM ins GROUP BY ticker""",
)
def _(spark, d):
    out = FA.insider_rollup(PG.insider_transactions(insider_pages(spark, d)))
    return out.select("ticker", "transaction_count", "open_market_count", rnd("net_purchase_value", 2).alias("net_purchase_value"))


# --- awards, launches, snapshots, plates, timetable ----------------------------------------------


def award_documents(spark, d):
    li = table(spark, d, "lineitem")
    agency = F.when(F.col("l_returnflag") == "R", "Department of Defense").when(F.col("l_returnflag") == "A", "NASA").otherwise("")
    a = F.struct(
        F.col("l_partkey").cast("string").alias("Award ID"), F.lit("Acme LLC").alias("Recipient Name"), F.to_date("l_shipdate").cast("string").alias("Start Date"),
        F.format_number("l_extendedprice", 2).alias("Award Amount"), agency.alias("Awarding Agency"), F.concat(F.lit("Office "), "l_linestatus").alias("Funding Agency"),
    )
    doc = F.to_json(F.struct(F.array(a).alias("results")))
    return li.select(F.concat(F.lit("O"), F.col("l_orderkey").cast("string")).alias("ticker"), doc.alias("payload"))


@query("a15_award_rows", f"SELECT 'O' || l_orderkey AS ticker, CAST(l_partkey AS VARCHAR) AS award_id, CASE l_returnflag WHEN 'R' THEN 'Department of Defense' WHEN 'A' THEN 'NASA' ELSE '' END AS awarding_agency, {r('l_extendedprice', 'award_amount', 2)} FROM lineitem")
def _(spark, d):
    return FI.parse_awards(award_documents(spark, d)).select("ticker", "award_id", "awarding_agency", rnd("award_amount", 2).alias("award_amount"))


@query(
    "g07_contract_rollup",
    f"""WITH {AWARDS_SQL}, b AS (SELECT ticker, l_extendedprice AS v, CASE WHEN l_returnflag = 'R' THEN 'Department of Defense' WHEN l_returnflag = 'A' THEN 'Agency ' || ticker ELSE 'Office ' || l_linestatus END AS agency, l_returnflag FROM am WHERE sc >= 0.45),
    g AS (SELECT ticker, agency, sum(v) AS s FROM b GROUP BY ALL), t AS (SELECT ticker, first(agency ORDER BY s DESC, agency) AS top_agency FROM g GROUP BY ticker)
    SELECT ticker, count(*) AS award_count, {r('sum(v)', 'total_amount', 2)}, {r('max(v)', 'largest_amount', 2)}, {r("coalesce(sum(v) FILTER (l_returnflag = 'R'), 0)", 'defence_amount', 2)}, any_value(top_agency) AS top_agency
    FROM b JOIN t USING (ticker) GROUP BY ticker""",
)
def _(spark, d):
    flag = F.col("l_returnflag")
    a = J.match_awards(awards(spark, d), part_companies(spark, d)).withColumns(
        {
            "award_amount": F.col("l_extendedprice"),
            "awarding_agency": F.when(flag == "R", "Department of Defense").when(flag == "A", F.concat(F.lit("Agency "), "ticker")).otherwise(""),
            "awarding_sub_agency": F.lit(""),
            "funding_agency": F.concat(F.lit("Office "), "l_linestatus"),
            "funding_sub_agency": F.lit(None).cast("string"),
        }
    )
    out = FA.contract_rollup(a)
    return out.select("ticker", "award_count", *[rnd(c, 2).alias(c) for c in ("total_amount", "largest_amount", "defence_amount")], F.get(F.col("top_agencies"), 0)["agency"].alias("top_agency"))


@query(
    "a16_launch_rows",
    """SELECT o_orderkey, 'L' || o_orderkey AS launch_id, CASE o_orderstatus WHEN 'F' THEN 'Success' WHEN 'O' THEN 'Go' ELSE '' END AS status, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS provider,
    'Launch ' || o_orderkey || ' ' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END || repeat(' ', 8) || 'Pad' || repeat(' ', 2) AS match_text FROM orders""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "Success").when(F.col("o_orderstatus") == "O", "Go")
    provider = F.when(F.col("o_orderstatus") != "P", F.struct(F.col("o_orderpriority").alias("name")))
    doc = F.struct(
        F.concat(F.lit("L"), F.col("o_orderkey").cast("string")).alias("id"), F.concat(F.lit("Launch "), F.col("o_orderkey").cast("string")).alias("name"), F.struct(status.alias("abbrev")).alias("status"),
        provider.alias("launch_service_provider"), F.struct(F.lit("Pad").alias("name")).alias("pad"),
    )
    out = FI.normalise_launches(o.select("o_orderkey", F.to_json(doc).alias("launch_json")))
    return out.select("o_orderkey", "launch_id", "status", "provider", "match_text")


@query(
    "a17_snapshot_items",
    f"""WITH s AS (SELECT 'C' || c_custkey AS ticker, c_name AS name, c_acctbal * 1e6 AS cap, CASE WHEN c_acctbal < 1000 THEN c_nationkey * 1.0 ELSE c_acctbal / 100 END AS pe, c_nationkey * 10.0 AS vol FROM customer)
    SELECT ticker, 'valuation' AS dimension, name || ' valuation snapshot' AS title, {r('cap', 'a', 2)}, {r('pe', 'b', 4)} FROM s UNION ALL SELECT ticker, 'market', name || ' market activity', {r('vol', 'a', 2)}, NULL FROM s""",
)
def _(spark, d):
    c = table(spark, d, "customer")
    snap = c.select(
        F.concat(F.lit("US.C"), F.col("c_custkey").cast("string")).alias("code"), F.col("c_name").alias("name"), F.lit("2024-01-01").alias("update_time"), (F.col("c_acctbal") * 1e6).alias("total_market_val"),
        F.when(F.col("c_acctbal") >= 1000, F.col("c_acctbal") / 100).otherwise(0.0).alias("pe_ttm_ratio"), F.col("c_nationkey").cast("double").alias("pe_ratio"), F.lit(None).cast("double").alias("pb_ratio"),
        F.lit(1.0).alias("last_price"), (F.col("c_nationkey") * 10.0).alias("volume"), F.lit(None).cast("double").alias("turnover"), F.lit(2.0).alias("highest52weeks_price"), F.lit(float("nan")).alias("lowest52weeks_price"),
    )
    ev = FI.snapshot_items(snap)
    a = F.coalesce(F.try_element_at("evidence", F.lit("market_cap")), F.try_element_at("evidence", F.lit("volume"))).cast("double")
    return ev.select("ticker", "dimension", "title", rnd(a, 2).alias("a"), rnd(F.try_element_at("evidence", F.lit("pe_ttm")).cast("double"), 4).alias("b"))


@query(
    "a18_classification",
    """WITH p AS (SELECT 'S' || l_suppkey AS ticker, l_orderkey * 10 + l_linenumber AS pos, 'pl' || l_partkey % 50 AS nm, CASE l_returnflag WHEN 'A' THEN 'CONCEPT' WHEN 'R' THEN 'REGION' ELSE 'OTHER' END AS ty FROM lineitem
      UNION ALL SELECT 'S' || s_suppkey, -1, 'nation ' || s_nationkey, 'INDUSTRY' FROM supplier WHERE s_acctbal > 0),
    g AS (SELECT ticker, ty, nm, min(pos) AS pos FROM p GROUP BY ALL)
    SELECT ticker, coalesce(arg_min(nm, pos) FILTER (ty = 'INDUSTRY'), '') AS industry, coalesce(arg_min(nm, pos) FILTER (ty = 'INDUSTRY'), arg_min(nm, (pos, nm)) FILTER (ty = 'CONCEPT'), arg_min(nm, (pos, nm)), '') AS sector,
    coalesce(string_agg(nm, ',' ORDER BY pos, nm) FILTER (ty = 'CONCEPT'), '') AS concepts FROM g GROUP BY ticker""",
)
def _(spark, d):
    li = table(spark, d, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "concept").when(F.col("l_returnflag") == "R", "region").otherwise("other")
    a = li.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"),
        F.concat(F.lit("pl"), (F.col("l_partkey") % 50).cast("string")).alias("plate_name"), kind.alias("plate_type"),
    )
    s = table(spark, d, "supplier").filter("s_acctbal > 0").select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("ticker"), F.lit(-1).cast("bigint").alias("position"), F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("plate_name"), F.lit("Industry").alias("plate_type")
    )
    return FI.classify(a.unionByName(s)).select("ticker", "industry", "sector", F.array_join("concepts", ",").alias("concepts"))


@query(
    "a19_timetable",
    """SELECT 'C' || o_custkey AS ticker, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS event_date, CASE WHEN o_orderpriority = '5-LOW' THEN 'Untitled event' ELSE o_orderpriority END AS title,
    'manual_timetable' AS source_key, CAST(o_orderkey AS DOUBLE) AS importance_score FROM orders WHERE o_orderstatus = 'P' OR CAST(o_orderdate AS DATE) >= DATE '1998-01-01'""",
)
def _(spark, d):
    o = table(spark, d, "orders")
    ev = F.struct(
        F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm")).alias("event_date"), F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority")).alias("title"),
        F.col("o_orderkey").cast("double").alias("importance_score"),
    )
    doc = o.select(F.to_json(F.create_map(F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.array(ev))).alias("config_json"))
    out = FI.timetable_events(doc, F.lit("1998-01-01").cast("date"))
    return out.select("ticker", F.col("event_date").cast("string"), "title", "source_key", "importance_score")


# --- text ------------------------------------------------------------------------------------

DOC_TERMS = ("license", "the", "and the", "RPO", "is", "en")


@query(
    "h01_term_counts",
    """SELECT doc_id, CAST(len(regexp_extract_all(text, 'license', 0, 'i')) AS BIGINT) AS first_group, CAST(len(regexp_extract_all(text, 'the', 0, 'i')) + len(regexp_extract_all(text, 'and\\s+the', 0, 'i'))
    + len(regexp_extract_all(text, '\\brpos?\\b', 0, 'i')) + len(regexp_extract_all(text, 'is', 0, 'i')) + len(regexp_extract_all(text, 'en', 0, 'i')) AS BIGINT) AS second_group FROM documents""",
)
def _(spark, d):
    c = table(spark, d, "documents").select("doc_id", TX.term_counts("text", DOC_TERMS, "license").alias("c"))
    return c.select("doc_id", F.col("c.backlog_mentions").cast("bigint").alias("first_group"), F.col("c.rpo_mentions").cast("bigint").alias("second_group"))


@query("h02_snippets")
def _(spark, d):
    s = table(spark, d, "documents").select("doc_id", TX.snippets("text", DOC_TERMS).alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("snippets"), F.array_join("s", " | ").alias("text"))


def filing_texts(spark, d):
    """Orders as short filing passages with amounts around the scanned terms."""
    o = table(spark, d, "orders")
    price = F.format_string("%.5f", F.col("o_totalprice") / 1000)
    body = (
        F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("As of the date our backlog was $"), price, F.lit(" million. Nothing else changed.")))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("We had $ "), price, F.lit(" million of remaining performance obligations and RPOs of 12.")))
        .otherwise(F.concat(F.lit("No orders were noted in "), F.col("o_orderpriority"), F.lit(".")))
    )
    return o.select("o_orderkey", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ticker"), F.col("o_orderkey").alias("position"), body.alias("text"))


H03_SQL = """am AS (SELECT o_orderkey, 'C' || o_custkey AS ticker, o_orderstatus, CAST(printf('%.5f', o_totalprice / 1000) AS DOUBLE) * 1e6 AS v FROM orders)"""


@query(
    "h03_amounts",
    f"""WITH {H03_SQL} SELECT o_orderkey, CAST(CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END AS BIGINT) AS amount_mentions, {r("CASE WHEN o_orderstatus <> 'P' THEN v END", 'largest_amount', 1)} FROM am""",
)
def _(spark, d):
    f = filing_texts(spark, d).select("o_orderkey", TX.amount_summary(TX.amounts("text")).alias("a"))
    return f.select("o_orderkey", F.col("a.amount_mentions").cast("bigint").alias("amount_mentions"), rnd("a.largest_amount", 1).alias("largest_amount"))


@query(
    "h04_amount_summary",
    f"""WITH {H03_SQL} SELECT ticker, count(*) FILTER (o_orderstatus = 'F') AS backlog_mentions, 3 * count(*) FILTER (o_orderstatus = 'O') AS rpo_mentions,
    {r("max(CASE WHEN o_orderstatus <> 'P' THEN v END)", 'largest_amount', 1)} FROM am GROUP BY ticker""",
)
def _(spark, d):
    f = filing_texts(spark, d).select("ticker", TX.term_counts("text").alias("c"), TX.amount_summary(TX.amounts("text")).alias("a"))
    out = f.groupBy("ticker").agg(
        F.sum("c.backlog_mentions").alias("backlog_mentions"), F.sum("c.rpo_mentions").alias("rpo_mentions"), F.max("a.largest_amount").alias("largest_amount")
    )
    return out.withColumn("largest_amount", rnd("largest_amount", 1))


@query(
    "h05_selected_filing",
    """SELECT 'C' || o_custkey AS ticker, coalesce(min(o_orderkey) FILTER (o_orderstatus <> 'P'), max(o_orderkey)) AS position FROM orders GROUP BY o_custkey""",
)
def _(spark, d):
    f = filing_texts(spark, d).withColumn("c", TX.term_counts("text")).select("ticker", "position", "c.backlog_mentions", "c.rpo_mentions")
    return TX.selected_filing(f).select("ticker", "position")


def proxy_texts(spark, d):
    p = spread(table(spark, d, "part"))
    holder = (F.col("p_size") / 2).cast("string")
    text = F.concat(
        F.lit("Intro text. Security Ownership of Management. Vanguard holds "), holder, F.lit("% of the shares. The customer share was 77%. "),
        F.lit("All directors and executive officers as a group hold "), F.col("p_size").cast("string"), F.lit("% of common stock. "), F.repeat(F.lit("filler text "), 120), F.lit("Executive Compensation follows: shares 99%."),
    )
    plain = F.concat(F.lit("A note without any holding, "), "p_name", F.lit(" 5%."))
    return p.select("p_partkey", F.col("p_brand").alias("ticker"), F.when(F.col("p_type") == "PROMO", plain).otherwise(text).alias("text"))


@query(
    "h06_ownership_percents",
    f"""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL ELSE {"round(greatest(p_size / 200.0, p_size / 100.0, 0.77), 6)"} END AS largest FROM part""",
)
def _(spark, d):
    return proxy_texts(spark, d).select("p_partkey", rnd(F.array_max(TX.ownership_percents("text"))).alias("largest"))


@query("h07_ownership_section", "SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN '' ELSE 'Security Ownership of Management. Vangua' END AS head, p_type <> 'PROMO' AS cut FROM part")
def _(spark, d):
    s = proxy_texts(spark, d).select("p_partkey", TX.ownership_section("text").alias("s"))
    return s.select("p_partkey", F.substring("s", 1, 40).alias("head"), ((F.col("s") != "") & ~F.contains(F.col("s"), F.lit("Executive Compensation"))).alias("cut"))


@query("h08_ownership_rows", f"SELECT p_partkey, CAST(CASE WHEN p_type = 'PROMO' THEN 0 ELSE 1 END AS BIGINT) AS n, {r('CASE WHEN p_type <> ' + chr(39) + 'PROMO' + chr(39) + ' THEN p_size / 200.0 END', 'top')} FROM part")
def _(spark, d):
    rows = proxy_texts(spark, d).select("p_partkey", TX.ownership_rows(TX.ownership_section("text")).alias("r"))
    return rows.select("p_partkey", F.size("r").cast("bigint").alias("n"), rnd(F.array_max(F.transform("r", lambda x: x["percent"]))).alias("top"))


@query("h09_group_percent", f"SELECT p_partkey, {r('CASE WHEN p_type <> ' + chr(39) + 'PROMO' + chr(39) + ' THEN p_size / 100.0 END', 'group_percent')} FROM part")
def _(spark, d):
    return proxy_texts(spark, d).select("p_partkey", rnd(TX.group_percent(TX.ownership_section("text"))).alias("group_percent"))


@query(
    "g09_proxy_rollup",
    f"SELECT p_brand AS ticker, count(*) AS filing_count, {r('max(p_size) / 100.0', 'management_group_percent')}, {r('max(p_size) / 200.0', 'top_holder_percent')} FROM part WHERE p_type <> 'PROMO' GROUP BY p_brand",
)
def _(spark, d):
    # what an outer explode gives is computed once; a plain column would be repeated in the filter and both fields made of it
    f = proxy_texts(spark, d).select("ticker", F.explode_outer(F.array(TX.ownership_section("text"))).alias("section"))
    f = f.withColumns({"rows": TX.ownership_rows("section"), "group_percent": TX.group_percent("section")})
    out = FA.proxy_rollup(f)
    return out.select("ticker", "filing_count", rnd("management_group_percent").alias("management_group_percent"), rnd("top_holder_percent").alias("top_holder_percent"))


LIGHT = ("license", "the", "und", "que", "de")
_FLAT = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"


@query(
    "h10_highlights",
    f"""WITH t AS (SELECT doc_id, {_FLAT} AS x FROM documents), k AS (SELECT doc_id, x, unnest({sql_list(LIGHT)}) AS term, unnest(range(1, {len(LIGHT) + 1})) AS o FROM t),
    p AS (SELECT *, instr(lower(x), term) AS at1 FROM k), s AS (SELECT doc_id, term, o, trim(substr(x, greatest(1, at1 - 180), at1 + length(term) + 180 - greatest(1, at1 - 180)), ' .') AS snippet FROM p WHERE at1 > 0),
    dd AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(snippet) ORDER BY o) AS n FROM s)
    SELECT doc_id, count(*) AS n, string_agg(term || ':' || snippet, ' | ' ORDER BY o) AS highlights FROM dd WHERE n = 1 GROUP BY doc_id""",
)
def _(spark, d):
    h = table(spark, d, "documents").select("doc_id", TX.highlights("text", LIGHT).alias("h")).filter(F.size("h") > 0)
    return h.select("doc_id", F.size("h").cast("bigint").alias("n"), F.array_join(F.transform("h", lambda x: F.concat(x["term"], F.lit(":"), x["snippet"])), " | ").alias("highlights"))


# --- composite score ---------------------------------------------------------------------------


def evidence_items(spark, d):
    """Orders as dated items whose evidence depends on the priority; some values are null."""
    o = table(spark, d, "orders")
    k, v, c = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_custkey")
    failed = F.col("o_orderstatus") == "F"

    def ev(**cols):
        return F.map_from_arrays(F.array(*[F.lit(x) for x in cols]), F.array(*[e.cast("string") for e in cols.values()]))

    sets = {
        "1-URGENT": ev(market_cap=v * 1e4, pe_ttm=F.when(~failed, (c % 50).cast("double"))),
        "2-HIGH": ev(quarterly_revenue_yoy=(v - 100000) / 500000, receivables_yoy=F.when(~failed, (k % 100) / 100), inventory_yoy=(k % 70) / 100),
        "3-MEDIUM": ev(
            backlog_mentions=k % 25, rpo_mentions=k % 3, largest_amount=v * 100, revenue=v * 70 + 1e6, government_contract_award_count=k % 2, government_contract_total_value=v * 300,
            government_contract_dod_value=F.when(~failed, v * 40),
        ),
        "4-NOT SPECIFIED": ev(
            insider_ownership=(k % 10) / 100, institutional_ownership=(k % 90) / 100, large_holder_max_percent=F.when(~failed, (k % 15) / 100), insider_net_purchase_value=(v - 250000) * 20,
            institutional_13f_manager_count=k % 4,
        ),
        "5-LOW": ev(
            gross_margin=(k % 60) / 100, operating_margin=(k % 30) / 100, net_margin=(k % 25) / 100 - 0.05, free_cash_flow_margin=(k % 20) / 100 - 0.05, liabilities_to_assets=(k % 95) / 100,
            debt_to_assets=(k % 65) / 100, large_buy_sell_ratio=F.when(~failed, v / 200000), large_net_flow_20d=v - 250000, return_20d=(k % 80) / 100 - 0.25,
        ),
    }
    evidence = None
    for name, m in sets.items():
        cond = F.col("o_orderpriority") == name
        evidence = F.when(cond, m) if evidence is None else evidence.when(cond, m)
    return o.select(
        k.alias("item_id"), F.concat(F.lit("C"), c.cast("string")).alias("ticker"), F.to_date("o_orderdate").alias("event_date"), F.col("o_orderdate").alias("created_at"),
        F.col("o_orderstatus").alias("source_key"), (v / 5000).alias("importance_score"), evidence.alias("evidence"),
    )


EV_SQL = {
    "1-URGENT": {"market_cap": "v * 1e4", "pe_ttm": "CASE WHEN ok THEN c % 50 END"},
    "2-HIGH": {"quarterly_revenue_yoy": "(v - 100000) / 500000", "receivables_yoy": "CASE WHEN ok THEN (k % 100) / 100.0 END", "inventory_yoy": "(k % 70) / 100.0"},
    "3-MEDIUM": {
        "backlog_mentions": "k % 25", "rpo_mentions": "k % 3", "largest_amount": "v * 100", "revenue": "v * 70 + 1e6", "government_contract_award_count": "k % 2",
        "government_contract_total_value": "v * 300", "government_contract_dod_value": "CASE WHEN ok THEN v * 40 END",
    },
    "4-NOT SPECIFIED": {
        "insider_ownership": "(k % 10) / 100.0", "institutional_ownership": "(k % 90) / 100.0", "large_holder_max_percent": "CASE WHEN ok THEN (k % 15) / 100.0 END",
        "insider_net_purchase_value": "(v - 250000) * 20", "institutional_13f_manager_count": "k % 4",
    },
    "5-LOW": {
        "gross_margin": "(k % 60) / 100.0", "operating_margin": "(k % 30) / 100.0", "net_margin": "(k % 25) / 100.0 - 0.05", "free_cash_flow_margin": "(k % 20) / 100.0 - 0.05",
        "liabilities_to_assets": "(k % 95) / 100.0", "debt_to_assets": "(k % 65) / 100.0", "large_buy_sell_ratio": "CASE WHEN ok THEN v / 200000 END", "large_net_flow_20d": "v - 250000",
        "return_20d": "(k % 80) / 100.0 - 0.25",
    },
}
METRICS_SQL = (
    "src AS (SELECT o_orderkey AS k, o_totalprice AS v, o_custkey AS c, o_orderstatus <> 'F' AS ok, 'C' || o_custkey AS ticker, o_orderdate, o_orderpriority AS pr, o_orderstatus FROM orders),\n"
    "nw AS (SELECT *, row_number() OVER (PARTITION BY ticker, pr ORDER BY o_orderdate DESC, k DESC) AS n FROM src),\n"
    "mt AS (SELECT ticker, "
    + ", ".join(f"max(CASE WHEN pr = '{p}' THEN CAST({e} AS DOUBLE) END) AS {m}" for p, ms in EV_SQL.items() for m, e in ms.items())
    + " FROM nw WHERE n = 1 GROUP BY ticker),\ncv AS (SELECT ticker, count(DISTINCT o_orderstatus) AS source_count, max(v / 5000) AS top_importance FROM src GROUP BY ticker)"
)
ALL_METRICS = [m for ms in EV_SQL.values() for m in ms]


@query("g11_latest_metrics", f"WITH {METRICS_SQL} SELECT ticker, {', '.join(r(m, m, 4) for m in ALL_METRICS)} FROM mt")
def _(spark, d):
    from tidemark.operators.rank import latest_items

    m = SC.latest_metrics(latest_items(evidence_items(spark, d)))
    return m.select("ticker", *[rnd(SC.num(x), 4).alias(x) for x in ALL_METRICS])


SCORE_SQL = f"""{METRICS_SQL}, cp AS (SELECT ticker,
  CASE WHEN market_cap IS NULL THEN 0 WHEN market_cap BETWEEN 5e8 AND 4e9 THEN 14 WHEN market_cap >= 3e8 AND market_cap < 5e8 THEN 9 WHEN market_cap > 4e9 AND market_cap <= 8e9 THEN 7 WHEN market_cap > 8e9 AND market_cap <= 15e9 THEN 3 ELSE 1 END AS eligibility,
  CASE WHEN pe_ttm > 0 AND pe_ttm <= 20 THEN 12 WHEN pe_ttm > 20 AND pe_ttm <= 30 THEN 9 WHEN pe_ttm > 30 AND pe_ttm <= 45 THEN 4 ELSE 0 END AS valuation,
  greatest(0, least(20, CASE WHEN quarterly_revenue_yoy >= 0.5 THEN 16 WHEN quarterly_revenue_yoy >= 0.25 THEN 13 WHEN quarterly_revenue_yoy >= 0.1 THEN 7 ELSE 0 END
    + CASE WHEN quarterly_revenue_yoy IS NULL OR receivables_yoy IS NULL THEN 0 WHEN receivables_yoy <= quarterly_revenue_yoy + 0.15 THEN 3 ELSE -2 END
    + CASE WHEN quarterly_revenue_yoy IS NULL OR inventory_yoy IS NULL THEN 0 WHEN inventory_yoy <= quarterly_revenue_yoy + 0.2 THEN 2 ELSE -2 END)) AS growth_quality,
  least(20, CASE WHEN coalesce(backlog_mentions, 0) + coalesce(rpo_mentions, 0) >= 20 THEN 9 WHEN coalesce(backlog_mentions, 0) + coalesce(rpo_mentions, 0) >= 8 THEN 7 WHEN coalesce(backlog_mentions, 0) + coalesce(rpo_mentions, 0) >= 1 THEN 4 ELSE 0 END
    + CASE WHEN rpo_mentions > 0 THEN 3 ELSE 0 END + CASE WHEN largest_amount IS NOT NULL THEN 4 ELSE 0 END + CASE WHEN largest_amount / nullif(revenue, 0) >= 2 THEN 4 WHEN largest_amount / nullif(revenue, 0) >= 1 THEN 2 ELSE 0 END
    + CASE WHEN government_contract_award_count >= 1 THEN 2 ELSE 0 END + CASE WHEN government_contract_total_value >= 1e8 THEN 4 WHEN government_contract_total_value >= 25e6 THEN 3 WHEN government_contract_total_value >= 5e6 THEN 1 ELSE 0 END
    + CASE WHEN government_contract_dod_value >= 1e7 THEN 1 ELSE 0 END) AS order_quality,
  greatest(0, least(14, CASE WHEN nullif(insider_ownership, 0) IS NULL THEN 0 WHEN insider_ownership >= 0.05 THEN 6 WHEN insider_ownership >= 0.02 THEN 3 ELSE 1 END
    + CASE WHEN institutional_ownership >= 0.65 THEN 4 WHEN institutional_ownership >= 0.4 THEN 2 ELSE 0 END + CASE WHEN large_holder_max_percent >= 0.1 THEN 3 WHEN large_holder_max_percent >= 0.05 THEN 2 ELSE 0 END
    + CASE WHEN insider_net_purchase_value > 0 THEN 3 WHEN insider_net_purchase_value < -2e6 THEN -2 ELSE 0 END + CASE WHEN institutional_13f_manager_count IS NULL THEN 0 ELSE least(2, institutional_13f_manager_count) END)) AS ownership_alignment,
  greatest(0, least(16, CASE WHEN gross_margin >= 0.35 THEN 4 WHEN gross_margin >= 0.2 THEN 2 ELSE 0 END + CASE WHEN operating_margin >= 0.15 THEN 4 WHEN operating_margin >= 0.08 THEN 2 ELSE 0 END
    + CASE WHEN net_margin IS NULL THEN 0 WHEN net_margin >= 0.1 THEN 3 WHEN net_margin > 0 THEN 1 ELSE -2 END + CASE WHEN free_cash_flow_margin IS NULL THEN 0 WHEN free_cash_flow_margin >= 0.08 THEN 3 WHEN free_cash_flow_margin >= 0 THEN 1 ELSE -2 END
    + CASE WHEN liabilities_to_assets <= 0.55 THEN 2 WHEN liabilities_to_assets > 0.75 THEN -1 ELSE 0 END + CASE WHEN debt_to_assets <= 0.25 THEN 2 WHEN debt_to_assets > 0.5 THEN -1 ELSE 0 END)) AS financial_quality,
  CASE WHEN large_buy_sell_ratio IS NULL AND large_net_flow_20d IS NULL AND return_20d IS NULL THEN 0 ELSE greatest(-8, least(8,
    CASE WHEN large_buy_sell_ratio >= 1.8 THEN 4 WHEN large_buy_sell_ratio >= 1.3 THEN 3 WHEN large_buy_sell_ratio >= 1.05 THEN 1 WHEN large_buy_sell_ratio < 0.8 THEN -2 ELSE 0 END
    + CASE WHEN large_net_flow_20d > 0 THEN 1 WHEN large_net_flow_20d < 0 THEN -1 ELSE 0 END
    + CASE WHEN (large_buy_sell_ratio >= 1.05 OR (large_buy_sell_ratio IS NULL AND large_net_flow_20d > 0)) AND return_20d BETWEEN -0.08 AND 0.12 THEN 3
      WHEN (large_buy_sell_ratio >= 1.05 OR (large_buy_sell_ratio IS NULL AND large_net_flow_20d > 0)) AND return_20d <= 0.2 THEN 1
      WHEN return_20d >= 0.45 THEN -7 WHEN return_20d >= 0.3 THEN -5 WHEN return_20d >= 0.2 THEN -3 WHEN return_20d < -0.2 THEN -1 ELSE 0 END)) END AS attention_flow,
  least(8, source_count * 1.2) + least(4, top_importance / 25) AS information_quality,
  [CASE WHEN market_cap IS NULL THEN 'market_cap' END, CASE WHEN pe_ttm IS NULL THEN 'pe_ttm' END, CASE WHEN quarterly_revenue_yoy IS NULL THEN 'quarterly_revenue_yoy' END,
    CASE WHEN gross_margin IS NULL AND operating_margin IS NULL THEN 'financial_quality' END, CASE WHEN coalesce(backlog_mentions, 0) = 0 AND coalesce(rpo_mentions, 0) = 0 THEN 'backlog_or_rpo' END,
    CASE WHEN insider_ownership IS NULL THEN 'insider_ownership' END, CASE WHEN institutional_ownership IS NULL AND institutional_13f_manager_count IS NULL AND large_holder_max_percent IS NULL THEN 'institutional_holder_signal' END] AS md
  FROM mt JOIN cv USING (ticker)),
ms AS (SELECT *, list_filter(md, lambda x: x IS NOT NULL) AS missing, coalesce(list_sum(list_transform(list_filter(md, lambda x: x IS NOT NULL), lambda x: CASE x WHEN 'market_cap' THEN 5 WHEN 'pe_ttm' THEN 3 WHEN 'quarterly_revenue_yoy' THEN 6
  WHEN 'financial_quality' THEN 4 WHEN 'backlog_or_rpo' THEN 8 WHEN 'insider_ownership' THEN 3 ELSE 2 END)), 0) AS pen FROM cp),
tt AS (SELECT *, greatest(0, least(100, eligibility + valuation + growth_quality + order_quality + ownership_alignment + financial_quality + attention_flow + information_quality - pen)) AS total FROM ms)"""


@query("g12_component_scores", f"WITH {SCORE_SQL} SELECT ticker, {', '.join(binary(c, c, 2) for c in SC.COMPONENTS)} FROM tt")
def _(spark, d):
    out = SC.score_items(evidence_items(spark, d))
    return out.select("ticker", *[rnd(c, 2).alias(c) for c in SC.COMPONENTS])


@query("g13_missing_dimensions", f"WITH {SCORE_SQL} SELECT ticker, array_to_string(missing, ',') AS missing, CAST(pen AS BIGINT) AS penalty FROM tt")
def _(spark, d):
    out = SC.score_items(evidence_items(spark, d))
    return out.select("ticker", F.array_join("missing_dimensions", ",").alias("missing"), SC.penalty(F.col("missing_dimensions")).cast("bigint").alias("penalty"))


@query("g14_total_and_grade", f"WITH {SCORE_SQL} SELECT ticker, {binary('total', 'total_score', 2)}, CASE WHEN total >= 80 THEN 'A' WHEN total >= 65 THEN 'B' WHEN total >= 45 THEN 'C' ELSE 'D' END AS grade FROM tt")
def _(spark, d):
    return SC.score_items(evidence_items(spark, d)).select("ticker", rnd("total_score", 2).alias("total_score"), "grade")


@query(
    "g15_ranked_scores",
    f"WITH {SCORE_SQL} SELECT ticker, {binary('total', 'total_score', 2)}, CAST(len(missing) AS BIGINT) AS missing_count FROM tt",
)
def _(spark, d):
    out = SC.score_items(evidence_items(spark, d)).orderBy(F.desc("total_score"), "ticker")
    return out.select("ticker", rnd("total_score", 2).alias("total_score"), F.size("missing_dimensions").cast("bigint").alias("missing_count"))
