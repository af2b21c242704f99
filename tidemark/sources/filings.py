"""Parsers from filing, award, launch and vendor documents to flat rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.numeric import finite

# Filing forms whose facts count.
FACT_FORMS = ("10-Q", "10-Q/A", "10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A", "6-K", "6-K/A")

FACTS = (
    "STRUCT<facts: MAP<STRING, MAP<STRING, STRUCT<units: MAP<STRING, ARRAY<STRUCT<form: STRING, fp: STRING, fy: STRING,"
    " frame: STRING, start: STRING, `end`: STRING, filed: STRING, val: STRING>>>>>>>"
)


def flatten_facts(companies: DataFrame, json: str = "facts_json") -> DataFrame:
    """``cik, facts_json`` to fact rows in USD from accepted forms.

    A tag is taken from us-gaap, else ifrs-full, else the first other namespace that has it.
    """
    doc = companies.select("cik", F.from_json(json, FACTS).alias("d"))
    ns = doc.select("cik", F.posexplode("d.facts").alias("ns_pos", "namespace", "tags"))
    tags = ns.select("cik", "ns_pos", "namespace", F.explode("tags").alias("tag", "body"))
    units = tags.select("cik", "ns_pos", "namespace", "tag", F.explode("body.units").alias("unit", "rows"))
    rows = units.select("cik", "ns_pos", "namespace", "tag", "unit", F.posexplode("rows").alias("position", "f"))
    rank = F.when(F.col("namespace") == "us-gaap", 0).when(F.col("namespace") == "ifrs-full", 1).otherwise(F.col("ns_pos") + 2)
    w = Window.partitionBy("cik", "tag")
    rows = rows.withColumn("__rank", rank).withColumn("__best", F.min("__rank").over(w)).filter(F.col("__rank") == F.col("__best"))
    out = rows.select(
        "cik", "tag", "unit", "position", S.normalise_form("f.form").alias("form"), "f.fp", F.col("f.fy").try_cast("int").alias("fy"), "f.frame", "f.start",
        F.col("f.end").alias("end"), "f.filed", F.col("f.val").try_cast("double").alias("value"),
    )
    return out.filter((F.col("unit") == "USD") & F.col("form").isin(*FACT_FORMS) & F.col("value").isNotNull())


SUBMISSIONS = (
    "STRUCT<filings: STRUCT<recent: STRUCT<form: ARRAY<STRING>, accessionNumber: ARRAY<STRING>, filingDate: ARRAY<STRING>,"
    " primaryDocument: ARRAY<STRING>>>>"
)


def latest_filings(companies: DataFrame, forms: Sequence[str], limit: int, json: str = "submissions_json", page: str | None = None) -> DataFrame:
    """First ``limit`` filings per company, in listed order, of the wanted forms.

    A long list may come in several documents; ``page`` names the column that orders them.
    """
    wanted = [f.strip().upper().replace("SCHEDULE 13", "SC 13") for f in forms]
    order = F.lit(0) if page is None else F.col(page)
    doc = companies.select("cik", order.alias("page"), F.from_json(json, SUBMISSIONS).alias("d"))
    recent = F.col("d.filings.recent")
    zipped = F.arrays_zip(
        recent["form"].alias("form"), recent["accessionNumber"].alias("accession"), recent["filingDate"].alias("filing_date"), recent["primaryDocument"].alias("document")
    )
    rows = doc.select("cik", "page", F.posexplode(zipped).alias("position", "f")).select("cik", "page", "position", "f.form", "f.accession", "f.filing_date", "f.document")
    kept = rows.filter(S.normalise_form("form").isin(*wanted))
    w = Window.partitionBy("cik").orderBy("page", "position")
    return kept.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit).drop("place")


def well_formed(xml: Column) -> Column:
    """True when the text is parseable XML."""
    probe = F.from_xml(xml, "`__bad` STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    return probe.isNotNull() & probe["__bad"].isNull()


VALUE = "STRUCT<value: STRING>"
FORM4 = (
    "issuer STRUCT<issuerTradingSymbol: STRING>, reportingOwner ARRAY<STRUCT<reportingOwnerId: STRUCT<rptOwnerName: STRING>>>,"
    f" nonDerivativeTable STRUCT<nonDerivativeTransaction: ARRAY<STRUCT<transactionDate: {VALUE},"
    " transactionCoding: STRUCT<transactionCode: STRING>,"
    f" transactionAmounts: STRUCT<transactionShares: {VALUE}, transactionPricePerShare: {VALUE}, transactionAcquiredDisposedCode: {VALUE}>>>>"
)


def form4_transactions(filings: DataFrame, xml: str = "xml") -> DataFrame:
    """Insider transaction rows of ownership documents; malformed documents give none."""
    doc = filings.withColumn("d", F.from_xml(xml, FORM4))
    # an outer explode: for an inner one the optimiser filters by the documents' size, parsed anew for every condition
    rows = doc.select(*[c for c in filings.columns if c != xml], "d.issuer.issuerTradingSymbol", F.get(F.col("d.reportingOwner"), 0).alias("o"), F.posexplode_outer("d.nonDerivativeTable.nonDerivativeTransaction").alias("position", "t"))
    rows = rows.where(F.col("position").isNotNull())
    amount = F.col("t.transactionAmounts")
    shares = F.trim(amount["transactionShares"]["value"]).try_cast("double")
    price = F.trim(amount["transactionPricePerShare"]["value"]).try_cast("double")
    return rows.select(
        *[c for c in filings.columns if c != xml],
        "position",
        F.trim("issuerTradingSymbol").alias("issuer"),
        F.trim("o.reportingOwnerId.rptOwnerName").alias("owner"),
        F.trim("t.transactionDate.value").alias("transaction_date"),
        F.trim("t.transactionCoding.transactionCode").alias("transaction_code"),
        F.trim(amount["transactionAcquiredDisposedCode"]["value"]).alias("acquired_disposed"),
        shares.alias("shares"),
        price.alias("price"),
        (shares * price).alias("value"),
    )


INFO_TABLE = "infoTable ARRAY<STRUCT<nameOfIssuer: STRING, cusip: STRING, value: STRING, shrsOrPrnAmt: STRUCT<sshPrnamt: STRING, sshPrnamtType: STRING>>>"


def holdings_13f(filings: DataFrame, xml: str = "xml") -> DataFrame:
    """Holdings of information tables, whatever the namespace prefix; value is reported in thousands."""
    bare = F.regexp_replace(F.regexp_replace(F.col(xml), r"<(/?)[A-Za-z0-9_]+:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    doc = filings.withColumn("d", F.from_xml(bare, INFO_TABLE))
    keep = [c for c in filings.columns if c != xml]
    rows = doc.select(*keep, F.posexplode_outer("d.infoTable").alias("position", "h")).where(F.col("position").isNotNull())  # outer: see form4_transactions
    return rows.select(
        *keep,
        "position",
        F.coalesce(F.trim("h.nameOfIssuer"), F.lit("")).alias("name_of_issuer"),
        F.coalesce(F.trim("h.cusip"), F.lit("")).alias("cusip"),
        (F.trim("h.value").try_cast("double") * 1000).alias("value_usd"),
        F.trim("h.shrsOrPrnAmt.sshPrnamt").try_cast("double").alias("shares"),
        F.coalesce(F.trim("h.shrsOrPrnAmt.sshPrnamtType"), F.lit("")).alias("share_type"),
    )


def class_percents(xml: Column | str) -> Column:
    """Distinct class percentages of a 13D/G document as shares, descending; none when malformed."""
    x = F.col(xml) if isinstance(xml, str) else xml
    raw = F.regexp_extract_all(x, F.lit(r"(?i)<(?:\w+:)?classpercent(?:\s[^>]*)?>([^<]*)<"), F.lit(1))
    values = F.transform(raw, lambda v: F.trim(F.replace(v, F.lit("%"), F.lit(""))).try_cast("double"))
    kept = F.transform(F.filter(values, lambda v: (v > 0) & (v <= 100)), lambda v: v / 100)
    return F.when(well_formed(x), F.sort_array(F.array_distinct(kept), False)).otherwise(F.slice(kept, 1, 0))


AWARDS = (
    "STRUCT<results: ARRAY<STRUCT<`Award ID`: STRING, `Recipient Name`: STRING, `Start Date`: STRING, `End Date`: STRING, `Award Amount`: STRING,"
    " `Awarding Agency`: STRING, `Awarding Sub Agency`: STRING, `Funding Agency`: STRING, `Funding Sub Agency`: STRING, `Award Type`: STRING>>>"
)


def parse_awards(payloads: DataFrame, json: str = "payload") -> DataFrame:
    """Contract award documents to rows with a typed amount."""
    keep = [c for c in payloads.columns if c != json]
    rows = payloads.select(*keep, F.explode(F.from_json(json, AWARDS)["results"]).alias("a"))
    text = {
        "award_id": "Award ID", "recipient_name": "Recipient Name", "awarding_agency": "Awarding Agency", "awarding_sub_agency": "Awarding Sub Agency",
        "funding_agency": "Funding Agency", "funding_sub_agency": "Funding Sub Agency", "award_type": "Award Type",
    }
    return rows.select(
        *keep,
        *[F.coalesce(F.col("a")[v], F.lit("")).alias(k) for k, v in text.items()],
        F.col("a")["Start Date"].alias("start_date"),
        F.col("a")["End Date"].alias("end_date"),
        F.replace(F.col("a")["Award Amount"], F.lit(","), F.lit("")).try_cast("double").alias("award_amount"),
    )


NAMED = "STRUCT<name: STRING, abbrev: STRING, description: STRING>"
LAUNCH = (
    f"STRUCT<id: STRING, name: STRING, url: STRING, net: STRING, window_start: STRING, window_end: STRING, probability: DOUBLE, status: {NAMED}, launch_service_provider: {NAMED},"
    f" rocket: STRUCT<configuration: STRUCT<full_name: STRING, name: STRING>>, mission: STRUCT<name: STRING, type: STRING, description: STRING, orbit: {NAMED}, agencies: ARRAY<{NAMED}>>,"
    f" pad: STRUCT<name: STRING, location: {NAMED}>, vidURLs: ARRAY<STRUCT<url: STRING>>>"
)


def normalise_launches(launches: DataFrame, json: str = "launch_json") -> DataFrame:
    """Launch documents to flat events with defaults and the text that keywords are matched in."""
    keep = [c for c in launches.columns if c != json]
    d = launches.select(*keep, F.from_json(json, LAUNCH).alias("d"))

    def t(path: str) -> Column:
        return F.coalesce(F.col(f"d.{path}"), F.lit(""))

    rocket = F.coalesce(F.nullif("d.rocket.configuration.full_name", F.lit("")), F.col("d.rocket.configuration.name"), F.lit(""))
    agencies = F.array_join(
        F.flatten(F.transform(F.coalesce("d.mission.agencies", F.array().cast(f"array<{NAMED}>")), lambda a: F.array(F.coalesce(a["name"], F.lit("")), F.coalesce(a["abbrev"], F.lit(""))))), " "
    )
    parts = [
        t("name"), t("launch_service_provider.name"), t("launch_service_provider.abbrev"), t("rocket.configuration.full_name"), t("rocket.configuration.name"), t("mission.name"), t("mission.type"),
        t("mission.description"), t("mission.orbit.name"), t("pad.name"), t("pad.location.name"), agencies,
    ]
    return d.select(
        *keep, F.col("d.id").alias("launch_id"), t("name").alias("name"), t("url").alias("url"), "d.net", "d.window_start", "d.window_end", "d.probability",
        t("status.name").alias("status_name"), t("status.abbrev").alias("status"), t("launch_service_provider.name").alias("provider"), rocket.alias("rocket"), t("mission.name").alias("mission_name"),
        t("mission.type").alias("mission_type"), t("mission.orbit.name").alias("orbit"), t("pad.name").alias("pad"), t("pad.location.name").alias("location"),
        F.coalesce(F.get(F.col("d.vidURLs"), 0)["url"], F.lit("")).alias("webcast_url"), F.concat_ws(" ", *parts).alias("match_text"),
    )


def snapshot_items(snapshots: DataFrame) -> DataFrame:
    """Market snapshot rows to a valuation and a market item each; P/E prefers the trailing value."""

    def num(c: str) -> Column:
        return finite(F.col(c).try_cast("double"))

    def evidence(**cols: Column) -> Column:
        return F.map_from_arrays(F.array(*[F.lit(k) for k in cols]), F.array(*[v.cast("string") for v in cols.values()]))

    pe = F.coalesce(F.nullif(num("pe_ttm_ratio"), F.lit(0.0)), num("pe_ratio"))
    code = F.col("code")
    ticker = S.clean_symbol(code)
    name = F.coalesce(F.nullif(F.col("name"), F.lit("")), ticker)
    valuation = F.struct(
        F.lit("valuation").alias("dimension"), F.concat(name, F.lit(" valuation snapshot")).alias("title"), F.lit(70).alias("importance_score"), F.lit(82).alias("quality_score"),
        F.lit(86).alias("confidence_score"), evidence(market_cap=num("total_market_val"), pe_ttm=pe, pb=num("pb_ratio"), price=num("last_price")).alias("evidence"),
    )
    market = F.struct(
        F.lit("market").alias("dimension"), F.concat(name, F.lit(" market activity")).alias("title"), F.lit(45).alias("importance_score"), F.lit(78).alias("quality_score"),
        F.lit(84).alias("confidence_score"),
        evidence(volume=num("volume"), turnover=num("turnover"), highest52weeks_price=num("highest52weeks_price"), lowest52weeks_price=num("lowest52weeks_price")).alias("evidence"),
    )
    return snapshots.select(ticker.alias("ticker"), F.col("update_time").alias("event_date"), F.explode(F.array(valuation, market)).alias("i")).select("ticker", "event_date", "i.*")


def classify(plates: DataFrame) -> DataFrame:
    """``ticker, position, plate_name, plate_type`` to industry, sector, concepts and regions.

    Repeats of a plate are folded first, so a ticker's lists are as long as its distinct plates.
    """
    kind = F.upper(F.coalesce("plate_type", F.lit("")))
    unique = plates.groupBy("ticker", kind.alias("kind"), F.trim("plate_name").alias("name")).agg(F.min("position").alias("position"))
    place = F.struct("position", "name")

    def first(k: str) -> Column:
        return F.min_by("name", F.when(F.col("kind") == k, place))

    def listed(k: str) -> Column:
        named = F.when((F.col("kind") == k) & (F.col("name") != ""), place)
        return F.transform(F.array_sort(F.collect_list(named)), lambda x: x["name"])

    out = unique.groupBy("ticker").agg(
        F.coalesce(first("INDUSTRY"), F.lit("")).alias("industry"), first("CONCEPT").alias("__c"), F.min_by("name", place).alias("__any"), listed("CONCEPT").alias("concepts"), listed("REGION").alias("regions")
    )
    sector = F.coalesce(F.nullif("industry", F.lit("")), F.col("__c"), F.col("__any"), F.lit(""))
    return out.withColumn("sector", sector).drop("__c", "__any")


TIMETABLE = (
    "MAP<STRING, ARRAY<STRUCT<event_date: STRING, window_label: STRING, catalyst_type: STRING, title: STRING, summary: STRING, source_key: STRING, source_url: STRING,"
    " importance_score: DOUBLE, confidence_score: DOUBLE, status: STRING>>>"
)


def timetable_events(configs: DataFrame, today: Column, json: str = "config_json") -> DataFrame:
    """Configured events with defaults; undated ones and those from today on are kept."""
    rows = configs.select(F.explode(F.from_json(json, TIMETABLE)).alias("ticker", "events")).select(F.upper("ticker").alias("ticker"), F.explode("events").alias("e"))

    def text(c: str, default: str) -> Column:
        return F.coalesce(F.nullif(F.col(f"e.{c}"), F.lit("")), F.lit(default)).alias(c)

    out = rows.select(
        "ticker", F.substring("e.event_date", 1, 10).try_cast("date").alias("event_date"), text("window_label", ""), text("catalyst_type", "event"), text("title", "Untitled event"), text("summary", ""),
        text("source_key", "manual_timetable"), text("source_url", ""), F.coalesce("e.importance_score", F.lit(0.0)).alias("importance_score"),
        F.coalesce("e.confidence_score", F.lit(0.0)).alias("confidence_score"), text("status", "WATCH"),
    )
    return out.filter(F.col("event_date").isNull() | (F.col("event_date") >= today))
