"""Company fundamentals and ownership roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.numeric import div, growth
from tidemark.operators import joins as J
from tidemark.session import materialise

# Tags tried in order for each metric.
REVENUE_TAGS = (
    "RevenueFromContractWithCustomerExcludingAssessedTax",
    "Revenues",
    "SalesRevenueNet",
    "SalesRevenueGoodsNet",
    "Revenue",
    "RevenueFromContractsWithCustomers",
)
RECEIVABLE_TAGS = ("AccountsReceivableNetCurrent", "ReceivablesNetCurrent", "CurrentTradeReceivables", "TradeAndOtherCurrentReceivables")
INVENTORY_TAGS = ("InventoryNet", "InventoryFinishedGoodsNetOfReserves", "Inventories")
FLOW_TAGS = {
    "gross_profit": ("GrossProfit",),
    "operating_income": ("OperatingIncomeLoss", "ProfitLossFromOperatingActivities", "OperatingProfitLoss"),
    "net_income": ("NetIncomeLoss", "ProfitLoss"),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities", "CashFlowsFromUsedInOperatingActivities", "CashFlowsFromUsedInOperations"),
    "capital_expenditures": (
        "PaymentsToAcquirePropertyPlantAndEquipment",
        "PurchaseOfPropertyPlantAndEquipmentClassifiedAsInvestingActivities",
        "PurchaseOfOtherLongtermAssetsClassifiedAsInvestingActivities",
    ),
}
STOCK_TAGS = {
    "assets": ("Assets",),
    "liabilities": ("Liabilities",),
    "equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest", "Equity"),
    "receivables": RECEIVABLE_TAGS,
    "inventory": INVENTORY_TAGS,
    "cash": ("CashAndCashEquivalentsAtCarryingValue", "CashCashEquivalentsRestrictedCashAndRestrictedCashEquivalents", "CashAndCashEquivalents", "Cash"),
    "debt_current": ("ShortTermBorrowings", "LongTermDebtCurrent", "CurrentDebtInstrumentsIssued", "CurrentLeaseLiabilities", "BorrowingsCurrent"),
    "debt_noncurrent": (
        "LongTermDebtNoncurrent", "LongTermDebtAndFinanceLeaseObligationsNoncurrent", "LongtermBorrowings", "NoncurrentLeaseLiabilities", "BorrowingsNoncurrent",
    ),
}
PRIOR_TAGS = {"receivables_prior": RECEIVABLE_TAGS, "inventory_prior": INVENTORY_TAGS}


def tag_rank(tags: Sequence[str]) -> Column:
    """0-based preference of the row's tag; null for other tags."""
    return F.nullif(F.array_position(S.literal_array(tags), F.col("tag")), F.lit(0).cast("bigint")) - 1


def quarterly() -> Column:
    return S.is_quarterly_fact(F.col("start"), F.col("end"), F.col("fp"), F.col("frame"))


def annual() -> Column:
    return S.is_annual_fact(F.col("start"), F.col("end"), F.col("fp"), F.col("frame"))


def text_or_blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def prior_year_matches(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key the latest fact and its prior-year fact: same period a fiscal year earlier, else by position.

    The fallback is the fourth fact after the latest, or the next one when there are fewer.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(text_or_blank("end")), F.desc(text_or_blank("filed")), "position")
    df = facts.withColumns({"__n": F.row_number().over(w), "__fp": F.first("fp").over(w), "__fy": F.first("fy").over(w)})
    known = (F.coalesce("__fp", F.lit("")) != "") & (F.coalesce("__fy", F.lit(0)) != 0)
    same = known & (F.col("__n") > 1) & (F.col("fp") == F.col("__fp")) & (F.col("fy") == F.col("__fy") - 1)

    def nth(k: int) -> Column:
        return F.max(F.when(F.col("__n") == k, F.col("value")))

    out = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("facts"),
        F.min_by(F.struct("end", "value", "fp", "fy"), "__n").alias("latest"),
        F.min_by("value", F.when(same, F.col("__n"))).alias("__match"),
        nth(5).alias("__fifth"),
        nth(2).alias("__second"),
    )
    prior = F.coalesce("__match", F.when(F.col("facts") >= 5, F.col("__fifth")).otherwise(F.col("__second")))
    return out.select(*keys, "facts", "latest", prior.alias("prior_value"))


def revenue_growth(facts: DataFrame, tags: Sequence[str] = REVENUE_TAGS) -> DataFrame:
    """Year-on-year revenue growth per company: first tag with a result, quarterly before annual."""
    periods = F.filter(F.array(F.when(quarterly(), F.lit(0)), F.when(annual(), F.lit(1))), lambda p: p.isNotNull())
    rows = facts.withColumn("tag_rank", tag_rank(tags)).filter(F.col("tag_rank").isNotNull()).withColumn("period", F.explode(periods))
    pairs = prior_year_matches(rows, ["cik", "tag", "tag_rank", "period"])
    valid = pairs.filter((F.col("facts") >= 2) & (F.col("prior_value") != 0))
    best = valid.groupBy("cik").agg(F.min_by(F.struct("tag", "period", "latest", "prior_value"), F.struct("tag_rank", "period")).alias("b"))
    return best.select(
        "cik",
        F.col("b.tag").alias("tag"),
        F.when(F.col("b.period") == 0, "quarterly").otherwise("annual").alias("period_type"),
        F.col("b.latest.end").alias("period_end"),
        F.col("b.latest.value").alias("revenue"),
        F.col("b.prior_value").alias("revenue_prior"),
        growth(F.col("b.latest.value"), F.col("b.prior_value")).alias("revenue_yoy"),
    )


def statement_growth(statements: DataFrame) -> DataFrame:
    """``ticker, period, revenue`` to growth of the latest quarter over the one four places earlier."""
    w = Window.partitionBy("ticker").orderBy(F.desc("period"))
    tail = statements.filter(F.col("revenue").isNotNull()).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= 5)

    def at(k: int) -> Column:
        return F.max(F.when(F.col("n") == k, F.col("revenue")))

    out = tail.groupBy("ticker").agg(at(1).alias("latest"), at(5).alias("prior"))
    return out.select("ticker", growth("latest", "prior").alias("revenue_yoy"))


def newest_value(tags: Sequence[str], when: Column) -> Column:
    """Aggregate: value of the preferred tag's newest fact among rows where ``when`` holds."""
    rank = tag_rank(tags)
    order = F.struct((-rank).alias("t"), text_or_blank("end").alias("e"), text_or_blank("filed").alias("f"), (-F.col("position")).alias("p"))
    return F.max_by("value", F.when(when & rank.isNotNull(), order))


def latest_facts(facts: DataFrame, metrics: dict[str, Sequence[str]]) -> DataFrame:
    """Newest value of each metric per company, by tag preference."""
    return facts.groupBy("cik").agg(*[newest_value(tags, F.lit(True)).alias(m) for m, tags in metrics.items()])


def prior_year_end(end: Column) -> Column:
    """The same text date a year earlier (29 February finds no match by design)."""
    return F.concat((F.substring(end, 1, 4).try_cast("int") - 1).cast("string"), F.substring(end, 5, 100))


def financial_quality(facts: DataFrame) -> DataFrame:
    """Margins, free cash flow, leverage and growth of receivables and inventory per company.

    One aggregate over the facts picks all metrics; flow metrics must end with the revenue period.
    """
    rev = revenue_growth(facts).withColumnRenamed("tag", "revenue_tag")
    df = facts.join(rev, "cik").withColumn("__prior_end", prior_year_end(F.col("period_end")))
    flow = (F.col("end") == F.col("period_end")) & ((F.col("period_type") != "quarterly") | quarterly())
    prior = F.col("end") == F.col("__prior_end")
    picked = df.groupBy("cik").agg(
        *[newest_value(t, flow).alias(m) for m, t in FLOW_TAGS.items()],
        *[newest_value(t, F.lit(True)).alias(m) for m, t in STOCK_TAGS.items()],
        *[newest_value(t, prior).alias(m) for m, t in PRIOR_TAGS.items()],
    )
    c = F.col
    zero = F.lit(0.0)
    debt = F.when(
        c("debt_current").isNotNull() | c("debt_noncurrent").isNotNull(), F.coalesce(F.abs("debt_current"), zero) + F.coalesce(F.abs("debt_noncurrent"), zero)
    )
    fcf = F.when(
        c("operating_cash_flow").isNotNull() | c("capital_expenditures").isNotNull(),
        F.coalesce("operating_cash_flow", zero) - F.coalesce(F.abs("capital_expenditures"), zero),
    )
    out = rev.join(picked, "cik").withColumns({"total_debt": debt, "free_cash_flow": fcf})
    return out.withColumns(
        {
            "gross_margin": div("gross_profit", "revenue"),
            "operating_margin": div("operating_income", "revenue"),
            "net_margin": div("net_income", "revenue"),
            "free_cash_flow_margin": div("free_cash_flow", "revenue"),
            "liabilities_to_assets": div("liabilities", "assets"),
            "debt_to_assets": div("total_debt", "assets"),
            "receivables_yoy": growth("receivables", "receivables_prior"),
            "inventory_yoy": growth("inventory", "inventory_prior"),
        }
    ).drop("debt_current", "debt_noncurrent", "receivables_prior", "inventory_prior")


def first_rows(rows: DataFrame, key: str, order: Sequence[str], cols: Sequence[str], limit: int | None, name: str) -> DataFrame:
    """The rows per key in order as an array; the first ``limit`` (a group limit before the exchange) if that is given."""
    w = Window.partitionBy(key).orderBy(*order)
    numbered = rows.withColumn("__k", F.row_number().over(w))
    tail = numbered if limit is None else numbered.filter(F.col("__k") <= limit)
    out = tail.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("__k", *cols))).alias("__r"))
    return out.select(key, F.transform("__r", lambda r: F.struct(*[r[c].alias(c) for c in cols])).alias(name))


def form4_rollup(transactions: DataFrame, key: str = "ticker", listed: int | None = None) -> DataFrame:
    """Counts and values of acquired and disposed shares, the net value and the rows in filing order (the first ``listed`` if that is given)."""
    side, value = F.col("acquired_disposed"), F.col("value")
    bought, sold = side == "A", side == "D"
    cols = ["transaction_date", "transaction_code", "shares", "price", "value"]
    if listed is not None:
        transactions = materialise(transactions.select(key, "filing_no", "position", "acquired_disposed", *cols), "transactions")  # each document is parsed once
    totals = [
        F.count(F.lit(1)).alias("transaction_count"),
        F.count_if(bought).alias("purchase_count"),
        F.count_if(sold).alias("sale_count"),
        F.coalesce(F.sum(F.when(bought, value)), F.lit(0.0)).alias("purchase_value"),
        F.coalesce(F.sum(F.when(sold, value)), F.lit(0.0)).alias("sale_value"),
    ]
    rows = F.array_sort(F.collect_list(F.struct("filing_no", "position", *cols)))
    out = transactions.where(F.col(key).isNotNull()).groupBy(key).agg(*totals, *([] if listed is not None else [rows.alias("__r")]))
    out = out.withColumn("net_purchase_value", F.col("purchase_value") - F.col("sale_value"))
    if listed is not None:
        return out.join(first_rows(transactions, key, ["filing_no", "position"], cols, listed, "transactions"), key)
    return out.withColumn("transactions", F.transform("__r", lambda r: F.struct(*[r[c].alias(c) for c in cols]))).drop("__r")


def insider_rollup(transactions: DataFrame, key: str = "ticker") -> DataFrame:
    """Open-market buys and sales (codes P and S without the derivative flag) and their net value."""
    open_market = F.col("trade_code").isin("P", "S") & ~F.contains(F.col("transaction_flags"), F.lit("D"))
    buy, sell = open_market & (F.col("trade_code") == "P"), open_market & (F.col("trade_code") == "S")
    size = F.abs("value")
    out = transactions.groupBy(key).agg(
        F.count(F.lit(1)).alias("transaction_count"),
        F.count_if(open_market).alias("open_market_count"),
        F.count_if(buy).alias("purchase_count"),
        F.count_if(sell).alias("sale_count"),
        F.coalesce(F.sum(F.when(buy, size)), F.lit(0.0)).alias("purchase_value"),
        F.coalesce(F.sum(F.when(sell, size)), F.lit(0.0)).alias("sale_value"),
    )
    return out.withColumn("net_purchase_value", F.col("purchase_value") - F.col("sale_value"))


def contract_rollup(awards: DataFrame, key: str = "ticker") -> DataFrame:
    """Award count, total, largest, defence share by agency text, and the five largest agencies."""
    amount = F.coalesce("award_amount", F.lit(0.0))
    blank = F.lit("")
    agency = F.coalesce(F.nullif(F.trim("awarding_agency"), blank), F.nullif(F.trim("funding_agency"), blank))
    text = F.upper(F.concat_ws(" ", *[F.coalesce(c, blank) for c in ("awarding_agency", "awarding_sub_agency", "funding_agency", "funding_sub_agency")]))
    defence = F.contains(text, F.lit("DEFENSE")) | F.contains(text, F.lit("DEPARTMENT OF THE AIR FORCE")) | F.contains(text, F.lit("DEPARTMENT OF THE NAVY"))
    total = awards.groupBy(key).agg(
        F.count(F.lit(1)).alias("award_count"), F.sum(amount).alias("total_amount"), F.max(amount).alias("largest_amount"),
        F.coalesce(F.sum(F.when(defence, amount)), F.lit(0.0)).alias("defence_amount"),
    )
    per = awards.withColumn("agency", agency).filter(F.col("agency").isNotNull()).groupBy(key, "agency").agg(F.sum(amount).alias("amount"))
    top = first_rows(per.withColumn("__o", -F.col("amount")), key, ["__o", "agency"], ["agency", "amount"], 5, "top_agencies")
    return total.join(top, key, "left")


def beneficial_rollup(filings: DataFrame, key: str = "ticker") -> DataFrame:
    """``percents`` array per filing to the filing count and the largest reported share."""
    return filings.groupBy(key).agg(F.count(F.lit(1)).alias("filing_count"), F.max(F.array_max("percents")).alias("max_reported_percent"))


def proxy_rollup(filings: DataFrame, key: str = "ticker") -> DataFrame:
    """``section, rows, group_percent`` per filing to counts and the largest group and holder shares."""
    with_section = filings.filter(F.col("section") != "")
    top = F.array_max(F.transform("rows", lambda r: r["percent"]))
    return with_section.groupBy(key).agg(
        F.count(F.lit(1)).alias("filing_count"), F.max("group_percent").alias("management_group_percent"), F.max(top).alias("top_holder_percent")
    )


def holdings_rollup(holdings: DataFrame, companies: DataFrame, managers_checked: int | None = None) -> DataFrame:
    """Managers that hold each company, with the total reported value and shares.

    ``holdings``: ``manager, manager_no, name_of_issuer, value_usd, shares``. Issuer names are
    matched once per distinct token set, and companies of one token set share its totals. ``managers_checked`` limits the managers by number.
    """
    checked = holdings if managers_checked is None else holdings.filter(F.col("manager_no") < managers_checked)
    # each document is parsed once, and a manager's holdings of one token set are one row
    held = checked.groupBy("manager", J._token_set("name_of_issuer").alias("issuer_set")).agg(F.sum("value_usd").alias("value_usd"), F.sum("shares").alias("shares"))
    held = materialise(held.where("issuer_set IS NOT NULL"), "holdings")
    sets = held.select("issuer_set").distinct()
    own, by_symbol = J.company_names(companies, sets)
    pairs = materialise(J.token_set_matches(sets, own.select("company_set").distinct()), "set-pairs")

    def rollup(matched: DataFrame, key: str) -> DataFrame:
        return matched.join(held, "issuer_set").groupBy(key).agg(
            F.count_distinct("manager").alias("matched_manager_count"),
            F.coalesce(F.sum("value_usd"), F.lit(0.0)).alias("total_value_usd"),
            F.coalesce(F.sum("shares"), F.lit(0.0)).alias("total_shares"),
        )

    once = own.where("single").join(rollup(pairs, "company_set"), "company_set").drop("company_set", "single")
    several = J.spread_join(pairs, own.where("NOT single").select("ticker", "company_set"), "company_set").select("issuer_set", "ticker")
    return once.unionByName(rollup(several.unionByName(by_symbol).distinct(), "ticker"))
