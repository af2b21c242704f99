"""Symbol lists, name matching, keyword matching and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.numeric import fixed_text, let, round_even
from tidemark.operators.merge import latest_per_key
from tidemark.session import materialise


def append_items(items: DataFrame, path: str) -> None:
    """Append items to the partitioned item table."""
    items.write.mode("append").partitionBy("dimension").parquet(path)


def clean_symbols(raw: DataFrame) -> DataFrame:
    """``position, symbol`` to distinct clean symbols with their first position."""
    clean = raw.select(F.col("position"), S.clean_symbol("symbol").alias("symbol")).filter(F.col("symbol").isNotNull())
    return clean.groupBy("symbol").agg(F.min("position").alias("position"))


def merge_symbol_lists(*lists: DataFrame) -> DataFrame:
    """Union of ``position, symbol`` lists keeping the first occurrence; earlier lists come first."""
    union = None
    for i, part in enumerate(lists):
        part = part.select(F.struct(F.lit(i).alias("source"), F.col("position").cast("bigint").alias("position")).alias("at"), F.upper(F.trim("symbol")).alias("symbol"))
        union = part if union is None else union.unionByName(part)
    return union.filter(F.col("symbol") != "").groupBy("symbol").agg(F.min("at").alias("at"))


def ranked(df: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """``df`` with its place (from 1) in the whole order.

    The rows are dealt to ranges of the order, written once and numbered inside each range behind the
    rows of the ranges before, so no task sees the whole table.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()), "ranges")
    # one row for each range
    before = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    before = before.withColumn("__before", F.sum("__n").over(Window.orderBy("__range")) - F.col("__n")).drop("__n")
    place = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return dealt.withColumn(name, place.cast("bigint")).join(F.broadcast(before), "__range").withColumn(name, F.col(name) + F.col("__before")).drop("__range", "__before")


def symbol_batch(symbols: DataFrame, offset: int, limit: int) -> DataFrame:
    """Rows ``offset+1 .. offset+limit`` of a merged list (a batch of a run)."""
    return ranked(symbols, "position", "at").filter(F.col("position").between(offset + 1, offset + limit)).select("symbol", "position")


def source_listing(sources: DataFrame) -> DataFrame:
    """Sources with the number of sources of the same scope."""
    per_scope = sources.groupBy("scope").agg(F.count(F.lit(1)).alias("sources_in_scope"))
    return sources.join(per_scope, "scope")


def screen_report(results: DataFrame, limit: int | None = None) -> DataFrame:
    """The ranked report, formatted; the first ``limit`` rows if that is given."""
    top = ranked(results, "place", F.desc("total_score"), F.asc("ticker"))
    top = top if limit is None else top.filter(F.col("place") <= limit)
    cap = F.when(F.abs("market_cap") >= 1e6, S.money_text("market_cap")).otherwise("small")
    return top.select("ticker", "place", fixed_text("total_score", 2).alias("score"), cap.alias("market_cap"))


# --- names --------------------------------------------------------------------------------


def match_awards(awards: DataFrame, companies: DataFrame, least: float = 0.45) -> DataFrame:
    """Awards fetched for a ticker, kept when the recipient matches the company's name.

    Awards carry the ticker they were fetched for, so this is an equi join plus a row-wise
    token score; a company without usable tokens keeps all its awards. Tokens are made once for each distinct recipient;
    that table is broadcast only where its measured size allows, and a common recipient is split by the adaptive join otherwise.
    """
    names = companies.select("ticker", S.company_tokens("name").alias("__own"))
    recipients = awards.select(F.col("recipient_name").alias("__name")).distinct().select("__name", S.company_tokens("__name").alias("__tokens"))
    joined = awards.join(names, "ticker").join(recipients, F.col("recipient_name") == F.col("__name"), "left").drop("__name")
    joined = joined.withColumn("__score", S.match_score(F.col("__own"), F.coalesce("__tokens", F.array().cast("array<string>"))))
    nameless = F.size("__own") == 0
    kept = joined.filter(nameless | (F.col("__score") >= least))
    return kept.withColumn("recipient_match_score", F.when(~nameless, round_even("__score", 3))).drop("__own", "__tokens", "__score")


#: Rows of one join key that meet in one task, on either side.
KEY_ROWS = 2_048


def spread_join(left: DataFrame, right: DataFrame, key: str, block: int = KEY_ROWS) -> DataFrame:
    """Inner join on ``key`` in which a frequent key is dealt out to blocks on both sides.

    A key with ``n`` and ``m`` rows becomes ``ceil(n / block) * ceil(m / block)`` keys of at most about ``block`` rows a side: every row
    has a block of its own side by hash and is repeated for the blocks of the other. Only frequent keys are looked up, and keys
    that one side lacks are dropped before.
    """
    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias(name))

    frequent = materialise(sizes(left, "__lb").join(sizes(right, "__rb"), key).where("__lb > 1 OR __rb > 1"), "frequent-keys")

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        out = df.join(frequent, key, "left")
        mine = F.pmod(F.xxhash64(*df.columns), F.coalesce(own, F.lit(1)).cast("long")).cast("int").alias(f"{own}_at")
        return out.select(*df.columns, mine, F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1)).alias(f"{other}_at"))

    return dealt(left, "__lb", "__rb").join(dealt(right, "__rb", "__lb"), [key, "__lb_at", "__rb_at"]).drop("__lb_at", "__rb_at")


def _token_set(name: Column | str) -> Column:
    """A name's distinct tokens in order, joined by blanks; names of equal sets match alike."""
    return F.array_join(F.array_sort(S.issuer_tokens(name)), " ")


def token_set_matches(issuer_sets: DataFrame, company_sets: DataFrame) -> DataFrame:
    """Pairs ``issuer_set, company_set`` of distinct token sets that share two tokens, or the only token of the company's.

    The join key is the pair of tokens itself (or the single token), so every joined row is a
    match: a frequent word alone never pairs anything. A frequent pair is dealt out (``spread_join``), and two sets that share several
    pairs are one row, kept under their first common pair.
    """
    def split(c: str) -> Column:
        return F.split(c, " ")

    def token_pairs(s: Column) -> Column:
        return F.flatten(F.transform(s, lambda a: F.transform(F.filter(s, lambda b: b > a), lambda b: F.concat(a, F.lit(" "), b))))

    it, ct = split("issuer_set"), split("company_set")
    issuer_keys = issuer_sets.where("issuer_set <> ''").select("issuer_set", F.explode(F.concat(token_pairs(it), it)).alias("key"))
    company_keys = company_sets.where("company_set <> ''").select("company_set", F.explode(F.when(F.size(ct) >= 2, token_pairs(ct)).otherwise(ct)).alias("key"))
    common = F.array_sort(F.array_intersect(it, ct))
    first = F.when(F.size(ct) >= 2, F.concat(common[0], F.lit(" "), common[1])).otherwise(F.col("company_set"))
    return spread_join(issuer_keys, company_keys, "key").where(F.col("key") == first).select("issuer_set", "company_set")


def company_names(companies: DataFrame, issuer_sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ticker, company_set, single`` and the pairs ``issuer_set, ticker`` of issuers that name the ticker itself.

    ``single``: the ticker has one token set and no issuer names it, so no issuer can match it twice.
    """
    own = companies.select("ticker", _token_set("name").alias("company_set")).where("company_set IS NOT NULL").distinct().withColumn("sym", F.lower("ticker"))
    named = issuer_sets.select("issuer_set", F.explode(F.split("issuer_set", " ")).alias("sym"))
    words = named.select("sym", F.lit(True).alias("named")).distinct()
    flagged = own.join(words, "sym", "left").withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("ticker")))
    flagged = materialise(flagged.select("ticker", "sym", "company_set", ((F.col("sets") == 1) & F.col("named").isNull()).alias("single")), "company-names")
    by_symbol = spread_join(named, flagged.where("NOT single").select("ticker", "sym").distinct(), "sym").select("issuer_set", "ticker")
    return flagged.drop("sym"), by_symbol


def issuer_matches(issuers: DataFrame, companies: DataFrame) -> DataFrame:
    """Pairs ``issuer, ticker`` that share two name tokens, the only token, or the ticker itself.

    Token sets are matched once for all names that have them (``token_set_matches``) and spread to the names; only tickers that an issuer
    can match in several ways (several names, or the ticker itself) pass a distinct.
    """
    names = materialise(issuers.select("issuer").distinct().select("issuer", _token_set("issuer").alias("issuer_set")).where("issuer_set IS NOT NULL"), "issuer-names")
    sets = names.select("issuer_set").distinct()
    own, by_symbol = company_names(companies, sets)
    pairs = token_set_matches(sets, own.select("company_set").distinct())
    named = materialise(names.join(pairs, "issuer_set").select("issuer", "company_set"), "issuer-sets")
    once = spread_join(named, own.where("single").select("ticker", "company_set"), "company_set").select("issuer", "ticker")
    several = spread_join(named, own.where("NOT single").select("ticker", "company_set"), "company_set").select("issuer", "ticker")
    symbols = spread_join(names, by_symbol, "issuer_set").select("issuer", "ticker")
    return once.unionByName(several.unionByName(symbols).distinct())


def keyword_matches(events: DataFrame, text: Column, keywords: dict[str, list[str]]) -> DataFrame:
    """One row per event and symbol with the symbol's keywords contained in the event text.

    The keyword table is configuration, so it is a literal and the match stays a projection:
    no join and nothing broadcast.
    """
    table = F.array(*[F.struct(F.lit(s).alias("symbol"), S.literal_array(ks).alias("keywords")) for s, ks in sorted(keywords.items())])

    def hits(low: Column) -> Column:
        per_symbol = F.transform(
            table,
            lambda e: F.struct(
                e["symbol"].alias("symbol"), F.filter(e["keywords"], lambda k: F.contains(low, F.lower(k))).alias("matched_keywords")
            ),
        )
        return F.filter(per_symbol, lambda h: F.size(h["matched_keywords"]) > 0)

    found = events.select("*", F.explode(let(F.lower(text), hits)).alias("__hit"))
    return found.select(*events.columns, "__hit.symbol", "__hit.matched_keywords")


#: A word, or a single mark or blank of a text; the parts by which keywords are looked up.
_PART = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]"


def _anchors(keywords: DataFrame) -> DataFrame:
    """Each keyword with its longest word, else a mark, else a blank (``part``), and whether that is bounded inside the keyword on both sides.

    A bounded part stands in a text as it is; any other can lie inside a longer word.
    """
    parts = F.array_distinct(F.regexp_extract_all("low", F.lit(f"({_PART})"), F.lit(1)))
    weight = lambda p: F.length(p) * 2 - F.when(F.trim(p) == "", 1).otherwise(0)
    longest = F.array_sort(parts, lambda a, b: weight(b) - weight(a))
    out = keywords.withColumn("low", F.lower("keyword")).withColumn("part", F.get(longest, 0))
    at = F.instr("low", F.col("part"))
    word = F.col("part").rlike(r"^[\p{L}\p{N}]")
    inner = ~F.substring(F.col("low"), at - 1, F.lit(1)).rlike(r"[\p{L}\p{N}]") & (at > 1) & (at + F.length("part") <= F.length("low"))
    return out.withColumn("bounded", ~word | inner)


def keyword_matches_by_index(events: DataFrame, key: str, text: str, keywords: DataFrame) -> DataFrame:
    """``keyword_matches`` for a keyword table of any size: ``symbol, position, keyword``; ``key`` tells the events apart.

    Keywords are looked up by one of their words: first in the vocabulary of all texts (a word that is not bounded by its keyword by
    the letters of its first three-letter piece), then by the words found there in the texts. What is left is confirmed in the text, so the work
    follows the texts and the matches, not texts times keywords. Null texts, keys and keywords and empty keywords match nothing.
    """
    clean = events.where(F.col(key).isNotNull() & F.col(text).isNotNull())
    listed = materialise(_anchors(keywords.where("keyword <> ''").select("symbol", "position", "keyword")), "keywords")
    words = materialise(clean.select(F.col(key).alias("__key"), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(f"({_PART})"), F.lit(1)))).alias("word")), "event-words")
    known = words.select("word").distinct()
    exact = listed.where("bounded").join(known, F.col("part") == F.col("word"))
    size = F.least(F.length("part"), F.lit(3))
    loose = listed.where("NOT bounded").select("symbol", "position", "part", F.substring("part", F.lit(1), size).alias("piece"))
    pieces = F.flatten(F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - k + 1, F.lit(1))), lambda i: F.substring(F.col("word"), i, k))))
    inside = spread_join(known.select("word", F.explode(F.array_distinct(pieces)).alias("piece")), loose, "piece").where(F.contains("word", F.col("part")))
    look = materialise(exact.select("symbol", "position", "word").unionByName(inside.select("symbol", "position", "word")), "keyword-words")
    met = spread_join(words, look, "word").select("__key", "symbol", "position").distinct()
    candidates = met.join(listed.select("symbol", "position", "keyword"), ["symbol", "position"])
    grouped = candidates.groupBy("__key", F.col("symbol").alias("__symbol")).agg(F.sort_array(F.collect_list(F.struct("position", "keyword"))).alias("__may"))
    joined = clean.join(grouped, F.col(key) == F.col("__key"))
    found = joined.withColumn("__hit", let(F.lower(text), lambda low: F.filter("__may", lambda k: F.contains(low, F.lower(k["keyword"])))))
    return found.where(F.size("__hit") > 0).select(*events.columns, F.col("__symbol").alias("symbol"), F.transform("__hit", lambda k: k["keyword"]).alias("matched_keywords"))


def keyword_table(spark: SparkSession, keywords: dict[str, list[str]]) -> DataFrame:
    rows = [(s, i, k) for s, ks in sorted(keywords.items()) for i, k in enumerate(ks)]
    return spark.createDataFrame(rows, "symbol string, position int, keyword string")


def still_relevant(net: Column, status: Column, now: Column, lookback_hours: int = 24) -> Column:
    """False for events older than the lookback and for finished ones in the past."""
    hours = F.lit(max(0, lookback_hours))
    old = net < now - F.make_dt_interval(F.lit(0), hours)
    done = F.lower(F.coalesce(status, F.lit(""))).isin("success", "failure", "partial failure") & (net < now)
    return ~F.coalesce(old | done, F.lit(False))


# --- dates --------------------------------------------------------------------------------


def named_segments(rows: DataFrame, date: str, segments: list[tuple[str, str, str]]) -> DataFrame:
    """Rows repeated for each named date segment (inclusive) they fall in; segments are configuration."""
    table = F.array(*[F.struct(F.lit(n).alias("segment"), F.lit(a).cast("date").alias("a"), F.lit(b).cast("date").alias("b")) for n, a, b in segments])
    hit = F.filter(table, lambda s: F.col(date).between(s["a"], s["b"]))
    return rows.select("*", F.explode(F.transform(hit, lambda s: s["segment"])).alias("segment"))


def missing_weekdays(present: DataFrame, key: str, date: str) -> DataFrame:
    """Weekdays between the first and last date of each key that have no row; a null key equals no other, so all its weekdays are missing.

    Only the days present are shuffled: the gap behind each of them is filled in place.
    """
    have = present.select(key, F.col(date).alias("day")).where("day IS NOT NULL").distinct()
    upto = F.lead("day").over(Window.partitionBy(key).orderBy("day"))
    gaps = have.withColumn("__next", upto).select(
        key, F.when(F.col(key).isNotNull(), F.date_add("day", 1)).otherwise(F.col("day")).alias("a"), F.when(F.col("__next").isNotNull(), F.date_sub("__next", 1)).otherwise(F.col("day")).alias("b")
    )
    return gaps.where("a <= b").select(key, F.explode(S.weekdays(F.col("a"), F.col("b"))).alias("day"))


def unique_filings(filings: DataFrame) -> DataFrame:
    """First listed filing of each ``(cik, accession, document)``."""
    return latest_per_key(filings.withColumn("__k", -F.col("position")), ["cik", "accession", "document"], ["__k"]).drop("__k")
