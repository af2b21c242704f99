"""Term scans, snippets, amounts and ownership statements in filing texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.numeric import col, let
from tidemark.functions.textscan import around, fold_matches, match_spans, squeeze, term_pattern

# Terms scanned in filings.
ORDER_TERMS = (
    "backlog",
    "remaining performance obligation",
    "remaining performance obligations",
    "contract liability",
    "contract liabilities",
    "deferred revenue",
    "RPO",
)

# Terms highlighted on official pages.
PAGE_TERMS = (
    "award", "backlog", "contract", "customer", "data center", "defense", "design win", "dod", "launch", "mission",
    "nasa", "order", "payload", "platform", "production", "qualification", "satellite", "spacecraft",
)

# Patterns of an amount after or before a term.
AMOUNT_PATTERNS = (
    r"(?:backlog|remaining performance obligations?|RPOs?).{0,220}?\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(billion|million|thousand|bn|mm|m)?",
    r"\$?\s*([0-9][0-9,]*(?:\.[0-9]+)?)\s*(billion|million|thousand|bn|mm|m).{0,220}?(?:backlog|remaining performance obligations?|RPOs?)",
)

# Where an ownership section starts and ends.
SECTION_ANCHORS = (
    "security ownership of certain beneficial owners",
    "security ownership of beneficial owners",
    "security ownership of management",
    "beneficial owners and management",
    "beneficial ownership of common stock",
    "beneficial ownership of our common stock",
    "principal stockholders",
)
SECTION_ENDS = ("executive compensation", "equity compensation plan", "certain relationships", "audit committee")

# Words that make a sentence an ownership statement, and words that rule it out.
OWNERSHIP_WORDS = ("beneficial", "shares", "stockholder", "shareholder", "voting power", "blackrock", "vanguard")
OTHER_WORDS = (
    "customer", "revenue", "gross margin", "segment", "ownership interest", "proposal", "vote", "broker", "ratification",
    "compensation", "no effect",
)

# Words that make a percentage an ownership percentage, and patterns of a group holding.
PERCENT_CONTEXT = ("class", "beneficial", "voting", "ownership", "owned")
PERCENT = r"([0-9]+(?:\.[0-9]+)?)\s*%"
GROUP_PATTERNS = (
    r"(?i)all\s+(?:directors|executive officers).{0,500}?([0-9]+(?:\.[0-9]+)?)\s*%",
    r"(?i)directors\s+and\s+executive\s+officers\s+as\s+a\s+group.{0,500}?([0-9]+(?:\.[0-9]+)?)\s*%",
    r"(?i)all\s+executive\s+officers\s+and\s+directors\s+as\s+a\s+group.{0,500}?([0-9]+(?:\.[0-9]+)?)\s*%",
)


def term_counts(text: Column | str, terms: Sequence[str] = ORDER_TERMS, marker: str = "backlog") -> Column:
    """Counts of the terms that contain ``marker`` and of the other terms; overlapping terms all count."""

    def total(chosen: list[str]) -> Column:
        parts = [F.regexp_count(col(text), F.lit("(?iU)" + term_pattern(t))) for t in chosen]
        return sum(parts, F.lit(0))

    first = [t for t in terms if marker in t.lower()]
    return F.struct(total(first).alias("backlog_mentions"), total([t for t in terms if t not in first]).alias("rpo_mentions"))


def snippets(text: Column | str, terms: Sequence[str] = ORDER_TERMS, radius: int = 220, max_snippets: int = 4, spacing: int = 80) -> Column:
    """Passages around matches in term order, skipping one that starts within ``spacing`` of a kept one."""
    t = col(text)

    def step(acc: Column, at: Column, m: Column, k: Column) -> Column:
        a = F.greatest(F.lit(0), at - radius)
        near = F.exists(acc, lambda x: F.abs(x["a"] - a) < spacing)
        here = F.struct(a.alias("a"), at.alias("s"), (at + F.length(m)).alias("e"))
        return F.when((F.size(acc) < max_snippets) & ~near, F.concat(acc, F.array(here))).otherwise(acc)

    # one fold a term over what the terms before it kept: at most ``max_snippets`` places are held
    kept = F.array().cast("array<struct<a:int,s:int,e:int>>")
    def with_term(kept: Column, pattern: str) -> Column:
        return let(kept, lambda acc: fold_matches(t, pattern, acc, step))

    for x in terms:
        kept = with_term(kept, term_pattern(x))
    found = F.transform(kept, lambda s: around(t, s["s"], s["e"], radius))
    return F.coalesce(found, F.array().cast("array<string>"))


def amounts(text: Column | str, max_items: int | None = None, least: float = 100_000, radius: int = 160) -> Column:
    """Money amounts near a term, in pattern order: value, number, unit and context; the first ``max_items`` if that is given."""
    t = col(text)

    def item(s: Column) -> Column:
        unit = F.lower(F.coalesce(s["second"], F.lit("")))
        return F.struct(
            S.money_value(s["first"], unit).alias("value"), s["first"].alias("raw_number"), unit.alias("unit"), around(t, s["start"], s["end"], radius).alias("context")
        )

    found = F.filter(F.transform(match_spans(t, AMOUNT_PATTERNS), item), lambda a: a["value"] >= least)
    return found if max_items is None else F.slice(found, 1, max_items)


def search_text(text: Column | str, snips: Column) -> Column:
    return F.when(F.size(snips) > 0, F.array_join(snips, " ")).otherwise(col(text))


def amount_summary(found: Column) -> Column:
    return F.struct(F.size(found).alias("amount_mentions"), F.array_max(F.transform(found, lambda a: a["value"])).alias("largest_amount"))


def selected_filing(scans: DataFrame) -> DataFrame:
    """Per ticker the first filing (by ``position``) with a mention, else the last readable one."""
    rest = [c for c in scans.columns if c != "ticker"]
    row = F.struct(*rest)
    hit = F.col("backlog_mentions") + F.col("rpo_mentions") > 0
    picked = scans.groupBy("ticker").agg(
        F.coalesce(F.min_by(row, F.when(hit, F.col("position"))), F.max_by(row, F.col("position"))).alias("r")
    )
    return picked.select("ticker", "r.*")


def ownership_percents(text: Column | str, radius: int = 120) -> Column:
    """Distinct percentages in (0, 100] with an ownership word nearby, as shares, descending."""
    t = col(text)

    def kept(s: Column) -> Column:
        v = s["first"].try_cast("double")
        start = F.greatest(F.lit(0), s["start"] - radius)
        around_it = F.lower(F.substring(t, start + 1, s["end"] + radius - start))
        owned = let(around_it, lambda near: F.exists(S.literal_array(PERCENT_CONTEXT), lambda w: F.contains(near, w)))
        return (v > 0) & (v <= 100) & owned

    found = F.transform(F.filter(match_spans(t, [PERCENT]), kept), lambda s: s["first"].try_cast("double") / 100)
    return F.sort_array(F.array_distinct(found), False)


def ownership_section(text: Column | str, span: int | None = None, least: int = 1_200) -> Column:
    """From the earliest anchor, cut at the first end marker that comes after ``least`` characters; blank without anchor."""

    def cut(section: Column, low: Column) -> Column:
        ends = [let(F.locate(m, low), lambda at: F.when(at > least + 1, at)) for m in SECTION_ENDS]
        return let(F.least(*ends), lambda end: F.when(end.isNotNull(), F.substring(section, F.lit(1), end - 1)).otherwise(section))

    def first_anchor(low: Column) -> Column:
        return F.least(*[F.nullif(F.locate(a, low), F.lit(0)) for a in SECTION_ANCHORS])

    def section_from(t: Column) -> Column:
        section = F.substring(t, let(F.lower(t), first_anchor), F.length(t) if span is None else F.lit(span))
        return let(section, lambda s: let(F.lower(s), lambda low: cut(s, low)))

    return F.coalesce(let(col(text), section_from), F.lit(""))


def ownership_rows(section: Column | str, limit: int | None = None, longest: int | None = None, shown: int | None = None) -> Column:
    """Ownership sentences (15 characters at least) of a section with their largest percentage.

    The first ``limit``, no sentence over ``longest`` characters and the first ``shown`` of its text, if these are given.
    """
    sentences = F.split(col(section), r"(?<=[.%])\s+")

    def named(low: Column, words: Sequence[str]) -> Column:
        return F.exists(S.literal_array(words), lambda w: F.contains(low, w))

    def row(s: Column) -> Column:
        values = F.transform(F.regexp_extract_all(s, F.lit(PERCENT), F.lit(1)), lambda v: v.try_cast("double") / 100)
        return F.struct(F.trim(s).alias("text"), F.array_max(values).alias("percent"))

    rows = F.transform(F.filter(sentences, lambda s: let(F.lower(s), lambda low: named(low, OWNERSHIP_WORDS) & ~named(low, OTHER_WORDS))), row)

    def fits(r: Column) -> Column:
        size = F.length(r["text"])
        return (r["percent"] > 0) & (r["percent"] <= 1) & (size >= 15) & (F.lit(True) if longest is None else size <= longest)

    good = F.filter(rows, fits)
    text = lambda r: r["text"] if shown is None else F.substring(r["text"], 1, shown)
    return F.transform(good if limit is None else F.slice(good, 1, limit), lambda r: F.struct(text(r).alias("name_or_context"), r["percent"].alias("percent")))


def group_percent(section: Column | str) -> Column:
    """Largest percentage held by directors and officers as a group."""

    def largest(s: Column) -> Column:
        found = F.concat(*[F.regexp_extract_all(s, F.lit(p), F.lit(1)) for p in GROUP_PATTERNS])
        values = F.filter(F.transform(found, lambda v: v.try_cast("double")), lambda v: (v > 0) & (v <= 100))
        return F.array_max(values) / 100

    return let(col(section), largest)


def highlights(text: Column | str, terms: Sequence[str] = PAGE_TERMS, radius: int = 180, max_snippets: int | None = None) -> Column:
    """First passage of each term in term order; repeated passages count once."""
    none = F.array().cast("array<struct<term:string,at:int,snippet:string>>")

    def entry(t: Column, term: Column, at: Column) -> Column:
        a = F.greatest(F.lit(1), at - radius)
        snip = F.substring(t, a, at + F.length(term) + radius - a)
        return F.struct(term.alias("term"), at.alias("at"), F.btrim(snip, F.lit(" .")).alias("snippet"))

    def search(t: Column, low: Column) -> Column:
        return F.transform(S.literal_array(terms), lambda term: let(F.instr(low, F.lower(term)), lambda at: F.when(at > 0, entry(t, term, at))))

    found = F.filter(let(squeeze(text), lambda t: let(F.lower(t), lambda low: search(t, low))), lambda h: h.isNotNull())

    def step(acc: Column, h: Column) -> Column:
        seen = F.exists(acc, lambda k: F.lower(k["snippet"]) == F.lower(h["snippet"]))
        room = F.lit(True) if max_snippets is None else F.size(acc) < max_snippets
        return F.when(room & ~seen, F.concat(acc, F.array(h))).otherwise(acc)

    kept = F.aggregate(found, none, step)
    return F.transform(kept, lambda h: F.struct(h["term"].alias("term"), h["snippet"].alias("snippet")))
