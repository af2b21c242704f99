"""Web pages: title, description, text, checksum, cleaned filing text and insider tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import scalars as S
from tidemark.functions.numeric import col, let
from tidemark.functions.textscan import squeeze, strip_tags, unescape


def page_text(html: Column | str) -> Column:
    """Visible text before entity decoding: no scripts, styles, comments or tags."""
    t = F.regexp_replace(F.coalesce(col(html), F.lit("")), r"(?is)<(script|style|noscript)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    return strip_tags(t)


def fragment(html: Column) -> Column:
    return squeeze(unescape(strip_tags(html)))


def page_title(html: Column | str) -> Column:
    return F.regexp_extract(F.coalesce(col(html), F.lit("")), r"(?is)<title[^>]*>(.*?)</title>", 1)


def page_description(html: Column | str) -> Column:
    h = F.coalesce(col(html), F.lit(""))
    name = r"(?:name|property)=[\"'](?:description|og:description)[\"']"
    content = r"content=[\"']([^\"']+)[\"']"
    first = F.regexp_extract(h, rf"(?is)<meta[^>]+{name}[^>]+{content}", 1)
    second = F.regexp_extract(h, rf"(?is)<meta[^>]+{content}[^>]+{name}", 1)
    return F.coalesce(F.nullif(first, F.lit("")), second)


#: Between the parts of a page that are decoded together; squeezed away with the white space around it.
BREAK = "\n\u0001\n"


def extract_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """Title, description, text and SHA-256 of the text for each page; the three are decoded in one go."""
    keep = [c for c in pages.columns if c != html]
    parts = [strip_tags(page_title(html)), strip_tags(page_description(html)), page_text(html)]
    whole = unescape(F.concat_ws(BREAK, *[F.translate(p, "\u0001", " ") for p in parts]))
    df = pages.select(*keep, F.split(whole, BREAK).alias("p"))
    df = df.select(*keep, *[squeeze(F.col("p")[i]).alias(n) for i, n in enumerate(("title", "description", "text"))])
    return df.withColumn("text_checksum", F.when(F.col("text") != "", F.sha2("text", 256)).otherwise(""))


def clean_filing_text(raw: Column | str) -> Column:
    """Entities decoded first, then scripts, styles and tags dropped and white space squeezed."""
    t = unescape(raw)
    t = F.regexp_replace(t, r"(?is)<script.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style.*?</style>", " ")
    return squeeze(strip_tags(t))


#: Cells of an insider row that are read.
CELLS = 12


def insider_transactions(pages: DataFrame, html: str = "html", ticker: str = "ticker", site: str = "") -> DataFrame:
    """Rows of insider-trade tables: at least 12 cells and the page's own symbol in the fourth.

    Rows and cells are cut and rows of other symbols dropped before they leave the page's row; a symbol with an entity is looked at
    once more when the cells of the kept rows have been decoded.
    """
    keep = [c for c in pages.columns if c != html]
    own = F.upper(F.trim(ticker))

    def cells_of(tr: Column) -> Column:
        return F.regexp_extract_all(tr, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), F.lit(1))

    def maybe(td: Column) -> Column:
        symbol = let(squeeze(strip_tags(F.get(td, 3))), lambda s: F.contains(s, F.lit("&")) | (F.upper(s) == own))
        return F.when(F.size(td) >= CELLS, symbol).otherwise(F.lit(False))

    found = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1)), lambda tr, i: F.struct(i.alias("row_no"), F.slice(cells_of(tr), 1, CELLS).alias("td")))
    # tags and white space of all cells are taken out in one pass each; neither reaches over the mark between two cells
    def bare(td: Column) -> Column:
        return F.regexp_replace(F.array_join(td, "\u0001"), "<[^>\u0001]+>", " ")

    kept = F.transform(F.filter(found, lambda r: maybe(r["td"])), lambda r: F.struct(r["row_no"], r["td"], bare(r["td"]).alias("__bare")))
    # what an outer explode gives is computed once; an inner one, or a plain column, would be repeated in every filter and field made of it
    rows = pages.select(*keep, F.explode_outer(kept).alias("r")).where(F.col("r").isNotNull()).select(*keep, "r.row_no", "r.td", unescape("r.__bare").alias("__text"))
    rows = rows.select(*keep, "row_no", "td", F.explode_outer(F.array(F.transform(F.split(squeeze("__text"), "\u0001"), lambda t: F.trim(t)))).alias("c"))

    def link(i: int, needle: str) -> Column:
        hrefs = F.regexp_extract_all(F.get(F.col("td"), i), F.lit(r"(?is)<a\b[^>]*href=[\"']([^\"']*)[\"']"), F.lit(1))
        return F.coalesce(F.get(F.filter(hrefs, lambda h: F.contains(F.lower(h), F.lit(needle))), 0), F.lit(""))

    def cell(i: int) -> Column:
        return F.get(F.col("c"), i)

    person = link(4, "/insider/")
    return rows.filter(F.upper(cell(3)) == own).select(
        *keep,
        "row_no",
        cell(0).alias("transaction_flags"),
        cell(1).alias("filing_datetime"),
        cell(2).alias("trade_date"),
        cell(4).alias("insider_name"),
        cell(5).alias("title"),
        cell(6).alias("trade_type"),
        F.regexp_extract(cell(6), r"^\s*([A-Z])\b", 1).alias("trade_code"),
        S.signed_number(cell(7)).alias("price"),
        S.signed_number(cell(8)).alias("quantity"),
        S.signed_number(cell(9)).alias("owned"),
        cell(10).alias("ownership_delta"),
        S.signed_number(cell(11)).alias("value"),
        link(1, "sec.gov").alias("sec_form4_url"),
        F.when(person.startswith("/"), F.concat(F.lit(site), person)).otherwise(person).alias("insider_url"),
    )
