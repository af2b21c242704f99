"""Text helpers: entities, whitespace, tags and match offsets.

One small Arrow-batched Python helper covers what SQL functions cannot say, the full HTML
entity table. Match offsets come from the lengths of the texts between the matches.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import col, let


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    import html

    return texts.map(lambda t: None if t is None else html.unescape(t))


# not deterministic on paper: a filter on the result does not make the optimiser run it a second time
_unescape_once = _unescape.asNondeterministic()

# The entities that are replaced without the table, the ampersand last.
COMMON_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&"))
_RARE = "&(?!(?:" + "|".join(e[1:-1] for e, _ in COMMON_ENTITIES) + ");)"


def unescape(text: Column | str) -> Column:
    """HTML entities to characters; only texts with another than the four common entities travel to Python."""
    t = col(text)
    common = t
    for entity, character in COMMON_ENTITIES:
        common = F.replace(common, F.lit(entity), F.lit(character))
    rare = t.rlike(_RARE)
    return F.coalesce(_unescape_once(F.when(rare, t)), F.when(t.contains("&"), common).otherwise(t))


def squeeze(text: Column | str) -> Column:
    """Any run of white space becomes one blank; ends trimmed."""
    return F.trim(F.regexp_replace(col(text), r"(?U)\s+", " "))


def strip_tags(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"<[^>]+>", " ")


def _pattern(pattern: str) -> Column:
    return F.lit("(?iU)" + pattern)


def _gaps(text: Column, pattern: str) -> Column:
    """Lengths of the texts before, between and behind the matches of a pattern."""
    return F.transform(F.split(text, _pattern(pattern), -1), lambda part: F.length(part))


def fold_matches(text: Column, pattern: str, start: Column, step) -> Column:
    """Folds ``step(state, at, match, k)`` over the matches of a pattern (never empty ones), from left to right.

    ``at`` is a match's 0-based place and ``k`` its number; the place runs with the fold, so nothing but
    the matches, the gaps between them and the state is held. Case and Unicode are folded as in the term counts.
    """
    matches = F.regexp_extract_all(text, _pattern(f"({pattern})"), F.lit(1))

    def run(gaps: Column) -> Column:
        def one(acc: Column, m: Column, k: Column) -> Column:
            at = acc["at"] + F.get(gaps, k)
            return F.struct((at + F.length(m)).alias("at"), (k + 1).alias("k"), step(acc["state"], at, m, k).alias("state"))

        zero = F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), start.alias("state"))
        return F.aggregate(matches, zero, lambda acc, m: one(acc, m, acc["k"]))["state"]

    return let(_gaps(text, pattern), run)


def match_spans(text: Column | str, patterns: Sequence[str]) -> Column:
    """All matches of each pattern in turn: pattern number, 0-based start and end, and the first two groups (blank: null)."""
    t = col(text)
    none = F.array().cast("array<struct<pattern:int,start:int,end:int,first:string,second:string>>")

    def of(number: int, pattern: str) -> Column:
        def group(i: int) -> Column:
            return F.regexp_extract_all(t, _pattern(pattern), F.lit(i)) if re.compile(pattern).groups >= i else F.array().cast("array<string>")

        def spans(both: Column) -> Column:
            def step(acc: Column, at: Column, m: Column, k: Column) -> Column:
                here = F.struct(
                    F.lit(number).alias("pattern"), at.alias("start"), (at + F.length(m)).alias("end"), F.get(both["one"], k).alias("first"), F.nullif(F.get(both["two"], k), F.lit("")).alias("second")
                )
                return F.concat(acc, F.array(here))

            return fold_matches(t, pattern, none, step)

        return let(F.struct(group(1).alias("one"), group(2).alias("two")), spans)

    return F.coalesce(F.concat(*[of(k, p) for k, p in enumerate(patterns)]), none)


def around(text: Column, start: Column, end: Column, radius: int) -> Column:
    """Text from ``radius`` before ``start`` to ``radius`` after ``end``, trimmed."""
    a = F.greatest(F.lit(0), start - radius)
    return F.trim(F.substring(text, a + 1, end + radius - a))


def java_quote(text: str) -> str:
    """Regular expression that matches ``text`` literally, any white space for a blank."""
    quoted = "".join(c if c.isalnum() else "\\" + c for c in text if c != " ") if " " not in text else None
    if quoted is not None:
        return quoted
    return r"\s+".join(java_quote(p) for p in text.split(" "))


def term_pattern(term: str) -> str:
    return r"\bRPOs?\b" if term.upper() == "RPO" else java_quote(term)
