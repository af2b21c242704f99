"""Chat formatting: event logs folded into final messages, then rendered with a loss mask.

A conversation is a log of events ``(conv_id, seq, kind, msg, role, text)``:

* ``open`` starts message ``msg`` with a role and a first text;
* ``delta`` appends a streamed text;
* ``edit`` replaces what the message holds;
* ``regenerate`` empties the message and drops every later message opened before it.

The fold is relational (the last reset of a message, the last truncation before it, then the
texts after both in order), so no state array is copied from event to event, and everything is
built-in SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"

#: Characters that start a control string, with their escapes. ``%`` comes first when escaping
#: and last when reading back, so any text survives the round trip.
ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"))


def escape(text: Column) -> Column:
    """No escaped text holds ``<`` or ``[``, so it cannot hold a turn mark or a foreign control string."""
    for plain, coded in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return text


def unescape(text: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        text = F.replace(text, F.lit(coded), F.lit(plain))
    return text


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("%0A"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("%0A"), F.lit("\n")))


def events_of_turns(turns: DataFrame, chunk: int = 512) -> DataFrame:
    """The event log of finished turns ``(conv_id, turn, role, text)``: an ``open``, then deltas of ``chunk`` code points.

    Order is by turn, then role, then text (nulls first); repeated rows are separate messages.
    A null text or role counts as empty. Extra columns are ignored.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("msg", F.row_number().over(order).cast("long"))
    pieces = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)), F.lit(chunk)),
        lambda i: F.substring(F.col("text"), i, F.lit(chunk)),
    )
    first = F.struct(F.lit("open").alias("kind"), F.col("role").alias("role"), F.lit("").alias("text"))
    rest = F.transform(pieces, lambda p: F.struct(F.lit("delta").alias("kind"), F.lit("").alias("role"), p.alias("text")))
    log = rows.select("conv_id", "msg", F.posexplode(F.concat(F.array(first), rest)).alias("part", "event"))
    # parts are numbered inside their message; 2^32 of them are more than a text can have
    return log.select("conv_id", (F.col("msg") * (1 << 32) + F.col("part")).alias("seq"), F.col("event.kind").alias("kind"), "msg", F.col("event.role").alias("role"), F.col("event.text").alias("text"))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, msg, role, text)`` of event logs.

    Events apply in order of ``seq`` (ties: kind, then text). Null texts are empty; an event with
    a null ``msg`` or ``seq`` or an unknown kind changes nothing. A message exists when an ``open`` survives;
    the last surviving one names the role. An empty log gives no rows.
    """
    e = events.where("msg IS NOT NULL AND seq IS NOT NULL AND kind IN ('open', 'delta', 'edit', 'regenerate')").select(
        "conv_id", "seq", "kind", "msg", "role", F.coalesce("text", F.lit("")).alias("text")
    )
    own = W.partitionBy("conv_id", "msg")
    before = W.partitionBy("conv_id").orderBy("msg").rangeBetween(W.unboundedPreceding, -1)
    regenerated = F.when(F.col("kind") == "regenerate", F.col("seq"))
    e = e.withColumn("cut", F.max(regenerated).over(before))
    e = e.where("cut IS NULL OR seq > cut")
    e = e.withColumn("reset", F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("seq"))).over(own))
    piece = F.when(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")), F.struct("seq", "kind", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text")))
    folded = e.groupBy("conv_id", "msg").agg(
        F.max(F.when(F.col("kind") == "open", F.struct("seq", "role"))).alias("opened"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "").alias("text"),
    )
    return folded.where("opened IS NOT NULL").select("conv_id", "msg", F.coalesce("opened.role", F.lit("")).alias("role"), "text")


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted`` and its ``segments`` (text, loss).

    ``formatted`` is the segments' texts joined. A message of role ``learn`` has its escaped text
    in a segment of its own with loss, everything else is without. A conversation is the record
    that is written, so its messages meet in one row.
    """
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    learnt = F.array(
        F.struct(head.alias("text"), F.lit(False).alias("loss")), F.struct(body.alias("text"), F.lit(True).alias("loss")), F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss"))
    )
    plain = F.array(F.struct(F.concat(head, body, F.lit(CLOSE)).alias("text"), F.lit(False).alias("loss")))
    rows = messages.select("conv_id", F.struct("msg", F.when(F.col("role") == learn, learnt).otherwise(plain).alias("parts")).alias("turn"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    segments = grouped.select("conv_id", F.flatten(F.transform("turns", lambda t: t["parts"])).alias("segments"))
    return segments.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(rendered: DataFrame) -> DataFrame:
    """``turns`` (role, text) parsed from ``formatted`` and ``loss_text``, the unescaped text under the mask."""
    raw = F.filter(F.split("formatted", r"<\|im_end\|>\n"), lambda x: x != "")
    turns = F.transform(
        raw,
        lambda x: F.struct(
            _unescape_role(F.substring_index(F.replace(x, F.lit(OPEN), F.lit("")), "\n", 1)).alias("role"),
            unescape(F.regexp_replace(x, r"^[^\n]*\n", "")).alias("text"),
        ),
    )
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return rendered.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))
