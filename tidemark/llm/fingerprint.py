"""Document fingerprints: randomised edit embedding, consistent bit sampling, banding, verification.

A text is embedded by a random walk over its code points (Chakraborty, Goldenberg and Koucky):
at every step a random function of the current code point's class decides whether the walk moves
on, so a code point is repeated a random number of times, and two texts that differ by few edits
fall into step again after each edit. Edit distance becomes Hamming distance of the embeddings.
The random functions repeat after ``PERIOD`` steps and are the same for every text.

The fingerprint keeps a nested sample of embedding positions: level 0 keeps all, level ``l`` one
of every ``2**l``, and each level is a subset of the one before. A text takes the lowest level
with at most ``2 * LEAST`` samples, so fingerprints of texts of any two lengths can be compared
on the samples of the coarser level. A sample is one hex digit, a hash of the code point there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import connect_groups, join_components, materialise, mix64, partitions_for, ranged

PERIOD, CLASSES, LEAST = 4096, 256, 256
#: Code points walked together; bounds the memory of a task, not the length of a text.
CHUNK = 6_000_000
#: Chance that two unrelated code points give the same digit, taken off the likeness.
CHANCE = 0.13

_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def _class_of(points: np.ndarray) -> np.ndarray:
    return (mix64(points.astype(np.uint64) + np.uint64(0x51ED)) >> np.uint64(56)).astype(np.uint8)


def _digit_of(points: np.ndarray) -> np.ndarray:
    return (mix64(points.astype(np.uint64) + np.uint64(0xA11CE)) >> np.uint64(60)).astype(np.uint8)


def _stays() -> np.ndarray:
    """[class, step in period] -> steps until the walk has left a code point that it reaches at this step."""
    grid = np.arange(CLASSES, dtype=np.uint64)[:, None] * np.uint64(PERIOD) + np.arange(PERIOD, dtype=np.uint64)
    moves = (mix64(grid + np.uint64(0xC6C)) & np.uint64(1)).astype(bool)
    moves[:, -1] |= ~moves.any(1)
    stay = np.zeros((CLASSES, PERIOD), np.int64)
    ahead = np.zeros(CLASSES, np.int64)
    for step in range(2 * PERIOD - 1, -1, -1):
        ahead = np.where(moves[:, step % PERIOD], 1, ahead + 1)
        stay[:, step % PERIOD] = ahead
    return stay.astype(np.int32)


_STAY = _stays().ravel()


def _pick(level: int, blocks: np.ndarray) -> np.ndarray:
    """Embedding position that each block of ``level`` keeps; nested over the levels."""
    at = blocks.astype(np.int64)
    for lower in range(level, 0, -1):
        bit = mix64(at.astype(np.uint64) + np.uint64(lower << 48)) & np.uint64(1)
        at = 2 * at + bit.astype(np.int64)
    return at


def _level(length: int) -> int:
    return max(0, int(length).bit_length() - LEAST.bit_length())


def _digits(steps: np.ndarray, points: np.ndarray, end: int) -> str:
    """Fingerprint of one text: ``steps`` at which the walk reaches each code point, ``end`` of the walk."""
    level = _level(end)
    at = _pick(level, np.arange(end >> level if end >> level else 0))
    where = np.searchsorted(steps, at, "right") - 1
    return f"{level:02x}:" + _HEX[_digit_of(points[where])].tobytes().decode()


def _walk(texts: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Walk all texts in step with each other from the given steps.

    Texts must come longest first. Returns the steps of all code points (the i-th of all texts
    next to each other), where the i-th ones begin, and the end of each walk.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    longest = int(sizes[0]) if len(sizes) else 0
    active = np.searchsorted(-sizes, -np.arange(longest), "left")  # texts with more than i code points
    begins = np.concatenate([[0], np.cumsum(active)])
    classes = np.empty(int(begins[-1]), np.int32)
    for r, t in enumerate(texts):
        classes[begins[: len(t)] + r] = _class_of(t).astype(np.int32) * PERIOD
    steps = np.empty(len(classes), np.int32)
    now = start.astype(np.int32).copy()
    mask = np.int32(PERIOD - 1)
    for i in range(longest):
        a, b = begins[i], begins[i + 1]
        here = now[: b - a]
        steps[a:b] = here
        here += _STAY[classes[a:b] + (here & mask)]
    return steps, begins, now, sizes


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprints(texts: list[str], edited: list[str] | None = None, shared: list[int] | None = None) -> tuple[list[str], list[str]]:
    """Fingerprints of texts, and of edited forms that agree with them in their first ``shared`` code points.

    The walk of an edited text is carried on from its last shared code point.
    """
    out, out_edited = [""] * len(texts), [""] * len(texts)
    points = [_points(t) for t in texts]
    order = sorted(range(len(texts)), key=lambda i: -len(points[i]))
    steps, begins, ends, _ = _walk([points[i] for i in order], np.zeros(len(order)))
    own: dict[int, np.ndarray] = {}
    for r, i in enumerate(order):
        own[i] = steps[begins[: len(points[i])] + r]
        out[i] = _digits(own[i], points[i], int(ends[r]))
    if edited is None:
        return out, out_edited
    tails, first = {}, {}
    ending = {i: int(ends[r]) for r, i in enumerate(order)}
    for i, text in enumerate(edited):
        tails[i] = _points(text)[shared[i] :]
        first[i] = int(own[i][shared[i]]) if shared[i] < len(own[i]) else ending[i]
    order = sorted(tails, key=lambda i: -len(tails[i]))
    steps, begins, ends, _ = _walk([tails[i] for i in order], np.array([first[i] for i in order]))
    for r, i in enumerate(order):
        whole = np.concatenate([own[i][: shared[i]], steps[begins[: len(tails[i])] + r]])
        out_edited[i] = _digits(whole, np.concatenate([points[i][: shared[i]], tails[i]]), int(ends[r]))
    return out, out_edited


def likeness(one: str, other: str) -> float:
    """Share of equal samples of the coarser level, chance taken off: 1 for equal fingerprints, about 0 for strangers."""
    if one == other:
        return 1.0
    la, lb = int(one[:2], 16), int(other[:2], 16)
    a, b = np.frombuffer(one[3:].encode(), np.uint8), np.frombuffer(other[3:].encode(), np.uint8)
    level = max(la, lb)
    if la < level:
        a = _coarser(a, la, level)
    if lb < level:
        b = _coarser(b, lb, level)
    n = min(len(a), len(b))
    most = max(len(a), len(b))
    agree = float((a[:n] == b[:n]).sum()) / most if most else 1.0
    return max(0.0, min(1.0, (agree - CHANCE) / (1 - CHANCE)))


def _coarser(digits: np.ndarray, level: int, wanted: int) -> np.ndarray:
    at = np.arange(len(digits) >> (wanted - level), dtype=np.int64)
    for lower in range(wanted, level, -1):
        bit = mix64(at.astype(np.uint64) + np.uint64(lower << 48)) & np.uint64(1)
        at = 2 * at + bit.astype(np.int64)
    return digits[at]


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > CHUNK:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def add_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every whole text (null: of the empty text). No shuffle.

    An empty text has the fingerprint ``00:``. Repeated rows get the same fingerprint, a column that has the name already is replaced,
    an empty table stays empty.
    """
    kept = docs.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            found: list[str] = []
            for a, b in _chunks([len(t) for t in texts]):
                found += fingerprints(texts[a:b])[0]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema)


def successor_prints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document, its edited text and its successor in descending order of ``key``, fingerprinted.

    The edited text has its last third (rounded down, in code points) replaced by the first as many
    code points of the successor, or by all of it; the last document's successor is the first one. A null
    text is empty, a null key comes last, rows with equal keys follow in order of a hash of the
    text, then of the text; a lone document is its own successor. Extra columns are left out, an empty table stays
    empty. Columns: the key, ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``,
    ``near_edited``, ``near_next``.

    Texts are shuffled once, into ranges of the key sorted inside; each range also gets the rows
    that come first in the range after it, so no pair of neighbours is cut. The ranges' bounds and first keys, a number
    set by the shuffle partitions, are all that reaches the driver.
    """
    spark = docs.sparkSession
    n = partitions_for(spark)
    order_key = F.coalesce(F.col(key), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select(F.col(key).cast("long").alias(key), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("k", order_key)
    bucket, _ = ranged(rows.select("k"), "k", 4 * n, 0.1 / n)
    rows = rows.withColumn("bucket", bucket)
    heads = sorted(((r[0], r[1]) for r in rows.groupBy("bucket").agg(F.max("k")).collect()), reverse=True)
    serves = {heads[(i + 1) % len(heads)][1]: heads[i][0] for i in range(len(heads))}
    lend = F.lit(None).cast("int")
    if serves:
        lend = F.element_at(F.map_from_arrays(F.array(*[F.lit(h) for h in serves]), F.array(*[F.lit(b) for b in serves.values()])), F.col("k"))
    targets = F.filter(F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("lent")), F.struct(lend.alias("b"), F.lit(1).alias("lent"))), lambda t: t["b"].isNotNull())
    placed = rows.select(key, "text", "k", F.explode(targets).alias("at")).select(key, "text", "k", "at.b", "at.lent")
    placed = placed.repartition(n, "b").sortWithinPartitions("b", "lent", F.desc("k"), F.xxhash64("text"), "text").select("b", "lent", key, "text")
    schema = T.StructType(
        [T.StructField(key, T.LongType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
        + [T.StructField(c, T.DoubleType()) for c in ("near_edited", "near_next")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                size += len(row[3])
                if size > CHUNK:
                    yield _neighbours(held, schema)
                    held, size = held[-1:], len(row[3])
        if held:
            yield _neighbours(held, schema)

    return placed.mapInArrow(run, schema)


def _neighbours(rows: list[tuple], schema: T.StructType) -> pa.RecordBatch:
    """Result rows of all but the last of consecutive rows ``(range, lent, key, text)``; lent rows only follow others."""
    own = [i for i in range(len(rows) - 1) if not rows[i][1]]
    texts = [r[3] for r in rows]
    edited, shared = [], []
    for i in range(len(rows)):
        t = texts[i]
        keep = len(t) - len(t) // 3
        follow = texts[i + 1][: len(t) // 3] if i + 1 < len(rows) and not rows[i][1] else t[keep:]
        edited.append(t[:keep] + follow)
        shared.append(keep)
    prints, edited_prints = fingerprints(texts, edited, shared)
    columns = [
        pa.array([rows[i][2] for i in own], pa.int64()),
        pa.array([len(texts[i]) for i in own], pa.int64()),
        pa.array([hashlib.sha256(edited[i].encode()).hexdigest() for i in own], pa.string()),
        pa.array([prints[i] for i in own], pa.string()),
        pa.array([edited_prints[i] for i in own], pa.string()),
        pa.array([likeness(prints[i], edited_prints[i]) for i in own], pa.float64()),
        pa.array([likeness(prints[i], prints[i + 1]) for i in own], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=schema.names)


#: Samples hashed together in a band, and bands of a level.
BAND, BANDS = 12, 24


def _band_keys(print_: str) -> list[int]:
    """Keys of the bands at the text's own level and the next coarser one, as a near text may be just across.

    A band's samples lie among the first ``LEAST / 2`` of the level, which every longer text of both levels has; a text
    with fewer samples has one band, all of them.
    """
    level, digits = int(print_[:2], 16), np.frombuffer(print_[3:].encode(), np.uint8)
    keys = []
    for wanted in (level, level + 1):
        own = digits if wanted == level else _coarser(digits, level, wanted)
        span = LEAST // 2
        for band in range(BANDS if len(own) >= span else 1):
            draw = mix64(np.arange(BAND, dtype=np.uint64) + np.uint64(band * BAND + (wanted << 32))) % np.uint64(span)
            some = own[draw.astype(np.int64)] if len(own) >= span else own
            key = mix64(some.astype(np.uint64) + mix64(np.arange(len(some), dtype=np.uint64))).sum(dtype=np.uint64) + np.uint64(wanted * BANDS + band)
            keys.append(int(mix64(np.array([key]))[0].astype(np.int64)))
    return keys


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = 0.6) -> DataFrame:
    """Per document: the key, ``fingerprint`` and ``component_id``, the smallest key reachable by near fingerprints.

    Two documents are near when they share a band of samples and their fingerprints are at least ``least`` alike; equal
    fingerprints are one class. Groups of a band are resolved by ``connect_groups``, so no group is
    expanded into pairs and none is cut off. Empty texts are near nothing. A null key has no
    component; repeated rows keep a row each; an empty table stays empty.
    """
    prints = materialise(add_fingerprint(docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")), "t").drop("t"), "prints")
    usable = prints.where("k IS NOT NULL AND fingerprint <> '00:'")
    classes = materialise(usable.groupBy("fingerprint").agg(F.min("k").alias("c")), "print-classes")

    @F.pandas_udf("array<bigint>")
    def bands(column):
        return column.map(_band_keys)

    @F.pandas_udf("double")
    def alike(a, b):
        return a.combine(b, likeness)

    # a key with several texts leads several classes, so classes are numbered by their print
    numbered = classes.select(F.xxhash64("fingerprint").alias("k"), "fingerprint", "c")
    groups = materialise(numbered.select("k", F.explode(bands("fingerprint")).alias("h")).distinct(), "bands")

    def verify(pairs: DataFrame) -> DataFrame:
        of = lambda side, name: numbered.select(F.col("k").alias(side), F.col("fingerprint").alias(name))
        return pairs.join(of("a", "fa"), "a").join(of("b", "fb"), "b").where(alike("fa", "fb") >= least).select("a", "b")

    links = connect_groups(numbered.select("k"), groups, verify, "prints")
    leader = join_components(numbered.select("k"), links, "k", "prints").withColumnRenamed("component_id", "leader").join(numbered, "k")
    first = leader.groupBy("leader").agg(F.min("c").alias("first"))
    keyed = usable.join(leader.join(first, "leader").select("fingerprint", "first"), "fingerprint").select(F.col("k").alias("a"), F.col("first").alias("b"))
    return join_components(prints, keyed.distinct(), "k", "print-keys").select(F.col("k").alias(key), "fingerprint", "component_id")
