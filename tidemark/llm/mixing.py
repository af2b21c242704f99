"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. With weight ``w`` the ``k``-th block of a source is
released at slot ``floor((k - 1) / w)`` and due at ``ceil(k / w)``; the earliest deadline among
the released blocks takes the slot. While all sources last, each has at any time received its
share to within less than one block. ``exact_slots`` does so with the weights as they are, block by block in one task; a
document finds its slot by its rank in its source.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping, Sequence
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import free_names, materialise

#: Documents of a block, and rows ranked in one task.
BLOCK_ROWS, RANKED_ROWS = 64, 2_000
#: More sources than this are refused: the task that makes the schedule holds a block of each.
MAX_SOURCES = 50_000


def exact_slots(weights: Sequence[float], blocks: Sequence[int]) -> Iterator[tuple[int, int]]:
    """Source and block number of every slot, earliest deadline first among the released, until all blocks are placed.

    Weights are taken as the rational numbers that the floats are, so nothing drifts. A slot for which no block is
    released, as happens after a source has ended, is left out. Sources that weigh nothing take turns after the others.
    """
    ratios = [Fraction(max(0.0, w)) for w in weights]
    if not any(ratios):
        ratios = [Fraction(1)] * len(ratios)
    base = lcm(*[r.denominator for r in ratios]) if ratios else 1
    parts = [int(r * base) for r in ratios]
    total = sum(parts)
    waiting = [(0, i, 0) for i in range(len(parts)) if parts[i] and blocks[i]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, int, int]] = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(k + 1) * total // parts[i]), i, k))
        _, i, k = heapq.heappop(ready)
        yield i, k
        slot += 1
        if k + 1 < blocks[i]:
            heapq.heappush(waiting, ((k + 1) * total // parts[i], i, k + 1))
    last = [i for i in range(len(parts)) if not parts[i]]
    if last:
        yield from ((last[i], k) for i, k in exact_slots([1.0] * len(last), [blocks[i] for i in last]))


def mix(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    power: float = 0.5,
    source: str = "source",
    key: str = "doc_id",
    block_rows: int = BLOCK_ROWS,
    seed: int = 17,
    names: tuple[str, str] = ("mix_slot", "mix_place"),
) -> DataFrame:
    """``docs`` with ``mix_slot`` and ``mix_place`` (or other ``names``): sorted by both, the documents are mixed to the weights.

    ``weights`` maps sources to target weights; sources it leaves out weigh nothing. By default a source weighs its
    number of documents to the ``power``. Weights are not rounded: while all sources last, each is within one block of its
    share. Slots are numbered without holes, and sources that weigh nothing follow when the others have ended. No document is
    dropped or repeated: when a source ends, the others go on in proportion. A
    null source is a source. Inside a source the order is a hash of the key (ties: the key, then
    the whole row's hash); repeated rows each take a place. Columns of the two names are replaced, all others are kept whatever
    their names; an empty table stays empty.

    Ranks inside a source are taken in hash buckets of about ``RANKED_ROWS`` rows, so a source
    that holds a third of all rows is ranked by as many tasks as it needs.
    """
    spark = docs.sparkSession
    kept = docs.drop(*names)
    counted = kept.groupBy(F.col(source).alias("s")).count().limit(MAX_SOURCES + 1).collect()
    if len(counted) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    sizes = {r[0]: r[1] for r in counted}
    if not sizes:
        return kept.withColumn(names[0], F.lit(0).cast("long")).withColumn(names[1], F.lit(0).cast("long"))
    target = {s: float(weights.get(s, 0.0)) if weights is not None else float(n) ** power for s, n in sizes.items()}
    ordered = sorted(sizes, key=lambda s: (s is not None, s or ""))
    own = hashed, place, number, bucket, buckets, first, count, slots, local = free_names(kept, "h", "src", "id", "b", "buckets", "first", "n", "slots", "local")
    # one row a source; sources go by number, so a null one needs no care below
    plan = spark.createDataFrame([(s, i, max(1, -(-sizes[s] // RANKED_ROWS))) for i, s in enumerate(ordered)], f"{place} string, {number} int, {buckets} int")
    rows = kept.withColumn(hashed, F.xxhash64(F.lit(seed), F.col(key)))
    rows = rows.join(F.broadcast(plan), F.col(source).cast("string").eqNullSafe(F.col(place))).withColumn(bucket, F.pmod(hashed, F.col(buckets).cast("long")))
    before = rows.groupBy(number, bucket).agg(F.count(F.lit(1)).alias(count))
    before = before.withColumn(first, F.coalesce(F.sum(count).over(W.partitionBy(number).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    blocks = [-(-sizes[s] // block_rows) for s in ordered]
    before = _with_slots(before, _all_slots(spark, [target[s] for s in ordered], blocks), block_rows, own)
    order = F.row_number().over(W.partitionBy(number, bucket).orderBy(hashed, key, F.xxhash64(*kept.columns)))
    ranked = rows.withColumn(local, order).join(before, [number, bucket])
    rank = F.col(first) + F.col(local) - 1
    slot = F.element_at(slots, (F.floor(rank / block_rows) - F.floor(F.col(first) / block_rows) + 1).cast("int"))
    return ranked.select(*[F.col(c) for c in kept.columns], slot.cast("long").alias(names[0]), (rank % block_rows).cast("long").alias(names[1]))


def _all_slots(spark: SparkSession, weights: list[float], blocks: list[int]) -> DataFrame:
    """``exact_slots`` as rows (id, k, slot); made and written by one task, which holds a block a source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            found = enumerate(exact_slots(weights, blocks))
            while some := list(islice(found, 50_000)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for _, (i, _) in some], pa.int32()), pa.array([k for _, (_, k) in some], pa.int64()), pa.array([t for t, _ in some], pa.int64())], names=["id", "k", "slot"]
                )

    return materialise(spark.range(0, 1, 1, 1).mapInArrow(run, "id int, k long, slot long"), "mix-slots")


def _with_slots(before: DataFrame, made: DataFrame, block_rows: int, own: list[str]) -> DataFrame:
    """Of every hash bucket: its first rank, and the slots of the blocks that its rows lie in."""
    _, _, number, bucket, _, first, count, slots, _ = own
    ks = F.sequence(F.floor(F.col(first) / block_rows), F.floor((F.col(first) + F.col(count) - 1) / block_rows))
    plain = before.select(F.col(number).alias("id"), F.col(bucket).alias("b"), F.col(first).alias("first"), F.explode(ks).alias("k"))
    listed = F.sort_array(F.collect_list(F.struct("k", "slot")))
    met = plain.join(made, ["id", "k"]).groupBy("id", "b", "first").agg(F.transform(listed, lambda x: x["slot"]).alias("slots"))
    return met.select(F.col("id").alias(number), F.col("b").alias(bucket), F.col("first").alias(first), F.col("slots").alias(slots))
