"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps
from inspect import isgeneratorfunction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import drop_table, materialise, shared_dir

__all__ = ["byte_slices", "connect_groups", "drop_table", "free_names", "fresh_path", "join_components", "materialise", "mix64", "partitions_for", "ranged", "table", "text_arrays", "tidy", "write_bytes"]

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small driver-side file to the shared folder through Hadoop's file systems."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(conf).create(target, True)
    try:
        for i in range(0, len(data), 1 << 20):
            out.write(bytearray(data[i : i + (1 << 20)]))
    finally:
        out.close()


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(run: Callable) -> Callable:
    """A function over batches, or over one group's table, that gives its memory back at the end: Spark keeps Python workers from stage to stage."""
    if isgeneratorfunction(run):

        @wraps(run)
        def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            try:
                yield from run(batches)
            finally:
                _give_back()

    else:

        @wraps(run)
        def tidied(table: pa.Table) -> pa.Table:
            try:
                return run(table)
            finally:
                _give_back()

    return tidied


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, with underscores in front where the table has such a column (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64), element-wise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the byte offset of each row (nulls are empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def byte_slices(column: pa.Array, most_bytes: int, most_rows: int = 1 << 30) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of a string column with at most so many bytes and rows, one row at least."""
    ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(column), 0)).astype(np.int64))])
    a = 0
    while a < len(column):
        b = min(len(column), a + most_rows, max(a + 1, int(np.searchsorted(ends, ends[a] + most_bytes, "right")) - 1))
        yield a, b
        a = b


def partitions_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranged(df: DataFrame, key: str, buckets: int, error: float = 0.002) -> tuple[Column, list]:
    """Column that numbers ranges of a numeric key, ascending, and the bounds between them.

    The bounds are approximate quantiles of the key alone, so only that column is read; their
    number is the parameter, whatever the table's size. Null keys go to range 0.
    """
    bounds = sorted(set(df.approxQuantile(key, [i / buckets for i in range(1, buckets)], error))) if buckets > 1 else []
    edges = F.array(*[F.lit(float(b)) for b in bounds]) if bounds else None
    if edges is None:
        return F.lit(0), bounds
    number = F.size(F.filter(edges, lambda b: b < F.col(key).cast("double")))
    return F.coalesce(number, F.lit(0)), bounds


def join_components(ids: DataFrame, links: DataFrame, key: str, name: str) -> DataFrame:
    """``ids`` with ``component_id``: the smallest id that ``links`` (columns a, b) reach, itself if none.

    Large-star and small-star steps alternate on the edge table until the stars do not change,
    so rounds grow with the logarithm of the longest chain. Every round is one shuffle of the
    edges and is written to the shared folder, which cuts the lineage.
    """
    edges = materialise(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-edges"
    )
    seen = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(star, "u").select(F.greatest("v", "m").alias("a"), "m", "u")
        edges_next = (
            small.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
            .distinct()
        )
        edges = materialise(edges_next, f"{name}-edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    stars = edges.groupBy(F.col("u").alias(key)).agg(F.min("v").alias("component_id"))
    return ids.join(stars, key, "left").withColumn("component_id", F.coalesce("component_id", key))


#: Rounds with pivots, and components of a group that give one in a round.
PIVOT_ROUNDS, PIVOTS = 2, 8


def connect_groups(
    nodes: DataFrame,
    groups: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    name: str,
    rank: Callable[[str], Column] | None = None,
    possible: Callable[[str, str], Column] | None = None,
) -> DataFrame:
    """Links (a, b) that connect whatever the pairs inside the groups connect.

    ``nodes`` has ``k``, ``groups`` rows (h, k) and what else ``rank`` and ``possible`` need: every pair inside a
    group that is ``possible`` (a condition on two aliases of ``groups``) might link, and ``verify`` returns
    those of the pairs (a, b) that do.

    A group is not expanded into pairs. In each of ``PIVOT_ROUNDS`` rounds, the best members (lowest ``rank``
    of an alias, then smallest) of up to ``PIVOTS`` of its components are compared with the members outside their
    component. A group of alike members is one component after that and is done. In what is left, the members outside
    a group's largest component are compared with all members of other components. So every possible
    pair is compared or connected, at a cost of the groups' sizes plus the exceptions.
    """
    spark = nodes.sparkSession
    rank = rank or (lambda alias: F.lit(0.0))
    possible = possible or (lambda one, other: F.lit(True))
    component = nodes.select("k", F.col("k").alias("component"))
    found = spark.createDataFrame([], "a long, b long")

    def resolve(met: DataFrame) -> tuple[DataFrame, DataFrame]:
        pairs = materialise(met.select(F.least("x.k", "y.k").alias("a"), F.greatest("x.k", "y.k").alias("b")).distinct(), f"{name}-pairs")
        links = materialise(found.unionByName(verify(pairs)), f"{name}-links")
        return links, join_components(nodes, links, "k", name).withColumnRenamed("component_id", "component")

    for round_ in range(PIVOT_ROUNDS + 1):
        here = materialise(groups.join(component, "k"), f"{name}-groups")
        parts = here.alias("x").groupBy("h", "component").agg(F.min(F.struct(rank("x").alias("rank"), F.col("x.k").alias("k"))).alias("best"), F.count(F.lit(1)).alias("members"))
        several = parts.groupBy("h").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("members", "component")).alias("most")).where("parts > 1").select("h", F.col("most.component").alias("most"))
        several = materialise(several, f"{name}-open")
        if several.isEmpty():
            return found
        open_ = here.join(several, "h")
        if round_ < PIVOT_ROUNDS:
            order = F.row_number().over(W.partitionBy("h").orderBy("best"))
            chosen = parts.join(several.select("h"), "h").withColumn("r", order).where(F.col("r") <= PIVOTS).select("h", F.col("best.k").alias("k"))
            few = open_.join(chosen, ["h", "k"], "left_semi")
        else:
            few = open_.where("component <> most")
        met = few.alias("x").join(open_.alias("y"), (F.col("x.h") == F.col("y.h")) & (F.col("x.component") != F.col("y.component")) & possible("x", "y"))
        found, component = resolve(met)
        groups = open_.drop("component", "most")
    return found
