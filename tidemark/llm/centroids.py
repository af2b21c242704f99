"""Centroid clustering on integer vectors with an incremental distance matrix.

Every vector keeps the exact dot products with all centroids in a written table. When a round has moved the
centroids, a vector's row changes only by ``component * change`` over the components that a centroid really changed;
the nearest centroid follows from ``|centroid|^2 - 2 dot``. Cluster sums are kept the same way: only
vectors that moved to another cluster are added and taken away. A round is one pass over the table without a shuffle.

All arithmetic is exact. Products run in doubles while every partial sum stays under 2^53, in 64-bit integers under 2^62,
and in Python's integers beyond.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_table, materialise

#: Components of a vector, factor before the floor, centroids, rounds.
DIM, SCALE, CENTROIDS, ROUNDS = 64, 256, 40, 5
#: Vectors that are worked on together.
CHUNK = 4096

_STATE = "k long, vec binary, wide array<string>, dots array<long>, before int, cluster int"
_STATE_ARROW = pa.schema(
    [("k", pa.int64()), ("vec", pa.binary()), ("wide", pa.list_(pa.string())), ("dots", pa.list_(pa.int64())), ("before", pa.int32()), ("cluster", pa.int32())]
)


def doubles(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that hold ``dim`` finite components, and their values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    right = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False))
    at = np.flatnonzero(right)
    flat = column.take(pa.array(at)).flatten().cast(pa.float64())
    values = np.asarray(pc.fill_null(flat, float("nan"))).reshape(len(at), dim)
    fine = np.isfinite(values).all(axis=1)
    return at[fine], values[fine]


def scaled(x: float, scale: int) -> int:
    """``floor(scale * x)``; a finite number whose product leaves the range of doubles is an integer itself."""
    y = scale * x
    return int(np.floor(y)) if np.isfinite(y) else int(x) * scale


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact matrix product of integer arrays (64-bit or objects)."""
    if a.dtype != object and b.dtype != object and a.size and b.size:
        bound = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
        if bound < 1 << 53:
            return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
        if bound < 1 << 62:
            return a @ b
    elif not (a.size and b.size):
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    return a.astype(object) @ b.astype(object)


def _array(rows: list[list[int]], dim: int) -> np.ndarray:
    """64-bit integers if squares of differences certainly fit, Python's integers otherwise."""
    if not rows:
        return np.zeros((0, dim), np.int64)
    out = np.array(rows, object).reshape(len(rows), dim)
    return out.astype(np.int64) if max(map(abs, out.ravel().tolist()), default=0) < 1 << 27 else out


def _vectors(vec: pa.Array, wide: pa.Array, dim: int) -> np.ndarray:
    """Rows of a batch; a vector with a component beyond 32 bits is stored as decimal text."""
    if vec.null_count == 0:
        return np.frombuffer(b"".join(vec.to_pylist()), "<i4").reshape(len(vec), dim).astype(np.int64)
    rows = [list(map(int, w)) if v is None else np.frombuffer(v, "<i4").tolist() for v, w in zip(vec.to_pylist(), wide.to_pylist())]
    return _array(rows, dim)


def nearest(dots: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Number of the centroid with the smallest squared distance (ties: smaller number)."""
    return np.argmin(norms[None, :] - 2 * dots, axis=1).astype(np.int32)


def changes(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Components that any centroid changed, and the changes in them (components x centroids)."""
    delta = new - old
    moved = np.flatnonzero((delta != 0).any(axis=0))
    return moved, delta[:, moved].T


def _norms(centroids: np.ndarray) -> np.ndarray:
    return np.array([sum(x * x for x in map(int, c)) for c in centroids], object if centroids.dtype == object else np.int64)


def _fits(values: np.ndarray) -> np.ndarray:
    return np.array([-(1 << 62) < int(x) < 1 << 62 for x in values.ravel()]).reshape(values.shape) if values.dtype == object else np.ones(values.shape, bool)


def _advance(old: np.ndarray | None, new: np.ndarray, dim: int):
    """Brings dot products from the ``old`` centroids to the ``new`` (all anew without ``old``) and assigns every vector."""
    norms = _norms(new)
    moved, delta = changes(old, new) if old is not None else (np.arange(dim), new.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(first, CHUNK)
                vectors = _vectors(batch.column(1), batch.column(2), dim)
                kept = batch.column(3)
                if old is None:
                    dots = product(vectors, new.T)
                elif kept.null_count:  # products beyond 64 bits are not stored
                    dots = product(vectors, new.T)
                else:
                    stored = np.asarray(kept.flatten()).reshape(batch.num_rows, len(new))
                    dots = stored + product(vectors[:, moved], delta) if len(moved) else stored
                cluster = nearest(dots, norms)
                whole_rows = _fits(dots).all(axis=1)
                held = pa.array([d.tolist() if ok else None for d, ok in zip(dots, whole_rows)], pa.list_(pa.int64())) if not whole_rows.all() else pa.ListArray.from_arrays(
                    pa.array(np.arange(len(dots) + 1) * len(new), pa.int32()), pa.array(dots.astype(np.int64).ravel())
                )
                before = batch.column(5)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), held, before, pa.array(cluster)], schema=_STATE_ARROW)

    return run


def _moves(dim: int):
    """Per task and cluster: change of the vectors' number and sum (decimal text) by those that came and went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[int, int] = {}
        total: dict[int, list[int]] = {}
        for batch in batches:
            vectors = _vectors(batch.column(0), batch.column(1), dim)
            for side, sign in ((batch.column(3), 1), (batch.column(2), -1)):
                number = np.array([-1 if c is None else c for c in side.to_pylist()])
                for c in np.unique(number[number >= 0]).tolist():
                    own = vectors[number == c]
                    count[c] = count.get(c, 0) + sign * len(own)
                    total[c] = [t + sign * int(s) for t, s in zip(total.get(c, [0] * dim), own.sum(axis=0))]
        keys = sorted(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int32()), pa.array([count[c] for c in keys], pa.int64()), pa.array([[str(x) for x in total[c]] for c in keys], pa.list_(pa.string()))], names=["cluster", "n", "total"]
        )

    return run


def _fold(table: pa.Table) -> pa.Table:
    """Sum of the tasks' changes of one cluster; there is one row a task."""
    total = [0] * len(table.column("total")[0])
    for row in table.column("total").to_pylist():
        total = [a + int(b) for a, b in zip(total, row)]
    return pa.table({"cluster": table.column("cluster").slice(0, 1), "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()), "total": pa.array([[str(x) for x in total]], pa.list_(pa.string()))})


def cluster(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", dim: int = DIM, scale: int = SCALE, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: str = "2"
) -> DataFrame:
    """Per kept vector: the key, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid_sha256``.

    Kept are the vectors with exactly ``dim`` components, none null or non-finite; each component ``x`` becomes the integer
    ``floor(scale * x)``. The first centroids are the vectors with the smallest sha256 of ``seed:key``, in that order (ties: the
    vector itself; a null key counts as empty text); with fewer vectors there are fewer centroids. In each of ``rounds`` rounds
    every vector goes to the nearest centroid by squared distance (ties: smaller number), then every centroid with vectors becomes
    their floored mean; at last all are assigned once more. ``distance`` is the squared distance to the own
    centroid, ``cluster_inertia`` and ``inertia`` its sums over the cluster and over all; each is null where it does not
    fit a long. Repeated rows each count and are returned; null keys stay null; extra columns are left out, so
    their names cannot clash; an empty table, or one without a vector to keep, gives no rows.

    What reaches the driver is the first centroids and one sum a cluster and round.
    """
    spark = vectors.sparkSession

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(first, CHUNK)
                at, values = doubles(batch.column(1), dim)
                with np.errstate(over="ignore"):
                    whole_numbers = np.floor(values * scale)
                small = (np.abs(whole_numbers) < 1 << 27).all(axis=1)
                narrow = np.where(small[:, None], whole_numbers, 0).astype("<i4")
                vec = [v.tobytes() if s else None for v, s in zip(narrow, small)]
                wide = [None if s else [str(scaled(float(x), scale)) for x in v] for v, s in zip(values, small)]
                none = [None] * len(at)
                yield pa.RecordBatch.from_arrays(
                    [a.cast(f.type) for a, f in zip([batch.column(0).take(pa.array(at)), pa.array(vec, pa.binary()), pa.array(wide, pa.list_(pa.string())), pa.array(none, pa.list_(pa.int64())), pa.array(none, pa.int32()), pa.array(none, pa.int32())], _STATE_ARROW)],
                    schema=_STATE_ARROW,
                )

    state = materialise(vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).mapInArrow(integers, _STATE), "centroid-vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("k").cast("string"), F.lit(""))), 256)
    first = state.select(order.alias("h"), "vec", "wide").orderBy("h", "vec", "wide").limit(centroids).collect()
    if not first:
        return state.select(F.col("k").alias(key), "cluster", *[F.lit(None).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.lit(None).cast("string").alias("centroid_sha256"))
    centre = _array([np.frombuffer(r["vec"], "<i4").tolist() if r["vec"] is not None else list(map(int, r["wide"])) for r in first], dim)
    old = None
    count, total = [0] * len(centre), [[0] * dim for _ in centre]
    for _ in range(rounds):
        following = materialise(state.withColumn("before", F.col("cluster")).mapInArrow(_advance(old, centre, dim), _STATE), "centroid-dots")
        drop_table(state)
        state, old = following, centre
        moved = state.where("NOT before <=> cluster").select("vec", "wide", "before", "cluster").mapInArrow(_moves(dim), "cluster int, n long, total array<string>")
        for c, n, change in moved.groupBy("cluster").applyInArrow(_fold, "cluster int, n long, total array<string>").collect():
            count[c] += n
            total[c] = [a + int(b) for a, b in zip(total[c], change)]
        centre = _array([[t // n for t in row] if n else list(map(int, before)) for row, n, before in zip(total, count, old)], dim)
    last = materialise(state.withColumn("before", F.col("cluster")).mapInArrow(_advance(old, centre, dim), _STATE), "centroid-dots")
    drop_table(state)
    return _report(last, centre, dim, key)


def _report(state: DataFrame, centre: np.ndarray, dim: int, key: str) -> DataFrame:
    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _vectors(batch.column(1), batch.column(2), dim)
            own = centre[np.asarray(batch.column(3))]
            if vectors.dtype == object or own.dtype == object:
                vectors, own = vectors.astype(object), own.astype(object)
            gap = vectors - own
            distance = (gap * gap).sum(axis=1) if len(gap) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array([int(d) if int(d) < 1 << 63 else None for d in distance], pa.int64())], names=["k", "cluster", "distance"])

    rows = state.select("k", "vec", "wide", "cluster").mapInArrow(measured, "k long, cluster int, distance long")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = rows.groupBy("cluster").agg(F.when(F.count(F.when(F.col("distance").isNull(), 1)) == 0, exact).alias("s"), F.count(F.when(F.col("distance").isNull(), 1)).alias("wide"))
    found = {r["cluster"]: r["s"] for r in sums.collect()}  # one row a cluster
    total = None if any(s is None for s in found.values()) else sum(map(int, found.values()))

    def fitting(x) -> int | None:
        return None if x is None or int(x) >= 1 << 63 else int(x)

    hashes = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centre]
    known = spark_rows(state, [(c, fitting(found.get(c)), fitting(total), hashes[c]) for c in range(len(centre))])
    return rows.join(F.broadcast(known), "cluster").select(F.col("k").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def spark_rows(df: DataFrame, rows: list[tuple]) -> DataFrame:
    """One row a centroid; their number is a parameter, so the table may be broadcast."""
    return df.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
