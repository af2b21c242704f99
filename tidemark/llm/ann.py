"""Approximate nearest neighbours over balanced posting lists.

Centroids come from balanced halving of a bounded sample, followed by rounds in which crowded centroids are made dearer. A graph of their
nearest neighbours, held in memory by every task, is searched best-first. Every vector goes to
the list of its nearest centroid and to those of further ones that are nearly as near and lie in another direction (boundary
replicas). A query reads the lists whose centroids are at most ``ratio`` times as far as its nearest
one; that ratio is measured: a few of the queries themselves are compared with all rows, and the ratio reaches the stated share of
what they found by the walk that answers them. Distances are exact, so an answer can miss a neighbour but never states a wrong distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import drop_table, materialise, mix64, partitions_for

#: Vectors meant for a list, most lists of one dimension, sampled vectors a list, and dimensions that get centroids of their own.
LIST, MOST_LISTS, SAMPLED, MOST_DIMS = 128, 4096, 16, 16
#: Lists of a vector at most, and how much further than the nearest a centroid may be for a replica.
REPLICAS, CLOSURE = 4, 1.15
#: Neighbours of a centroid in the graph, and candidates that a search keeps at least.
DEGREE, BEAM = 24, 48
#: Rows that a query surely reads, so that small tables and small lists are compared whole.
LEAST = 4096
#: Queries of a dimension that measure the ratio, and the share of their neighbours that it must reach.
MEASURED, REACH = 192, 0.96
#: Vectors of a block of a list, queries that search together, and results a task holds before it hands them on.
BLOCK, PACK, HELD = 512, 1024, 400_000


def usable(column: pa.Array) -> tuple[list[bytes | None], np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (doubles), dimension and two digests of every vector; None where it is null, empty, zero or not finite."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0)).astype(np.int64)
    flat = np.asarray(pc.fill_null(column.flatten().cast(pa.float64()), float("nan"))) + 0.0  # one zero
    ends = np.cumsum(sizes)
    out: list[bytes | None] = [None] * len(sizes)
    one, two = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        values = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
        fine = np.isfinite(values).all(axis=1) & (values != 0).any(axis=1)
        at, values = at[fine], np.ascontiguousarray(values[fine])
        words = mix64(values.view(np.uint64) + mix64(np.arange(dim, dtype=np.uint64)))
        one[at], two[at] = words.sum(axis=1, dtype=np.uint64).view(np.int64), mix64(words).sum(axis=1, dtype=np.uint64).view(np.int64)
        for i, v in zip(at.tolist(), values):
            out[i] = v.tobytes()
    return out, sizes.astype(np.int32), one, two


def scale_of(v: np.ndarray) -> float:
    """A power of two near the largest component, so that squares neither overflow nor vanish."""
    top = float(np.abs(v).max()) if v.size else 1.0
    return float(2.0 ** np.floor(np.log2(top))) if top > 0 else 1.0


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of ``a`` to the same rows of ``b``; infinite only where a double cannot hold them."""
    with np.errstate(over="ignore"):
        gap = a - b
        top = np.abs(gap).max(axis=-1, keepdims=True)
        unit = np.where((top > 1e100) | (top < 1e-100), np.where(top > 0, top, 1.0), 1.0)
        # a running sum adds in one order whatever the shape, so a pair has the same distance in every block
        return np.sqrt(np.cumsum(np.square(gap / unit), axis=-1)[..., -1]) * unit[..., 0]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``, rounded."""
    return np.maximum(0.0, np.square(a).sum(1)[:, None] + np.square(b).sum(1)[None, :] - 2 * (a @ b.T))


def balanced_centroids(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids of about equally large parts of the sample."""
    rng = np.random.default_rng(7)
    parts = [np.arange(len(sample))]
    while len(parts) < lists:
        largest = max(range(len(parts)), key=lambda i: len(parts[i]))
        rows = parts[largest]
        if len(rows) < 2:
            break
        own = sample[rows]
        side = own[rng.integers(len(own))] - own[rng.integers(len(own))]
        for _ in range(4):  # halves along the line between their means
            order = np.argsort(own @ side, kind="stable")
            half = len(rows) // 2
            side = own[order[half:]].mean(0) - own[order[:half]].mean(0)
        order = np.argsort(own @ side, kind="stable")
        parts[largest] = rows[order[: len(rows) // 2]]
        parts.append(rows[order[len(rows) // 2 :]])
    centre = np.stack([sample[p].mean(0) for p in parts])
    price = np.zeros(len(centre))
    even = len(sample) / len(centre)
    for _ in range(rounds):
        own = np.concatenate([np.argmin(squares(sample[i : i + 2048], centre) + price, axis=1) for i in range(0, len(sample), 2048)])
        size = np.bincount(own, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, own, sample)
        centre = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centre)
        spread = np.square(sample - centre[own]).sum(1).mean()
        price += 0.1 * spread * np.clip(size / even - 1, -1, 1)  # crowded centroids become dearer
    return centre


@dataclass
class Lists:
    """Centroids of one dimension, divided by ``unit``, their graph, where a walk over it begins, and the smallest squared distance that a ratio is taken of."""

    unit: float
    centre: np.ndarray
    graph: np.ndarray
    entries: np.ndarray
    floor: float


def build(sample: np.ndarray, lists: int) -> Lists:
    unit = scale_of(sample)
    centre = balanced_centroids(sample / unit, lists)
    n = len(centre)
    degree = min(DEGREE, n - 1)
    graph = np.zeros((n, degree + 2), np.int64)
    apart = np.full(n, np.inf)
    for i in range(0, n, 1024):
        gap = squares(centre[i : i + 1024], centre)
        gap[np.arange(len(gap)), np.arange(i, i + len(gap))] = np.inf
        apart[i : i + 1024] = np.where(gap > 0, gap, np.inf).min(1)
        graph[i : i + 1024, :degree] = np.argsort(gap, axis=1, kind="stable")[:, :degree]
    graph[:, degree], graph[:, degree + 1] = (np.arange(n) + 1) % n, (np.arange(n) - 1) % n  # a ring connects all
    some = apart[np.isfinite(apart)]
    floor = float(np.median(some)) / 100 if len(some) else 1e-300  # a query may lie on a centroid
    return Lists(unit, centre, graph, np.unique(np.linspace(0, n - 1, 16).astype(np.int64)), floor)


def graph_search(index: Lists, queries: np.ndarray, beam: int, ratio: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centroids (-1: none) and squared distances, nearest first, that a best-first walk over the graph finds for every query.

    The walk ends when the ``beam`` nearest that it knows are all expanded. With ``ratio`` it is repeated with a wider beam for the
    queries whose whole beam is within that ratio of their nearest centroid.
    """
    queries = queries / index.unit
    n = len(index.centre)
    norm = np.square(index.centre).sum(1)

    def gaps(rows: np.ndarray, ids: np.ndarray) -> np.ndarray:
        q = queries[rows]
        dots = np.einsum("ij,ikj->ik", q, index.centre[ids])
        return np.maximum(0.0, np.square(q).sum(1)[:, None] + norm[ids] - 2 * dots)

    def walk(rows: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        ids = np.full((len(rows), width), -1, np.int64)
        far = np.full((len(rows), width), np.inf)
        done = np.ones((len(rows), width), bool)
        entry = np.broadcast_to(index.entries, (len(rows), len(index.entries)))
        live = np.arange(len(rows))
        more, more_far = entry, gaps(rows, entry)
        while len(live):
            all_ids = np.concatenate([ids[live], more], axis=1)
            all_far = np.concatenate([far[live], more_far], axis=1)
            all_done = np.concatenate([done[live], np.zeros(more.shape, bool)], axis=1)
            order = np.lexsort((~all_done, all_ids), axis=1)  # of one centroid the expanded entry comes first
            all_ids, all_far, all_done = (np.take_along_axis(x, order, 1) for x in (all_ids, all_far, all_done))
            again = np.zeros(all_ids.shape, bool)
            again[:, 1:] = (all_ids[:, 1:] == all_ids[:, :-1]) & (all_ids[:, 1:] >= 0)
            all_far = np.where(again, np.inf, all_far)
            all_done |= again
            all_ids = np.where(again, -1, all_ids)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :width]
            ids[live], far[live], done[live] = (np.take_along_axis(x, order, 1) for x in (all_ids, all_far, all_done))
            going = ~done[live].all(axis=1)
            live = live[going]
            if not len(live):
                break
            step = np.argsort(done[live], axis=1, kind="stable")[:, : max(1, width // 16)]  # the nearest that are not expanded
            picked = np.take_along_axis(ids[live], step, 1)
            fresh = ~np.take_along_axis(done[live], step, 1)
            done[live[:, None], step] = True
            more = index.graph[np.where(fresh, picked, picked[:, :1])].reshape(len(live), -1)
            more_far = gaps(rows[live], more)
        return ids, far

    width = min(beam, n)
    ids, far = walk(np.arange(len(queries)), width)
    while ratio is not None and width < n:
        full = np.flatnonzero(far[:, -1] <= ratio * ratio * np.maximum(far[:, 0], index.floor))
        if not len(full):
            break
        wider = min(n, 4 * width)
        ids = np.pad(ids, ((0, 0), (0, wider - width)), constant_values=-1)
        far = np.pad(far, ((0, 0), (0, wider - width)), constant_values=np.inf)
        for i in range(0, len(full), 128):
            part = full[i : i + 128]
            ids[part], far[part] = walk(part, wider)
        width = wider
    return ids, far


def closure(index: Lists, vectors: np.ndarray) -> np.ndarray:
    """Lists of every vector (-1: none): the nearest centroid, then others that are nearly as near and not nearer to a chosen one."""
    ids, far = graph_search(index, vectors, BEAM)
    out = np.full((len(vectors), REPLICAS), -1, np.int64)
    out[:, 0] = ids[:, 0]
    number = np.ones(len(vectors), np.int64)
    for j in range(1, ids.shape[1]):
        may = np.flatnonzero((ids[:, j] >= 0) & (far[:, j] <= CLOSURE**2 * far[:, 0]) & (number < REPLICAS))
        if not len(may):
            continue
        chosen = out[may]
        between = np.square(index.centre[chosen] - index.centre[ids[may, j]][:, None, :]).sum(2)
        apart = np.where(chosen >= 0, between, np.inf).min(1) >= far[may, j]
        take = may[apart]
        out[take, number[take]] = ids[take, j]
        number[take] += 1
    return out


_RESULT = "query long, q_one long, q_two long, vec_id long, one long, two long, place int, score double, vec binary"


class Best:
    """The best results of every query that a task has met: (score, key, class, place), smallest first."""

    def __init__(self, k: int):
        self.k, self.of, self.held = k, {}, 0

    def worst(self, query: tuple) -> float:
        """Score that a further result must not exceed."""
        found = self.of.get(query, ())
        return found[-1][0] if len(found) == self.k else float("inf")

    def add(self, query: tuple, found: list[tuple]) -> None:
        old = self.of.get(query, [])
        by_row: dict[tuple, float] = {}  # a row that several lists hold takes one place
        for score, *row in (*old, *found):
            by_row[tuple(row)] = min(score, by_row.get(tuple(row), score))
        new = sorted((score, *row) for row, score in by_row.items())[: self.k]
        self.held += len(new) - len(old)
        self.of[query] = new

    def batches(self, with_vectors: dict | None = None) -> Iterator[pa.RecordBatch]:
        rows = [(*q, key, one, two, place, score, with_vectors.get((one, two)) if with_vectors else None) for q, found in self.of.items() for score, key, one, two, place in found]
        names = [c.split()[0] for c in _RESULT.split(", ")]
        kinds = [pa.int64()] * 6 + [pa.int32(), pa.float64(), pa.binary()]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)
        self.of, self.held = {}, 0


def compare(best: Best, queries: list[tuple], q: np.ndarray, classes: list[tuple], v: np.ndarray, ids: list[list[int]]) -> None:
    """Adds the ``k`` nearest rows among ``classes`` to every query; only those that rounding leaves possible are measured exactly."""
    k = best.k
    unit = scale_of(np.concatenate([q, v]))
    rough = squares(q / unit, v / unit)
    loose = 1e-12 * (np.square(q / unit).sum(1)[:, None] + np.square(v / unit).sum(1).max())
    kept = min(k + 1, len(classes))  # one class may hold the query alone
    limit = np.partition(rough, kept - 1, axis=1)[:, kept - 1 : kept]
    known = np.array([best.worst(query) for query in queries])[:, None] / unit
    with np.errstate(over="ignore"):
        near = rough <= np.minimum(limit, known * known * (1 + 1e-9)) + loose
    for i in np.flatnonzero(near.any(axis=1)).tolist():
        at = np.flatnonzero(near[i])
        found = []
        for score, c in zip(distances(q[i][None], v[at]).tolist(), at.tolist()):
            own = classes[c] == queries[i][1:]
            listed = list(ids[c])
            if own and queries[i][0] in listed:
                listed.remove(queries[i][0])  # one row is the query itself
            found += [(score, key, *classes[c], place) for place, key in enumerate(listed[:k])]
        best.add(queries[i], found)


def _stack(raw: list[bytes], dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), dim)


def nearest(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best results of every query; a row that several lists hold counts once."""
    query = ["query", "q_one", "q_two"]
    single = rows.groupBy(*query, "vec_id", "one", "two", "place").agg(F.min("score").alias("score"), F.first("vec").alias("vec"))
    order = W.partitionBy(*query).orderBy("score", "vec_id", "one", "two", "place")
    return single.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _scan(queries: list[tuple], q: np.ndarray, dim: int, k: int):
    """Brute force of a few queries over every class of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, vectors = Best(k), {}
        for batch in batches:
            classes = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            raw = batch.column(2).to_pylist()
            if classes:
                compare(best, queries, q, classes, _stack(raw, dim), batch.column(3).to_pylist())
                met = {(one, two) for found in best.of.values() for _, _, one, two, _ in found}
                vectors = {c: r for c, r in [*vectors.items(), *zip(classes, raw)] if c in met}
        yield from best.batches(vectors)

    return run


def chosen(index: Lists, q: np.ndarray, ratio: float, held: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists (-1: none) that the walk meets for every query, and which of them it reads.

    Besides the ratio, lists are read until they hold ``LEAST`` classes, and surely enough others (a class lies in ``REPLICAS`` lists at most).
    """
    ids, far = graph_search(index, q, BEAM, ratio)
    near = (ids >= 0) & (far <= ratio * ratio * np.maximum(far[:, :1], index.floor) * (1 + 1e-12))
    sizes = np.where(ids >= 0, held[ids], 0)
    near |= (ids >= 0) & (np.cumsum(sizes, axis=1) - sizes < max(LEAST, REPLICAS * (k + 1)))
    return ids, near


def measured_ratio(index: Lists, classes: DataFrame, dim: int, sample: list[tuple], k: int, reach: float) -> float:
    """Smallest distance ratio with which the sampled queries' own searches reach that share of their true neighbours.

    ``sample``: key, digests and vector of queries that are drawn from all of them, so that the share holds for the queries asked,
    however unlike the other rows they are. What the walk misses is made up for by a larger ratio.
    """
    queries = [tuple(r[:3]) for r in sample]
    q = _stack([r[3] for r in sample], dim)
    found = nearest(classes.where(F.col("dim") == dim).select("one", "two", "vec", "ids").mapInArrow(_scan(queries, q, dim, k), _RESULT), k)
    rows = found.select("query", "q_one", "q_two", "vec").collect()  # at most k of each sampled query
    if not rows:
        return 1.0
    place = {query: i for i, query in enumerate(queries)}
    at = np.array([place[r["query"], r["q_one"], r["q_two"]] for r in rows])
    lists = closure(index, _stack([r["vec"] for r in rows], dim))
    unit = index.unit
    far = np.sqrt(squares(q / unit, index.centre))
    needed = np.where(lists >= 0, far[at[:, None], lists], np.inf).min(1) / np.maximum(far.min(1)[at], index.floor**0.5)
    ratio = float(np.quantile(needed, reach, method="higher")) * (1 + 1e-9)
    plenty = np.full(len(index.centre), 1 << 40)
    for _ in range(200):
        ids, near = chosen(index, q, ratio, plenty, k)
        read = np.zeros((len(q), len(index.centre) + 1), bool)
        np.put_along_axis(read, np.where(near, ids, -1), True, axis=1)
        read[:, -1] = False
        if read[at[:, None], lists].any(1).mean() >= reach:
            break
        ratio *= 1.1
    return ratio


def search(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", reach: float = REACH) -> DataFrame:
    """Per query up to ``k`` rows: ``query_id``, ``rank`` (from 1), the key, ``score`` (Euclidean distance in doubles).

    Queries are the rows where ``is_query`` (a condition on the key) holds, candidates all rows but the query's own, of the same
    dimension. Nearest come first, ties by the smaller key. A vector that is null, empty, zero or has a null or non-finite component takes no
    part, nor does a null key. Equal vectors are one class of which the ``k + 1`` smallest keys matter, whatever their
    number. Repeated rows are candidates of each other and one query; a key with several vectors is one query for each of them. An empty table gives
    no rows; other columns are not read, so their names cannot clash.

    The index is fitted on a bounded sample (``MOST_LISTS * SAMPLED`` vectors of each of the ``MOST_DIMS`` most frequent dimensions; vectors of
    other dimensions share one list each), but holds every row. ``reach`` is the share of true neighbours that the measured ratio
    must reach for ``MEASURED`` queries. A list longer than ``BLOCK`` is dealt out to blocks by hash.
    """
    spark = vectors.sparkSession

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims, one, two = usable(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(raw, pa.binary()), pa.array(dims), pa.array(one), pa.array(two)], names=["k", "asks", "vec", "dim", "one", "two"])

    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = materialise(rows.where("k IS NOT NULL").mapInArrow(prepare, "k long, asks boolean, vec binary, dim int, one long, two long").where("vec IS NOT NULL"), "ann-vectors")
    same = ["dim", "one", "two"]
    few = rows.select("k", "vec", *same).withColumn("r", F.row_number().over(W.partitionBy(*same).orderBy("k"))).where(F.col("r") <= k + 1)
    classes = materialise(few.groupBy(*same).agg(F.first("vec").alias("vec"), F.sort_array(F.collect_list("k")).alias("ids")), "ann-classes")
    sizes = {r[0]: r[1] for r in classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_DIMS).collect()}
    indexes: dict[int, tuple[Lists, float]] = {}
    asking = rows.where("asks").select("k", "one", "two", "vec", "dim").distinct()
    for dim, n in sizes.items():
        lists = max(1, min(MOST_LISTS, n // LIST))
        wanted = lists * SAMPLED
        # digests are uniform, so a range of them is a random sample
        share = int(min(1.0, max(wanted, MEASURED) / n) * (1 << 40))
        sample = [tuple(r) for r in classes.where((F.col("dim") == dim) & (F.pmod("two", F.lit(1 << 40)) < share)).select("one", "two", "vec").collect()]
        if not sample:
            continue
        index = build(_stack([r[2] for r in sample], dim), lists)
        asked = asking.where(F.col("dim") == dim).orderBy(F.xxhash64("k", "two"), "one").limit(MEASURED).collect()
        indexes[dim] = index, measured_ratio(index, classes, dim, asked, k, reach) if asked else 1.0
    return _answers(spark, rows, classes, indexes, k, key)


def _answers(spark, rows: DataFrame, classes: DataFrame, indexes: dict[int, tuple[Lists, float]], k: int, key: str) -> DataFrame:
    fitted = spark.sparkContext.broadcast(indexes)

    def by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        dims = np.asarray(batch.column(0))
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            yield dim, at, _stack(batch.column(3).take(pa.array(at)).to_pylist(), dim)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, PACK):
                batch = whole.slice(first, PACK)
                for dim, at, v in by_dim(batch):
                    lists = closure(fitted.value[dim][0], v) if dim in fitted.value else np.zeros((len(at), 1), np.int64)
                    row, column = np.nonzero(lists >= 0)
                    kept = batch.take(pa.array(at[row]))
                    yield pa.RecordBatch.from_arrays([kept.column(0), pa.array(lists[row, column].astype(np.int32)), *kept.columns[1:]], names=["dim", "list", "one", "two", "vec", "ids"])

    posted = materialise(classes.select("dim", "one", "two", "vec", "ids").mapInArrow(post, "dim int, list int, one long, two long, vec binary, ids array<long>"), "ann-lists")
    counts = posted.groupBy("dim", "list").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    counts = materialise(counts, "ann-sizes")
    salt = F.pmod(F.xxhash64("one", "two"), F.col("blocks").cast("long")).cast("int")
    place, parts = ["dim", "list", "block"], partitions_for(spark)
    blocked = posted.join(counts, ["dim", "list"]).withColumn("block", salt).repartition(parts, *place).groupBy(*place).agg(F.collect_list(F.struct("one", "two", "vec", "ids")).alias("held"))

    held = {dim: np.zeros(len(index.centre), np.int64) for dim, (index, _) in indexes.items()}
    for dim, number, n in posted.groupBy("dim", "list").count().collect():  # one row a list
        if dim in held:
            held[dim][number] = n
    asking = rows.where("asks").select("dim", "one", "two", "vec", "k").distinct()
    total = asking.count()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries of a batch, packed by the lists that they read."""
        for whole in batches:
            for first in range(0, whole.num_rows, PACK):
                batch = whole.slice(first, PACK)
                for dim, at, q in by_dim(batch):
                    if dim in fitted.value:
                        index, ratio = fitted.value[dim]
                        ids, near = chosen(index, q, ratio, held[dim], k)
                        row, column = np.nonzero(near)
                        lists = ids[row, column]
                    else:
                        row, lists = np.arange(len(at)), np.zeros(len(at), np.int64)
                    order = np.argsort(lists, kind="stable")
                    row, lists = row[order], lists[order]
                    starts = np.flatnonzero(np.concatenate([[True], lists[1:] != lists[:-1]])) if len(lists) else np.zeros(0, np.int64)
                    kept = batch.take(pa.array(at[row]))
                    offsets = pa.array(np.concatenate([starts, [len(lists)]]).astype(np.int32))
                    packs = [pa.ListArray.from_arrays(offsets, kept.column(c)) for c in (4, 1, 2, 3)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(starts), dim, np.int32)), pa.array(lists[starts].astype(np.int32)), *packs], names=["dim", "list", "k", "q_one", "q_two", "q_vec"])

    packs = asking.repartition(max(1, -(-total // PACK)), "k").mapInArrow(ask, "dim int, list int, k array<long>, q_one array<long>, q_two array<long>, q_vec array<binary>")
    packs = packs.join(counts, ["dim", "list"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks").repartition(parts, *place)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(k)
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                keys, one, two, vec = (batch.column(c)[i].as_py() for c in range(1, 5))
                c_one, c_two, c_vec, c_ids = (x.to_pylist() for x in batch.column(5)[i].values.flatten())
                compare(best, list(zip(keys, one, two)), _stack(vec, dim), list(zip(c_one, c_two)), _stack(c_vec, dim), c_ids)
                if best.held > HELD:
                    yield from best.batches()
        yield from best.batches()

    pairs = packs.join(blocked, place).select("dim", "k", "q_one", "q_two", "q_vec", "held")
    found = materialise(pairs.mapInArrow(score, _RESULT), "ann-found")
    drop_table(posted)
    fitted.destroy()
    return nearest(found, k).select(F.col("query").alias("query_id"), "rank", F.col("vec_id").alias(key), "score")
