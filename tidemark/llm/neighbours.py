"""Embedding near-duplicates by sorted projection passes.

Every pass draws its own random hyperplanes and orders the vectors lexicographically by their concatenated sign bits;
each vector is compared with the next ``WINDOW`` in that order, and pairs whose cosine reaches
the limit are united across the passes. There are as many passes as meet a pair at the limit with a stated chance. The comparison is exact, so no pair below the limit links. What
the windows leave out of a component's links is then counted exactly: members within half the
limit's angle of the component's first vector all link with each other (their angles add up to
the limit's at most) and are only counted, and the few others are compared with the whole component block by block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_components, materialise, mix64, partitions_for

#: Least number of passes, neighbours compared in each, and hyperplanes of a pass.
PASSES, WINDOW, PLANES = 12, 32, 64
#: Chance with which a lone pair at the limit is to be met, and vectors from which the passes for it are derived.
RECALL, SAMPLE = 0.99, 2048
#: Vectors of a block in the exact count.
BLOCK = 512


def _vectors(column: pa.Array) -> tuple[list[bytes | None], np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (doubles), dimension and two digests of every usable vector; None where it is null, empty, zero or not finite."""
    lists = column.to_pylist()
    out: list[bytes | None] = []
    dims = np.zeros(len(lists), np.int32)
    one, two = np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
    for i, x in enumerate(lists):
        v = np.array([np.nan if e is None else e for e in x], np.float64) if x else np.zeros(0)
        size = float(np.sqrt(np.square(v / max(1e-300, np.abs(v).max())).sum())) if len(v) and np.isfinite(v).all() and np.abs(v).max() > 0 else 0.0
        if not size:
            out.append(None)
            continue
        unit = v / np.abs(v).max() / size
        raw = unit.astype("<f8")
        place = np.arange(len(raw), dtype=np.uint64)
        words = mix64(raw.view(np.uint64) + mix64(place))
        dims[i] = len(raw)
        one[i], two[i] = int(words.sum(dtype=np.uint64).view(np.int64)), int(mix64(words).sum(dtype=np.uint64).view(np.int64))
        out.append(raw.tobytes())
    return out, dims, one, two


def _planes(number: int, dim: int) -> np.ndarray:
    return np.random.default_rng([20_240_611, number, dim]).standard_normal((dim, PLANES))


def _codes(u: np.ndarray, number: int) -> np.ndarray:
    """Sign bits in order of the planes, the first most significant, as sortable signed integers."""
    bits = (u @ _planes(number, u.shape[1]) >= 0).astype(np.uint64)
    code = (bits << np.arange(PLANES - 1, -1, -1, dtype=np.uint64)).sum(1, dtype=np.uint64)
    return (code ^ np.uint64(1 << 63)).view(np.int64)


class _Union:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def stars(self) -> list[tuple[int, int]]:
        return [(x, self.find(x)) for x in self.parent if self.find(x) != x]


def meeting_chances(u: np.ndarray, n: int, least: float, window: int) -> np.ndarray:
    """Chance that one pass brings together each row of the sample ``u`` of ``n`` unit vectors and a vector at cosine ``least`` to it.

    Two vectors at an angle share a plane's sign with a chance of one less the angle over pi, so the sample's angles tell how many
    vectors share the first ``m`` signs with a row; where many are close to each other, that falls slowly. A pair whose signs
    part behind ``m`` has its places spread evenly over the two halves of that run. Vectors that link with the row are
    left out: they connect the pair themselves.
    """
    cosine = np.clip(u @ u.T, -1, 1)
    share = 1 - np.arccos(cosine) / np.pi
    share[cosine >= least] = 0
    others = max(1.0, n - 1.0) / max(1, len(u) - 1)
    same = 1 - np.arccos(least) / np.pi
    out, alike = np.zeros(len(u)), (share > 0).astype(np.float64)
    for m in range(PLANES):
        x = 2 * window / np.maximum(alike.sum(1) * others, 1)
        met = np.where(x <= 1, x * x / 2, np.where(x < 2, 1 - (2 - x) ** 2 / 2, 1.0))
        out += same**m * (1 - same if m + 1 < PLANES else 1) * met
        alike *= share
    return out


def passes_for(sample: list[tuple[int, bytes]], sizes: dict[int, int], least: float, window: int) -> int:
    """Passes in which a lone pair at the limit is met with the chance ``RECALL``, for nine tenths of the sampled vectors of every length.

    ``sample`` has (length, vector), ``sizes`` the number of vectors of each length.
    """
    most = PASSES
    for dim in {d for d, _ in sample}:
        u = np.stack([np.frombuffer(v, "<f8") for d, v in sample if d == dim])
        q = float(np.quantile(meeting_chances(u, sizes[dim], least, window), 0.1))
        if q < 1:
            most = max(most, int(np.ceil(np.log(1 - RECALL) / np.log1p(-q))))
    return most


_FOUND = "kind int, a long, b long, boundary int, place int, grp long, vec binary"
_FOUND_ARROW = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("boundary", pa.int32()), ("place", pa.int32()), ("grp", pa.int64()), ("vec", pa.binary())])


def _window_links(least: float, window: int):
    """Unites linked neighbours of a sorted partition; hands on its first and last rows for the borders."""

    def edge(kind: int, boundary: int, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"kind": kind, "a": i, "b": i, "boundary": boundary, "place": k, "grp": g, "vec": v} for k, (g, i, v) in enumerate(rows)], _FOUND_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        union, head, tail = _Union(), [], []
        for whole in batches:
            for first in range(0, whole.num_rows, 8192):
                batch = whole.slice(first, 8192)
                rows = list(zip(*(batch.column(i).to_pylist() for i in range(3))))
                if len(head) < window:
                    head += rows[: window - len(head)]
                block = tail + rows
                group = np.array([r[0] for r in block])
                ids = np.array([r[1] for r in block])
                for g in np.unique(group):
                    at = np.flatnonzero(group == g)
                    u = np.stack([np.frombuffer(block[i][2], "<f8") for i in at])
                    own = ids[at]
                    for k in range(1, min(window, len(at) - 1) + 1):
                        near = np.flatnonzero(np.einsum("ij,ij->i", u[:-k], u[k:]) >= least)
                        for i in near.tolist():
                            union.link(int(own[i]), int(own[i + k]))
                tail = block[-window:]
        yield edge(1, part - 1, head)
        yield edge(2, part, tail[::-1])
        stars = union.stars()
        yield pa.RecordBatch.from_pylist([{"kind": 0, "a": a, "b": b} for a, b in stars], _FOUND_ARROW)

    return run


def _border_links(least: float, window: int):
    def run(table: pa.Table) -> pa.Table:
        heads = table.filter(pc.equal(table.column("kind"), 1)).to_pylist()
        tails = table.filter(pc.equal(table.column("kind"), 2)).to_pylist()
        found = []
        for t in tails:
            for h in heads:
                if t["place"] + h["place"] + 1 <= window and t["grp"] == h["grp"] and float(np.frombuffer(t["vec"], "<f8") @ np.frombuffer(h["vec"], "<f8")) >= least:
                    found.append((t["a"], h["a"]))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return run


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.9, passes: int | None = None, window: int = WINDOW) -> DataFrame:
    """Per vector: the key, ``n_links``, ``component_id`` and ``kept``.

    Two vectors link when their cosine (in doubles) is at least ``least``. ``n_links`` counts the
    other rows linked directly, ``component_id`` is the smallest key reachable by links, and
    ``kept`` marks the vector with that key. A vector that is null, empty, zero or has a null or non-finite component links with
    nothing, nor do vectors of different length link; so does a row with a null key, whose component is null and which is
    not kept. Equal vectors are one class and are counted, not paired; repeated rows keep a row each. Extra
    columns are left out; an empty table stays empty. Without ``passes`` their number follows from the number of
    vectors and from how close they lie (``passes_for``).
    """
    spark = vectors.sparkSession

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, dims, one, two = _vectors(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), pa.array(dims), pa.array(one), pa.array(two)], names=["k", "vec", "dim", "one", "two"])

    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("v")).mapInArrow(prepare, "k long, vec binary, dim int, one long, two long")
    rows = materialise(rows, "vectors")
    usable = rows.where("vec IS NOT NULL AND k IS NOT NULL")
    classes = usable.groupBy("dim", "one", "two").agg(F.min("k").alias("c"), F.count(F.lit(1)).alias("m"), F.first("vec").alias("vec"))
    # a key with several vectors leads several classes; they are told apart by a number of their own
    classes = materialise(classes.withColumn("class", F.xxhash64("dim", "one", "two")), "classes")
    if passes is None:
        # the class is a hash, so the first ones are a random sample
        sizes = {r[0]: r[1] for r in classes.groupBy("dim").count().orderBy(F.desc("count")).limit(SAMPLE).collect()}
        passes = passes_for([tuple(r) for r in classes.orderBy("class").select("dim", "vec").limit(SAMPLE).collect() if r[0] in sizes], sizes, least, window)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 4096):
                batch = whole.slice(first, 4096)
                dims = np.asarray(batch.column(1))
                for dim in np.unique(dims):
                    at = np.flatnonzero(dims == dim)
                    own = batch.take(pa.array(at))
                    u = np.frombuffer(b"".join(own.column(2).to_pylist()), "<f8").reshape(len(at), dim)
                    for number in range(passes):
                        group = pa.array(np.full(len(at), int(dim) * passes + number, np.int64))
                        yield pa.RecordBatch.from_arrays([group, pa.array(_codes(u, number)), own.column(0), own.column(2)], names=["grp", "code", "class", "vec"])

    ordered = classes.select("class", "dim", "vec").mapInArrow(project, "grp long, code long, class long, vec binary")
    ordered = ordered.repartitionByRange(partitions_for(spark), "grp", "code", "class").sortWithinPartitions("grp", "code", "class")
    found = materialise(ordered.select("grp", "class", "vec").mapInArrow(_window_links(least, window), _FOUND), "windows")
    borders = found.where("kind > 0").groupBy("boundary").applyInArrow(_border_links(least, window), "a long, b long")
    links = materialise(found.where("kind = 0").select("a", "b").unionByName(borders), "vector-links")
    members = materialise(join_components(classes.select("class"), links, "class", "vectors").withColumnRenamed("component_id", "leader").join(classes, "class"), "members")
    counts = _link_counts(members, least)
    # classes of one component, and classes of one key, belong together
    by_leader = members.groupBy("leader").agg(F.min("c").alias("first"))
    keyed = materialise(usable.select("k", F.xxhash64("dim", "one", "two").alias("class")).join(members.select("class", "leader"), "class").join(by_leader, "leader"), "keyed")
    found_components = join_components(keyed.select("k").distinct(), keyed.select(F.col("k").alias("a"), F.col("first").alias("b")).distinct(), "k", "vector-keys")
    out = rows.withColumn("class", F.when(F.col("vec").isNotNull() & F.col("k").isNotNull(), F.xxhash64("dim", "one", "two")))
    out = out.select("k", "class").join(counts, "class", "left").join(found_components, "k", "left")
    component = F.coalesce("component_id", "k")
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("k") == component, F.lit(False)).alias("kept"))


def _link_counts(members: DataFrame, least: float) -> DataFrame:
    """Exact number of other rows that each class's rows link with: (class, n_links).

    ``members`` has class, leader, m (rows of the class) and vec.
    """
    half = float(np.sqrt((1 + least) / 2)) + 1e-9  # cosine of half the limit's angle, on the safe side

    @F.pandas_udf("double")
    def cosine(a, b):
        return a.combine(b, lambda x, y: float(np.frombuffer(x, "<f8") @ np.frombuffer(y, "<f8")))

    heads = members.where("class = leader").select("leader", F.col("vec").alias("head"))
    sized = members.groupBy("leader").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    inside = members.join(sized, "leader").join(heads, "leader").select("class", "leader", "m", "vec", "size", (cosine("vec", "head") >= half).alias("ball"))
    inside = materialise(inside, "balls")
    balls = inside.groupBy("leader").agg(F.sum(F.when(F.col("ball"), F.col("m")).otherwise(0)).alias("ball_rows"), F.count_if(~F.col("ball")).alias("others"))
    open_ = inside.join(balls.where("others > 0"), "leader")

    def blocks(df: DataFrame, salt: int, count: str, name: str) -> DataFrame:
        """Random blocks of about ``BLOCK`` members, so a component of any size is many groups."""
        number = F.pmod(F.xxhash64(F.lit(salt), "class"), F.ceil(F.col(count) / BLOCK))
        return df.groupBy("leader", number.alias(f"{name}_no")).agg(F.collect_list(F.struct("class", "m", "ball", "vec")).alias(name))

    pairs = blocks(open_.where("NOT ball"), 1, "others", "rest").join(blocks(open_, 2, "size", "all"), "leader").select("rest", "all")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            classes, adds = [], []
            for i in range(batch.num_rows):
                rest, every = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                u = np.stack([np.frombuffer(r["vec"], "<f8") for r in rest])
                v = np.stack([np.frombuffer(r["vec"], "<f8") for r in every])
                a, b = np.array([r["class"] for r in rest]), np.array([r["class"] for r in every])
                near = (u @ v.T >= least) & (a[:, None] != b[None])
                ball = np.array([r["ball"] for r in every])
                classes += [a, b[ball]]
                adds += [near @ np.array([r["m"] for r in every]), np.array([r["m"] for r in rest]) @ near[:, ball]]
            c, n = (np.concatenate(classes), np.concatenate(adds)) if classes else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)), pa.array(n.astype(np.int64))], names=["class", "more"])

    more = pairs.mapInArrow(count, "class long, more long").groupBy("class").agg(F.sum("more").alias("more"))
    near = inside.join(balls, "leader").select("class", (F.when(F.col("ball"), F.col("ball_rows") - F.col("m")).otherwise(0)).alias("near"))
    joined = members.select("class", "m").join(near, "class", "left").join(more, "class", "left")
    return joined.select("class", (F.col("m") - 1 + F.coalesce("near", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_links"))
