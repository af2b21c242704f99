"""Centroid clustering and nearest neighbours against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import centroids


def clustered(rows, dim, scale, k, rounds):
    """The contract, vector by vector."""
    kept = [(i, [math.floor(scale * Fraction(x)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest())
    centre = [v for _, v in order[:k]]

    def far(v, c):
        return sum((a - b) ** 2 for a, b in zip(v, c))

    def assign():
        return [min(range(len(centre)), key=lambda j: (far(v, centre[j]), j)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for j in range(len(centre)):
            members = [v for (_, v), c in zip(kept, own) if c == j]
            if members:
                centre[j] = [sum(x) // len(members) for x in zip(*members)]
    own = assign()
    distance = [far(v, centre[c]) for (_, v), c in zip(kept, own)]
    by = {j: sum(d for d, c in zip(distance, own) if c == j) for j in range(len(centre))}

    def long(x):
        return x if x < 1 << 63 else None

    return [(i, c, long(d), long(by[c]), long(sum(distance)), hashlib.sha256(",".join(map(str, centre[c])).encode()).hexdigest()) for (i, _), c, d in zip(kept, own, distance)]


COLUMNS = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def odd_vectors(seed, dim, n=300):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 3, 1.0) for _ in range(dim)]) for i in range(n)]
    hot = rows[0][1]
    rows += [(1000 + i, hot) for i in range(n // 2)]  # copies, ties
    rows += [(5, rows[5][1]), (5, rows[5][1]), (6, rows[9][1])]  # repeated rows, one key twice
    rows += [(2000, None), (2001, []), (2002, [1.0] * (dim - 1)), (2003, [float("nan")] * dim), (2004, [float("inf")] + [0.0] * (dim - 1)), (2005, [None] + [0.0] * (dim - 1)), (2006, [0.0] * dim)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1) for k, v in rows], "vec_id long, embedding array<double>, cluster string, score int")


@pytest.mark.parametrize("factor", [1.0, 3e6, 1e200, 1e307])
def test_clusters_equal_brute_force(spark, factor):
    rows = odd_vectors(3, 4)
    rows += [(3000 + i, [factor, -factor * i, 0.5, -0.25]) for i in range(3)] + [(None, [0.1, 0.2, 0.3, 0.4])]
    got = centroids.cluster(frame(spark, rows), dim=4, centroids=7, rounds=3)
    assert got.columns == COLUMNS
    assert in_order(map(tuple, got.collect())) == in_order(clustered(rows, 4, 256, 7, 3))


def test_clusters_of_little(spark):
    assert centroids.cluster(frame(spark, [])).count() == 0
    assert centroids.cluster(frame(spark, [(1, None), (2, [1.0])])).count() == 0
    rows = [(1, [1.0, 2.0]), (2, [1.0, 2.5])]
    got = centroids.cluster(frame(spark, rows), dim=2)
    assert in_order(map(tuple, got.collect())) == in_order(clustered(rows, 2, 256, 40, 5))


def test_products_are_exact_at_every_width():
    rng = random.Random(1)
    for size in (100, 1 << 26, 1 << 30, 1 << 80):
        a = [[rng.randrange(-size, size) for _ in range(5)] for _ in range(6)]
        b = [[rng.randrange(-size, size) for _ in range(5)] for _ in range(4)]
        kind = np.int64 if size < 1 << 31 else object
        got = centroids.product(np.array(a, kind), np.array(b, kind).T)
        assert [[int(x) for x in row] for row in got] == [[sum(x * y for x, y in zip(p, q)) for q in b] for p in a]


def test_only_changed_components_are_used():
    old = np.array([[1, 2, 3], [4, 5, 6]])
    new = np.array([[1, 7, 3], [4, 5, 6]])
    moved, delta = centroids.changes(old, new)
    assert moved.tolist() == [1] and delta.tolist() == [[5, 0]]
