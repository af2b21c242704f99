"""Posting lists against brute force: exact distances, recall, ties, copies and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann


def brute(rows, asks, k):
    """Per query (key, vector): the sorted (score, key) of all other rows."""
    good = [(i, tuple(map(float, v))) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    out = {}
    for i, v in set(good):
        if not asks(i):
            continue
        others = list(good)
        others.remove((i, v))
        scored = sorted((float(np.sqrt(sum((x - y) ** 2 for x, y in zip(v, w)))), j) for j, w in others if len(w) == len(v))
        out.setdefault(i, []).append(scored[:k])
    return out


def answers(spark, rows, every, k=10, **more):
    frame = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], "vec_id long, embedding array<double>, rank string, score double")
    got = ann.search(frame, F.col("vec_id") % every == 0, k, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    found = {}
    for r in got.collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return {q: sorted(v) for q, v in found.items()}


def gaussian(n, dim, centres, seed):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((centres, dim)) * 3
    return middle[rng.integers(0, centres, n)] + rng.standard_normal((n, dim)) * 0.7


@pytest.mark.parametrize("reach", [0.96, 1.0])
def test_recall_and_exact_scores(spark, reach):
    v = np.concatenate([gaussian(2600, 12, 40, 1), np.random.default_rng(2).standard_normal((900, 12))])
    v[-300:] = v[0] + np.random.default_rng(3).standard_normal((300, 12)) * 1e-3  # one dense group
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, want = answers(spark, rows, 20, reach=reach), brute(rows, lambda i: i % 20 == 0, 10)
    hits = 0
    for q, (scored,) in want.items():
        mine = got[q]
        assert [r for r, _, _ in mine] == list(range(1, 11))
        assert [(s, j) for _, s, j in mine] == sorted((s, j) for _, s, j in mine)
        for _, score, j in mine:
            assert abs(score - np.sqrt(np.square(v[q] - v[j]).sum())) < 1e-12
        hits += len({j for _, _, j in mine} & {j for _, j in scored})
    assert hits / (10 * len(want)) >= (0.9 if reach < 1 else 0.98)


def test_copies_ties_and_odd_rows(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(120)]  # many ties and copies
    rows += [(200 + i, [1.0, 1.0, 1.0]) for i in range(60)]
    rows += [(300, rows[0][1]), (300, rows[0][1]), (300, [9.0, 9.0, 9.0])]  # repeated rows, a key with two vectors
    rows += [(400, None), (410, []), (420, [0.0, 0.0, 0.0]), (430, [float("nan"), 1.0, 1.0]), (440, [float("inf"), 1.0, 1.0]), (450, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(500, [1.0, 2.0]), (501, [1.0, 2.5]), (510, [4.0])]
    got, want = answers(spark, rows, 10, k=7, reach=1.0), brute(rows, lambda i: i % 10 == 0, 7)
    assert 510 not in got and len(want[510][0]) == 0
    for q, lists in want.items():
        mine = got.get(q, [])
        assert sorted((round(s, 9), j) for _, s, j in mine) == sorted((round(s, 9), j) for scored in lists for s, j in scored)


def test_few_and_extreme_vectors(spark):
    assert answers(spark, [], 1) == {}
    assert answers(spark, [(0, [1.0, 2.0])], 1) == {}
    rows = [(0, [1e200, 0.0]), (1, [0.0, 1e200]), (2, [1e-200, 0.0]), (3, [0.0, 1e-200]), (4, [3.0, 4.0])]
    got = answers(spark, rows, 1)
    assert [j for _, _, j in got[2]] == [3, 4, 0, 1]
    assert got[0][0][1] == pytest.approx(1e200) and got[2][0][1] == pytest.approx(2**0.5 * 1e-200) and got[4][0][1] == 5.0


def test_hot_list_in_blocks(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("PACK", 8), ("MOST_LISTS", 4), ("HELD", 50)):
        monkeypatch.setattr(ann, name, value)
    v = gaussian(900, 6, 3, 9)
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, want = answers(spark, rows, 30, reach=1.0), brute(rows, lambda i: i % 30 == 0, 10)
    hits = sum(len({j for _, _, j in got[q]} & {j for _, j in scored}) for q, (scored,) in want.items())
    assert hits / (10 * len(want)) >= 0.95


def test_a_row_of_several_lists_takes_one_place():
    best = ann.Best(2)
    best.add((1, 0, 0), [(0.5, 7, 1, 1, 0), (0.6, 8, 2, 2, 0)])
    best.add((1, 0, 0), [(0.5 + 1e-16, 7, 1, 1, 0), (0.55, 9, 3, 3, 0)])
    best.add((1, 0, 0), [(0.6000000000000001, 7, 1, 1, 0)])
    assert best.of[1, 0, 0] == [(0.5, 7, 1, 1, 0), (0.55, 9, 3, 3, 0)]
    rng = np.random.default_rng(1)
    a, b = rng.standard_normal((50, 64)), rng.standard_normal((50, 64))
    assert ann.distances(a, b).tolist() == [float(ann.distances(a[i : i + 1], b[i : i + 1])[0]) for i in range(50)]


def test_graph_walk_finds_the_nearest_centroids():
    rng = np.random.default_rng(8)
    v = rng.standard_normal((4000, 8))
    index = ann.build(v, 200)
    queries = rng.standard_normal((300, 8))
    true = ann.squares(queries / index.unit, index.centre)
    ids, far = ann.graph_search(index, queries, ann.BEAM)
    assert (ids[:, 0] == true.argmin(1)).mean() > 0.99
    assert np.allclose(np.take_along_axis(true, ids, 1), far)
    ids, far = ann.graph_search(index, queries, 8, 1.5)
    near = [(set(np.flatnonzero(t <= 2.25 * t.min())), set(i[f <= 2.25 * f[0]].tolist())) for t, i, f in zip(true, ids, far)]
    assert sum(len(a & b) for a, b in near) / sum(len(a) for a, _ in near) > 0.99
    sizes = np.bincount(true.argmin(1), minlength=200)
    assert sizes.max() < 20


def test_queries_unlike_the_other_rows(spark):
    rng = np.random.default_rng(12)
    v = np.repeat(rng.standard_normal((300, 16)), 20, axis=0) + 1e-3 * rng.standard_normal((6000, 16))  # tight groups, each in one list
    v[::100] = rng.standard_normal((60, 16))  # the queries alone lie between them
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got = answers(spark, rows, 100)
    hits = 0
    for q in range(0, 6000, 100):
        gaps = np.sqrt(np.square(v - v[q]).sum(1))
        gaps[q] = np.inf
        hits += len({j for _, _, j in got[q]} & set(np.argsort(gaps)[:10].tolist()))
    assert hits / 600 >= 0.9


def test_a_query_on_a_centroid_reads_its_surroundings():
    rng = np.random.default_rng(4)
    index = ann.build(rng.standard_normal((2000, 4)), 100)
    ids, near = ann.chosen(index, index.centre[:20] * index.unit, 12.0, np.full(100, 1 << 20), 10)
    assert (near.sum(1) > 1).mean() >= 0.8


def test_a_small_table_is_compared_whole(spark):
    v = np.random.default_rng(6).standard_normal((700, 32))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    got, want = answers(spark, rows, 100), brute(rows, lambda i: i % 100 == 0, 10)
    assert {q: [j for _, _, j in found] for q, found in got.items()} == {q: [j for _, j in scored] for q, (scored,) in want.items()}
