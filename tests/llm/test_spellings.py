"""Spelling variants against all pairs of a small vocabulary."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import spellings


def one_apart(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(count: dict[str, int], ratio: int = 10) -> list[tuple]:
    near = {w: [v for v in count if v != w and one_apart(v, w)] for w in count}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-count[v], v), default=None)
        form[w] = best if best is not None and count[best] >= ratio * count[w] else None
    out = []
    for w in count:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, count[w], len(near[w]), count[form[w]] if form[w] else None))
    return sorted(out)


def words_of(rows, least=7, times=2, every=31) -> dict[str, int]:
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= least:
                count[run] += 1
    return {w: n for w, n in count.items() if n >= times}


COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeé×ñst") for _ in range(rng.randrange(6, 13))) for _ in range(60)]
    rows = []
    for doc in range(220):
        picked = [rng.choice(base[: 8 if rng.random() < 0.5 else 60]) for _ in range(rng.randrange(1, 60))]
        rows.append((doc, " ".join(w.upper() if rng.random() < 0.1 else w for w in picked) + rng.choice(["", ".", "1x\n"])))
    huge = "abcdefgh" * 5_000
    rows += [(900, None), (901, ""), (902, "short"), (903, huge), (904, huge), (905, huge[:-1]), (906, huge[:-1]), (None, "unclaimed unclaimed"), (7, rows[7][1]), (7, rows[7][1])]
    return rows


@pytest.mark.parametrize("every", [31, 3, None])
def test_variants_equal_all_pairs(spark, rows, every):
    docs = spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], "doc_id long, text string, word string, n int, root string")
    got = spellings.variants(docs, every=every)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == grouped(words_of(rows, every=every))


def test_blocks_and_anagrams(spark, monkeypatch):
    """One third of the words have the same letters, leaves are dealt to several blocks, and lengths are missing in the sample."""
    for name, value in (("SAMPLE", 120), ("LEAF_SAMPLE", 3), ("BLOCK_WORDS", 16), ("BUCKET", 3)):
        monkeypatch.setattr(spellings, name, value)
    rng = random.Random(2)
    words = {"".join(p) for p in itertools.islice(itertools.permutations("abcdefg"), 150)}
    while len(words) < 450:
        words.add("".join(rng.choice("abc") for _ in range(rng.randrange(5, 10))))
    count = {w: rng.choice([2, 3, 40, 700]) for w in sorted(words)}
    got = spellings.group(spark.createDataFrame(list(count.items()), "word string, n long"))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == grouped(count)


def test_nothing_to_group(spark):
    assert spellings.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert spellings.variants(spark.createDataFrame([(1, "nothing occurs repeatedly")], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        spellings.group(spark.createDataFrame([("a", 1)], "word string, n long"), ratio=1)


def test_tree_search_reaches_every_near_count():
    rng = np.random.default_rng(4)
    counts = rng.poisson(0.4, (600, spellings.LETTERS)).astype(np.int32)
    tree = spellings.Tree(counts, 5)
    assert sorted(np.concatenate(list(tree.rows.values())).tolist()) == list(range(600))
    leaf = tree.find(counts)
    queries = counts[:200].copy()
    for q in queries:
        q[rng.integers(0, spellings.LETTERS)] += 1
        lowered = rng.choice(np.flatnonzero(q))
        q[lowered] -= 1
    met = {(leaf_, r) for leaf_, rows in tree.search(queries, 1, 1) for r in rows.tolist()}
    for i in range(200):
        gap = counts - queries[i]
        for j in np.flatnonzero((np.maximum(gap, 0).sum(1) <= 1) & (np.maximum(-gap, 0).sum(1) <= 1)):
            assert (int(leaf[j]), i) in met


def test_letter_order():
    pairs = [("abcd", "abxcd", True), ("abcd", "abcde", True), ("abcd", "zabcd", True), ("aabb", "aaabb", True), ("abcd", "axbdc", False), ("abab", "baabb", False)]
    for a, b, want in pairs:
        x, y = (spellings.letter_codes([w])[0].reshape(1, -1) for w in (a, b))
        assert bool(spellings.inserted_once(x, y)[0]) is want is one_apart(a, b)
