"""Spelling variants: k-d trees over letter counts, then letter order.

One inserted or deleted letter changes one letter count by one, one replaced letter raises one count and lowers another, so
near words lie within an L1 distance of two. For every word length a k-d tree over the 90 letter counts is cut from a
bounded sample; it only deals words out to leaves, so results do not depend on it. A word searches the tree of its own
length (one count up, one down) and the tree of the next length (one count up). A search crosses a splitting plane
only where a single count change reaches the other side, once in each direction. In a leaf a
finer tree over all its words does the same, and what is left is compared letter by letter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop_table, materialise, partitions_for

#: Least length and number of a word, and how many times more often its form occurs.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: One occurrence in so many is misspelt by the query's rule.
EVERY = 31
#: Words from which the trees are cut; words and letters of a block of a leaf; words of a leaf of a block's own tree.
SAMPLE, BLOCK_WORDS, BLOCK_LETTERS, BUCKET = 65_536, 16_384, 4_000_000, 384
#: Least sampled words of a leaf, and words that search together.
LEAF_SAMPLE, BATCH = 24, 8_192

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters a-z, then U+00C0 to U+00FF.
LETTERS = 26 + 64


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = 1) -> DataFrame:
    """One row an occurrence of a maximal run of so many letters: (doc, run), only A-Z lower-cased. Null texts have none."""
    pattern = F.lit(f"([A-Za-zÀ-ÿ]{{{least_length},}})")
    runs = docs.select(F.col(key).alias("doc"), F.explode(F.regexp_extract_all(F.col(text), pattern, F.lit(1))).alias("run"))
    return runs.select("doc", F.translate("run", _UPPER, _LOWER).alias("run"))


def misspelt(doc: Column, run: Column, every: int = EVERY) -> Column:
    """The run without letter ``h % length`` where ``every`` divides ``h``, the crc32 of ``doc:run``; a null doc is empty."""
    h = F.crc32(F.concat(F.coalesce(doc.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, every: int | None = EVERY) -> DataFrame:
    """Distinct words with their number of occurrences ``n``, counted before the shuffle as well as behind it."""
    found = occurrences(docs, key, text, least_length)
    word = misspelt(F.col("doc"), F.col("run"), every) if every else F.col("run")
    return found.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def letter_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letter numbers of all words, one behind the other, and the words' lengths."""
    raw = np.frombuffer("".join(words).encode("utf-16-le", "surrogatepass"), "<u2").astype(np.int32)
    return np.where(raw < 0xC0, raw - ord("a"), raw - 0xC0 + 26), np.fromiter(map(len, words), np.int64, len(words))


def letter_counts(words: list[str]) -> np.ndarray:
    codes, sizes = letter_codes(words)
    row = np.repeat(np.arange(len(words)), sizes)
    kind = np.int16 if len(words) and sizes.max() < 1 << 15 else np.int32
    return np.bincount(row * LETTERS + codes, minlength=len(words) * LETTERS).reshape(len(words), LETTERS).astype(kind)


class Tree:
    """K-d tree over letter counts; inner nodes send counts up to the cut left, leaves are numbered from ``first``."""

    def __init__(self, counts: np.ndarray, leaf: int, first: int = 0):
        self.letter: list[int] = []
        self.cut: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaf: list[int] = []
        self.rows: dict[int, np.ndarray] = {}
        self.first = self.leaves = first
        self._grow(counts, leaf)

    def _grow(self, counts: np.ndarray, most: int) -> None:
        waiting = [(np.arange(len(counts)), -1, False)]
        while waiting:
            rows, parent, right = waiting.pop()
            node = len(self.letter)
            if parent >= 0:
                (self.right if right else self.left)[parent] = node
            found = self._split(counts, rows) if len(rows) > most else None
            letter, cut = found if found else (-1, 0)
            self.letter.append(letter)
            self.cut.append(cut)
            self.left.append(-1)
            self.right.append(-1)
            self.leaf.append(-1 if found else self.leaves)
            if found:
                low = counts[rows, letter] <= cut
                waiting += [(rows[~low], node, True), (rows[low], node, False)]
            else:
                self.rows[self.leaves] = rows
                self.leaves += 1

    @staticmethod
    def _split(counts: np.ndarray, rows: np.ndarray) -> tuple[int, int] | None:
        """Letter and cut that halve the rows best, None if all counts are equal."""
        own = counts[rows]
        best, found = len(rows), None
        middle = np.sort(own, axis=0, kind="stable")[(len(rows) - 1) // 2]
        for cut in (middle, middle - 1):
            uneven = np.abs(2 * (own <= cut).sum(axis=0) - len(rows))
            letter = int(np.argmin(uneven))
            if uneven[letter] < best:
                best, found = int(uneven[letter]), (letter, int(cut[letter]))
        return found

    def find(self, counts: np.ndarray) -> np.ndarray:
        """Leaf of every row."""
        out = np.zeros(len(counts), np.int64)
        for leaf, rows in self.search(counts, 0, 0):
            out[rows] = leaf
        return out

    def search(self, counts: np.ndarray, up: int, down: int) -> Iterator[tuple[int, np.ndarray]]:
        """Leaves, and the rows for which they can hold counts that differ by at most one raised (``up``) and one lowered (``down``) letter.

        A plane is crossed where the letter's count is next to it: a second raise or a count further away leaves the box of
        what can be near. Crossing the same letter's planes twice in one direction would need two steps.
        """
        waiting = [(0, np.arange(len(counts)), np.full(len(counts), up, np.int8), np.full(len(counts), down, np.int8))]
        while waiting:
            node, rows, ups, downs = waiting.pop()
            if not len(rows):
                continue
            if self.leaf[node] >= 0:
                yield self.leaf[node], rows
                continue
            value, cut = counts[rows, self.letter[node]], self.cut[node]
            inside = value <= cut
            left, right = inside | ((value == cut + 1) & (downs > 0)), ~inside | ((value == cut) & (ups > 0))
            waiting.append((self.left[node], rows[left], ups[left], (downs - ~inside)[left]))
            waiting.append((self.right[node], rows[right], (ups - inside)[right], downs[right]))


def cut_trees(sample: list[str], leaf: int) -> dict[int, Tree]:
    """A tree for every length of the sample's words; leaves are numbered through."""
    by_length: dict[int, list[str]] = {}
    for w in sample:
        by_length.setdefault(len(w), []).append(w)
    trees, first = {}, 1
    for length in sorted(by_length):
        trees[length] = Tree(letter_counts(by_length[length]), leaf, first)
        first = trees[length].leaves
    return trees


def replaced_once(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rows of two letter tables of the same width that differ in exactly one place."""
    return (a != b).sum(axis=1) == 1


def inserted_once(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of ``long`` (one letter more) that give the row of ``short`` without one of their letters."""
    width = short.shape[1]
    differs = np.concatenate([short != long[:, :-1], np.ones((len(short), 1), bool)], axis=1)
    behind = short != long[:, 1:]
    last = np.where(behind.any(axis=1), width - 1 - np.argmax(behind[:, ::-1], axis=1), -1)
    return differs.argmax(axis=1) > last


def by_length(words: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for length in np.unique(sizes).tolist():
        yield length, np.flatnonzero(sizes == length)


class Block:
    """Words of one length, or a part of one leaf's, with their own finer tree."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, np.array(n, np.int64)
        counts = letter_counts(words)
        self.codes = letter_codes(words)[0].reshape(len(words), -1).astype(np.int8)
        self.tree = Tree(counts, BUCKET)
        self.kind = _exact_floats(counts)
        self.parts = {leaf: (rows, *self._used(counts[rows])) for leaf, rows in self.tree.rows.items()}

    def _used(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        letters = np.flatnonzero(counts.any(axis=0))
        own = counts[:, letters].astype(self.kind)
        return letters, own, np.square(own).sum(axis=1)

    def near(self, words: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
        """Places of near pairs: among ``words`` (of the same length, or one shorter) and in the block.

        One letter raised and one lowered is a squared distance of two between words of the same length, one raised is a
        squared distance of one to the next length, and nothing else is.
        """
        counts = letter_counts(words)
        codes = letter_codes(words)[0].reshape(len(words), -1).astype(np.int8)
        floats = counts.astype(np.promote_types(self.kind, _exact_floats(counts)))
        norms = np.square(floats).sum(axis=1)
        mine, theirs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, 2_000_000 // max(1, codes.shape[1]))
        for leaf, rows in self.tree.search(counts, 1, int(same)):
            own, letters, held, size = self.parts[leaf]
            for i in range(0, len(rows), 2048):
                part = rows[i : i + 2048]
                gap = size[None, :] - 2 * (floats[part][:, letters] @ held.T)
                q, h = np.nonzero(gap == ((2 if same else 1) - norms[part])[:, None])
                for k in range(0, len(q), step):
                    a, b = part[q[k : k + step]], own[h[k : k + step]]
                    good = replaced_once(codes[a], self.codes[b]) if same else inserted_once(codes[a], self.codes[b])
                    mine.append(a[good])
                    theirs.append(b[good])
        return np.concatenate(mine), np.concatenate(theirs)


def _exact_floats(counts: np.ndarray) -> type:
    """Floats that hold sums of squares of these counts exactly."""
    return np.float32 if counts.shape[0] and np.square(counts.astype(np.float64)).sum(axis=1).max() < 1 << 21 else np.float64


_NEAR = "word string, near long, form_n long, form string"
_NEAR_ARROW = pa.schema([("word", pa.string()), ("near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])


def _summed(words: list[str], n: np.ndarray, own: np.ndarray, others: list[str], m: np.ndarray, at: np.ndarray, ratio: int) -> pa.RecordBatch:
    """Per word of ``own``: its near words ``at`` among ``others``, and the best (most frequent, then smallest) with ``ratio`` times its n."""
    number = np.bincount(own, minlength=len(words))
    met = np.flatnonzero(number)
    best: dict[int, tuple[int, str]] = {}
    frequent = m[at] >= ratio * n[own]
    for i, j in zip(own[frequent].tolist(), at[frequent].tolist()):
        new = (-int(m[j]), others[j])
        if i not in best or new < best[i]:
            best[i] = new
    forms = [best.get(i) for i in met.tolist()]
    columns = [pa.array([words[i] for i in met.tolist()], pa.string()), pa.array(number[met], pa.int64()), pa.array([f and -f[0] for f in forms], pa.int64()), pa.array([f and f[1] for f in forms], pa.string())]
    return pa.RecordBatch.from_arrays(columns, schema=_NEAR_ARROW)


def _search_blocks(ratio: int):
    """Over a sorted partition: the words of a block come first, then the words that search it, in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, block, home = None, None, ([], [])
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH):
                rows = whole.slice(first, BATCH)
                place = np.stack([np.asarray(rows.column(i)) for i in range(4)], axis=1)
                all_words, all_n = rows.column(4).to_pylist(), np.asarray(rows.column(5))
                starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(axis=1)]))
                for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(place)]):
                    *now, role = place[a].tolist()
                    if now != here:
                        here, block, home = now, None, ([], [])
                    if role == 0:
                        home[0].extend(all_words[a:b])
                        home[1].extend(all_n[a:b].tolist())
                        continue
                    if not home[0]:
                        continue  # no word of that length in the leaf
                    block = block or Block(*home)
                    step = max(1, BLOCK_LETTERS // max(1, here[0]))
                    for k in range(a, b, step):
                        words, n = all_words[k : min(b, k + step)], all_n[k : min(b, k + step)]
                        mine, theirs = block.near(words, role == 1)
                        if len(mine):
                            yield _summed(words, n, mine, block.words, block.n, theirs, ratio)
                            if role == 2:
                                yield _summed(block.words, block.n, theirs, words, n, mine, ratio)

    return run


def near_words(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word that has near ones: ``near`` (their number), ``form`` and ``form_n``: the one with the largest n (ties: smallest) if that is ``ratio`` times its own.

    ``words`` has distinct, non-empty ``word`` of letters a-z and U+00C0 to U+00FF, and ``n``. Every pair of words that differ by exactly one
    inserted, deleted or replaced letter is found. A leaf with many words is dealt out to blocks by hash.
    """
    spark = words.sparkSession
    total = words.count()
    share = min(1.0, SAMPLE / max(1, total))
    sample = [r[0] for r in words.where(F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int(share * (1 << 20))).select("word").collect()]
    trees = cut_trees(sample, max(LEAF_SAMPLE, int(BLOCK_WORDS * share)))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH):
                batch = whole.slice(first, BATCH)
                own = batch.column(0).to_pylist()
                leaf = np.zeros(len(own), np.int32)
                for length, rows in by_length(own):
                    if length in trees:
                        leaf[rows] = trees[length].find(letter_counts([own[i] for i in rows]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([len(w) for w in own], pa.int32()), pa.array(leaf)], names=["word", "n", "length", "leaf"])

    placed = materialise(words.select("word", "n").mapInArrow(home, "word string, n long, length int, leaf int"), "spelling-leaves")
    blocks: dict[tuple[int, int], int] = {}  # leaves of the sampled trees, and leaf 0 of the lengths that the sample lacks
    sizes = placed.groupBy("length", "leaf").count().where(F.col("count") > F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), F.floor(F.lit(BLOCK_LETTERS) / F.col("length")))))
    for length, leaf, count in sizes.collect():
        blocks[length, leaf] = -(-count // max(1, min(BLOCK_WORDS, BLOCK_LETTERS // length)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, BATCH):
                batch = whole.slice(first, BATCH)
                own = batch.column(0).to_pylist()
                leaves, hashes = np.asarray(batch.column(3)), np.asarray(batch.column(4))
                at, to, parts, roles, lengths = [], [], [], [], []

                def send(rows: np.ndarray, length: int, leaf: int, role: int) -> None:
                    number = blocks.get((length, leaf), 1)
                    for part in range(number):
                        mine = rows[hashes[rows] % number == part] if role == 0 else rows
                        at.append(mine)
                        for column, value in ((to, leaf), (parts, part), (roles, role), (lengths, length)):
                            column.append(np.full(len(mine), value, np.int32))

                for length, rows in by_length(own):
                    for leaf in np.unique(leaves[rows]).tolist():
                        send(rows[leaves[rows] == leaf], length, leaf, 0)
                    counts = letter_counts([own[i] for i in rows])
                    for role, goal, down in ((1, length, 1), (2, length + 1, 0)):
                        if goal not in trees:
                            send(rows, goal, 0, role)
                            continue
                        for leaf, found in trees[goal].search(counts, 1, down):
                            send(rows[found], goal, leaf, role)
                take = np.concatenate(at)
                columns = [np.concatenate(c) for c in (lengths, to, parts, roles)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), batch.column(0).take(pa.array(take)), batch.column(1).take(pa.array(take))], names=["length", "leaf", "block", "role", "word", "n"])

    dealt = placed.withColumn("h", F.pmod(F.xxhash64("word", F.lit(7)), F.lit(1 << 40))).mapInArrow(deal, "length int, leaf int, block int, role int, word string, n long")
    order = ["length", "leaf", "block"]
    found = dealt.repartition(partitions_for(spark), *order).sortWithinPartitions(*order, "role").mapInArrow(_search_blocks(ratio), _NEAR)
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))))
    out = materialise(found.groupBy("word").agg(F.sum("near").alias("near"), best.alias("best")).select("word", "near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")), "spelling-near")
    drop_table(placed)
    return out


def group(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``words`` has distinct ``word`` and ``n``. ``form`` is the near word with the largest n (ties: smallest in code-point
    order) if that is at least ``ratio`` (over 1) times the word's own, else null; ``root`` is what following forms ends at, the word itself without
    a form. Every step multiplies n by ``ratio`` at least, so the doubled steps below reach the end of any chain of 64-bit counts.
    """
    if ratio < 2:
        raise ValueError("a form must be at least twice as frequent, or chains need not end")
    near = near_words(words, ratio)
    known = materialise(words.join(near, "word", "left").select("word", "n", F.coalesce("near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n"), "spelling-forms")
    steps = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    reach, most = 1, int(np.ceil(63 / np.log2(ratio)))
    while reach < most:
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialise(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling-roots")
        reach *= 2
    out = known.join(steps, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, every: int | None = EVERY) -> DataFrame:
    """``group`` over the ``vocabulary`` of whole texts.

    Words are runs of letters a-z, A-Z (lower-cased) and U+00C0 to U+00FF with at least ``least_length`` letters that occur ``least_count``
    times; with ``every`` some occurrences are misspelt first (``misspelt``). A null or empty text has no words, a very long run is one word,
    a null key counts as empty text, repeated rows count again, an empty table gives no rows, and other columns are not read, so their
    names cannot clash.
    """
    return group(materialise(vocabulary(docs, key, text, least_length, least_count, every), "spelling-words"), ratio)
