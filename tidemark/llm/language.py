"""Language ID: interpolated Kneser-Ney character models, one per language.

Letters are folded to ``CLASSES`` classes (a-z, a hash class for any other letter, one class for
every run of anything else), so a model of order 3 has at most ``CLASSES ** 3`` = 262,144
entries per language whatever the corpus is; that bound is what makes it safe to send the models to every task. Counts are taken over
all learning rows. The models lie in sorted hash arrays: the keys of all n-grams seen in any
language, and a row of log-probabilities of each language beside every key; n-grams seen in none
back off through arrays of the order below.

The language with the lowest cross-entropy per symbol wins. A text is accepted when that cross-entropy is not
above what the language's own learning rows of like length show (mean plus ``SIGMAS`` standard
deviations, ``MARGIN`` bits at least).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import mix64, tidy

CLASSES = 64
#: More languages than this are refused: the models would outgrow a task (about 1 MB a language).
MAX_LANGUAGES = 200
SIGMAS, MARGIN = 8.0, 1.5
#: Code points scored at once.
CHUNK = 1_000_000

UNKNOWN = "und"


@lru_cache(maxsize=1)
def _folding() -> np.ndarray:
    """Class of every code point: 0 no letter, 1-26 a-z in either case, else a hash class of the lower-case letter."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            code = ord(low[0]) if len(low) == 1 else c
            out[c] = code - 96 if 97 <= code <= 122 else 27 + (code * 2654435761 % 2**32 >> 7) % (CLASSES - 27)
    return out


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Folded symbols of all texts, each text between two gaps, and the bounds of each text's own symbols.

    A text's symbols run from its first one to the gap that closes it; a text without letters has none.
    """
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    joined = "\n".join([t or "" for t in texts]) + "\n"
    kind = _folding()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    ends = np.cumsum(sizes + 1)  # just behind the line feed that closes each text
    keep = np.ones(len(kind), bool)
    keep[1:] = (kind[1:] != 0) | (kind[:-1] != 0)
    keep[0] = kind[0] != 0
    # every text keeps exactly one closing gap, so the next one starts behind a gap
    before = np.concatenate([[0], np.cumsum(keep)])
    count = before[ends] - before[ends - sizes - 1]
    stream = kind[keep]
    bounds = np.stack([before[ends] - count, before[ends]], 1)
    return stream, bounds


def _keys(stream: np.ndarray) -> np.ndarray:
    """Packed trigram that ends at each symbol; before the first symbol lie two gaps."""
    s = stream.astype(np.int32)
    k = s.copy()
    k[1:] += s[:-1] * CLASSES
    k[2:] += s[:-2] * CLASSES**2
    return k


def _text_keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Trigrams of all texts and each text's bounds; no trigram reaches into the text before."""
    stream, bounds = symbols(texts)
    keys = _keys(stream)
    first = bounds[:, 0][bounds[:, 1] > bounds[:, 0]]
    if len(first):
        keys[first] = stream[first]  # after two gaps
        second = first + 1
        second = second[second < len(keys)]
        keys[second] = stream[second].astype(np.int32) + stream[second - 1].astype(np.int32) * CLASSES
        # a text's second symbol follows its first and the gap before it
    return keys, bounds


def kneser_ney(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From trigram counts ``[u, v, w]``: probabilities of trigrams, of bigrams, and the weight with which ``u v`` backs off."""

    def discount(c: np.ndarray) -> float:
        n1, n2 = float((c == 1).sum()), float((c == 2).sum())
        return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5

    seen = (counts > 0).astype(np.float64)
    c2 = seen.sum(0)  # contexts before each bigram
    c1 = (c2 > 0).astype(np.float64).sum(0)
    d3, d2, d1 = discount(counts), discount(c2), discount(c1)
    p1 = np.maximum(c1 - d1, 0) / max(c1.sum(), 1) + d1 * (c1 > 0).sum() / max(c1.sum(), 1) / CLASSES if c1.sum() else np.full(CLASSES, 1 / CLASSES)
    t2 = c2.sum(1, keepdims=True)
    back2 = np.where(t2 > 0, d2 * (c2 > 0).sum(1, keepdims=True) / np.maximum(t2, 1), 1.0)
    p2 = np.maximum(c2 - d2, 0) / np.maximum(t2, 1) + back2 * p1
    t3 = counts.sum(2, keepdims=True)
    back3 = np.where(t3 > 0, d3 * seen.sum(2, keepdims=True) / np.maximum(t3, 1), 1.0)
    p3 = np.maximum(counts - d3, 0) / np.maximum(t3, 1) + back3 * p2
    return p3, p2, back3[:, :, 0]


@dataclass
class Models:
    """Languages in order of name, with their arrays and the calibrated limits."""

    languages: list[str]
    keys: np.ndarray  # sorted hashes of the trigrams seen in any language
    bits: np.ndarray  # [key, language] -log2 of their probability
    low_keys: np.ndarray  # sorted hashes of all bigrams
    low_bits: np.ndarray  # [bigram, language] -log2 of the bigram
    back_bits: np.ndarray  # [bigram, language] -log2 of the weight with which it backs off
    limits: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # [language, length class]

    def table(self) -> np.ndarray:
        """[trigram, language] bits of every possible trigram, probed once in the sorted arrays."""
        every = np.arange(CLASSES**3, dtype=np.uint64)
        digest = mix64(every)
        at = np.minimum(np.searchsorted(self.keys, digest), max(0, len(self.keys) - 1))
        pair = np.searchsorted(self.low_keys, mix64(every % np.uint64(CLASSES**2)))
        context = np.searchsorted(self.low_keys, mix64(every // np.uint64(CLASSES)))
        out = self.low_bits[pair] + self.back_bits[context]
        if len(self.keys):
            hit = self.keys[at] == digest
            out[hit] = self.bits[at[hit]]
        return out.astype(np.float32)


def build(languages: list[str], counts: dict[str, np.ndarray]) -> Models:
    pairs = np.arange(CLASSES**2, dtype=np.uint64)
    order2 = np.argsort(mix64(pairs))
    seen = np.zeros(CLASSES**3, bool)
    p3s, p2s, backs = [], [], []
    for name in languages:
        p3, p2, back = kneser_ney(counts[name].reshape(CLASSES, CLASSES, CLASSES).astype(np.float64))
        seen |= counts[name] > 0
        p3s.append(-np.log2(p3.ravel()))
        p2s.append(-np.log2(p2.ravel()))
        backs.append(-np.log2(np.maximum(back.ravel(), 1e-12)))
    at = np.flatnonzero(seen).astype(np.uint64)
    digest = mix64(at)
    order3 = np.argsort(digest)
    stack = lambda arrays, pick: np.stack([a[pick] for a in arrays], 1).astype(np.float32) if arrays else np.zeros((len(pick), 0), np.float32)
    return Models(languages, digest[order3], stack(p3s, at[order3].astype(np.int64)), mix64(pairs)[order2], stack(p2s, order2), stack(backs, order2))


def _length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(20, np.log2(np.maximum(n, 1)).astype(np.int64))


def cross_entropies(texts: list[str | None], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits per symbol of every text under each language, and its number of symbols (0: no letter)."""
    out, sizes = [], []
    at = 0
    while at < len(texts):
        end, total = at, 0
        while end < len(texts) and (end == at or total + len(texts[end] or "") <= CHUNK):
            total += len(texts[end] or "")
            end += 1
        keys, bounds = _text_keys(texts[at:end])
        n = bounds[:, 1] - bounds[:, 0]
        sums = np.zeros((end - at, table.shape[1]))
        some = np.flatnonzero(n)
        if len(some):
            # texts follow each other without holes, so each sum ends where the next begins
            for language in range(table.shape[1]):
                sums[some, language] = np.add.reduceat(table[:, language][keys], bounds[some, 0], dtype=np.float64)
        out.append(sums / np.maximum(n, 1)[:, None])
        sizes.append(n)
        at = end
    return (np.concatenate(out) if out else np.zeros((0, table.shape[1]))), (np.concatenate(sizes) if sizes else np.zeros(0, np.int64))


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key as text (null: empty) leaves ``fold``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == fold


def fit(docs: DataFrame, learn: Column, text: str = "text", lang: str = "lang") -> Models:
    """Models of every non-null ``lang`` of the rows that ``learn`` marks, over their whole texts.

    Two passes over those rows: trigram counts (summed per task, then over tasks) and the limits of
    acceptance. Rows without a letter teach nothing. Without learning rows there is no language.
    """
    rows = docs.where(learn & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), object)
            texts = batch.column(1).to_pylist()
            for name in set(names.tolist()):
                own = total.setdefault(name, np.zeros(CLASSES**3, np.int64))
                held: list[str | None] = []
                size = 0
                for i in np.flatnonzero(names == name).tolist():
                    held.append(texts[i])
                    size += len(texts[i] or "")
                    if size > CHUNK:
                        _add(own, held)
                        held, size = [], 0
                _add(own, held)
        for name, own in total.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used), pa.string()), pa.array(used, pa.int64()), pa.array(own[used], pa.int64())], names=["lang", "gram", "n"])

    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    counts = {name: np.zeros(CLASSES**3, np.int64) for name in languages}
    # at most CLASSES ** 3 rows for each language
    summed = rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names, grams, ns = (summed.column(i) for i in range(3))
    where = np.array(names.to_pylist(), object)
    for name in languages:
        own = where == name
        counts[name][np.asarray(grams)[own]] = np.asarray(ns)[own]
    models = build(languages, counts)
    models.limits = _limits(rows, models)
    return models


def _add(total: np.ndarray, texts: list[str | None]) -> None:
    keys, bounds = _text_keys(texts) if texts else (np.zeros(0, np.int32), np.zeros((0, 2), np.int64))
    if len(keys) and len(bounds):
        total += np.bincount(keys, minlength=CLASSES**3)


def _limits(rows: DataFrame, models: Models) -> np.ndarray:
    """Highest accepted bits per symbol of each language and class of length, from all learning rows."""
    names = models.languages
    if not names:
        return np.zeros((0, 21))
    packed = rows.sparkSession.sparkContext.broadcast(models)

    @tidy
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = packed.value.table()
        place = {n: i for i, n in enumerate(packed.value.languages)}
        total = np.zeros((3, len(place) * 21))
        for batch in batches:
            bits, n = cross_entropies(batch.column(1).to_pylist(), table)
            own = np.fromiter((place[x] for x in batch.column(0).to_pylist()), np.int64, batch.num_rows)
            some = np.flatnonzero(n)
            b = bits[some, own[some]]
            cell = own[some] * 21 + _length_class(n[some])
            for i, w in enumerate((np.ones(len(b)), b, b * b)):
                total[i] += np.bincount(cell, w, len(place) * 21)
        used = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), *[pa.array(t[used]) for t in total]], names=["cell", "n", "s", "q"])

    sums = np.zeros((3, len(names) * 21))
    for r in rows.mapInArrow(measure, "cell long, n double, s double, q double").groupBy("cell").agg(F.sum("n"), F.sum("s"), F.sum("q")).collect():
        sums[:, r[0]] = r[1:]
    n, s, q = sums.reshape(3, len(names), 21)
    every = s.sum(1) / np.maximum(n.sum(1), 1)
    mean = np.where(n > 0, s / np.maximum(n, 1), every[:, None])
    spread = np.sqrt(np.maximum(q / np.maximum(n, 1) - mean**2, 0))
    spread = np.where(n >= 30, spread, np.max(np.where(n >= 30, spread, 0), 1, keepdims=True) + 0.5)
    return mean + np.maximum(SIGMAS * spread, MARGIN)


def identify(docs: DataFrame, models: Models, text: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1), ``lang_bits`` (per symbol) and ``accepted``, their names behind ``prefix``. No shuffle.

    A null text and one without a letter get ``und``, score 0, no bits, and are not accepted; so does every text when no
    language was learned. Equal cross-entropies go to the first language by name. Very long texts are scored whole, repeated rows
    get equal results, an empty table stays empty; columns of these four names are replaced, all others are kept whatever their names.
    """
    spark = docs.sparkSession
    kinds = {"lang_pred": T.StringType(), "score": T.DoubleType(), "lang_bits": T.DoubleType(), "accepted": T.BooleanType()}
    added = [T.StructField(prefix + name, kind) for name, kind in kinds.items()]
    kept = docs.drop(*[f.name for f in added])
    packed = spark.sparkContext.broadcast(models)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = packed.value
        table = m.table()
        for batch in batches:
            bits, n = cross_entropies(batch.column(batch.schema.get_field_index(text)).to_pylist(), table)
            known = (n > 0) & bool(m.languages)
            best = bits.argmin(1) if m.languages else np.zeros(len(n), np.int64)
            low = bits[np.arange(len(n)), best] if m.languages else np.zeros(len(n))
            # symbols of a text are far from independent; a hundred of them count at most
            odds = np.exp2(-(bits - low[:, None]) * np.minimum(n, 100)[:, None]).sum(1)
            score = np.where(known, 1 / np.maximum(odds, 1), 0.0)
            good = known & (low <= m.limits[best, _length_class(n)]) if m.languages else known
            names = [m.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())]
            columns = [pa.array(names, pa.string()), pa.array(score), pa.array(np.where(known, low, 0.0), mask=~known), pa.array(good)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *[f.name for f in added]])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, *added]))
