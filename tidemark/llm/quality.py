"""Quality classifier: a linear-chain conditional random field over the lines of a document.

Every line is good or bad. Its potential adds weights of its own binned features and of those of
the lines before and after; neighbouring labels add a transition weight. Forward and backward
passes give each line's marginal, and the marginals, weighted by line length, give the document's
share of bad text, which a calibrated logistic turns into the score.

Training knows documents only. All lines start with their document's label; after a first fit
the lines of bad documents that the field takes for good ones are relabelled and the field is fitted again.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import mix64, text_arrays, tidy
from tidemark.llm.shingles import word_hashes

#: Labelled documents that the field is fitted on: those with the smallest hash of the key.
SAMPLE = 6_000
#: Lines of one training sequence; longer documents give several.
SEQUENCE = 256
BINS = 12
#: Quantiles between the bins of a feature; close together at both ends, where bad lines are.
QUANTILES = (0.005, 0.03, 0.1, 0.3, 0.7, 0.9, 0.94, 0.96, 0.975, 0.987, 0.995)
#: Bytes whose features are computed at once.
CHUNK = 1_000_000

#: Byte classes: upper, lower, digit, white space, full stop or comma, bar, other ASCII mark, the rest.
_CLASS = np.full(256, 7, np.uint8)
_CLASS[:128] = 6
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_CLASS[[0x20, *range(0x09, 0x0E)]] = 3
_CLASS[[0x2E, 0x2C]] = 4
_CLASS[0x7C] = 5

FEATURES = ("words", "word_size", "upper", "digits", "stops", "bars", "marks", "foreign", "distinct", "doubled", "repeated", "lines")


def line_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature matrix of all lines of a batch of texts, the lines' sizes in bytes and each text's bounds.

    A null or empty text is one empty line.
    """
    raw, offsets = text_arrays(column)
    n = len(column)
    feeds = np.flatnonzero(raw == 0x0A)
    # a line begins at each text's start and behind each line feed; a feed belongs to the line it closes
    doc_of_feed = np.searchsorted(offsets, feeds, "right") - 1
    order = np.argsort(np.concatenate([offsets[:-1] * 2, (feeds + 1) * 2 - 1]), kind="stable")
    starts = np.concatenate([offsets[:-1], feeds + 1])[order]
    docs = np.concatenate([np.arange(n), doc_of_feed])[order]
    # a feed at the very end of a text gives an empty last line at the next text's start; keep texts in order
    order = np.lexsort((np.arange(len(docs)), docs))
    starts, docs = starts[order], docs[order]
    per_doc = np.bincount(docs, minlength=n)
    bounds = np.concatenate([[0], np.cumsum(per_doc)])
    lines = len(starts)
    edges = np.concatenate([starts, [len(raw)]])
    sizes = np.diff(edges)
    counts = np.zeros((lines, 8), np.int64)
    if len(raw):
        some = np.flatnonzero(sizes > 0)
        kinds = _CLASS[raw]
        for k in range(8):
            counts[some, k] = np.add.reduceat(kinds == k, starts[some], dtype=np.int64)
    words, line = word_hashes(raw, edges) if len(raw) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    # word_hashes numbers empty lines and their successors alike by offset; take the last line that starts there
    n_words = np.bincount(line, minlength=lines)
    doubled = np.bincount(line[1:], (words[1:] == words[:-1]) & (line[1:] == line[:-1]), lines) if len(words) else np.zeros(lines)
    if len(words):
        order = np.lexsort((words, line))
        w, at = words[order], line[order]
        fresh = np.ones(len(w), bool)
        fresh[1:] = (w[1:] != w[:-1]) | (at[1:] != at[:-1])
        distinct = np.bincount(at, fresh, lines)
    else:
        distinct = np.zeros(lines)
    # a line's identity: its words with their places, inside its document
    place = np.arange(len(words)) - np.concatenate([[0], np.cumsum(n_words)])[:-1][line] if len(words) else np.zeros(0, np.int64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(words + mix64(place.astype(np.uint64))), dtype=np.uint64)]) if len(words) else np.zeros(1, np.uint64)
    ends = np.cumsum(n_words)
    identity = mix64(total[ends] - total[ends - n_words]) ^ mix64(docs.astype(np.uint64) + np.uint64(77))
    _, inverse, times = np.unique(identity, return_inverse=True, return_counts=True)
    repeated = (times[inverse] > 1) & (n_words > 0)
    letters = np.maximum(counts[:, 0] + counts[:, 1] + counts[:, 7], 1)
    visible = np.maximum(sizes - counts[:, 3], 1)
    per_word = np.maximum(n_words, 1)
    x = np.stack(
        [
            np.log2(n_words + 1),
            (sizes - counts[:, 3]) / per_word,
            counts[:, 0] / letters,
            counts[:, 2] / visible,
            counts[:, 4] / per_word,
            counts[:, 5] / per_word,
            counts[:, 6] / per_word,
            counts[:, 7] / letters,
            distinct / per_word,
            doubled / per_word,
            repeated.astype(float),
            np.log2(per_doc[docs]),
        ],
        1,
    )
    return x.astype(np.float32), sizes, bounds


@dataclass
class Field:
    """A fitted field: bin edges of every feature, weights for bad, transitions and the calibration."""

    edges: list[np.ndarray]
    own: np.ndarray  # [feature, bin]
    before: np.ndarray
    after: np.ndarray
    bias: float
    moves: np.ndarray  # [label, next label]
    scale: float = -6.0
    shift: float = 3.0


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Index of each feature's bin in the flattened weights."""
    return np.stack([np.searchsorted(e, x[:, k], "right") + k * BINS for k, e in enumerate(edges)], 1).astype(np.int32) if len(x) else np.zeros((0, len(edges)), np.int32)


def _shifted(bins: np.ndarray, bounds: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the neighbouring line, and whether there is one in the same text."""
    n = len(bins)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.arange(n) + step
    ok = (at >= 0) & (at < n)
    at = np.clip(at, 0, max(0, n - 1))
    ok &= text[at] == text if n else ok
    return bins[at] if n else bins, ok


def _potentials(field: Field, bins: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    score = field.own.ravel()[bins].sum(1) + field.bias
    for weights, step in ((field.before, -1), (field.after, 1)):
        other, ok = _shifted(bins, bounds, step)
        score += np.where(ok, weights.ravel()[other].sum(1), 0.0)
    return score


class _Lockstep:
    """Texts of a batch longest first, so that all their i-th lines are one array slice."""

    def __init__(self, bounds: np.ndarray):
        sizes = np.diff(bounds)
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        self.first = bounds[:-1][self.order]
        self.longest = int(self.sizes[0]) if len(sizes) else 0
        self.active = np.searchsorted(-self.sizes, -np.arange(self.longest), "left")


def marginals(potential: np.ndarray, moves: np.ndarray, bounds: np.ndarray, pairs: bool = False):
    """P(bad) of every line by forward and backward passes; with ``pairs`` also the expected transitions and the log-partition.

    Messages are kept as normalised probabilities, so a text of any length stays in range.
    """
    step = _Lockstep(bounds)
    n = len(potential)
    top = np.maximum(potential, 0)
    emit = np.stack([np.exp(-top), np.exp(potential - top)], 1)
    jump = np.exp(moves)
    ahead, behind = np.zeros((n, 2)), np.ones((n, 2))
    log_z = float(top.sum())
    for i in range(step.longest):
        m = step.active[i]
        at = step.first[:m] + i
        now = emit[at] if i == 0 else (ahead[at - 1] @ jump) * emit[at]
        total = now.sum(1, keepdims=True)
        ahead[at] = now / total
        if pairs:
            log_z += float(np.log(total).sum())
    expected = np.zeros((2, 2))
    for i in range(step.longest - 2, -1, -1):
        m = step.active[i + 1]
        at = step.first[:m] + i
        right = emit[at + 1] * behind[at + 1]
        now = right @ jump.T
        if pairs:
            joint = ahead[at][:, :, None] * jump[None] * right[:, None, :]
            expected += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
        behind[at] = now / now.sum(1, keepdims=True)
    both = ahead * behind
    bad = both[:, 1] / both.sum(1) if n else np.zeros(0)
    return (bad, expected, log_z) if pairs else bad


def _train(bins: np.ndarray, bounds: np.ndarray, labels: np.ndarray, edges: list[np.ndarray], rounds: int = 80, rate: float = 0.15, ridge: float = 1e-3) -> Field:
    """Maximum likelihood with a small ridge, by Adam over all sequences."""
    k = len(edges)
    field = Field(edges, np.zeros((k, BINS)), np.zeros((k, BINS)), np.zeros((k, BINS)), 0.0, np.zeros((2, 2)))
    near = [_shifted(bins, bounds, -1), _shifted(bins, bounds, 1)]
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    y = labels.astype(np.float64)
    inside = text[1:] == text[:-1] if len(text) else np.zeros(0, bool)
    a, b = labels[:-1][inside].astype(int), labels[1:][inside].astype(int)
    seen = np.bincount(a * 2 + b, minlength=4).reshape(2, 2).astype(float)
    size = 3 * k * BINS + 5
    m, v = np.zeros(size), np.zeros(size)
    theta = np.zeros(size)
    lines = max(1, len(bins))
    for t in range(1, rounds + 1):
        bad, expected, _ = marginals(_potentials(field, bins, bounds), field.moves, bounds, True)
        rest = y - bad
        grads = [np.bincount(bins.ravel(), np.repeat(rest, k), k * BINS)]
        for other, ok in near:
            grads.append(np.bincount(other.ravel(), np.repeat(rest * ok, k), k * BINS))
        grad = np.concatenate([*grads, [rest.sum()], (seen - expected).ravel()]) / lines - ridge * theta
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w = theta[: 3 * k * BINS].reshape(3, k, BINS)
        field.own, field.before, field.after = w
        field.bias = float(theta[-5])
        field.moves = theta[-4:].reshape(2, 2)
    return field


def _bad_share(bad: np.ndarray, sizes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the marginals of each text; an empty line weighs like one byte."""
    weight = np.maximum(sizes, 1).astype(np.float64)
    top = np.add.reduceat(bad * weight, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
    return top / np.add.reduceat(weight, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)


def learn_field(x: np.ndarray, sizes: np.ndarray, bounds: np.ndarray, good: np.ndarray) -> Field:
    """Fit on lines of labelled texts; ``good`` is each text's label."""
    edges = []
    for k in range(x.shape[1]):
        edges.append(np.unique(np.quantile(x[:, k], QUANTILES)))
    bins = _binned(x, edges)
    text = np.repeat(np.arange(len(good)), np.diff(bounds))
    cuts = [np.arange(a, b, SEQUENCE) for a, b in zip(bounds[:-1], bounds[1:])]
    pieces = np.concatenate([*cuts, [bounds[-1]]]).astype(np.int64)
    labels = (good[text] == 0).astype(np.int8)
    field = _train(bins, pieces, labels, edges)
    bad = marginals(_potentials(field, bins, pieces), field.moves, pieces)
    # in a bad text, lines that look good are good, but not its worst line
    worst = np.maximum.reduceat(bad, bounds[:-1])[text] if len(bad) else bad
    labels = ((labels == 1) & ((bad > 0.5) | (bad >= worst))).astype(np.int8)
    field = _train(bins, pieces, labels, edges)
    share = _bad_share(marginals(_potentials(field, bins, bounds), field.moves, bounds), sizes, bounds)
    field.scale, field.shift = _calibrate(share, good)
    return field


def _calibrate(share: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Logistic of the bad share for P(good), by damped Newton steps; the slope stays negative."""
    if not len(good) or good.min() == good.max():
        return -6.0, 3.0
    z = np.stack([share, np.ones(len(share))], 1)
    w = np.array([-4.0, 2.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (good - p) - 1e-2 * w
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        w = w + np.clip(np.linalg.solve(h, g), -2, 2)
    return min(float(w[0]), -0.1), float(w[1])


def score_texts(column: pa.Array, field: Field) -> np.ndarray:
    """P(good) of every text of a column."""
    out = []
    _, offsets = text_arrays(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1)
        x, sizes, bounds = line_features(column.slice(a, b - a))
        bins = _binned(x, field.edges)
        share = _bad_share(marginals(_potentials(field, bins, bounds), field.moves, bounds), sizes, bounds)
        out.append(1 / (1 + np.exp(-np.clip(field.scale * share + field.shift, -30, 30))))
        a = b
    return np.concatenate(out) if out else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Field | None:
    """A field from at most ``sample`` labelled documents that ``learn`` (over the key) marks; None without any.

    The sample is the labelled keys with the smallest hash, so it does not depend on partitions. Null keys and null
    labels teach nothing; a key labelled twice counts with its lower label. Features of the sample's
    lines are all that reaches the driver.
    """
    chosen = (
        labels.where(learn & F.col(key).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(key).alias("k"))
        .agg(F.min(label).cast("int").alias("good"))
        .orderBy(F.xxhash64("k"), "k")
        .limit(sample)
    )
    # bounded by ``sample`` rows of two numbers
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").select("k", "good", "t")

    @tidy
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, sizes, bounds = line_features(batch.column(2))
            packed = [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            weights = [sizes[a:b].astype("<i8").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(packed, pa.binary()), pa.array(weights, pa.binary())], names=["k", "good", "x", "sizes"])

    got = rows.mapInArrow(extract, "k long, good int, x binary, sizes binary").toArrow()
    if not got.num_rows:
        return None
    order = np.argsort(np.asarray(got.column("k")), kind="stable")
    xs, ws = got.column("x").to_pylist(), got.column("sizes").to_pylist()
    x = np.concatenate([np.frombuffer(xs[i], np.float32).reshape(-1, len(FEATURES)) for i in order])
    sizes = np.concatenate([np.frombuffer(ws[i], "<i8") for i in order])
    bounds = np.concatenate([[0], np.cumsum([len(ws[i]) // 8 for i in order])])
    return learn_field(x, sizes, bounds, np.asarray(got.column("good"))[order].astype(float))


def add_score(docs: DataFrame, field: Field | None, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the quality score of every whole text, 0 to 1 (higher: better). No shuffle.

    A null or empty text is one empty line and is scored like any other. Without a field (nothing to learn from) every score is 0.5. Repeated rows get
    equal scores; a column that has the name is replaced; an empty table stays empty.
    """
    kept = docs.drop(name)
    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            score = score_texts(column, field) if field else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    return kept.mapInArrow(run, schema)
