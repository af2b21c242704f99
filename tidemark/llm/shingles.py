"""Word shingles of whole texts as sorted 64-bit hashes, vectorised over a batch of documents."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from tidemark.llm.common import mix64, text_arrays

_BYTE = mix64(np.arange(256, dtype=np.uint64) + np.uint64(0x5EED))
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@lru_cache(maxsize=4)
def _table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; kept for the usual sizes."""
    return _table(int(base), 1 << max(10, (n - 1).bit_length()))[:n]


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a batch of UTF-8 texts, and the document that each word is in.

    Words are runs of bytes outside space and 0x09-0x0D; A-Z count as a-z. A word's hash is a
    polynomial over mixed byte values, taken from prefix sums, with its length mixed in.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~_SPACE[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = offsets[1:-1]
    edge = edge[edge < len(raw)]
    begins[edge] |= word[edge]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ends_mask = word.copy()
    ends_mask[:-1] &= ~word[1:]
    last = edge[edge > 0] - 1
    ends_mask[last] |= word[last]
    ends = np.flatnonzero(ends_mask) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), dtype=np.uint64, out=sums[1:])
    value = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(raw))[starts]
    value = mix64(value + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return value, np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(column: pa.Array, width: int = 5, chunk: int = 1_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text: their hashes sorted within each document, and each document's bounds.

    A text with fewer words than ``width`` has one shingle, its whole word sequence; one without
    words (or null) has none. ``chunk`` is the number of bytes hashed at once.
    """
    raw, offsets = text_arrays(column)
    hashes, owners = [], []
    rows = len(column)
    a = 0
    while a < rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + chunk, "right")) - 1)
        words, doc = word_hashes(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        count = np.bincount(doc, minlength=b - a)
        first = np.concatenate([[0], np.cumsum(count)])
        rolled = np.zeros(len(words), np.uint64)
        reach = np.minimum(width, count[doc]) if len(words) else count
        usable = np.arange(len(words)) + reach <= first[doc + 1] if len(words) else np.zeros(0, bool)
        for k in range(width):
            ahead = np.zeros(len(words), np.uint64)
            if k < len(words):
                ahead[: len(words) - k] = words[k:]
            rolled = np.where(k < reach, mix64(rolled * np.uint64(0x2545F4914F6CDD1D) + ahead + np.uint64(k + 1)), rolled) if len(words) else rolled
        own, h = doc[usable], rolled[usable]
        order = np.lexsort((h, own))
        own, h = own[order], h[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
        hashes.append(h[fresh])
        owners.append(own[fresh] + a)
        a = b
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    own = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    return h, np.concatenate([[0], np.cumsum(np.bincount(own, minlength=rows))]).astype(np.int64)


def set_digest(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's members; equal sets have equal digests."""
    one = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes), dtype=np.uint64)])
    two = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(hashes ^ np.uint64(0xABCDEF0123456789)), dtype=np.uint64)])
    return one[bounds[1:]] - one[bounds[:-1]], two[bounds[1:]] - two[bounds[:-1]]
