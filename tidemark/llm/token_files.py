"""Token-id files: canonical length-limited Huffman codes from global counts.

A file set is a folder with

* ``codes``: one row, the code length of every id (0: unused); the codes are canonical, so the
  lengths are the whole code;
* ``blocks``: rows of independent blocks. ``part`` and ``block`` give the order, ``before`` the
  ids of the part before the block, ``n_ids`` its ids, ``doc_ids`` and ``doc_sizes`` its whole
  documents in order, ``bits`` the code stream (most significant bit first) and ``checkpoints``
  the bit offset of every ``EVERY``-th id.

The blocks are Parquet rows: Spark's committer then leaves no half-written file behind when an
executor is lost, and any store that Spark writes to will do. Decoding looks codes up in one
table, all checkpoints of a batch of blocks in step with each other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import byte_slices, fresh_path, partitions_for

#: Ids after which a block is closed (at the end of a document), and ids between checkpoints.
BLOCK, EVERY = 1 << 16, 512
#: Bytes of text encoded together; bounds a task's memory.
CHUNK = 32_000_000
#: Code lengths are limited to this many bits over the least that the alphabet needs.
SPARE_BITS = 4


# --- words to ids ----------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    """The tokenizer, the same merges behind a bare white-space split, and which ids end a word.

    Lower-case ASCII letters pass the tokenizer's normalisation and splitting unchanged, so words of them can go to the bare form.
    """
    import json
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        parts = json.load(file)
    bare = Tokenizer.from_str(json.dumps(parts | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "added_tokens": []}))
    size = t.get_vocab_size()
    ends = np.fromiter(((t.id_to_token(i) or "").endswith("</w>") for i in range(size)), bool, size)
    return t, bare, ends


def _encode_words(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of distinct words: a flat array, where each word's ids begin in it, and how many they are.

    Words of letters alone are encoded joined by spaces and cut behind the ids that end a word.
    Each has one end at least, so as many ends as words prove the cuts; where there are more, and
    for all other words, each word is encoded by itself.
    """
    tokenizer, bare, ends = _tokenizer(path)
    first, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    letters = np.asarray(pc.utf8_is_alpha(words)).astype(bool)
    ascii_ = np.asarray(pc.string_is_ascii(words)).astype(bool)
    flat: list[np.ndarray] = []
    base = 0
    alone = [np.flatnonzero(~letters)]
    for pick, engine in ((letters & ascii_, bare), (letters & ~ascii_, tokenizer)):
        at = np.flatnonzero(pick)
        own = words.filter(pa.array(pick))
        own = (pc.ascii_lower(own) if engine is bare else own).to_pylist()
        starts = range(0, len(at), 4096)
        joined = [" ".join(own[k : k + 4096]) for k in starts]
        for k, encoded in zip(starts, engine.encode_batch_fast(joined, add_special_tokens=False)):
            some = at[k : k + 4096]
            ids = np.array(encoded.ids, np.int64)
            cuts = np.flatnonzero(ends[ids]) + 1
            if len(cuts) == len(some) and cuts[-1] == len(ids):
                first[some] = base + np.concatenate([[0], cuts[:-1]])
                sizes[some] = np.diff(cuts, prepend=0)
                flat.append(ids)
                base += len(ids)
            else:
                alone.append(some)
    rest = np.concatenate(alone)
    for k in range(0, len(rest), 4096):
        some = rest[k : k + 4096]
        lists = [e.ids for e in tokenizer.encode_batch_fast(words.take(pa.array(some)).to_pylist(), add_special_tokens=False)]
        n = np.fromiter(map(len, lists), np.int64, len(lists))
        first[some] = base + np.cumsum(n) - n
        sizes[some] = n
        flat.append(np.fromiter((i for x in lists for i in x), np.int64, int(n.sum())))
        base += len(flat[-1])
    return (np.concatenate(flat) if flat else np.zeros(0, np.int64)), first, sizes


def _gather(flat: np.ndarray, first: np.ndarray, sizes: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Concatenated runs ``picks`` of a flat array; run ``i`` begins at ``first[i]``."""
    n = sizes[picks]
    at = np.cumsum(n) - n
    return flat[np.repeat(first[picks] - at, n) + np.arange(int(n.sum()))]


#: A run of ASCII marks without an apostrophe behind a letter or digit that NFC and lower case
#: leave a letter or digit (Latin without the dotted capital I).
_TAIL = r"([A-Za-z0-9\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}])[!-&(-/:-@\[-`{-~]+$"


def encode_texts(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts (null: none), flat, and the number of ids of each text.

    The tokenizer splits at white space, drops it and never looks across it, so each distinct word of the batch is
    encoded once. A run of ASCII marks behind a letter or digit is a token group of its own to
    the tokenizer and is taken off its word first.
    """
    if texts.null_count:
        texts = texts.fill_null("")
    split = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    starts = np.asarray(split.offsets).astype(np.int64)
    flat = split.flatten().dictionary_encode()
    codes = np.asarray(flat.indices).astype(np.int64)
    words = flat.dictionary
    cores = pc.replace_substring_regex(words, _TAIL, r"\1")
    cores = pc.if_else(pc.match_substring(words, "<|"), words, cores)  # marks of special tokens stay whole
    kept = np.asarray(pc.binary_length(cores)).astype(np.int64)
    cut = np.flatnonzero(np.asarray(pc.binary_length(words)).astype(np.int64) > kept)
    core = cores.dictionary_encode()
    ids, first, sizes = _encode_words(core.dictionary, path)
    pick = np.asarray(core.indices).astype(np.int64)
    word_first, word_sizes = first[pick], sizes[pick]
    if len(cut):
        some = words.take(pa.array(cut)).cast(pa.large_binary()).to_pylist()
        tail = pa.array([w[k:].decode() for w, k in zip(some, kept[cut].tolist())], pa.large_string()).dictionary_encode()
        tail_ids, tail_first, tail_sizes = _encode_words(tail.dictionary, path)
        tail_pick = np.asarray(tail.indices).astype(np.int64)
        # every cut word's ids are written out once, core and tail together
        pairs = np.stack([pick[cut], tail_pick + len(sizes)], 1).ravel()
        whole = _gather(np.concatenate([ids, tail_ids]), np.concatenate([first, tail_first + len(ids)]), np.concatenate([sizes, tail_sizes]), pairs)
        word_sizes[cut] += tail_sizes[tail_pick]
        word_first[cut] = len(ids) + np.cumsum(word_sizes[cut]) - word_sizes[cut]
        ids = np.concatenate([ids, whole])
    out = _gather(ids, word_first, word_sizes, codes)
    total = np.concatenate([[0], np.cumsum(word_sizes[codes])])
    return out, total[starts[1:]] - total[starts[:-1]]


# --- the code --------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Best code lengths of at most ``limit`` bits for the counts (package-merge); 0 where a count is 0."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    least = int(len(used) - 1).bit_length()
    limit = least + SPARE_BITS if limit is None else limit
    if limit < least:
        raise ValueError(f"{len(used)} ids need at least {least} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    n = len(order)
    leaves: list[np.ndarray] = []
    packages = np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        rank = np.argsort(merged, kind="stable")
        leaves.append(rank < n)
        merged = merged[rank]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(leaves):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of every id: shorter codes first, equal lengths in order of id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    if len(order):
        n = lengths[order].astype(np.uint64)
        longest = int(n.max())
        reach = np.cumsum(np.uint64(1) << (np.uint64(longest) - n)) - (np.uint64(1) << (np.uint64(longest) - n))
        codes[order] = reach >> (np.uint64(longest) - n)
    return codes


def pack_bits(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Code stream of ids and the bit offset of every ``EVERY``-th."""
    n = lengths[ids].astype(np.int64)
    at = np.cumsum(n) - n
    total = int(n.sum())
    word = at >> 5
    value = codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
    size = (total >> 5) + 2
    high = np.bincount(word, (value >> np.uint64(32)).astype(np.float64), size)
    high += np.bincount(word + 1, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), size)
    return high.astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8], at[::EVERY].astype("<i8")


class Decoder:
    """Table-driven decoder of a canonical code."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max()) if len(lengths) else 1)
        codes = canonical(lengths)
        used = np.flatnonzero(lengths)
        order = used[np.lexsort((used, lengths[used]))]
        span = np.int64(1) << (self.bits - lengths[order].astype(np.int64))
        self.symbol = np.zeros(1 << self.bits, np.int32)
        self.length = np.ones(1 << self.bits, np.int64)
        first = (codes[order].astype(np.int64)) << (self.bits - lengths[order].astype(np.int64))
        where = np.repeat(first, span) + np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span)
        self.symbol[where] = np.repeat(order, span)
        self.length[where] = np.repeat(lengths[order].astype(np.int64), span)

    def decode(self, streams: list[bytes], checkpoints: list[np.ndarray], sizes: list[int]) -> np.ndarray:
        """All ids of the blocks, one block after another."""
        if not sum(sizes):
            return np.zeros(0, np.int32)
        joined = b"".join([*streams, b"\0" * 8])
        window = np.ndarray((len(joined) - 3,), ">u4", joined, 0, (1,))
        base = np.cumsum([0, *map(len, streams)])[:-1] * 8
        starts = np.concatenate([c.astype(np.int64) + b for c, b in zip(checkpoints, base)])
        counts = np.concatenate([np.minimum(EVERY, n - np.arange(0, n, EVERY)) for n in sizes]).astype(np.int64)
        target = np.cumsum(counts) - counts
        order = np.argsort(-counts, kind="stable")
        at, target, counts = starts[order], target[order], counts[order]
        out = np.empty(int(sum(sizes)), np.int32)
        shift = np.int64(32 - self.bits)
        live = np.searchsorted(-counts, -np.arange(int(counts[0])), "left")
        for i in range(int(counts[0])):
            m = live[i]
            here = at[:m]
            seen = ((window[here >> 3].astype(np.int64) << (here & 7)) & 0xFFFFFFFF) >> shift
            out[target[:m] + i] = self.symbol[seen]
            here += self.length[seen]
        return out


# --- files -----------------------------------------------------------------------------------

_BLOCK_SCHEMA = "part int, block int, before long, n_ids long, doc_ids binary, doc_known binary, doc_sizes binary, {}"


def write_token_files(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", end_id: int = 2, path: str | None = None) -> str:
    """Encode whole texts, append ``end_id`` to each, and write them in ascending order of ``key``; returns the folder.

    Null keys come first, equal keys follow in order of a hash of the text, then of the text. A null or empty text
    has only the end id. Extra columns are left out; an empty table gives a file set without blocks.

    One shuffle sorts the texts by range of the key; the ids are written once uncoded, counted
    with partial sums, and then coded block by block without another shuffle.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "token-files")
    size = _tokenizer(vocabulary)[0].get_vocab_size()
    width = "<u2" if size <= 1 << 16 else "<u4"
    rows = docs.select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(partitions_for(spark), "k").sortWithinPartitions("k", F.xxhash64("t"), "t")

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        block = before = held = 0
        keys: list[np.ndarray] = []
        known: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal block, before, held
            flat = np.concatenate(ids)
            row = {"part": part, "block": block, "before": before, "n_ids": len(flat), "doc_ids": np.concatenate(keys).astype("<i8").tobytes(), "doc_known": np.concatenate(known).tobytes(), "doc_sizes": np.concatenate(sizes).astype("<i8").tobytes(), "ids": flat.astype(width).tobytes()}
            block, before, held = block + 1, before + len(flat), 0
            for x in (keys, known, sizes, ids):
                x.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in (whole.slice(a, b - a) for whole in batches for a, b in byte_slices(whole.column(1), CHUNK)):
            flat, n = encode_texts(batch.column(1), vocabulary)
            ends = np.cumsum(n)
            whole = np.insert(flat, ends, end_id)
            n = n + 1
            total = np.concatenate([[0], np.cumsum(n)])
            present = np.asarray(batch.column(0).is_valid().to_numpy(False), bool)
            number = batch.column(0).fill_null(0).to_numpy(False)
            a = 0
            while a < len(n):
                b = min(len(n), max(a + 1, int(np.searchsorted(total, total[a] + BLOCK - held, "left"))))
                keys.append(number[a:b])
                known.append(present[a:b])
                sizes.append(n[a:b])
                ids.append(whole[total[a] : total[b]])
                held += int(total[b] - total[a])
                a = b
                if held >= BLOCK:
                    yield close()
        if held:
            yield close()

    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.binary()), ("doc_known", pa.binary()), ("doc_sizes", pa.binary()), ("ids", pa.binary())])
    plain = f"{path}/plain"
    rows.mapInArrow(tokenise, _BLOCK_SCHEMA.format("ids binary")).write.option("compression", "zstd").parquet(plain)
    raw = spark.read.schema(_BLOCK_SCHEMA.format("ids binary")).parquet(plain)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), width), minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    # at most one row for each id of the vocabulary
    counts = np.zeros(size, np.int64)
    for r in raw.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    codes = canonical(lengths)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, marks = [], []
            for x in batch.column(batch.num_columns - 1):
                stream, at = pack_bits(np.frombuffer(x.as_buffer(), width), codes, lengths)
                bits.append(stream)
                marks.append(at.tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bits, pa.binary()), pa.array(marks, pa.binary())], names=[*batch.schema.names[:-1], "bits", "checkpoints"])

    raw.mapInArrow(code, _BLOCK_SCHEMA.format("bits binary, checkpoints binary")).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codes")
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents of a file set: ``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids_crc32`` and the ``ids`` as little-endian 32-bit integers."""
    lengths = np.frombuffer(spark.read.schema("lengths binary").parquet(f"{path}/codes").first()[0], np.uint8)
    blocks = spark.read.schema(_BLOCK_SCHEMA.format("bits binary, checkpoints binary")).parquet(f"{path}/blocks")
    # one row for each part: as many as there were shuffle partitions
    parts = sorted(tuple(r) for r in blocks.groupBy("part").agg(F.sum("n_ids")).collect())
    offsets = dict(zip([p for p, _ in parts], np.concatenate([[0], np.cumsum([n for _, n in parts])]).tolist()))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for whole in batches:
            for first in range(0, whole.num_rows, 32):
                cols = {n: whole.column(i).slice(first, 32).to_pylist() for i, n in enumerate(whole.schema.names)}
                ids = decoder.decode(cols["bits"], [np.frombuffer(c, "<i8") for c in cols["checkpoints"]], cols["n_ids"])
                docs, starts, sizes, sums, parts_ = [], [], [], [], []
                at = 0
                for part, before, keys, known, n in zip(cols["part"], cols["before"], cols["doc_ids"], cols["doc_known"], cols["doc_sizes"]):
                    start = offsets[part] + before
                    for k, ok, m in zip(np.frombuffer(keys, "<i8").tolist(), np.frombuffer(known, bool).tolist(), np.frombuffer(n, "<i8").tolist()):
                        own = ids[at : at + m].astype("<u4").tobytes()
                        docs.append(k if ok else None)
                        starts.append(start)
                        sizes.append(m)
                        sums.append(zlib.crc32(own))
                        parts_.append(own)
                        at += m
                        start += m
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), pa.array(parts_, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    return blocks.mapInArrow(decode, T.StructType([T.StructField(n, T.LongType()) for n in ("doc_id", "start", "n_tokens", "ids_crc32")] + [T.StructField("ids", T.BinaryType())]))
