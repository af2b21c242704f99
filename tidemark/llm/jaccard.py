"""N-gram Jaccard join by vertical partitioning.

The global order of shingles is the order of their 64-bit hashes. It is cut into fragments, every
fragment is worked on apart, and what the fragments count is summed.

1. A document's shingles are dealt to the fragments. In each fragment a shingle is *shared* when
   documents with different sets hold it; the counts of shared shingles, summed over the
   fragments, bound what a document can have in common with any other. Documents with fewer than the
   threshold are done: they link with nothing. Equal sets are one class from here on.
2. The classes that are left are dealt to fragments again, which now give every shingle's
   frequency. The rarest shingles of each class, one more than it may miss, are its prefix: two
   linked classes have a prefix shingle in common, and from the first one on both have room for
   the overlap that they need.
3. Classes with a common prefix shingle are compared, by partial overlaps per fragment that are
   summed per pair. ``connect_groups`` compares the classes with the fewest lone shingles first, which
   connects a group of near copies by one comparison each, and then only what is still apart.
   Every pair that could link is compared or connected, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import byte_slices, connect_groups, free_names, join_components, materialise, tidy
from tidemark.llm.shingles import set_digest, shingle_sets

#: Shingles that a fragment should hold, and the fewest fragments.
FRAGMENT_SHINGLES, FRAGMENTS = 3_000_000, 8
#: Bytes of text in a block of documents, which has 4,096 documents at most.
BLOCK_BYTES = 24_000_000
#: Fragments in which the overlap of a pair is counted.
OVERLAP_FRAGMENTS = 4

_BLOCK = "fragment int, block long, docs binary, known binary, two binary, sizes binary, here binary, one binary, counts binary, shingles binary"


def _fragment_count(docs: DataFrame, text: str) -> int:
    """A power of two that follows the size of the texts (about six bytes a word)."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    wanted = max(FRAGMENTS, total / 6 / FRAGMENT_SHINGLES)
    return 1 << max(1, int(np.ceil(np.log2(wanted))))


def _deal(docs: DataFrame, key: str, text: str, width: int, fragments: int, short: bool) -> DataFrame:
    """Shingles by fragment, a row for each block of documents.

    ``here`` numbers the block's documents that have shingles in the fragment, ``one`` is their set's digest, ``counts``
    their number of shingles in it. Fragment 0 names all documents and also carries what else is known of them.
    With ``short`` only 32 bits behind the fragment's own are kept, which is enough to bound what is shared.
    """
    bits = np.uint64(64 - int(np.log2(fragments)))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for whole in batches:
            for first, last in byte_slices(whole.column(1), BLOCK_BYTES, 4096):
                batch = whole.slice(first, last - first)
                hashes, bounds = shingle_sets(batch.column(1), width)
                n = batch.num_rows
                one, two = set_digest(hashes, bounds)
                sizes = np.diff(bounds)
                fragment = (hashes >> bits).astype(np.int64)
                order = np.argsort(fragment.astype(np.uint16) if fragments <= 1 << 16 else fragment, kind="stable")
                per = np.bincount(fragment * n + np.repeat(np.arange(n), sizes), minlength=fragments * n).reshape(fragments, n)
                ends = np.concatenate([[0], np.cumsum(per.sum(1))])
                dealt = hashes[order]
                if short:
                    dealt = ((dealt << (np.uint64(64) - bits)) >> np.uint64(32)).astype("<u4")
                known = np.asarray(batch.column(0).is_valid().to_numpy(False), bool)
                about = [batch.column(0).fill_null(0).to_numpy(False).astype("<i8"), known, two, sizes.astype("<i8")]
                for f in range(fragments):
                    here = np.flatnonzero(per[f]) if f else np.arange(n)
                    if len(here):
                        parts = [*(x if f == 0 else x[:0] for x in about), here.astype("<u2"), one[here], per[f][here].astype("<u4"), dealt[ends[f] : ends[f + 1]]]
                        row = [pa.array([f], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in parts)]
                        yield pa.RecordBatch.from_arrays(row, names=["fragment", "block", "docs", "known", "two", "sizes", "here", "one", "counts", "shingles"])
                block += 1

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, _BLOCK)


def _all(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


@tidy
def _shared_counts(table: pa.Table) -> pa.Table:
    """Of one fragment, by block: how many shingles of each document a document with another set holds too."""
    one, shingles = _all(table, "one", "<u8"), _all(table, "shingles", "<u4")
    owner = np.repeat(np.arange(len(one), dtype=np.uint64), _all(table, "counts", "<u4"))
    packed = np.sort((shingles.astype(np.uint64) << np.uint64(32)) | owner)
    value, doc = packed >> np.uint64(32), (packed & np.uint64(0xFFFFFFFF)).astype(np.int64)
    total = np.zeros(len(one), np.int64)
    if len(value):
        starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
        set_of = one[doc]
        shared = np.minimum.reduceat(set_of, starts) != np.maximum.reduceat(set_of, starts)
        total = np.bincount(doc, np.repeat(shared, np.diff(np.append(starts, len(value)))), len(one)).astype(np.int64)
    ends = np.cumsum([len(x) // 2 for x in table.column("here").to_pylist()])
    counts = [total[a:b].astype("<u4").tobytes() for a, b in zip([0, *ends[:-1]], ends)]
    return table.drop_columns(["counts", "shingles"]).append_column("shared", pa.array(counts, pa.binary()))


@tidy
def _block_documents(table: pa.Table) -> pa.Table:
    """A block's documents with their shared shingles summed over the fragments."""
    about = table.filter(pc.equal(table.column("fragment"), 0))
    sizes = _all(about, "sizes", "<i8")
    shared = np.zeros(len(sizes), np.int64)
    for here, counts in zip(table.column("here").to_pylist(), table.column("shared").to_pylist()):
        shared[np.frombuffer(here, "<u2")] += np.frombuffer(counts, "<u4")
    keys = pa.array(_all(about, "docs", "<i8"), mask=~_all(about, "known", bool))
    return pa.table({"k": keys, "one": _all(about, "one", "<i8"), "two": _all(about, "two", "<i8"), "n_shingles": sizes, "shared": shared})


def documents(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """One row per document: ``k``, its set's digest ``one`` and ``two``, ``n_shingles``, ``shared`` (never less than what it has in common with others)."""
    blocks = _deal(docs, key, text, width, _fragment_count(docs, text), True)
    counted = blocks.groupBy("fragment").applyInArrow(_shared_counts, "fragment int, block long, docs binary, known binary, two binary, sizes binary, here binary, one binary, shared binary")
    return counted.groupBy("block").applyInArrow(_block_documents, "k long, one long, two long, n_shingles long, shared long")


@tidy
def _frequencies(table: pa.Table) -> pa.Table:
    """Of one fragment, by block: the shingles that several documents hold, with their frequencies, for each document."""
    shingles, counts = _all(table, "shingles", "<u8"), _all(table, "counts", "<u4")
    order = np.argsort(shingles, kind="stable")
    value = shingles[order]
    starts = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]])) if len(value) else np.zeros(0, np.int64)
    times = np.diff(np.append(starts, len(value)))
    frequency = np.empty(len(value), np.int64)
    frequency[order] = np.repeat(times, times)
    many = frequency > 1
    kept = np.bincount(np.repeat(np.arange(len(counts)), counts), many, len(counts)).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(kept)])
    held, often = shingles[many], frequency[many].astype("<u4")
    ends = np.cumsum([len(x) // 2 for x in table.column("here").to_pylist()])
    blocks = list(zip([0, *ends[:-1]], ends))
    out = table.select(["fragment", "block", "docs", "sizes", "here"])
    for name, parts in (
        ("counts", [kept[a:b].astype("<u4") for a, b in blocks]),
        ("shingles", [held[at[a] : at[b]] for a, b in blocks]),
        ("frequencies", [often[at[a] : at[b]] for a, b in blocks]),
    ):
        out = out.append_column(name, pa.array([x.tobytes() for x in parts], pa.binary()))
    return out


def _prefixes(percent: int):
    """Of a block of classes: their prefix shingles, from the shared ones of all fragments; ``room`` counts a class's shingles from there on."""

    @tidy
    def run(table: pa.Table) -> pa.Table:
        about = table.filter(pc.equal(table.column("fragment"), 0))
        ids, sizes = _all(about, "docs", "<i8"), _all(about, "sizes", "<i8")
        here, counts = _all(table, "here", "<u2").astype(np.int64), _all(table, "counts", "<u4")
        doc, shingles, frequency = np.repeat(here, counts), _all(table, "shingles", "<u8"), _all(table, "frequencies", "<u4")
        order = np.lexsort((shingles, frequency, doc))
        doc, shingles = doc[order], shingles[order]
        held = np.bincount(doc, minlength=len(ids))
        lone = sizes - held  # come first in the order and lead to nobody
        place = np.arange(len(doc)) - (np.cumsum(held) - held)[doc]
        least = -(-percent * sizes // 100)  # what a partner has to hold
        take = place < (sizes - least + 1 - lone)[doc]
        doc, place = doc[take], place[take]
        return pa.table({"k": ids[doc], "h": shingles[take].view(np.int64), "n": sizes[doc], "room": (sizes - lone)[doc] - place})

    return run


def _sets(classes: DataFrame, text: str, width: int) -> DataFrame:
    """Each class's shingles by overlap fragment, as sorted arrays."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - int(np.log2(OVERLAP_FRAGMENTS)))
        for batch in (whole.slice(a, b - a) for whole in batches for a, b in byte_slices(whole.column(1), BLOCK_BYTES)):
            hashes, bounds = shingle_sets(batch.column(1), width)
            # sorted inside each document, so its fragments follow each other
            owner = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            group = owner * OVERLAP_FRAGMENTS + (hashes >> shift).astype(np.int64)
            counts = np.bincount(group, minlength=batch.num_rows * OVERLAP_FRAGMENTS)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(hashes.view(np.int64)))
            ids = np.repeat(batch.column(0).to_numpy(False), OVERLAP_FRAGMENTS)
            part = np.tile(np.arange(OVERLAP_FRAGMENTS, dtype=np.int32), batch.num_rows)
            size = np.repeat(np.diff(bounds), OVERLAP_FRAGMENTS)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(part), pa.array(size), lists], names=["id", "part", "n", "hashes"])

    return classes.select("k", text).mapInArrow(run, "id long, part int, n long, hashes array<bigint>")


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the sizes of both sets and of their intersection, summed over the fragments."""
    left = sets.select(F.col("id").alias("a"), "part", F.col("n").alias("na"), F.col("hashes").alias("ha"))
    right = sets.select(F.col("id").alias("b"), "part", F.col("n").alias("nb"), F.col("hashes").alias("hb"))
    partial = pairs.join(right, "b").join(left, ["a", "part"]).select("a", "b", "na", "nb", F.size(F.array_intersect("ha", "hb")).cast("long").alias("common"))
    return partial.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.sum("common").alias("common"))


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """Per document: the key, ``n_shingles`` and ``component_id``, the smallest key reachable by links.

    Two documents link when 100 times the size of their sets' intersection is at least ``percent`` times
    that of the union. A set holds the distinct shingles of ``width`` words (A-Z lower-cased, words apart by
    ASCII white space), very long texts whole; a shorter text is one shingle. A null or empty text, or one without words, has no shingle
    and links with nothing. Rows with equal keys count as one document with several sets and
    keep a row each; a null key has no component. Extra columns are left out; an empty table stays empty.
    """
    rows = materialise(documents(docs, key, text, width), "sets")
    alive = rows.where("k IS NOT NULL AND n_shingles > 0")
    classes = alive.groupBy("one", "two", "n_shingles").agg(F.min("k").alias("class_id"), F.max("shared").alias("shared"))
    near = materialise(classes.where(F.col("shared") * 100 >= F.col("n_shingles") * percent).select(F.col("class_id").alias("k")).distinct(), "near")
    copies = alive.join(classes.drop("shared"), ["one", "two", "n_shingles"]).select(F.col("k").alias("b"), F.col("class_id").alias("a")).where("a <> b").distinct()
    links = materialise(copies, "links").unionByName(_near_links(docs, near, key, text, width, percent))
    joined = join_components(rows.select("k", "n_shingles"), links, "k", "jaccard")
    return joined.select(F.col("k").alias(key), "n_shingles", "component_id")


def _near_links(docs: DataFrame, near: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """Links between classes that connect all that are linked."""
    # a class's texts may be large and classes many, so this is a shuffled join at every size
    chosen = near.select(F.col("k").alias(key)).hint("merge")
    texts = materialise(docs.join(chosen, key, "left_semi").select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).dropDuplicates(), "near-texts")
    shared = _deal(texts, "k", "t", width, _fragment_count(texts, "t"), False).groupBy("fragment").applyInArrow(_frequencies, "fragment int, block long, docs binary, sizes binary, here binary, counts binary, shingles binary, frequencies binary")
    groups = materialise(shared.groupBy("block").applyInArrow(_prefixes(percent), "k long, h long, n long, room long"), "prefixes")
    sets = materialise(_sets(texts.withColumnRenamed("t", "text"), "text", width), "near-sets")
    nodes = materialise(sets.select(F.col("id").alias("k")).distinct(), "near-nodes")

    def possible(x: str, y: str):
        """Both have room for the overlap that a link of their sizes needs."""
        room = F.least(f"{x}.room", f"{y}.room")
        return (100 + percent) * room >= percent * (F.col(f"{x}.n") + F.col(f"{y}.n"))

    def verify(pairs: DataFrame) -> DataFrame:
        return overlaps(pairs, sets).where(f"100 * common >= {percent} * (na + nb - common)").select("a", "b")

    return connect_groups(nodes, groups, verify, "near", lambda x: -F.col(f"{x}.room") / F.col(f"{x}.n"), possible)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """``docs`` with one document of each component: the one whose key is the component's.

    Of several rows with that key the one with the smallest hash of the text stays (ties: the smaller
    text). Documents that link with nothing stay, those with a null key too. All columns are kept.
    """
    linked = materialise(link(docs, key, text, width, percent).select(key, "component_id"), "components")
    dropped = linked.where(F.col(key) != F.col("component_id")).select(key).distinct()
    kept = docs.join(dropped, key, "left_anti")
    repeated = linked.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").select(key)
    if repeated.isEmpty():
        return kept
    rank = F.row_number().over(W.partitionBy(key).orderBy(F.xxhash64(text), text))
    (place,) = free_names(kept, "rank")
    single = kept.join(repeated, key, "left_semi").withColumn(place, rank).where(F.col(place) == 1).drop(place)
    return kept.join(repeated, key, "left_anti").unionByName(single)
