"""URL filters: rules in a sorted digest array, probed by vectorised binary search.

A rule is a host, a path prefix and a verdict. It fits its host and all subdomains when the
page's path starts with the rule's; the longest fitting rule decides. The rules are stored as
one file: sorted 64-bit xxhash keys, string offsets, verdicts and the full strings. Executors
fetch the file once and memory-map it, so workers of a machine share its pages; a hit counts
only when the stored string equals the probed one.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import free_names, fresh_path, write_bytes

_HEAD = struct.Struct("<8sQQ")
_MAGIC = b"TMURL001"
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

#: Largest rule table that is sent to every executor; about 100 bytes a rule. Beyond it the same
#: probes are joined with the rule table instead.
MAX_FILE_RULES = 2_000_000


def pack(rules: list[tuple[str, str, str]]) -> bytes:
    """The digest file of ``(host, path, verdict)`` rules; a repeated rule keeps ``block``."""
    verdicts: dict[str, bool] = {}
    for host, path, verdict in rules:
        key = (host or "").translate(_LOWER) + (path or "")
        verdicts[key] = verdicts.get(key, False) or verdict == "block"
    rows = sorted((xxhash.xxh64_intdigest(k.encode()), k.encode(), v) for k, v in verdicts.items())
    strings = [r[1] for r in rows]
    ends = np.cumsum([0, *map(len, strings)], dtype=np.uint64)
    body = np.array([r[0] for r in rows], np.uint64).tobytes() + ends.tobytes() + bytes(r[2] for r in rows) + b"".join(strings)
    return _HEAD.pack(_MAGIC, len(rows), int(ends[-1])) + body


class DigestArray:
    """Memory-mapped rule file."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        magic, n, size = _HEAD.unpack(raw[: _HEAD.size].tobytes())
        if magic != _MAGIC:
            raise ValueError(f"not a rule file: {path}")
        at = _HEAD.size
        self.keys = raw[at : at + 8 * n].view(np.uint64)
        at += 8 * n
        self.ends = raw[at : at + 8 * (n + 1)].view(np.uint64)
        at += 8 * (n + 1)
        self.block = raw[at : at + n]
        self.strings = raw[at + n : at + n + size]
        self.first = np.searchsorted(self.keys, self.keys)  # equal digests are neighbours

    def string(self, i: int) -> bytes:
        return self.strings[int(self.ends[i]) : int(self.ends[i + 1])].tobytes()

    def find(self, probes: list[bytes]) -> np.ndarray:
        """Index of each probe, -1 where it is no rule."""
        if not probes or not len(self.keys):
            return np.full(len(probes), -1, np.int64)
        digests = np.fromiter((xxhash.xxh64_intdigest(p) for p in probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, digests)
        hit = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests))
        out = np.full(len(probes), -1, np.int64)
        for k in hit:
            i = int(at[k])
            while i < len(self.keys) and self.keys[i] == digests[k]:
                if self.string(i) == probes[k]:
                    out[k] = i
                    break
                i += 1
        return out


@lru_cache(maxsize=4)
def _opened(name: str) -> DigestArray:
    return DigestArray(SparkFiles.get(name))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    if url is None:
        return "", ""
    at = url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    for mark in "?#":
        rest = rest.partition(mark)[0]
    slash = rest.find("/")
    host, path = (rest, "") if slash < 0 else (rest[:slash], rest[slash:])
    return host.translate(_LOWER), path


def probes_of(host: str, path: str, lengths: list[int]) -> list[str]:
    """Every rule that could fit, longest first: each parent of the host with each prefix of the path."""
    if not host:
        return []
    labels = host.split(".")
    parents = [".".join(labels[i:]) for i in range(len(labels))]
    found = {p + path[:n] for p in parents for n in lengths if n <= len(path)}
    return sorted(found, key=lambda s: (-len(s), s))


def filter_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", max_file_rules: int = MAX_FILE_RULES) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path, null if none fits) and ``verdict``.

    Columns of ``pages`` with one of these four names are replaced. A null url, one without
    ``://`` and one without a host fit no rule and get ``default``, the verdict for an address that is not in the array.
    Repeated pages are judged row by row; an empty rule table gives ``default`` everywhere. Null
    host or path in a rule counts as empty; a rule with both verdicts blocks.

    The digest file holds at most ``max_file_rules`` rules (counted first). A larger table is not
    sent around: the probes are exploded and joined with it on the full string.
    """
    spark = pages.sparkSession
    kept = pages.drop("host", "path", "rule", "verdict")
    clean = rules.select(F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.col("verdict").alias("verdict"))
    lengths = sorted(r[0] for r in clean.select(F.length("path")).distinct().collect())
    if clean.limit(max_file_rules + 1).count() > max_file_rules:
        return _joined(kept, clean, url, default, lengths)
    name = f"rules-{uuid.uuid4().hex}.bin"
    path = fresh_path(spark, name)
    write_bytes(spark, path, pack([tuple(r) for r in clean.collect()]))
    spark.sparkContext.addFile(path)
    local = path.rsplit("/", 1)[-1]
    added = [T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = _opened(local)
        for batch in batches:
            parts = [split_url(u) for u in batch.column(batch.schema.get_field_index(url)).to_pylist()]
            probes, owner = [], []
            for i, (h, p) in enumerate(parts):
                own = probes_of(h, p, lengths)
                probes += [s.encode() for s in own]
                owner += [i] * len(own)
            found = array.find(probes)
            rule, verdict = [None] * len(parts), [default] * len(parts)
            for k in np.flatnonzero(found >= 0)[::-1]:  # longest last, so it stays
                rule[owner[k]] = probes[k].decode()
                verdict[owner[k]] = "block" if array.block[found[k]] else "allow"
            columns = [*batch.columns, pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "host", "path", "rule", "verdict"])

    return kept.mapInArrow(judge, T.StructType([*kept.schema.fields, *added]))


def _joined(kept: DataFrame, rules: DataFrame, url: str, default: str, lengths: list[int]) -> DataFrame:
    """The same verdicts for a rule table of any size, by one join on the full string."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    at = F.expr(f"instr(`{url}`, '://')")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.translate(F.coalesce(F.regexp_extract(rest, "^[^/?#]*", 0), F.lit("")), upper, lower)
    path = F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))
    row, found = free_names(kept, "row", "best")
    rows = kept.withColumn(row, F.monotonically_increasing_id()).withColumn("host", host).withColumn("path", path)
    labels = F.split("host", "\\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(parents, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    table = rules.groupBy(F.concat(F.translate("host", upper, lower), "path").alias("key")).agg(F.max(F.col("verdict") == "block").alias("blocks"))
    best = (
        rows.where(F.col("host") != "").select(F.col(row).alias("row"), F.explode(F.array_distinct(keys)).alias("key"))
        .join(table, "key")
        .groupBy("row")
        .agg(F.max(F.struct(F.length("key").alias("n"), "key", "blocks")).alias("best"))
    )
    judged = rows.join(best.select(F.col("row").alias(row), F.col("best").alias(found)), row, "left")
    verdict = F.when(F.col(found).isNull(), default).otherwise(F.when(F.col(f"{found}.blocks"), "block").otherwise("allow"))
    return judged.withColumn("rule", F.col(f"{found}.key")).withColumn("verdict", verdict).drop(found, row)
