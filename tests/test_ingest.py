"""The ingest log over several batches with a restart: refreshed, repeated and late rows, compaction, and reads in between."""

from __future__ import annotations

import datetime as dt
import random

from tidemark.operators import merge as M
from tidemark.streaming import live as L

SCHEMA = "run_id long, ticker string, source_key string, observation_type string, title string, source_url string, fetched_at timestamp, metadata map<string,string>"


def rows(seed, n, runs):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        run = rng.choice(runs)
        meta = {k: str(rng.randrange(9)) for k in rng.sample("abc", rng.randrange(0, 3))}
        at = dt.datetime(2024, 1, 1) + dt.timedelta(hours=run)
        out.append((run, f"T{rng.randrange(6)}", rng.choice(["s1", "s2"]), "fetch", rng.choice(["x", None, "y"]), "u", at, meta or None))
    return out


def in_order(df):
    return sorted((tuple(str(r[c]) for c in ("ticker", "source_key", "raw_hash", "title", "source_url", "run_id", "fetched_at")) + (str(sorted((r["metadata"] or {}).items())),)) for r in df.collect())


def plain(spark, batch):
    return M.merge_observations(spark.createDataFrame(batch, SCHEMA).withColumn("raw_hash", M.stable_hash("ticker", "source_key", "observation_type", "title", "source_url")))


def test_batches_with_a_restart_equal_one_merge(spark, tmp_path):
    source, path = f"{tmp_path}/in", f"{tmp_path}/out"
    seen = []
    parts = [rows(1, 60, [5, 6]), rows(2, 40, [9]), rows(3, 30, [1, 12]), [], rows(4, 20, [13]), rows(5, 5, [2])]  # later parts hold late runs and old contents
    parts[3] = parts[0][:10]  # rows that were there before
    for part in parts:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        seen += part
        got = L.live_ingest(spark.readStream.schema(SCHEMA).parquet(source), path, buckets=4, most_deltas=2)
        assert in_order(got) == in_order(plain(spark, seen))
    log = L.IngestLog(spark, f"{path}/log", 4, 2)
    assert log.state()["number"] >= 2 and len(log.open_deltas(log.state())) < 2


def test_compaction_rewrites_touched_buckets_only_and_survives_repeats(spark, tmp_path):
    log = L.IngestLog(spark, f"{tmp_path}/log", buckets=8, most_deltas=100)

    def hashed(batch):
        return spark.createDataFrame(batch, SCHEMA).withColumn("raw_hash", M.stable_hash("ticker", "source_key", "observation_type", "title", "source_url"))

    first = rows(7, 200, [1, 2, 3])
    log.append(hashed(first), 0)
    log.append(hashed(first), 0)  # the same batch once more
    assert len(log.compact()) > 1
    before = log.state()
    one = [(9, "T0", "s1", "fetch", "x", "u", dt.datetime(2024, 2, 1), {"a": "new"})]
    log.append(hashed(one), 1)
    assert in_order(log.read()) == in_order(plain(spark, first + one))  # an open delta counts
    touched = log.compact()
    after = log.state()
    assert len(touched) == 1 and {b: v for b, v in after["buckets"].items() if int(b) not in touched} == {b: v for b, v in before["buckets"].items() if int(b) not in touched}
    assert in_order(log.read()) == in_order(plain(spark, first + one))
    log.append(hashed(one), 1)  # compacted already, and handed in again after a restart
    assert log.open_deltas(log.state()) == [] and log.compact() == []
    assert L.IngestLog(spark, f"{tmp_path}/none").read() is None
