"""The pipeline's stages: each against what its operator is tested for, on the smallest tables and on odd rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm.test_documents import components, word_set  # noqa: E402
from tidemark.llm import mixing, pieces  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    plain = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("score", F.lit("mine")).withColumn("ids", F.col("doc_id"))
    odd = [(900_001, None), (900_002, ""), (900_003, "....\n\n"), (None, "A text without a key, and of and the ing."), (900_004, "the of and ing tion " * 20_000)]
    return plain.unionByName(spark.createDataFrame(odd, "doc_id long, text string"), allowMissingColumns=True)


def test_filters_keep_columns_and_clean_documents(spark, docs):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = STAGES["quality"](spark, docs, FOLDER)
    assert good.columns == docs.columns
    kept = {r.doc_id for r in good.collect()}
    assert sum(labels[k] for k in labels if k not in kept) <= 0.02 * len(labels)
    assert all(labels[k] == 0 for k in labels if k not in kept) or len(labels) > 100
    known = STAGES["language"](spark, docs, FOLDER)
    assert known.columns == docs.columns
    left = {r.doc_id for r in known.collect()}
    assert not left & {900_001, 900_002, 900_003}
    assert len(left) >= docs.count() - 3 - 2
    assert {r.score for r in known.where("doc_id < 900000").collect()} == {"mine"}


def test_dedup_leaves_one_of_each_group(spark, docs):
    out = STAGES["dedup"](spark, docs, FOLDER)
    assert out.columns == docs.columns
    rows = [(r.doc_id, word_set(r.text)) for r in docs.collect() if r.doc_id is not None]
    links = [(a, b) for i, (a, s) in enumerate(rows) for b, t in rows[:i] if s and t and 100 * len(s & t) >= 75 * len(s | t)]
    want = components([k for k, _ in rows], links)
    assert sorted(r.doc_id for r in out.collect() if r.doc_id is not None) == sorted(k for k, c in want.items() if k == c)


def test_mixing_orders_all_rows(spark, docs):
    out = STAGES["mixing"](spark, docs, FOLDER)
    assert out.columns == docs.columns
    got = [r.doc_id for r in out.collect()]
    placed = mixing.mix(docs, names=("__a", "__b")).collect()
    assert got == [r.doc_id for r in sorted(placed, key=lambda r: (r["__a"], r["__b"]))]


def test_tokens_decode_to_the_texts(spark, docs):
    import public_tokenizers

    out = STAGES["pieces"](spark, docs, FOLDER)
    assert out.where("NOT round_trip").count() == 0 and out.count() == docs.count()
    back = pieces.decode(out, public_tokenizers.path("piece_bpe_32k.model"))
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert all(r.decoded == texts[r.doc_id] and r.n_tokens == len(r.ids) for r in back.collect())


def test_run_and_an_empty_table(spark, docs):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.where("round_trip").count() == out.count() > 0
    nothing = docs.limit(0)
    for stage in STAGES.values():
        assert stage(spark, nothing, FOLDER).count() == 0


def test_run_returns_the_mixing_order_of_many_files(spark, docs, tmp_path):
    clean = spark.read.parquet(f"{FOLDER}/documents.parquet")
    clean.unionByName(clean.withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("source", F.lit("late"))).repartition(7, "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        out = corpus_pipeline.run(spark, str(tmp_path))
        assert len(out.inputFiles()) > 1
        got = {r.doc_id: (r.mix_slot, r.mix_place) for r in out.collect()}
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert len(got) == out.count() == len(set(got.values())) > 0
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet").where(F.col("doc_id").isin(list(got)))
    assert got == {r.doc_id: (r["__a"], r["__b"]) for r in mixing.mix(rows, names=("__a", "__b")).collect()}
