"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again.

Quality and language drop documents, the n-gram join leaves one of each group of near copies, mixing puts
the rest in the order of the target weights, and the last stage turns every text into ids. All stages
but the last return the columns of their input, whatever they are. Rereading files loses the order of rows, so
the last stage computes the schedule of the same rows again and returns it: sorted by ``mix_slot`` and
``mix_place``, its rows are in the order of the target weights.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import jaccard, language, mixing, pieces, quality
from tidemark.llm.common import free_names, materialise
from tidemark.session import shared_dir

#: Documents with a lower quality score are rejected.
QUALITY_LIMIT = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least ``QUALITY_LIMIT``; learned from labels outside the held-out fifth.

    A null, empty or very long text is scored whole like any other, repeated rows are kept or dropped together, columns are kept whatever their names, an empty table stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    field = quality.fit(docs, labels, ~language.in_fold(F.col("doc_id"), 5, 0))
    (score,) = free_names(docs, "quality_score")
    return quality.add_score(docs, field, name=score).where(F.col(score) >= QUALITY_LIMIT).drop(score)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like one of the languages; learned from documents outside the held-out third.

    Null and empty texts and texts without a letter are rejected; very long texts are judged whole, repeated rows are kept or dropped together, columns are kept
    whatever their names, an empty table stays empty.
    """
    models = language.fit(docs, ~language.in_fold(F.col("doc_id"), 3, 1))
    prefix = "judged_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    return language.identify(docs, models, prefix=prefix).where(F.col(f"{prefix}accepted")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links at 75 % of the 5-word shingles: the one with the smallest key, whole texts compared.

    Null and empty texts and null keys link with nothing and stay; of repeated rows with one key one stays; an empty table stays empty.
    """
    return jaccard.keep_one(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the mixing schedule (files and rows).

    A null source is a source; null keys, texts and repeated rows each keep a row; columns are kept whatever their names; an empty table stays empty.
    """
    slot, place = free_names(docs, "mix_slot", "mix_place")
    return mixing.mix(docs, names=(slot, place)).orderBy(slot, place).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with their number, whether decoding gives the text back, and its place in the mixing schedule.

    Texts are encoded first, without a shuffle; the schedule then moves keys, sources and ids. A null or empty text has no
    ids; null keys and repeated rows each keep a row; an empty table stays empty.
    """
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(docs.select("doc_id", "source", "text"), model, check="round_trip").drop("text")
    placed = mixing.mix(materialise(encoded, "pipeline-ids"))
    return placed.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), "round_trip", "mix_slot", "mix_place")


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("dedup", one_of_each),
    ("mixing", mixed),
    ("pieces", tokens),
]

#: The stages hold trained models and byte-level tokens, which SQL cannot express; tests compare
#: every stage with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, one after another."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    base = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}-{name}")
        docs = spark.read.parquet(f"{base}/{i}-{name}")
    return docs
