"""Registered queries over ``documents`` and ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ann, centroids, fingerprint, jaccard, language, mixing, neighbours, pieces, quality, spellings, token_files
from tidemark.llm.common import table
from tidemark.llm.registry import query


@query("op1_near_vectors")
def op1_near_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbours.link(table(spark, folder, "embeddings").select("vec_id", "embedding"))


@query("op2_jaccard")
def op2_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.link(table(spark, folder, "documents").select("doc_id", "text"))


@query("op3_token_files")
def op3_token_files(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    path = token_files.write_token_files(table(spark, folder, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read_documents(spark, path).drop("ids")


#: Documents whose score is lower are rejected.
QUALITY_LIMIT = 0.3


@query("op4_quality")
def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    held_out = language.in_fold(F.col("doc_id"), 5, 0)
    docs = table(spark, folder, "documents").select("doc_id", "text")
    field = quality.fit(docs, table(spark, folder, "labels"), ~held_out)
    scored = quality.add_score(docs, field)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= QUALITY_LIMIT).cast("int").alias("predicted"))


@query("op5_pieces")
def op5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = pieces.encode(table(spark, folder, "documents").select("doc_id", "text"), model, check="round_trip")
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), pieces.digest(F.col("ids")).alias("ids_crc32"), "round_trip")


@query("op6_mixing")
def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents").select("doc_id", "source"))


@query("op9_fingerprint")
def op9_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.successor_prints(table(spark, folder, "documents").select("doc_id", "text"))


@query("op10_language_id")
def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    held_out = language.in_fold(F.col("doc_id"), 3, 1)
    docs = table(spark, folder, "documents")
    models = language.fit(docs, ~held_out)
    return language.identify(docs.select("doc_id", "text"), models).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "lang_bits", "accepted")


@query("op11_ann")
def op11_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search(table(spark, folder, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 100 == 0)


def _centroids_sql(rounds: int = 5) -> str:
    """The same rounds as nested tables: vectors times 40 centroids, then floored means by component."""
    distance = "CAST(list_sum(list_transform(list_zip(r.v, c.v), lambda t: (t[1] - t[2]) * (t[1] - t[2]))) AS BIGINT)"
    steps = [
        """rows_ AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)""",
        """c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS j, v FROM (SELECT sha256('2:' || vec_id) AS h, v FROM rows_ ORDER BY h LIMIT 40))""",
    ]
    for k in range(rounds + 1):
        steps.append(
            f"""a{k} AS MATERIALIZED (
  SELECT rid, arg_min(j, (d, j)) AS j, min(d) AS d FROM (SELECT r.rid, c.j, {distance} AS d FROM rows_ r, c{k} c) GROUP BY rid)"""
        )
        if k < rounds:
            steps.append(
                f"""c{k + 1} AS MATERIALIZED (
  SELECT c.j, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN (
    SELECT j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM (
      SELECT j, i, sum(x) AS s, count(*) AS n FROM (SELECT a.j, unnest(r.v) AS x, generate_subscripts(r.v, 1) AS i FROM a{k} a JOIN rows_ r USING (rid)) GROUP BY j, i)
    GROUP BY j) m USING (j))"""
            )
    return f"""WITH {", ".join(steps)}
SELECT r.vec_id, CAST(a.j AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.j) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN rows_ r USING (rid) JOIN c{rounds} c ON c.j = a.j"""


@query("op13_centroids", _centroids_sql())
def op13_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return centroids.cluster(table(spark, folder, "embeddings").select("vec_id", "embedding"))


#: crc32 by a table that the first expression builds from its polynomial; letters beyond ASCII are two UTF-8 bytes.
_SPELLINGS_SQL = """WITH RECURSIVE t AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS crc),
runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents)
  WHERE length(run) >= 7 GROUP BY doc_id, run),
bytes AS (
  SELECT run, times, list_prepend(4294967295, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [CAST(195 AS BIGINT), CAST(unicode(c) - 64 AS BIGINT)] END))) AS b FROM runs),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(b, lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1]))) AS h FROM bytes, t),
words AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT times, CASE WHEN h % 31 = 0 THEN substring(run, 1, CAST(h % length(run) AS BIGINT)) || substring(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cut AS MATERIALIZED (
  SELECT word, i, substring(word, 1, i - 1) || substring(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT cut.word, cut.rest FROM cut JOIN words w ON w.word = cut.rest
  UNION SELECT cut.rest, cut.word FROM cut JOIN words w ON w.word = cut.rest),
best AS (
  SELECT p.word, count(*) AS n_near, first(p.other ORDER BY o.n DESC, encode(p.other)) AS form, max(o.n) AS form_n FROM pairs p JOIN words o ON o.word = p.other GROUP BY p.word),
formed AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.form_n >= 10 * w.n THEN b.form END AS form, CASE WHEN b.form_n >= 10 * w.n THEN b.form_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)),
walk AS (
  SELECT word, word AS root FROM formed UNION ALL SELECT k.word, f.form FROM walk k JOIN formed f ON f.word = k.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, k.root, f.n, f.n_near, f.form_n
FROM formed f JOIN walk k USING (word) JOIN formed e ON e.word = k.root AND e.form IS NULL"""


@query("op12_spellings", _SPELLINGS_SQL)
def op12_spellings(spark: SparkSession, folder: str) -> DataFrame:
    return spellings.variants(table(spark, folder, "documents").select("doc_id", "text"))
