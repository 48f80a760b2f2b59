"""One query for each operator of this package, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, hard_negatives, kneser_ney, langid, line_dedup, mixing, multi_index, near_dup, quality_cnn, rules, secrets, sentencepiece, token_counts
from .arrowmap import remainder


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", (remainder("doc_id", 5) == 0).alias("held_out"))
    model = langid.train(*langid.sample(docs.where("not held_out")))
    return langid.identify(docs, model, ["doc_id", "held_out"])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(documents(spark, sf_dir).select("doc_id", "text"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (remainder("doc_id", 3) == 1).alias("held_out"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    model = quality_cnn.train(*quality_cnn.sample(docs.where("not held_out"), labels))
    return quality_cnn.score(docs, model, ["doc_id", "held_out"])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mixed(documents(spark, sf_dir), prune=True)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op5_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = rules.ledger(documents(spark, sf_dir).select("doc_id", "text"))
    base = rules.fails(rules.BASE)
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~rules.fails(rules.STANDARD)).alias("kept"), "failed")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode(documents(spark, sf_dir), ["doc_id"])


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", (remainder("doc_id", 7) == 2).alias("held_out"))
    model = kneser_ney.train(docs.where("not held_out"))
    scored = kneser_ney.score(docs, model, ["doc_id", "held_out"])
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", kneser_ney.perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan(documents(spark, sf_dir)))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(documents(spark, sf_dir))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, enc = documents(spark, sf_dir), token_counts.encoder()
    return token_counts.counted(docs, enc, token_counts.frequent_lengths(docs, enc), ["doc_id"])


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    labels = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(vectors.withColumn("label", labels), "vec_id % 50 = 0")


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_mix_sources": op4_mix_sources,
    "op5_nearest_vectors": op5_nearest_vectors,
    "op6_quality_rules": op6_quality_rules,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_lm_score": op8_lm_score,
    "op9_secret_scan": op9_secret_scan,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_token_counts": op11_token_counts,
    "op12_centroid_clusters": op12_centroid_clusters,
    "op13_hard_negatives": op13_hard_negatives,
}

_SPACE = r"[\x20\x09-\x0D]"
# The measurements of the rule ledger over (id, doc_id, text); also the first stage of the pipeline.
LEDGER_SQL = rf"""
 docs AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
 words AS (SELECT id, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (SELECT id, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS w FROM docs)),
 tri AS (SELECT id, i, w, lead(w, 1) OVER p AS b, lead(w, 2) OVER p AS c FROM words WINDOW p AS (PARTITION BY id ORDER BY i)),
 twice AS (SELECT id, i FROM (SELECT id, i, count(*) OVER (PARTITION BY id, w, b, c) AS n FROM tri WHERE c IS NOT NULL) WHERE n > 1),
 covered AS (SELECT id, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY id),
 lines AS (SELECT id, count(*) AS n, count(*) - count(DISTINCT l) AS dup FROM (SELECT id, unnest(string_split(t, chr(10))) AS l FROM docs) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY id),
 counts AS (SELECT id, count(*) AS n, sum(length(w)) AS chars FROM words GROUP BY id),
 measured AS (SELECT id, doc_id, t, coalesce(c.n, 0) AS n_words, CAST(coalesce(c.chars, 0) AS BIGINT) AS word_chars,
   length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS n_upper,
   coalesce(l.n, 0) AS n_lines, coalesce(l.dup, 0) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words
   FROM docs LEFT JOIN counts c USING (id) LEFT JOIN lines l USING (id) LEFT JOIN covered v USING (id)),
 ledger AS (SELECT *, CAST(CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 4 * n_words THEN 4 ELSE 0 END
   + CASE WHEN 2 * n_upper > word_chars THEN 8 ELSE 0 END + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 25 * n_words THEN 32 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 64 ELSE 0 END AS BIGINT) AS failed FROM measured)"""

_FINITE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _kmeans_sql(rounds: int = 10) -> str:
    """Rounds written one after another: a0, a1, ... assign, c1, c2, ... are the centroids after each update."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
 FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})""",
        "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT 8))",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, vec_id, v, c, d FROM (SELECT k.r, k.vec_id, k.v, c.c,
  CAST(list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i]))) AS BIGINT) AS d FROM kept k, c{i} c)
 QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1)""")
        if i < rounds:
            parts.append(f"""c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN (SELECT c, list(f ORDER BY j) AS v
 FROM (SELECT c, j, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (SELECT a.c, t.j, sum(a.v[t.j]) AS s, count(*) AS n FROM a{i} a, range(1, 65) AS t(j) GROUP BY a.c, t.j)) GROUP BY c) m USING (c))""")
    return f"""WITH {", ".join(parts)}
SELECT a.vec_id, CAST(a.c AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
 sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c USING (c)"""


_NEGATIVES_SQL = f"""WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND {_FINITE}),
 scores AS MATERIALIZED (SELECT a.r AS anchor, a.vec_id AS anchor_id, c.r, c.vec_id, a.label = c.label AS alike,
  coalesce(CAST(list_sum(list_transform(range(1, least(len(a.v), len(c.v)) + 1), lambda i: a.v[i] * c.v[i])) AS BIGINT), 0) AS s
  FROM kept a JOIN kept c ON a.r <> c.r WHERE a.vec_id % 50 = 0),
 positives AS (SELECT * FROM scores WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY s DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor, p.r ORDER BY n.s DESC, n.vec_id) AS INTEGER) AS rank, n.vec_id AS negative_id, p.s AS positive_score, n.s AS negative_score
FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.alike AND 50 * p.s <= 100 * n.s AND 100 * n.s <= 95 * p.s
QUALIFY rank <= 3"""

ORACLE_SQL = {
    "op6_quality_rules": f"WITH {LEDGER_SQL} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM ledger",
    "op12_centroid_clusters": _kmeans_sql(),
    "op13_hard_negatives": _NEGATIVES_SQL,
}
