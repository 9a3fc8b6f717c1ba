"""The corpus queries on the driver tables: one per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clipledger.llm import (
    causal_lm, decontaminate, hard_negatives, ngram_join, packing, pii, secrets, sharding, substrings, syncmers, token_store, toxicity, whitening,
)
from clipledger.llm.base import table


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.train(docs, table(spark, folder, "labels"), ~toxicity.held_out())
    return toxicity.score(docs.select("doc_id", toxicity.held_out().alias("held_out"), "text"), model).drop("text")


def op2_syncmers(spark: SparkSession, folder: str) -> DataFrame:
    return syncmers.fingerprint_documents(table(spark, folder, "documents"))


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.scan_history(table(spark, folder, "documents").select("doc_id", "text"))[0]


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.detect_all(table(spark, folder, "documents"))


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def op6_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, folder, "documents"))


def op7_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard_documents(table(spark, folder, "documents"))


def op8_token_store(spark: SparkSession, folder: str) -> DataFrame:
    return token_store.store_and_read(table(spark, folder, "documents"))


def op9_causal_lm(spark: SparkSession, folder: str) -> DataFrame:
    return causal_lm.score_documents(table(spark, folder, "documents"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten_embeddings(table(spark, folder, "embeddings"))


def op12_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.drop_repeats(table(spark, folder, "documents"), with_text=False)


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mine_embeddings(table(spark, folder, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_syncmers, op3_secrets, op4_pii, op5_best_fit_packing,
        op6_ngram_join, op7_sharding, op8_token_store, op9_causal_lm, op10_decontamination,
        op11_whitening, op12_substring_dedup, op13_hard_negatives,
    )
}

ORACLES: dict[str, str] = {
    "op12_substring_dedup": r"""
WITH texts AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
windows AS (
    SELECT doc_id, place, md5(array_to_string(words[place:place + 19], ' ')) AS hash
    FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS place FROM texts WHERE len(words) >= 20)
),
later AS (
    SELECT doc_id, place FROM windows QUALIFY row_number() OVER (PARTITION BY hash ORDER BY doc_id, place) > 1
),
covered AS (SELECT DISTINCT doc_id, unnest(range(place, place + 20)) AS place FROM later),
words AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM texts),
kept AS (
    SELECT doc_id, string_agg(word, ' ' ORDER BY place) AS text, count(*) AS n
    FROM words ANTI JOIN covered USING (doc_id, place) GROUP BY doc_id
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
""",
    "op13_hard_negatives": """
WITH vectors AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda c: floor(256 * CAST(c AS DOUBLE))) AS x
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
),
scores AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
    FROM vectors a JOIN vectors b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
),
positives AS (
    SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
""",
}
