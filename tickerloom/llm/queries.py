"""The registered queries of this subpackage and their oracle SQL.

Every query reads whole tables; the thin functions below only pick and derive the columns that are asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from tickerloom.llm import (
    conversation_repair,
    exact_dedup,
    langid,
    minhash,
    mixing,
    neighbours,
    packing,
    quality_qda,
    quality_rules,
    toxicity,
    url_reputation,
    vector_codes,
    warc,
)
from tickerloom.llm.common import documents, labels


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.languages(documents(spark, sf_dir))
    return found.select("doc_id", (~langid.train_rows()).alias("held_out"), "lang_pred", "score")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    judged = url_reputation.judged_pages(pages, url_reputation.quality_outcomes(labels(spark, sf_dir)))
    numbers = [F.col(c).cast("bigint").alias(c) for c in ("n", "k")] + [F.round(c, 8).alias(c) for c in ("mean", "bound")]
    return judged.select("page_id", "host", "path", "rule", "verdict", *numbers)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(documents(spark, sf_dir))
    return book.withColumns({"base_failed": ~quality_rules.passes("base"), "kept": quality_rules.passes()})


def op4_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.ablations(quality_rules.ledger(documents(spark, sf_dir)))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(documents(spark, sf_dir), labels(spark, sf_dir))
    return scores.select("doc_id", (~toxicity.train_rows()).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="max")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.packed(documents(spark, sf_dir))
    return pieces.selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset")


def op8_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.buckets(packing.packed(documents(spark, sf_dir)))


def op9_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality_qda.quality_scores(documents(spark, sf_dir), labels(spark, sf_dir))
    return scores.select("doc_id", (~quality_qda.train_rows()).alias("held_out"), "score", (F.col("score") >= quality_qda.THRESHOLD).cast("int").alias("predicted"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.copies(documents(spark, sf_dir))
    return plan.selectExpr("doc_id", "size", "source", "source_size", "target", "copies", "size * copies AS taken")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_of_every(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_warc": op2_warc,
    "op3_url_reputation": op3_url_reputation,
    "op4_quality_rules": op4_quality_rules,
    "op4_ablations": op4_ablations,
    "op5_minhash": op5_minhash,
    "op6_toxicity": op6_toxicity,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_packing": op8_packing,
    "op8_buckets": op8_buckets,
    "op9_quality_qda": op9_quality_qda,
    "op10_mixing": op10_mixing,
    "op11_vector_codes": op11_vector_codes,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_neighbours": op13_neighbours,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op2_warc": warc.ORACLE,
    "op3_url_reputation": url_reputation.ORACLE,
    "op4_quality_rules": quality_rules.ORACLE,
    "op4_ablations": quality_rules.ABLATIONS_ORACLE,
    "op5_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
sides AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS to_id FROM w UNION SELECT r.doc_id, sides.b FROM reach r JOIN sides ON sides.a = r.to_id)
SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(to_id) AS component_id, w.doc_id = min(to_id) AS kept
FROM w JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY w.doc_id
""",
    "op7_exact_dedup": """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM d WINDOW same AS (PARTITION BY body)
""",
    "op11_vector_codes": vector_codes.oracle(),
    "op12_conversation_repair": conversation_repair.ORACLE,
}
