"""A training corpus from the documents table: rejects low quality, removes copies, mixes sources and packs sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes a stage's rows as Parquet in the shared
folder and reads them again as the next stage's docs. All stages but the last return the columns of documents, further
columns of any name included.

Null and empty texts are texts without words: the classifier scores them like any other, exact dedup keeps one of them,
near dedup links them with nothing, mixing takes them as often as their source's whole copies and they count no words
there; packing makes one sequence of the end token of each. Rows with a null doc_id teach nothing and are never near copies; each of them goes through. Rows that repeat a doc_id and its text are one
document to exact dedup, which keeps or drops them together; of those it keeps, near dedup keeps all. An empty table
gives an empty result, as does a table whose every row is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tickerloom.llm import exact_dedup, minhash, mixing, packing, quality_qda
from tickerloom.llm.common import documents, labels, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_qda.kept_by_quality(docs, labels(spark, sf_dir))


def exact_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_distinct(docs, keep="max")


def near_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.near_distinct(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed(docs)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.packed(docs)
    return pieces.selectExpr("doc_id", "start", "length", "crc32(ids) AS ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_deduplication),
    ("near dedup", near_deduplication),
    ("source mixing", source_mixing),
    ("packing", sequence_packing),
]

#: The classifier, the rounding draws and the tokenizer are not SQL; tests hold the stages and run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"pipeline-stage{i}")
    return docs
