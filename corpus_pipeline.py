"""The training-corpus pipeline: stages over ``documents``, each written as
Parquet and reread before the next.

Every stage but the last returns the columns of documents, with ``n_chars``
following the text. Language ID drops documents it rejects (no letter, or no
language at a posterior of a half); line dedup keeps the first of fuzzy-equal
lines; SimHash near-dedup keeps the document with the smallest id of each
component; the secret scan replaces secrets by their kind; packing returns the
bins with their texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtext.llm.langid import fit, identify
from loomtext.llm.linededup import dedup_lines, fresh, row_key
from loomtext.llm.packing import pack, packed_texts
from loomtext.llm.secrets import redact_secrets
from loomtext.llm.shared import shared_folder
from loomtext.llm.simhash import near_duplicates

LEAST_SCORE = 0.5


def recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else docs


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lang, score = fresh(docs.columns, "lang_pred", "score")
    judged = identify(docs, fit(docs), lang_out=lang, score_out=score)
    return judged.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(dedup_lines(docs))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of one id and one text are one document, of one id and other texts
    several; of a component the smallest id stays, among its texts that of the
    smallest hash; rows without an id stay."""
    (row,) = fresh(docs.columns, "row")
    keyed = docs.where("doc_id is not null").withColumn(row, row_key("doc_id", "text"))
    parts = near_duplicates(keyed, row).select(F.col(row).alias("key"), "component_id").distinct()
    ids = keyed.select(row, "doc_id").distinct()
    first = ids.join(parts, ids[row] == parts["key"]).groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("first")).select(F.col("first.key").alias("kept"))
    kept = keyed.join(first.withColumnRenamed("kept", row), row, "left_semi").dropDuplicates([row]).select(docs.columns)
    return kept.union(docs.where("doc_id is null"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return recounted(redact_secrets(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_texts(docs, pack(docs))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Fuzzy line dedup, fingerprints and learned languages are beyond DuckDB's SQL;
#: tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
