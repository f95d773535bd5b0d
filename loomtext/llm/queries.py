"""Registered queries of this subpackage: each applies one operator, with
production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomtext.llm.ann import nearest_neighbours
from loomtext.llm.conversations import oracle_sql as repair_sql, repair
from loomtext.llm.htmltext import extract_text
from loomtext.llm.langid import language_id
from loomtext.llm.licenses import scan_licenses
from loomtext.llm.linededup import dedup_lines
from loomtext.llm.media import stored_texts
from loomtext.llm.packing import pack
from loomtext.llm.resampling import oracle_sql as resampling_sql, resample
from loomtext.llm.secrets import find_secrets
from loomtext.llm.simhash import near_duplicates
from loomtext.llm.sptok import nbest_digests
from loomtext.llm.urlfilter import judge_urls, oracle_sql as url_sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), keyed=False)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, count_col="n_dropped")


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)


def op7_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_texts(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).drop("score")


def op9_sentencepiece_nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest_digests(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_html_extraction": op2_html_extraction,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_line_dedup": op5_line_dedup,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_iso_media": op7_iso_media,
    "op8_url_filter": op8_url_filter,
    "op9_sentencepiece_nbest": op9_sentencepiece_nbest,
    "op10_language_id": op10_language_id,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_license_scan": op12_license_scan,
    "op13_importance_resampling": op13_importance_resampling,
}

#: DuckDB SQL by query; the others are tested against brute-force versions.
ORACLES: dict[str, str] = {"op8_url_filter": url_sql(), "op11_conversation_repair": repair_sql(), "op13_importance_resampling": resampling_sql()}
