"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import centroids, line_dedup, merkle, warc
from lodestone.llm.bitpack import token_id_output
from lodestone.llm.decontaminate import find_leaks
from lodestone.llm.media import media_columns
from lodestone.llm.packing import best_fit_packing
from lodestone.llm.resampling import resample
from lodestone.llm.secrets import secret_scan
from lodestone.llm.shared import table
from lodestone.llm.sharding import shard_by_bytes
from lodestone.llm.simhash import near_duplicates
from lodestone.llm.toxicity import toxicity


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_id_output(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op10_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.centroid_clusters(table(spark, sf_dir, "embeddings"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_media_columns, op2_line_dedup, op3_secret_scan, op4_simhash_near_dedup, op5_sharding, op6_benchmark_decontamination, op7_toxicity, op8_token_id_output, op9_best_fit_packing, op10_quality_resampling, op11_centroid_clustering, op12_warc, op13_merkle_manifest)}
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE, "op11_centroid_clustering": centroids.ORACLE, "op12_warc": warc.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
