"""A corpus pipeline of training-data operators: from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.decontaminate import drop_leaks
from lodestone.llm.jaccard import keep_one_of_similar
from lodestone.llm.line_dedup import dedup_lines
from lodestone.llm.packing import best_fit_packing
from lodestone.llm.shared import materialize, table
from lodestone.llm.toxicity import fit, keep_clean


#: Rows of a batch that goes to a Python worker and back. Batches of whole texts are held twice there and twice in the JVM.
BATCH_ROWS = 2_000
#: Words a packing task keeps the ids of: the other stages have filled the executors' heaps before.
PACKING_WORDS = 100_000


def _small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to ``BATCH_ROWS``: what a stage returns runs when its caller writes it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    _small_batches(spark)
    return keep_clean(fit(docs, table(spark, sf_dir, "labels")), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; every document stays, and n_chars follows its text."""
    out = dedup_lines(docs, counts=False)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays whose five-word shingles are similar by 0.8 or more."""
    _small_batches(spark)
    return keep_one_of_similar(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    _small_batches(spark)
    return drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences."""
    _small_batches(spark)
    return best_fit_packing(docs, words=PACKING_WORDS)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("best_fit_packing", packing_stage),
]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
