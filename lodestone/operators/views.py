"""What callers see: validation of requests, projections of rows, answers as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import display_name, stage_progress, strip
from lodestone.operators.ingest import overlay
from lodestone.operators.state import stalled_at

TERMINAL = ("COMPLETED", "DEAD_LETTER")
QUESTION_MAX = 2000
STORED = ("document_id", "sha256", "filename", "size_bytes", "status", "stage", "title", "language", "page_count", "attempts", "failed_stage", "last_error", "created_at", "completed_at")


def valid_question(question: Column, most: int = QUESTION_MAX) -> Column:
    """Of 1 to ``most`` characters as it was sent, and not blank."""
    return F.coalesce((F.length(question) >= 1) & (F.length(question) <= most) & (strip(question) != ""), F.lit(False))


def unfinished(status: Column) -> Column:
    return ~F.coalesce(status, F.lit("")).isin(*TERMINAL)


def finished_ids(documents: DataFrame) -> DataFrame:
    return documents.where("completed_at IS NOT NULL").select("document_id")


def status_view(documents: DataFrame, progress: DataFrame, now_s: float) -> DataFrame:
    """Stored columns and, for documents that run, their latest ``progress(document_id, stage, done, total, at)``."""
    live = progress.select("document_id", F.struct(F.col("stage"), F.col("done"), F.col("total"), stage_progress(F.col("done"), F.col("total")).alias("ratio"), stalled_at(F.col("at"), F.lit(now_s)).alias("stalled")).alias("progress"))
    held = [c for c in STORED if c in documents.columns]
    joined = documents.select(*held, display_name(F.col("title"), F.col("filename")).alias("name")).join(live, "document_id", "left")
    return joined.withColumn("progress", F.when(unfinished(F.col("status")), F.col("progress")))


def live_only(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows of documents that still exist: a document deleted during its run ends it quietly."""
    return rows.join(documents.select("document_id"), "document_id", "left_semi")


def flatten_citations(citations: DataFrame) -> DataFrame:
    """Citations of documents and of the web as rows of one shape, nulls where a kind has no such column."""
    document = F.col("document_id").isNotNull()
    pick = lambda c, on: F.when(on, F.col(c)).alias(c)
    return citations.select("q_id", "ordinal", F.when(document, "document").otherwise("web").alias("kind"), pick("document_id", document), pick("filename", document), pick("page_number", document), pick("quote", document), pick("url", ~document), pick("title", ~document))


def candidate_view(candidates: DataFrame) -> DataFrame:
    """Candidates as a trace shows them, scores to four places."""
    return candidates.select("q_id", F.struct("source", "rank", F.round("score", 4).alias("score"), "child_id").alias("candidate"))


def envelope(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    """One row of JSON: code, message and a page of items."""
    items = F.to_json(F.struct(F.lit(200).alias("code"), F.lit("success").alias("message"), F.struct(F.coalesce(F.collect_list("item"), F.array()).alias("items"), F.coalesce(F.max("total"), F.lit(0)).alias("total"), F.lit(limit).alias("limit"), F.lit(offset).alias("offset")).alias("data")))
    columns = [c for c in rows.columns if c != "total"]
    return rows.select(F.struct(*columns).alias("item"), "total").agg(items.alias("body"))


def progress_over(documents: DataFrame, progress: DataFrame) -> DataFrame:
    """Documents with the stage that progress reports, where it does."""
    return overlay(documents, progress, ["document_id"], ["stage"])
