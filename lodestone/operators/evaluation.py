"""Retrieval quality: recall at k, reciprocal rank, by kind; reachability of labels; flips between two runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import squash


def per_question(hits: DataFrame, k: int, keys: Sequence[str] = ("q_id",), match: str = "match") -> DataFrame:
    """``recall`` (a match among the first k) and ``rr`` (1 over the rank of the first match, else 0) of each question."""
    found = F.min(F.when(F.col(match), F.col("rank")))
    return hits.groupBy(*keys).agg(F.max(F.when((F.col("rank") <= k) & F.col(match), 1.0).otherwise(0.0)).alias("recall"), F.coalesce(1.0 / found, F.lit(0.0)).alias("rr"))


def matched(hits: DataFrame, gold: DataFrame, documents: DataFrame) -> DataFrame:
    """``hits(q_id, rank, document_id, page_number)`` with kind and match: whether a hit has its question's file and page.

    Files are known by their hash. A gold file that is not in ``documents(document_id, sha256)`` can't be matched.
    """
    named = hits.join(documents, "document_id", "left").join(gold.select("q_id", "kind", "gold_sha256", "gold_page"), "q_id")
    right = F.coalesce((F.col("sha256") == F.col("gold_sha256")) & (F.col("page_number") == F.col("gold_page")), F.lit(False))
    return named.select("q_id", "kind", "rank", right.alias("match"))


def missing_files(gold: DataFrame, documents: DataFrame) -> DataFrame:
    """Questions whose gold file was never ingested: no retrieval could hit them."""
    return gold.join(documents.select(F.col("sha256").alias("gold_sha256")), "gold_sha256", "left_anti")


def summary(scores: DataFrame, kind: str = "kind") -> DataFrame:
    """``n``, mean recall and mean reciprocal rank of each kind and, under a null kind, of all: one pass."""
    sets = scores.groupingSets([[F.col(kind)], []], F.col(kind))
    return sets.agg(F.count("*").alias("n"), F.round(F.avg("recall"), 9).alias("recall"), F.round(F.avg("rr"), 9).alias("mrr"))


def unreachable(labels: DataFrame, children: DataFrame, on: Sequence[str]) -> DataFrame:
    """The labels whose quote no child of the gold page contains: no retrieval could hit them."""
    quoted = labels.withColumn("_quote", squash(F.col("quote")))
    there = children.select(*on, squash(F.col("content")).alias("_content"))
    condition: Column = F.contains(F.col("_content"), F.col("_quote"))
    for c in on:
        condition = condition & (quoted[c] == there[c])
    return quoted.join(there, condition, "left_anti").drop("_quote")


def flips(before: DataFrame, after: DataFrame, on: str = "q_id") -> DataFrame:
    """How many questions two runs judge differently: won, lost and the difference. A question of one run counts as missed in the other."""
    both = before.select(on, F.col("recall").alias("a")).join(after.select(on, F.col("recall").alias("b")), on, "full")
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return both.agg(F.coalesce(F.count_if(b > a), F.lit(0)).alias("won"), F.coalesce(F.count_if(a > b), F.lit(0)).alias("lost")).withColumn("net", F.col("won") - F.col("lost"))


def citation_accuracy(citations: DataFrame, gold: DataFrame, runs: DataFrame, on: Sequence[str] = ("document_id", "page_number")) -> DataFrame:
    """Share of the questions in ``runs(q_id, iterations)`` that cite their gold page, and their mean iterations."""
    right = citations.join(gold, ["q_id", *on], "left_semi").select("q_id").distinct().withColumn("_right", F.lit(1.0))
    judged = runs.join(right, "q_id", "left")
    return judged.agg(F.round(F.avg(F.coalesce("_right", F.lit(0.0))), 9).alias("accuracy"), F.round(F.avg("iterations"), 9).alias("mean_iterations"))


def eval_sets(spark, raw: dict) -> tuple[DataFrame, DataFrame]:
    """The two labelled sets of a parsed dataset file as tables."""
    a = [(q["id"], q["kind"], q["question"], q["gold_sha256"], q["gold_page"], q["quote"], list(q.get("turns", ()))) for q in raw.get("set_a", ())]
    b = [(q["id"], q["kind"], q["question"], q["corpus_answers"]) for q in raw.get("set_b", ())]
    return (
        spark.createDataFrame(a, "id string, kind string, question string, gold_sha256 string, gold_page int, quote string, turns array<string>"),
        spark.createDataFrame(b, "id string, kind string, question string, corpus_answers boolean"),
    )
