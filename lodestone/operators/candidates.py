"""From ranked candidates to a context: fusion, collapse to parents, token budget, citations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import cited_ordinals, quote, strip

RRF_K, BUDGET = 60, 8000


def fuse(ranked: DataFrame, keys: Sequence[str], id_column: str, k: int = RRF_K, top: int | None = None) -> DataFrame:
    """Reciprocal rank fusion: ``sum(1 / (k + rank))`` over the sources that found a candidate, best first."""
    summed = ranked.groupBy(*keys, id_column).agg(F.round(F.sum(1.0 / (F.lit(k) + F.col("rank"))), 9).alias("score"))
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), id_column)
    out = summed.withColumn("rank", F.row_number().over(order).cast("long"))
    return out if top is None else out.where(F.col("rank") <= top)


def collapse_to_parents(candidates: DataFrame, keys: Sequence[str] = ("q_id",)) -> DataFrame:
    """One candidate per parent, its best-ranked child; ranks run from 1 again.

    Candidates stay children until here: a citation's page is the child's.
    """
    first = F.row_number().over(Window.partitionBy(*keys, "parent_id").orderBy("rank"))
    winners = candidates.withColumn("_first", first).where("_first = 1").drop("_first")
    return winners.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("rank")).cast("long"))


def expand_parents(winners: DataFrame, parents: DataFrame) -> DataFrame:
    """Give each winner its parent's text and heading; what matched stays beside it, both without outer white space."""
    held = parents.select(F.col("parent_id"), strip(F.col("content")).alias("text"), F.col("heading_path").alias("heading"))
    return winners.withColumn("matched", strip(F.col("content"))).drop("content").join(held, "parent_id")


def build_context(candidates: DataFrame, keys: Sequence[str], ref: str, budget: int = BUDGET, previous: DataFrame | None = None, cost: str = "cost") -> DataFrame:
    """The passages that fit ``budget`` tokens, in order of rank, with ``ordinal`` and ``used`` (tokens so far).

    ``previous`` holds an earlier pass's passages: what it has costs nothing and is not taken again, its tokens are
    spent, its ordinals go on. Costs are never negative, so the first overflow ends the list: nothing shorter
    overtakes it.
    """
    keys = list(keys)
    first = F.row_number().over(Window.partitionBy(*keys, ref).orderBy("rank"))
    fresh = candidates.withColumn("_first", first).where("_first = 1").drop("_first")
    spent, count = F.lit(0), F.lit(0)
    if previous is not None:
        so_far = previous.groupBy(*keys).agg(F.max("used").alias("_used"), F.max("ordinal").alias("_count"))
        fresh = fresh.join(previous.select(*keys, ref), [*keys, ref], "left_anti").join(so_far, keys, "left")
        spent, count = F.coalesce("_used", F.lit(0)), F.coalesce("_count", F.lit(0))
    order = Window.partitionBy(*keys).orderBy("rank")
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    laid = fresh.withColumn("used", (F.sum(cost).over(running) + spent).cast("long")).withColumn("ordinal", (F.row_number().over(order) + count).cast("long"))
    return laid.where(F.col("used") <= budget).drop("_used", "_count")


def accumulate(previous: DataFrame, more: DataFrame) -> DataFrame:
    """A context after another pass: passages are added, never replaced."""
    return previous.unionByName(more, allowMissingColumns=True)


def prompt_line(ordinal: Column, filename: Column, heading: Column, page: Column, text: Column) -> Column:
    """How a passage stands in a prompt: its number, where it comes from, its text."""
    label = F.concat_ws(" | ", F.nullif(filename, F.lit("")), F.nullif(heading, F.lit("")), F.concat(F.lit("page "), page.cast("string")))
    return F.concat(F.lit("["), ordinal.cast("string"), F.lit("] ("), label, F.lit(") "), text)


def cited(answers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, position, ordinal)``: the markers of ``answers(answer)`` in order of first use."""
    return answers.select(*keys, F.posexplode(cited_ordinals(F.col("answer"))).alias("position", "ordinal"))


def map_citations(answers: DataFrame, passages: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Citations with their passage's columns and quote, and the phantoms: numbers of no passage. Other columns of ``answers`` are carried along."""
    numbers = cited(answers, [c for c in answers.columns if c != "answer"])
    known = numbers.join(passages, [*keys, "ordinal"]).withColumn("quote", quote(F.col("matched"), F.col("text")))
    return known, numbers.join(passages, [*keys, "ordinal"], "left_anti")


def rerank(candidates: DataFrame, scorer: Column | None, keys: Sequence[str], id_column: str, keep: int = 10) -> DataFrame:
    """The ``keep`` best by ``scorer``, a column over question and candidate; a candidate it can't score keeps its place.

    Without a scorer, or where it gives null, the order that came stands.
    """
    scored = candidates.withColumn("rerank_score", F.lit(None).cast("double") if scorer is None else scorer.cast("double"))
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("rerank_score"), "rank", id_column)
    return scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= keep)


def per_source(candidates: DataFrame, keys: Sequence[str] = ("q_id",)) -> DataFrame:
    return candidates.groupBy(*keys, "source").agg(F.count("*").alias("candidates"))
