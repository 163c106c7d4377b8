"""Rewriting and judging questions by what a first search found: feedback terms, and the spread of its scores.

The first documents of a question are taken as a sample of what it is about: words that weigh much in them and are rare
elsewhere are added to it (a relevance model). A search whose scores hardly differ has found nothing in particular, so
the spread of scores tells which questions are worth a second try.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.operators.keyword import terms

#: Documents of a question that are learned from, words that are added to it, decimal places of a weight.
DOCUMENTS, ADDED, PLACES = 5, 10, 6
#: A question whose scores deviate by less than this share of their mean is asked again.
LEAST_SPREAD = 0.15


def feedback_terms(hits: DataFrame, docs: DataFrame, questions: DataFrame, frequencies: DataFrame, total: int, documents: int = DOCUMENTS, added: int = ADDED) -> DataFrame:
    """``(q_id, term, weight, nth)``: the words that the first ``documents`` hits of a question add to it, from 1.

    A word weighs the sum over these hits of the hit's share of their scores, times the word's share of its text, times
    ``ln(1 + total / df)``. ``hits(q_id, doc_id, score, rank)``, ``docs(doc_id, text)``, ``questions(q_id, text)``,
    ``frequencies(term, df)`` of the corpus of ``total`` documents. Words of the question itself are not added.
    """
    first = hits.where(F.col("rank") <= documents).select("q_id", "doc_id", (F.col("score") / F.sum("score").over(Window.partitionBy("q_id"))).alias("share"))
    split = docs.join(first, "doc_id").select("q_id", "share", terms(F.col("text")).alias("words"))
    each = split.select("q_id", (F.col("share") / F.size("words")).alias("each"), F.explode("words").alias("term")).groupBy("q_id", "term").agg(F.sum("each").alias("mass"))
    own = questions.select("q_id", F.explode(terms(F.col("text"))).alias("term")).distinct()
    weighed = each.join(own, ["q_id", "term"], "left_anti").join(frequencies.select("term", "df"), "term")
    weighed = weighed.select("q_id", "term", F.round(F.col("mass") * F.ln(1 + F.lit(total) / F.col("df")), PLACES).alias("weight"))
    order = Window.partitionBy("q_id").orderBy(F.desc("weight"), "term")
    return weighed.withColumn("nth", F.row_number().over(order).cast("long")).where(F.col("nth") <= added)


def rewritten(questions: DataFrame, feedback: DataFrame) -> DataFrame:
    """``questions`` with the words of ``feedback(q_id, term, nth)`` behind their text; those without any stay as they are."""
    more = feedback.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "term"))), lambda x: x["term"]), " ").alias("_more"))
    return questions.join(more, "q_id", "left").withColumn("text", strip(F.concat_ws(" ", "text", "_more"))).drop("_more").select(*questions.columns)


def score_spread(hits: DataFrame, least: float = LEAST_SPREAD) -> DataFrame:
    """``(q_id, spread, sufficient)``: the deviation of a question's scores as a share of their mean, and whether that is enough."""
    spread = F.coalesce(F.stddev_pop("score") / F.abs(F.nullif(F.avg("score"), F.lit(0.0))), F.lit(0.0))
    return hits.groupBy("q_id").agg(F.round(spread, PLACES).alias("spread")).withColumn("sufficient", F.col("spread") >= least)
