"""Exact nearest neighbours by inner product; vectors are expected to have length one.

A single question is a column expression and a top-k sort. A batch of questions is answered per partition by matrix
products, k best a question, and only those are shuffled: what moves grows with questions and partitions, not with
the corpus. Questions are taken in blocks of a stated number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vectors import inner
from lodestone.sources.scratch import written

OVER_FETCH, TOP_K = 50, 10
#: Scores are compared to this many places, so that the order of a sum doesn't decide a tie.
PLACES = 9
#: Questions of a pass, and rows that are scored at a time: a worker holds BLOCK * SLICE scores.
BLOCK, SLICE = 4_096, 1_024


def knn(corpus: DataFrame, query: Sequence[float], k: int = OVER_FETCH, where: Column | None = None, id_column: str = "vec_id") -> DataFrame:
    """The ``k`` rows of ``corpus(id, embedding, ...)`` nearest to ``query``, with ``score``; ties by id.

    The filter and the limit come before anything is joined to the result.
    """
    rows = corpus if where is None else corpus.where(where)
    scored = rows.withColumn("score", F.round(inner(F.col("embedding"), F.lit(list(map(float, query)))), PLACES)).drop("embedding")
    return scored.orderBy(F.desc("score"), id_column).limit(k)


def vector_of(corpus: DataFrame, id_value: int, id_column: str = "vec_id") -> list[float]:
    row = corpus.where(F.col(id_column) == id_value).select("embedding").first()
    return list(row[0]) if row else []


def _local_best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best columns by score, then id, and of all that tie with the last of them."""
    if len(ids) <= k:
        return np.arange(len(ids))
    least = np.partition(scores, len(ids) - k)[len(ids) - k]
    near = np.flatnonzero(scores >= least)
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def knn_batch(questions: DataFrame, corpus: DataFrame, k: int = TOP_K, block: int = BLOCK) -> DataFrame:
    """``(q_id, vec_id, rank, score)`` for each of ``questions(q_id, embedding)`` over ``corpus(vec_id, embedding)``.

    At most ``block`` questions are sent to the tasks at a time. Questions and rows without a vector have no result,
    nor have scores that are not a number.
    """
    asked = questions.where("embedding IS NOT NULL").select(F.col("q_id").cast("long").alias("q_id"), "embedding")
    passes = max(1, math.ceil(asked.count() / block))
    found = None
    for part in range(passes):
        rows = asked.where(F.pmod(F.xxhash64("q_id"), F.lit(passes)) == part).collect()
        more = corpus.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_searcher([r[0] for r in rows], [r[1] for r in rows], k), "q_id long, vec_id long, score double")
        if passes > 1:  # a pass is done, and its questions forgotten, before the next is asked
            more, _ = written(more, "knn-pass")
        found = more if found is None else found.unionByName(more)
    best = Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("q_id", "vec_id", "rank", "score")


def _searcher(q_ids: list[int], vectors: list[list[float]], k: int):
    matrix = np.array(vectors, dtype=np.float64)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not q_ids:
            return
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0))] * len(q_ids)
        least = np.full(len(q_ids), -np.inf)  # the k-th best score so far; a row below it is in no result
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            ids = batch.column(0).to_numpy()
            rows = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
            scores = np.round(matrix @ rows.T, PLACES)
            near = scores >= least[:, None]
            for q in np.flatnonzero(near.any(axis=1)):
                (old_ids, old_scores), new = best[q], near[q]
                all_ids, all_scores = np.concatenate([old_ids, ids[new]]), np.concatenate([old_scores, scores[q, new]])
                keep = _local_best(all_ids, all_scores, k)
                best[q] = (all_ids[keep], all_scores[keep])
                if len(keep) == k:
                    least[q] = all_scores[keep].min()
        lengths = [len(ids) for ids, _ in best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, lengths), pa.int64()), pa.array(np.concatenate([b[0] for b in best]), pa.int64()), pa.array(np.concatenate([b[1] for b in best]), pa.float64())], ["q_id", "vec_id", "score"])

    return search


def merge_subqueries(hits: DataFrame, keys: Sequence[str] = ("q_id",), id_column: str = "vec_id") -> DataFrame:
    """One row for each child that any sub-query of a question found, at its best score; ranked 1 to n without gaps."""
    best = hits.groupBy(*keys, id_column).agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), id_column)).cast("long"))
