"""An inverted file over vectors: cells by k-means, the nearest cells probed, exact scores within them.

The table is written in folders by cell, so a question reads the cells it probes and no others. Cells are learned from a
bounded sample; every row is indexed. Scores are exact inner products, so probing all cells is exact search. How many
cells to probe for a wanted recall is measured, not guessed: see ``probes_for``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators.knn import BLOCK, PLACES, SLICE, TOP_K, _local_best, knn_batch
from lodestone.sources.scratch import drop, written

#: Most cells: their centroids are on the driver and in every task. Rows of the sample for each cell, at most about. Rounds of k-means.
MAX_CELLS, SAMPLE_PER_CELL, ROUNDS = 4_096, 256, 10
#: Components are added up as integers of this fineness, so that a sum doesn't depend on its order.
FINE = 1 << 24
#: Questions whose cells are sorted at a time.
PROBED = 256
ROW = "vec_id long, embedding array<double>"


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _affinity(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid by distance has the largest."""
    return rows @ centroids.T - (centroids * centroids).sum(axis=1) / 2


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE))


def _typed(corpus: DataFrame) -> DataFrame:
    return corpus.where("embedding IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))


def learn_cells(corpus: DataFrame, cells: int, rounds: int = ROUNDS, sample_per_cell: int = SAMPLE_PER_CELL) -> np.ndarray:
    """Centroids of about ``cells * sample_per_cell`` rows, taken by the hash of their ids; of all where there are no more."""
    rows = _typed(corpus)
    n = rows.count()
    part = max(1, n // (cells * sample_per_cell))
    hashed = F.xxhash64("vec_id")
    sample, path = written(rows.where(F.pmod(hashed, F.lit(part)) == 0), "vector-sample")
    centroids = np.array([r[0] for r in sample.orderBy(hashed, "vec_id").limit(cells).select("embedding").collect()], dtype=np.float64)

    def moved(centroids: np.ndarray) -> np.ndarray:
        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
            for batch in _batches(batches):
                x = _matrix(batch.column(1))
                cell = _affinity(x, centroids).argmax(axis=1)
                np.add.at(sums, cell, np.rint(x * FINE).astype(np.int64))
                counts += np.bincount(cell, minlength=len(centroids))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cell", "n", "sums"])

        def total(parts: pa.Table) -> pa.Table:
            n = sum(parts["n"].to_pylist())
            mean = np.array(parts["sums"].to_pylist(), dtype=np.int64).sum(axis=0) / FINE / n
            return pa.table({"cell": parts["cell"][:1], "mean": pa.array([mean], pa.list_(pa.float64()))})

        found = sample.mapInArrow(add, "cell long, n long, sums array<long>").groupBy("cell").applyInArrow(total, "cell long, mean array<double>").collect()
        out = centroids.copy()
        for r in found:
            out[r[0]] = r[1]
        return out

    for _ in range(rounds if len(centroids) else 0):
        after = moved(centroids)
        if (after == centroids).all():
            break
        centroids = after
    drop(corpus.sparkSession, path)
    return centroids


@dataclass(frozen=True)
class VectorIndex:
    """The index at ``path``: ``rows`` in folders by cell, and the ``centroids`` of the cells."""

    spark: SparkSession
    path: str

    @classmethod
    def build(cls, corpus: DataFrame, path: str, cells: int | None = None, rounds: int = ROUNDS) -> VectorIndex:
        """Index ``corpus(vec_id, embedding)``, vectors of one width and of length one. Rows without a vector are in no cell.

        ``cells``: four times the root of the rows where none are named.
        """
        spark = corpus.sparkSession
        rows = _typed(corpus)
        cells = min(MAX_CELLS, cells or 4 * math.isqrt(rows.count()) or 1)
        centroids = learn_cells(corpus, cells, rounds)

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _batches(batches):
                cell = _affinity(_matrix(batch.column(1)), centroids).argmax(axis=1) if batch.num_rows else np.empty(0, int)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], ["vec_id", "embedding", "cell"])

        # A cell of more rows than a task should write is several files.
        rows.mapInArrow(assign, f"{ROW}, cell int").hint("rebalance", "cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        return cls(spark, path)

    def rows(self, cells: list[int] | None = None) -> DataFrame:
        """The indexed rows, or those of some cells: a filter on folders."""
        rows = self.spark.read.schema(f"{ROW}, cell int").parquet(f"{self.path}/rows")
        return rows if cells is None else rows.where(F.col("cell").isin(cells) if cells else F.lit(False))

    def centroids(self) -> np.ndarray:
        found = self.spark.read.schema("cell int, centroid array<double>").parquet(f"{self.path}/centroids").orderBy("cell").collect()
        return np.array([r[1] for r in found], dtype=np.float64)

    def probed(self, questions: DataFrame, probes: int) -> DataFrame:
        """``(q_id, cell, place)``: the ``probes`` nearest cells of each of ``questions(q_id, embedding)``, from 0."""
        centroids = self.centroids()

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _batches(batches):
                if batch.num_rows and len(centroids):
                    near = np.argsort(-_affinity(_matrix(batch.column(1)), centroids), axis=1, kind="stable")[:, :probes]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), near.shape[1])), pa.array(near.ravel(), pa.int32()), pa.array(np.tile(np.arange(near.shape[1]), len(near)), pa.int32())], ["q_id", "cell", "place"])

        asked = questions.where("embedding IS NOT NULL").select(F.col("q_id").cast("long").alias("q_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        return asked.mapInArrow(probe, "q_id long, cell int, place int")

    def search(self, questions: DataFrame, k: int = TOP_K, probes: int = 8, block: int = BLOCK) -> DataFrame:
        """``(q_id, vec_id, rank, score)``: the ``k`` best rows of each question in the ``probes`` cells nearest to it.

        Questions go to the tasks in blocks; each block reads the cells that one of its questions probes. Where there
        are several blocks, each one's results are written before the next is asked. Of a block the driver holds the
        vectors, and a bit for each question and cell unless all cells are probed.
        """
        asked = questions.where("embedding IS NOT NULL").select(F.col("q_id").cast("long").alias("q_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        passes = max(1, math.ceil(asked.count() / block))
        centroids = self.centroids()
        found = None
        for n in range(passes):
            vectors = {r[0]: r[1] for r in asked.where(F.pmod(F.xxhash64("q_id"), F.lit(passes)) == n).collect()}
            q_ids = sorted(vectors)
            matrix = np.array([vectors[q] for q in q_ids], dtype=np.float64)
            probing = _probing(matrix, centroids, probes) if q_ids and probes < len(centroids) else None
            cells = None if probing is None else np.flatnonzero(np.unpackbits(np.bitwise_or.reduce(probing, axis=0), count=len(centroids))).tolist()
            more = self.rows(cells).mapInArrow(_cell_searcher(q_ids, matrix, probing, k), "q_id long, vec_id long, score double")
            if passes > 1:
                more, _ = written(more, "vector-pass")
            found = more if found is None else found.unionByName(more)
        best = Window.partitionBy("q_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("q_id", "vec_id", "rank", "score")

    def probes_for(self, questions: DataFrame, recall: float, k: int = TOP_K) -> int:
        """The fewest cells to probe for ``recall`` at ``k`` over ``questions``, by exact search: the place of each true neighbour's cell.

        Exact search costs a pass over all rows; a few hundred questions are enough.
        """
        exact = knn_batch(questions, self.rows(), k)
        cell_of = self.rows().select("vec_id", "cell").join(exact.select("vec_id").distinct(), "vec_id", "left_semi")
        cells = len(self.centroids())
        placed = exact.join(cell_of, "vec_id").join(self.probed(questions, cells), ["q_id", "cell"])
        counts = dict(placed.groupBy("place").count().collect())
        total, seen = sum(counts.values()), 0
        for place in range(cells):
            seen += counts.get(place, 0)
            if seen >= recall * total:
                return place + 1
        return max(1, cells)


def _probing(matrix: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """A row of packed bits for each row of ``matrix``: which cells it probes, the ``probes`` nearest."""
    out = []
    for at in range(0, len(matrix), PROBED):
        near = np.argsort(-_affinity(matrix[at : at + PROBED], centroids), axis=1, kind="stable")[:, :probes]
        held = np.zeros((len(near), len(centroids)), bool)
        np.put_along_axis(held, near, True, axis=1)
        out.append(np.packbits(held, axis=1))
    return np.concatenate(out)


def _cell_searcher(q_ids: list[int], matrix: np.ndarray, probing: np.ndarray | None, k: int):
    """Searches rows for the questions that probe their cell; for all where ``probing`` is None."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not q_ids:
            return
        best = [(np.empty(0, np.int64), np.empty(0))] * len(q_ids)
        least = np.full(len(q_ids), -np.inf)  # the k-th best score so far; a row below it is in no result
        everyone = np.arange(len(q_ids))
        for batch in _batches(batches):
            ids, rows, cells = batch.column(0).to_numpy(), _matrix(batch.column(1)), batch.column(2).to_numpy()
            for cell in np.unique(cells) if probing is not None else (None,):
                mine = slice(None) if cell is None else cells == cell
                asking = everyone if cell is None else np.flatnonzero(probing[:, cell >> 3] >> (7 - (cell & 7)) & 1)
                scores = np.round(matrix[asking] @ rows[mine].T, PLACES)
                near, some = scores >= least[asking, None], ids[mine]
                for i in np.flatnonzero(near.any(axis=1)):
                    q, new = asking[i], near[i]
                    all_ids, all_scores = np.concatenate([best[q][0], some[new]]), np.concatenate([best[q][1], scores[i, new]])
                    keep = _local_best(all_ids, all_scores, k)
                    best[q] = (all_ids[keep], all_scores[keep])
                    if len(keep) == k:
                        least[q] = best[q][1].min()
        lengths = [len(ids) for ids, _ in best]
        if sum(lengths):
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, lengths), pa.int64()), pa.array(np.concatenate([b[0] for b in best]), pa.int64()), pa.array(np.concatenate([b[1] for b in best]), pa.float64())], ["q_id", "vec_id", "score"])

    return search


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``(q_id, hits, wanted)``: how many of the exact neighbours of each question were found."""
    there = exact.join(found.select("q_id", "vec_id", F.lit(1).alias("hit")), ["q_id", "vec_id"], "left")
    return there.groupBy("q_id").agg(F.count("hit").alias("hits"), F.count("*").alias("wanted"))
