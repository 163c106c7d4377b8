"""The inverted file: exact with all cells, as good as was measured with fewer, and it reads what it probes."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators.knn import knn_batch
from lodestone.operators.vector_index import VectorIndex, learn_cells, recall


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(12, 16))[rng.integers(0, 12, 900)] + 0.4 * rng.normal(size=(900, 16))
    x[100:140] = x[100]  # copies tie
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    return table, table.where("vec_id % 50 = 0 AND embedding IS NOT NULL").select(F.col("vec_id").alias("q_id"), "embedding")


def ranked(rows):
    return sorted((r.q_id, r.rank, r.vec_id, r.score) for r in rows.collect())


def test_recall_is_as_measured_and_all_cells_are_exact(spark, tmp_path, corpus):
    table, questions = corpus
    index = VectorIndex.build(table, f"{tmp_path}/index", cells=24)
    assert index.rows().count() == 900
    exact = knn_batch(questions, table, 10)
    assert ranked(index.search(questions, 10, 24)) == ranked(exact)
    assert ranked(index.search(questions, 10, 24, block=5)) == ranked(exact)
    probes = index.probes_for(questions, 0.9)
    assert probes < 24
    got = recall(index.search(questions, 10, probes), exact).agg(F.sum("hits"), F.sum("wanted")).first()
    assert got[0] >= 0.9 * got[1]
    fewer = recall(index.search(questions, 10, probes - 1), exact).agg(F.sum("hits"), F.sum("wanted")).first() if probes > 1 else (0, 1)
    assert fewer[0] < 0.9 * fewer[1]


def test_cells_are_the_same_however_rows_come_and_few_are_read(spark, tmp_path, corpus):
    table, questions = corpus
    assert (learn_cells(table, 8, 3) == learn_cells(table.repartition(2), 8, 3)).all()
    index = VectorIndex.build(table, f"{tmp_path}/index", cells=8, rounds=3)
    x = {r.vec_id: np.array(r.embedding) for r in table.where("embedding IS NOT NULL").collect()}
    c = index.centroids()
    for r in index.rows().collect():
        assert r.cell == (((x[r.vec_id] - c) ** 2).sum(axis=1)).argmin()
    files = index.rows([1, 3]).select(F.input_file_name()).distinct().collect()
    assert {f[0].split("/cell=")[1].split("/")[0] for f in files} == {"1", "3"}
    scan = next(x for x in index.rows([1, 3])._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "PartitionFilters: [cell" in scan


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([(1, None)], "vec_id long, embedding array<double>")
    index = VectorIndex.build(none, f"{tmp_path}/index")
    assert index.search(none.withColumnRenamed("vec_id", "q_id")).count() == 0


def test_what_the_driver_gets_does_not_grow_with_questions_times_cells(spark, tmp_path, corpus, monkeypatch):
    table, questions = corpus
    index = VectorIndex.build(table, f"{tmp_path}/index", cells=24)
    collected, collect = [], type(table).collect
    monkeypatch.setattr(type(table), "collect", lambda self: collected.append(len(rows := collect(self))) or rows)
    found = {probes: index.search(questions, 10, probes) for probes in (6, 24)}
    assert sum(collected) <= 2 * (18 + 24)  # questions and centroids of each search, not 18 * (6 + 24) pairs
    monkeypatch.undo()
    near = index.probed(questions, 6).join(index.rows().select("vec_id", "cell"), "cell").select("q_id", "vec_id")
    every = knn_batch(questions, table, 900).join(near, ["q_id", "vec_id"])
    want = {}
    for r in sorted(every.collect(), key=lambda r: (r.q_id, -r.score, r.vec_id)):
        want.setdefault(r.q_id, []).append((r.vec_id, r.score))
    got = [(r.q_id, r.rank, r.vec_id, r.score) for r in found[6].collect()]
    assert sorted(got) == sorted((q, i, *x) for q, rows in want.items() for i, x in enumerate(rows[:10], 1))
    assert ranked(found[24]) == ranked(knn_batch(questions, table, 10))
