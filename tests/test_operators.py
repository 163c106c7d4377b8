"""Operators on small tables: the invariants of the read and write paths."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.functions.language import detect_language
from lodestone.functions.vectors import is_normalized, normalized, stub_embedding, well_formed
from lodestone.operators import candidates as C
from lodestone.operators import evaluation as E
from lodestone.operators import ingest as I
from lodestone.operators import state as S
from lodestone.operators.chunking import chunk_document, kept, pack, pack_words, packer
from lodestone.operators.knn import knn_batch, merge_subqueries


def value(spark, column, *args, schema="a string"):
    return spark.createDataFrame([args], schema).select(column).first()[0]


def test_text_functions(spark):
    assert value(spark, T.sanitize(F.col("a")), "a\n\n\n\nb\n```\nx\n\n\n\ny\n```\n\n\nc\n") == "a\n\nb\n\n```\nx\n\n\n\ny\n```\n\nc"
    assert value(spark, T.contextualize(F.lit("T"), F.lit(""), F.lit(None).cast("string"), F.col("a")), "body") == "T\n\nbody"
    assert value(spark, T.cited_ordinals(F.col("a")), "[2] [1, 2] [7] [99999999999999999999]") == [2, 1, 7]
    assert value(spark, T.strip(F.col("a")), " \n x \t") == "x"
    assert value(spark, T.squash(F.col("a")), " A\n\tB ") == "a b"
    assert value(spark, T.nfc(F.col("a")), "é") == "é"
    assert value(spark, T.plain_line(F.col("a")), "## **Big** <b>x</b> **").split() == ["Big**", "x"]
    assert value(spark, T.unglue(F.col("a")), "**A****B** 1**** 2") == "**A**\n**B** 1**** 2"
    assert value(spark, T.url_encode(F.col("a")), "a b.pdf") == "a%20b.pdf"
    assert value(spark, T.format_bytes(F.length("a") * 2048), "x") == "2.0 KB"
    assert value(spark, detect_language(F.col("a")), "the end of the day and it is for you") == "en"
    assert value(spark, detect_language(F.col("a")), "") == "other"


def test_vectors(spark):
    rows = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), (None,)], "v array<float>")
    got = rows.select(normalized(F.col("v")), well_formed(normalized(F.col("v")), 2)).collect()
    assert got[0][0] == pytest.approx([0.6, 0.8])
    assert [r[1] for r in got] == [True, False, False, False]
    assert value(spark, is_normalized(stub_embedding(F.col("a"), 100)), "x") is True


def test_packing(spark):
    text = lambda n: " ".join(map(str, range(n)))
    sizes = lambda n: [len(p.split()) for p in value(spark, pack(F.col("a"), 100, 200), text(n))]
    assert [sizes(n) for n in (0, 5, 200, 250, 300, 450)] == [[], [5], [200], [250], [200, 100], [200, 250]]
    for n in (0, 1, 199, 200, 201, 299, 300, 1234):
        assert value(spark, pack(F.col("a"), 100, 200), text(n)) == pack_words(text(n).split(), lambda w: 1, 100, 200)
    assert value(spark, packer(lambda w: 1, 2, 3)(F.col("a")), "a b c d") == ["a b c d"]
    assert pack_words(["aa", "b", "ccccccc", "dd"], len, 1, 6) == ["aa b", "ccccccc", "dd"]
    assert value(spark, kept(pack(F.col("a"), 100, 200)), text(19)) == []


def test_children_are_dense_and_owned(spark):
    docs = spark.createDataFrame([("a", " ".join(["w"] * 1830)), ("b", "short"), ("c", None)], "document_id string, text string")
    rows = chunk_document(docs).orderBy("chunk_index").collect()
    assert {r.document_id for r in rows} == {"a"}
    assert [r.chunk_index for r in rows] == list(range(len(rows)))
    assert {r.parent_index for r in rows} == {0, 1}
    assert all(20 <= r.token_count < 300 for r in rows)


def test_knn_batch_and_merge(spark):
    corpus = spark.createDataFrame([(i, [float(i == j) for j in range(5)]) for i in range(5)] + [(9, None)], "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [0.0, 1.0, 0.0, 0.0, 0.0]), (2, [0.0, 0.9, 0.1, 0.0, 0.0]), (3, None)], "q_id long, embedding array<float>")
    hits = knn_batch(asked, corpus, 2, block=1)
    assert sorted((r.q_id, r["rank"], r.vec_id) for r in hits.collect()) == [(1, 1, 1), (1, 2, 0), (2, 1, 1), (2, 2, 2)]
    merged = merge_subqueries(hits.withColumn("q_id", F.lit(0)))
    assert [(r.vec_id, r["rank"]) for r in merged.orderBy("rank").collect()] == [(1, 1), (2, 2), (0, 3)]
    assert knn_batch(asked.where("q_id = 3"), corpus, 2).count() == 0


CANDIDATES = "q_id int, parent_id string, rank int, cost int"


def test_budget_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, "a", 1, 301), (1, "b", 2, 301), (1, "c", 3, 51)], CANDIDATES)
    assert [r.parent_id for r in C.build_context(rows, ["q_id"], "parent_id", 500).collect()] == ["a"]


def test_what_is_held_costs_nothing_and_ordinals_go_on(spark):
    rows = spark.createDataFrame([(1, "a", 1, 300), (1, "b", 2, 100), (1, "a", 3, 300), (1, "c", 4, 100)], CANDIDATES)
    first = C.build_context(rows, ["q_id"], "parent_id", 350).select("q_id", "parent_id", "ordinal", "used")
    more = C.build_context(rows, ["q_id"], "parent_id", 500, first)
    assert [(r.parent_id, r.ordinal, r.used) for r in more.orderBy("ordinal").collect()] == [("b", 2, 400), ("c", 3, 500)]


def test_collapse_and_fuse(spark):
    rows = spark.createDataFrame([(1, "p", "a", 1), (1, "p", "b", 2), (1, "q", "c", 5)], "q_id int, parent_id string, child string, rank int")
    assert [(r.child, r["rank"]) for r in C.collapse_to_parents(rows).orderBy("rank").collect()] == [("a", 1), ("c", 2)]
    lists = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "b", 1), (1, "c", 2)], "q_id int, id string, rank int")
    assert [r.id for r in C.fuse(lists, ["q_id"], "id").orderBy("rank").collect()] == ["b", "a", "c"]


def test_citations(spark):
    answers = spark.createDataFrame([(1, "x [1, 3] y [2][1]")], "q_id int, answer string")
    passages = spark.createDataFrame([(1, 1, "t1", "m1"), (1, 2, "t2" * 300, "")], "q_id int, ordinal long, text string, matched string")
    known, phantom = C.map_citations(answers, passages, ["q_id"])
    assert {(r.ordinal, len(r.quote)) for r in known.collect()} == {(1, 2), (2, 280)}
    assert [r.ordinal for r in phantom.collect()] == [3]
    line = spark.range(1).select(C.prompt_line(F.lit(1), F.lit("f"), F.lit(None).cast("string"), F.lit(2), F.lit("t"))).first()[0]
    assert line == "[1] (f | page 2) t"


def test_evaluation(spark):
    hits = spark.createDataFrame([(1, 1, False), (1, 2, True), (2, 11, True), (3, 1, False)], "q_id int, rank int, match boolean")
    got = {r.q_id: (r.recall, r.rr) for r in E.per_question(hits, 10).collect()}
    assert got == {1: (1.0, 0.5), 2: (0.0, 1 / 11), 3: (0.0, 0.0)}
    labels = spark.createDataFrame([(1, "Hello  World"), (2, "absent")], "doc int, quote string")
    children = spark.createDataFrame([(1, "say hello world now"), (2, "x")], "doc int, content string")
    assert [r.doc for r in E.unreachable(labels, children, ["doc"]).collect()] == [2]


def test_writes_are_idempotent(spark):
    old = spark.createDataFrame([("d", 0, "a"), ("d", 1, "b"), ("e", 0, "c")], "document_id string, chunk_index int, content string")
    new = spark.createDataFrame([("d", 0, "A")], old.schema)
    once = I.replace_documents(old, new)
    assert sorted(map(tuple, once.collect())) == [("d", 0, "A"), ("e", 0, "c")]
    assert sorted(map(tuple, I.replace_documents(once, new).collect())) == sorted(map(tuple, once.collect()))
    assert sorted(map(tuple, I.upsert(old, new, ["document_id", "chunk_index"]).collect())) == [("d", 0, "A"), ("d", 1, "b"), ("e", 0, "c")]
    with pytest.raises(Exception, match="same keys"):
        I.positional_join(old, new, ["document_id", "chunk_index"]).collect()
    with pytest.raises(ValueError, match="limit"):
        I.list_documents(old, 101)


def test_stage_machine(spark):
    log = [("a", 1, "PARSING", "ok"), ("a", 2, "STRUCTURING", "transient"), ("a", 3, "STRUCTURING", "ok"), ("b", 1, "PARSING", "transient"), ("b", 2, "PARSING", "transient"), ("b", 3, "PARSING", "deferred"), ("b", 4, "PARSING", "transient"), ("b", 5, "PERSISTING", "ok"), ("c", 1, "PARSING", "permanent"), ("d", 1, "PERSISTING", "ok"), ("e", 1, "PARSING", "transient")]
    events = spark.createDataFrame([(*r, "e") for r in log], "document_id string, seq long, stage string, outcome string, error string")
    got = {r.document_id: (r.status, r.attempts) for r in S.fold_stages(events).collect()}
    assert got == {"a": ("STRUCTURING", 1), "b": ("DEAD_LETTER", 3), "c": ("DEAD_LETTER", 0), "d": ("COMPLETED", 0), "e": ("RETRYING", 1)}


def test_token_bucket(spark):
    log = [("a", 1, 0, 10, 10, 1.0), ("a", 2, 500, 1, 10, 1.0), ("a", 3, 2000, 1, 10, 1.0), ("a", 4, 2000, 11, 10, 1.0), ("b", 1, 0, 5, 5, 0.0), ("b", 2, 9000, 1, 5, 0.0), ("c", 1, 5000, 1, 5, 1.0), ("c", 2, 0, 4, 5, 1.0)]
    requests = spark.createDataFrame(log, "key string, seq long, at_ms long, tokens int, capacity int, refill_per_sec double")
    got = {(r.key, r.seq): (r.allowed, r.wait_ms) for r in S.token_bucket(requests).collect()}
    assert got == {("a", 1): (True, 0), ("a", 2): (False, 500), ("a", 3): (True, 0), ("a", 4): (False, -1), ("b", 1): (True, 0), ("b", 2): (False, -1), ("c", 1): (True, 0), ("c", 2): (True, 0)}


def test_outages(spark):
    events = spark.createDataFrame([("k", i, t, ok) for i, (t, ok) in enumerate([(0, True), (10, False), (2000, False), (2001, True), (2002, False)])], "key string, seq int, at_s long, ok boolean")
    assert sorted((r.began, r.failures, r.failed) for r in S.outages(events).collect()) == [(10, 2, True), (2002, 1, False)]


def test_rows_of_listed_ids(spark, tmp_path):
    from lodestone.operators.ingest import by_ids

    spark.range(3000).withColumnRenamed("id", "document_id").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    assert by_ids(rows, []).count() == 0
    assert "FileScan" not in by_ids(rows, [])._jdf.queryExecution().executedPlan().toString()
    assert sorted(r[0] for r in by_ids(rows, [5, 5, 9000, 7]).collect()) == [5, 7]
    assert "In(document_id, [5,7])" in by_ids(rows, [5, 7])._jdf.queryExecution().executedPlan().toString()
    assert by_ids(rows, range(1500)).count() == 1500


def test_question_vectors_keep_the_sign_of_zero_as_sql_does(spark, tmp_path):
    import duckdb
    import numpy as np

    import __spark_entry__

    rows = [(0, [1.0, -1e-8, 1e-8, 0.0]), (1, [-0.6, 0.8, -0.0, -4.9e-7]), (2, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = dict(con.sql(__spark_entry__.oracle_sql()["question_vectors"]).fetchall())
    got = {r.vec_id: r.unit for r in __spark_entry__.queries()["question_vectors"](spark, str(tmp_path)).collect()}
    assert np.signbit(want[0][1]) and got[2] is None
    assert {i: np.array(v).tobytes() for i, v in got.items() if v} == {i: np.array(v).tobytes() for i, v in want.items() if v}
