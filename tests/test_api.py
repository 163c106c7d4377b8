"""The engine's entry points, and the optional parts of the entry module."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lodestone.api import DOCUMENTS, Engine
from lodestone.operators import views as V
from lodestone.operators.candidates import per_source, rerank
from lodestone.operators.evaluation import eval_sets
from lodestone.plans.providers import in_input_order, trying_again
from lodestone.plans.read_path import Stages

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def payload(spark, *rows):
    return spark.createDataFrame([(s * 64, f"{s}.pdf", f"raw/{k * 64}.pdf", n) for s, k, n in rows], "sha256 string, filename string, object_key string, size_bytes long")


def test_a_file_is_accepted_once(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    objects = payload(spark, ("a", "a", 1), ("b", "b", 1), ("c", "x", 1)).select("object_key")
    accepted, rejected = engine.register(payload(spark, ("a", "a", 5), ("a", "a", 6), ("b", "x", 1), ("d", "d", 1), ("g", "g", 1)), objects)
    assert [r.sha256[0] for r in accepted.collect()] == ["a"]
    assert sorted((r.sha256[0], r.error_code) for r in rejected.collect()) == [("a", "DOCUMENT_ALREADY_INGESTED"), ("b", "HASH_MISMATCH"), ("d", "DOCUMENT_NOT_FOUND"), ("g", "VALIDATION_ERROR")]
    again, rejected = engine.register(payload(spark, ("a", "a", 5), ("b", "b", 5)), objects)
    assert [r.sha256[0] for r in again.collect()] == ["b"]
    assert [r.error_code for r in rejected.collect()] == ["DOCUMENT_ALREADY_INGESTED"]
    assert engine.list_documents(1).first().total == 2
    assert engine.is_new(payload(spark, ("a", "a", 1), ("e", "e", 1))).count() == 1
    first = accepted.first().document_id
    assert [tuple(r)[:2] for r in engine.reingest([first]).collect()] == [(first, False)]
    assert engine.reingest().count() == 0  # none is finished
    engine.change("documents", DOCUMENTS, accepted, lambda rows: rows.withColumns({"status": F.lit("DEAD_LETTER"), "attempts": F.lit(3), "last_error": F.lit("why")}))
    report = engine.reingest(accepted.select("document_id"))
    assert [tuple(r)[:2] for r in report.collect()] == [(first, True)]
    state = lambda: tuple(engine.document(first).select("status", "attempts", "last_error").first())
    assert state() == ("QUEUED", 0, None)
    engine.restore(report)
    assert state() == ("DEAD_LETTER", 3, "why")
    assert [r.relaunched for r in engine.reingest(["nobody"]).collect()] == [None]
    assert engine.delete_document(first)
    assert not engine.delete_document(first)
    assert engine.documents.count() == 1


@pytest.mark.parametrize("step", ["write", "commit"])
def test_a_write_that_dies_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    import lodestone.api as A

    engine, schema = Engine(spark, str(tmp_path)), "document_id string, n int"
    rows = lambda n: spark.createDataFrame([(f"d{i}", n) for i in range(20)], schema)
    engine.replace("t", rows(1))

    def die(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        if step == "write":
            m.setattr(A, "list_names", lambda s, p, real=A.list_names: die() if "_commits" not in p else real(s, p))
        else:
            m.setattr(A, "create_file", die)
        with pytest.raises(KeyboardInterrupt):
            engine.replace("t", rows(2))
    assert {r.n for r in engine.table("t", schema).collect()} == {1}
    engine.replace("t", rows(3))
    assert sorted(r.n for r in engine.table("t", schema).collect()) == [3] * 20


def test_a_first_write_that_dies_leaves_an_empty_table(spark, tmp_path):
    engine, schema = Engine(spark, str(tmp_path)), "document_id string, n int"
    assert engine.table("t", schema).count() == 0
    with pytest.raises(Exception, match="no rows"):
        engine.replace("t", spark.range(3).select(F.col("id").cast("string").alias("document_id"), F.raise_error(F.lit("no rows")).cast("int").alias("n")))
    assert engine.table("t", schema).count() == 0


def test_a_change_writes_the_buckets_it_touches(spark, tmp_path):
    engine, schema = Engine(spark, str(tmp_path)), "document_id string, n int"
    engine.replace("t", spark.createDataFrame([(f"d{i}", 1) for i in range(200)], schema))
    before = set(engine._newest("t")[1].items())
    one = spark.createDataFrame([("d7",)], "document_id string")
    engine.change("t", schema, one, lambda rows: rows.withColumn("n", F.when(F.col("document_id") == "d7", 9).otherwise(F.col("n"))))
    assert len(before - set(engine._newest("t")[1].items())) == 1
    assert sorted(r.n for r in engine.table("t", schema).collect()) == [1] * 199 + [9]


def test_evaluation_from_hits(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    accepted, _ = engine.register(payload(spark, ("a", "a", 5), ("b", "b", 5)), payload(spark, ("a", "a", 1), ("b", "b", 1)).select("object_key"))
    ids = {r.sha256[0]: r.document_id for r in accepted.collect()}
    gold = spark.createDataFrame([(1, "code", "a" * 64, 3), (2, "code", "b" * 64, 1), (3, "code", "e" * 64, 1)], "q_id int, kind string, gold_sha256 string, gold_page int")
    hits = spark.createDataFrame([(1, 1, ids["b"], 3), (1, 2, ids["a"], 3), (2, 1, ids["b"], 2), (3, 1, ids["a"], 1)], "q_id int, rank int, document_id string, page_number int")
    assert {(r.kind, r.n, r.recall, r.mrr) for r in engine.evaluate(hits, gold=gold).collect()} == {("code", 3, 0.333333333, 0.166666667), (None, 3, 0.333333333, 0.166666667)}
    from lodestone.operators.evaluation import missing_files

    assert [r.q_id for r in missing_files(gold, engine.documents).collect()] == [3]


def test_progress_is_reported_and_cleared(spark):
    from lodestone.operators import state as S

    schema = "document_id string, stage string, done long, total long, at double"
    held = spark.createDataFrame([("a", "PARSING", 1, 9, 1.0), ("b", "PARSING", 2, 2, 1.0)], schema)
    new = spark.createDataFrame([("a", "PARSING", 2, 9, 2.0), ("a", "ENRICHING", 11, 10, 3.0), ("c", "PARSING", 0, 4, 3.0)], schema)
    now = S.report_progress(held, new)
    assert sorted((r.document_id, r.stage, r.done) for r in now.collect()) == [("a", "ENRICHING", 10), ("b", "PARSING", 2), ("c", "PARSING", 0)]
    assert sorted(r.document_id for r in S.clear_progress(now, held.where("document_id = 'b'")).collect()) == ["a", "c"]
    counts = S.stage_counts(spark.createDataFrame([("a",), ("a",), ("b",)], "document_id string"), spark.createDataFrame([("a",)], "document_id string"), "ENRICHING")
    assert sorted(tuple(r) for r in counts.collect()) == [("a", "ENRICHING", 1, 2), ("b", "ENRICHING", 0, 1)]


def test_ask_keeps_a_trace_of_failures(spark, tmp_path):
    def broken(*_):
        raise RuntimeError("no database")

    engine = Engine(spark, str(tmp_path))
    with pytest.raises(RuntimeError):
        engine.ask(spark.range(1), Stages(broken, broken, broken, broken))
    assert "no database" in engine.traces.first().nodes


def test_views(spark):
    questions = spark.createDataFrame([("x",), (" \n",), ("",), (None,), ("y" * 2001,)], "q string")
    assert [r[0] for r in questions.select(V.valid_question(F.col("q"))).collect()] == [True, False, False, False, False]
    docs = spark.createDataFrame([("a", "RETRYING"), ("b", "COMPLETED")], "document_id string, status string").select("*", F.lit("t").alias("title"), F.lit("f").alias("filename"))
    progress = spark.createDataFrame([("a", "PARSING", 3, 2, 0.0), ("b", "PARSING", 1, 2, 0.0)], "document_id string, stage string, done int, total int, at double")
    got = {r.document_id: r.progress for r in V.status_view(docs, progress, 601.0).collect()}
    assert (got["a"].ratio, got["a"].stalled, got["b"]) == (1.0, True, None)
    citations = spark.createDataFrame([(1, 1, "d", "f", 2, "q", None, None), (1, 2, None, None, None, None, "u", "t")], "q_id int, ordinal int, document_id string, filename string, page_number int, quote string, url string, title string")
    assert [(r.kind, r.url, r.filename) for r in V.flatten_citations(citations).orderBy("ordinal").collect()] == [("document", None, "f"), ("web", "u", None)]
    page = spark.createDataFrame([("a", 7)], "document_id string, total long")
    assert V.envelope(page, 20, 0).first().body == '{"code":200,"message":"success","data":{"items":[{"document_id":"a"}],"total":7,"limit":20,"offset":0}}'
    assert [r[0] for r in V.live_only(docs, docs.where("document_id = 'a'")).select("document_id").collect()] == ["a"]


def test_rerank_and_sources(spark):
    rows = spark.createDataFrame([(1, "a", 1, "v"), (1, "b", 2, "v"), (1, "c", 3, "w")], "q_id int, id string, rank int, source string")
    assert [r.id for r in rerank(rows, F.when(F.col("id") == "c", 1.0), ["q_id"], "id", 2).orderBy("rank").collect()] == ["c", "a"]
    assert [r.id for r in rerank(rows, None, ["q_id"], "id", 2).orderBy("rank").collect()] == ["a", "b"]
    assert {(r.source, r.candidates) for r in per_source(rows).collect()} == {("v", 2), ("w", 1)}


def test_providers_and_sets(spark):
    calls = []

    def reader(image, attempt):
        calls.append(attempt)
        if attempt == 0:
            raise OSError("busy")
        return "loop" if attempt == 1 else "text"

    assert trying_again(reader, is_loop=lambda t: t == "loop")(b"") == "text"
    assert calls == [0, 1, 2]
    assert in_input_order([{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]) == [[1.0], [2.0]]
    a, b = eval_sets(spark, {"set_a": [{"id": "a01", "kind": "code", "question": "q", "gold_sha256": "s", "gold_page": 3, "quote": "x"}]})
    assert (a.first().turns, b.count()) == ([], 0)


def test_the_rest_stands_without_the_optional_parts(tmp_path):
    for name in ("lodestone", "__spark_entry__.py"):
        source = os.path.join(REPO, name)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        else:
            shutil.copy(source, tmp_path / name)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, timeout=120, env={**os.environ, "PYTHONPATH": str(tmp_path)})
    queries, sql, optional = said.stdout.split()[-3:]
    assert (int(queries) > 50, int(sql) > 45, optional) == (True, True, "False")


def test_documents_schema(spark):
    assert spark.createDataFrame([], DOCUMENTS).columns[0] == "document_id"


def test_one_document_is_read_from_its_bucket(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    payloads = spark.createDataFrame([(f"{i:064x}", f"f{i}", f"raw/{i:064x}.pdf", 9) for i in range(200)], "sha256 string, filename string, object_key string, size_bytes long")
    accepted, _ = engine.register(payloads, payloads.select("object_key"))
    one = accepted.first().document_id
    found = engine.document(one)
    assert [r.document_id for r in found.collect()] == [one]
    assert len({f.rpartition("/")[0] for f in found.inputFiles()}) == 1
    assert engine.document("none").count() == 0
