"""The stage chain: cut short, changed, sliced, crashed, it comes to the same rows and asks no provider twice."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.plans.chain import Chain, Stage
from lodestone.plans.providers import RateLimited, enrich
from lodestone.plans.write_path import ingest_chain

DOCS = "document_id string, content_fp string"
CHUNK = ("chunk_index",)


def docs_of(spark, **content):
    return spark.createDataFrame(list(content.items()), DOCS)


def chunks_stage(of):
    """``of``: how many chunks a document has."""
    sizes = F.create_map(*(F.lit(x) for pair in of.items() for x in pair))
    return Stage("chunks", lambda t: t["documents"].select("document_id", F.explode(F.sequence(F.lit(1).cast("long"), sizes[F.col("document_id")].cast("long"))).alias("chunk_index")), "document_id string, chunk_index long")


def test_a_stage_that_was_cut_short_goes_on_where_it_ended(spark, tmp_path):
    asked = spark.sparkContext.accumulator(0)
    most = {"n": 10}

    def answer(t):
        asked.add(t["chunks"].count())
        return t["chunks"].where(F.col("chunk_index") <= most["n"]).withColumn("value", F.lit(most["n"]))

    def strict(t):
        return t["answers"].groupBy("document_id").agg(F.count("*").alias("n"))

    chain = Chain(spark, str(tmp_path), [chunks_stage({"a": 40}), Stage("answers", answer, "document_id string, chunk_index long, value int", ("chunks",), CHUNK), Stage("after", strict, "document_id string, n long", ("answers",))])
    docs = docs_of(spark, a="1")
    assert chain.advance(docs) == 1
    assert {r.stage: (r.state, r.units, r.made) for r in chain.outcomes().collect()} == {"chunks": ("DONE", 1, 1), "answers": ("PARTIAL", 40, 10)}
    most["n"] = 1000
    assert chain.advance(docs) == 2
    assert asked.value == 40 + 30  # what was answered isn't asked for again
    assert sorted((r.value, r["count"]) for r in chain.rows("answers").groupBy("value").count().collect()) == [(10, 10), (1000, 30)]
    assert [r.n for r in chain.rows("after").collect()] == [40]
    assert chain.advance(docs) == 0
    assert asked.value == 70


def test_a_change_in_a_stage_makes_those_after_it_anew(spark, tmp_path):
    value = {"v": 10}
    one = lambda version: Stage("one", lambda t: t["documents"].select("document_id", F.lit(value["v"]).alias("x")), "document_id string, x int", version=version)
    two = Stage("two", lambda t: t["one"].select("document_id", F.col("x")), "document_id string, x int", ("one",))
    docs = docs_of(spark, a="1", b="1")
    chain = Chain(spark, str(tmp_path), [one("1"), two])
    chain.advance(docs)
    value["v"] = 20
    assert chain.advance(docs) == 0  # nothing has changed that a fingerprint is made of
    again = Chain(spark, str(tmp_path), [one("2"), two])
    again.advance(docs)
    assert sorted(tuple(r) for r in again.rows("two").select("document_id", "x").collect()) == [("a", 20), ("b", 20)]
    value["v"] = 30
    assert again.advance(docs_of(spark, a="2", b="1")) == 3
    assert sorted(tuple(r) for r in again.rows("two").select("document_id", "x").collect()) == [("a", 30), ("b", 20)]


def test_a_stage_that_puts_out_the_same_leaves_those_after_it(spark, tmp_path):
    runs = []

    def two(t):
        runs.append(sorted(r[0] for r in t["one"].select("document_id").collect()))
        return t["one"]

    stages = [Stage("one", lambda t: t["documents"].select("document_id", F.lit(1).alias("x")), "document_id string, x int"), Stage("two", two, "document_id string, x int", ("one",))]
    chain = Chain(spark, str(tmp_path), stages)
    chain.advance(docs_of(spark, a="1", b="1"))
    chain.advance(docs_of(spark, a="2", b="1"))
    assert runs == [["a", "b"], []]


def test_slices_reach_every_document(spark, tmp_path):
    seen = []

    def one(t):
        seen.append(sorted(r[0] for r in t["documents"].select("document_id").collect()))
        return t["documents"].where("document_id <> 'a'").select("document_id")

    chain = Chain(spark, str(tmp_path), [Stage("one", one, "document_id string")])
    docs = docs_of(spark, a="1", b="1", c="1")
    while chain.advance(docs, slice_documents=1):
        assert len(seen) < 9
    assert seen == [["a"], ["b"], ["c"]]
    assert {r.document_id: r.state for r in chain.outcomes().collect()} == {"a": "EMPTY", "b": "DONE", "c": "DONE"}
    chain.advance(docs_of(spark, a="2", b="1", c="1"))
    assert seen[3:] == [["a"]]


def test_documents_that_stay_short_take_turns(spark, tmp_path):
    seen = []

    def never(t):
        seen.append([r[0] for r in t["chunks"].select("document_id").distinct().collect()])
        return t["chunks"].where("false").select("document_id", "chunk_index")

    chain = Chain(spark, str(tmp_path), [chunks_stage({"a": 1, "b": 1}), Stage("never", never, "document_id string, chunk_index long", ("chunks",), CHUNK)])
    for _ in range(4):
        chain.advance(docs_of(spark, a="1", b="1"), slice_documents=1)
    assert seen == [["a"], ["b"], ["a"], ["b"]]


def test_rows_of_a_run_that_died_count(spark, tmp_path):
    calls = []

    def answer(t):
        calls.append(t["chunks"].count())
        return t["chunks"].select("document_id", "chunk_index")

    def last(t):
        if len(calls) == 1:
            raise OSError("the machine is gone")
        return t["answers"].select("document_id", "chunk_index")

    chain = Chain(spark, str(tmp_path), [chunks_stage({"a": 3}), Stage("answers", answer, "document_id string, chunk_index long", ("chunks",), CHUNK), Stage("last", last, "document_id string, chunk_index long", ("answers",))])
    with pytest.raises(OSError, match="gone"):
        chain.advance(docs_of(spark, a="1"))
    import shutil

    shutil.rmtree(tmp_path / "_ledger" / "stage=answers")  # as if it had died a moment earlier
    calls.append(None)
    chain.advance(docs_of(spark, a="1"))
    assert calls == [3, None, 0]
    assert chain.rows("last").count() == 3


def test_rows_that_were_not_asked_for_are_dropped(spark, tmp_path):
    chain = Chain(spark, str(tmp_path), [Stage("one", lambda t: t["documents"].select("document_id").union(spark.createDataFrame([("other",)], "document_id string")), "document_id string")])
    chain.advance(docs_of(spark, a="1"))
    assert [r.document_id for r in chain.rows("one").collect()] == ["a"]
    with pytest.raises(ValueError, match="no stage before"):
        Chain(spark, str(tmp_path), [Stage("x", lambda t: t["y"], "document_id string", ("y",))])


def test_a_provider_that_is_limited_at_once_yields_nothing(spark):
    def limited(chunks):
        raise RateLimited

    chunks = spark.createDataFrame([("d", i, "h", f"c{i}") for i in range(30)], "document_id string, chunk_index long, heading_path string, content string")
    assert enrich(chunks, None, limited).count() == 0


def test_ingestion_with_a_limited_provider(spark, tmp_path):
    """Chunks of every document are enriched over several runs; each is answered once, and what is stored is whole."""
    log = tmp_path / "answered"
    log.mkdir()

    def provider(chunks):
        import os
        import uuid

        if len(os.listdir(log)) >= int((tmp_path / "most").read_text()):
            raise RateLimited
        for c in chunks:
            (log / uuid.uuid4().hex).write_text(c["content"][:40])
        return [{"id": c["id"], "context": "about", "category": "LEGAL"} for c in chunks]

    text = lambda d: "\n\n".join(f"# H{i}\n" + " ".join(f"{d}w{i}x{k}" for k in range(700)) for i in range(3))
    parsed = spark.createDataFrame([(d, d, f"title {d}", [(1, "" if d == "empty" else text(d))]) for d in ("a", "b", "empty")], f"{DOCS}, title string, pages array<struct<page: int, markdown: string>>").repartition(1)
    chain = ingest_chain(spark, f"{tmp_path}/t", 8, provider)
    for run, most in enumerate((5, 1000), 1):
        (tmp_path / "most").write_text(str(most))
        assert chain.advance(parsed) == run
        short = {r.document_id for r in chain.outcomes().where("state = 'PARTIAL'").collect()}
        assert not short & {r.document_id for r in chain.rows("stored").collect()}
        assert bool(short) == (most < 1000)
        kinds = {(r.kind, r.status): r["count"] for r in chain.rows("stored").groupBy("kind", "status").count().collect()}
    children = chain.rows("children").count()
    assert children > 20
    assert len(list(log.iterdir())) == children == kinds["child", None]
    assert kinds["document", "COMPLETED"] == 2
    failed = chain.rows("stored").where("status = 'FAILED'").collect()
    assert [(r.document_id, r.error_code) for r in failed] == [("empty", "NO_EXTRACTABLE_TEXT")]
    stored = chain.rows("stored")
    orphans = stored.where("kind = 'child'").join(stored.where("kind = 'parent'").select(F.col("id").alias("parent_id")), "parent_id", "left_anti")
    assert orphans.isEmpty()
    assert chain.behind(parsed).isEmpty()


def test_progress_is_seen_while_a_stage_runs(spark, tmp_path):
    seen, stop = [], {"at": 2}

    def answer(t):
        seen.append({r.document_id: (r.stage, r.done, r.total) for r in chain.progress().collect()})
        if len(seen) > stop["at"]:
            raise OSError("the machine is gone")
        return t["chunks"].select("document_id", "chunk_index", F.lit(len(seen)).alias("step_no"))

    stages = [chunks_stage({"a": 30, "b": 9}), Stage("answers", answer, "document_id string, chunk_index long, step_no int", ("chunks",), CHUNK), Stage("after", lambda t: t["answers"].groupBy("document_id").agg(F.count("*").alias("n")), "document_id string, n long", ("answers",))]
    chain = Chain(spark, str(tmp_path), stages, step_units=10)
    docs = docs_of(spark, a="1", b="1")
    assert chain.progress().isEmpty()
    with pytest.raises(OSError, match="gone"):
        chain.advance(docs)
    assert seen[0] == {"a": ("answers", 0, 30), "b": ("answers", 0, 9)}
    done = [sum(d for _, d, _ in s.values()) for s in seen]
    assert done[0] < done[1] < done[2] < 39 and all(s["a"][2] == 30 and s["b"][2] == 9 for s in seen)
    left = {r.document_id: (r.stage, r.done, r.total) for r in chain.progress().collect()}
    assert left == seen[2]  # of a run that was killed the last reports stay
    n_before = len(seen)
    stop["at"] = 1000
    chain.advance(docs)
    assert seen[n_before] == {d: ("answers", n, total) for d, (_, n, total) in left.items()}  # goes on where the steps before ended
    assert {r.document_id: r.n for r in chain.rows("after").collect()} == {"a": 30, "b": 9}
    assert chain.rows("answers").count() == 39
    assert chain.progress().isEmpty()
    assert "step" not in chain.rows("answers").columns
