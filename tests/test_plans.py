"""Read path, write path, sources and streams, end to end on small tables."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from lodestone.plans import read_path as R
from lodestone.plans import write_path as W
from lodestone.plans.providers import embed, enrich, enrich_batch
from lodestone.sources import objects as O
from lodestone.sources.pdf import PdfError, read_pdf_spans, styled_lines
from lodestone.streaming.arrivals import first_arrivals, progress_sessions, stage_states

DIM = 4


def corpus(spark):
    """4 parents of 3 children each; child i has the i-th unit vector."""
    children = spark.createDataFrame([(i, i // 3, "d", i // 3 + 1, f" child {i} ", [float(i == j) for j in range(12)]) for i in range(12)], "child_id long, parent_id long, document_id string, page_number int, content string, embedding array<float>")
    parents = spark.createDataFrame([(p, f" parent {p} text ", f"Part > {p}") for p in range(4)], "parent_id long, content string, heading_path string")
    return children, parents


def stages(spark, **more):
    children, parents = corpus(spark)
    generate = lambda q, c: c.groupBy("q_id").agg(F.concat_ws(" ", F.array_sort(F.collect_list(F.concat(F.lit("["), F.col("ordinal").cast("string"), F.lit("]"))))).alias("answer"))
    return R.Stages(retrieve=R.vector_retriever(children, 12), expand=R.expand_with(children, parents), build_context=R.context_within(6), generate=generate, **more)


def questions(spark):
    return spark.createDataFrame([(1, [float(j == 6) for j in range(12)])], "q_id long, embedding array<float>")


def test_ask(spark):
    answers, context, trace = R.ask(questions(spark), stages(spark))
    rows = context.orderBy("ordinal").collect()
    assert (rows[0].text, rows[0].heading, rows[0].matched, rows[0].page_number) == ("parent 2 text", "Part > 2", "child 6", 3)
    assert [r.ordinal for r in rows] == [1, 2]
    assert answers.first().answer == "[1] [2]"
    assert [n["node"] for n in trace.nodes] == ["rewrite", "plan", "retrieve", "fuse", "build_context", "gate", "generate", "reflect"] or trace.iterations == 1


def test_fallbacks_and_fatal_stages(spark):
    def broken(*_):
        raise ValueError("prose")

    _, _, trace = R.ask(questions(spark), stages(spark, rewrite=broken, gate=broken))
    assert [n["node"] for n in trace.nodes if "fallback" in n] == ["rewrite", "gate"]
    trace = R.Trace()
    with pytest.raises(ValueError, match="prose"):
        R.ask(questions(spark), R.with_stage(stages(spark), retrieve=broken), trace=trace)
    assert trace.nodes[-1]["error"] == "ValueError: prose"


def test_the_loop_accumulates_and_still_answers(spark):
    other = spark.createDataFrame([(1, [float(j == 0) for j in range(12)])], "q_id long, embedding array<float>")
    more = R.with_stage(stages(spark, gate=lambda q, c: R.Verdict(False, other)), build_context=R.context_within(100))
    answers, context, trace = R.ask(questions(spark), more, max_iterations=3)
    assert trace.iterations == 3
    assert context.count() == context.select("parent_id").distinct().count() == 4
    assert answers.count() == 1


def test_write_path_end_to_end(spark):
    body = " ".join(f"w{i}" for i in range(700))
    parsed = spark.createDataFrame([("d", [(2, "more " * 30, "text", 1.0), (1, f"# Step 1\n{body}\n# Step 2\n{body}", "text", 1.0)]), ("e", [(1, "tiny", "text", 1.0)])], "document_id string, pages array<struct<page: int, markdown: string, source: string, confidence: double>>")
    documents = spark.createDataFrame([("d", "Title"), ("e", "Empty")], "document_id string, title string")
    parents, children = W.structure(parsed)
    parents, children = parents.cache(), children.cache()
    assert [r.chunk_index for r in parents.orderBy("chunk_index").collect()] == [0, 1, 2]
    assert [r.page_start for r in parents.orderBy("chunk_index").collect()] == [1, 1, 2]
    assert {r.heading_path for r in parents.collect()} == {"Step 1", "Step 2"}
    assert [r.chunk_index for r in children.orderBy("chunk_index").collect()] == list(range(children.count()))
    assert [r.document_id for r in W.without_text(documents, children).collect()] == ["e"]
    none = spark.createDataFrame([], "document_id string, chunk_index long")
    enriched = enrich(children, none)
    text = W.contextualized(children, enriched, documents)
    assert text.first().contextualized.startswith("Title > Step")
    vectors = embed(text, none, DIM)
    rows = W.child_rows(text, vectors, parents).cache()
    assert rows.count() == children.count()
    assert W.persist(rows, rows).exceptAll(rows).count() == 0
    assert enrich(children, enriched).count() == 0


def test_stages_go_stale(spark):
    docs = spark.createDataFrame([("a", "x"), ("b", "y")], "document_id string, text string")
    done = docs.select("document_id", W.fingerprint("text").alias("input_fp"))
    assert W.to_run(docs, done, "text").count() == 0
    assert [r[0] for r in W.to_run(docs.replace("y", "z", "text"), done, "text").collect()] == ["b"]


def test_enrichment_retries_alone_then_gives_up():
    calls = []

    def provider(chunks):
        calls.append([c["id"] for c in chunks])
        return [{"id": c["id"], "context": "c", "category": "LEGAL"} for c in chunks if c["id"] != 1 and (c["id"] != 2 or len(chunks) == 1)]

    got, limited = enrich_batch([{"id": i, "heading": None, "content": ""} for i in range(3)], provider)
    assert not limited
    assert [(g["id"], g["context"], g["category"]) for g in got] == [(0, "c", "LEGAL"), (1, "", "OTHER"), (2, "c", "LEGAL")]
    assert calls == [[0, 1, 2], [1], [1], [2]]


def test_what_a_rate_limited_provider_answered_is_kept(spark):
    from lodestone.plans.providers import RateLimited

    def limited(chunks):
        if len(chunks) == 1 or any(c["content"] == "c4" for c in chunks):
            raise RateLimited
        return [{"id": c["id"], "context": "done", "category": "LEGAL"} for c in chunks if c["content"] != "c1"]

    chunks = spark.createDataFrame([("d", i, "h", f"c{i}") for i in range(6)], "document_id string, chunk_index long, heading_path string, content string").coalesce(1)
    none = spark.createDataFrame([], "document_id string, chunk_index long, context string, category string")
    first = enrich(chunks, none, limited, size=2).persist()
    assert [tuple(r)[1:] for r in first.collect()] == [(0, "done", "LEGAL")]
    assert sorted(r.chunk_index for r in enrich(chunks, first).collect()) == [1, 2, 3, 4, 5]

    def full(texts):
        if "t2" in texts:
            raise RateLimited
        return [[1.0, 0.0]] * len(texts)

    texts = spark.createDataFrame([("d", i, f"t{i}") for i in range(4)], "document_id string, chunk_index long, contextualized string").coalesce(1)
    assert [r.chunk_index for r in embed(texts, none, 2, full, size=1).collect()] == [0, 1]


def test_questions_get_vectors_and_prompts_answers(spark):
    from lodestone.plans.providers import complete, embed_questions, read_pages

    asked = spark.createDataFrame([(1, "a"), (2, " "), (3, None)], "q_id long, text string")
    given = {r.q_id: r.embedding for r in embed_questions(asked, 2, lambda texts: [[3.0, 4.0]] * len(texts)).collect()}
    assert given == {1: [0.6, 0.8], 2: None, 3: None}
    assert {r.q_id: r.embedding and round(sum(x * x for x in r.embedding), 6) for r in embed_questions(asked, 8).collect()} == {1: 1.0, 2: None, 3: None}
    prompts = spark.createDataFrame([(1, "sources\nwhat?"), (2, None)], "q_id long, prompt string")
    assert {r.q_id: r.answer for r in complete(prompts).collect()} == {1: "what? [1]", 2: None}
    pages = spark.createDataFrame([("d", i, b"x") for i in range(4)], "document_id string, page int, image binary")
    assert read_pages(pages, lambda b: "read").count() == 4
    assert read_pages(pages, lambda b: "read", deadline=1.0).count() == 0


def test_a_stage_that_fails_on_its_rows_falls_back(spark):
    broken = lambda q: q.withColumn("text", F.raise_error(F.lit("no rewrite")).cast("string"))
    seen = lambda *_: spark.createDataFrame([(1, 1, "passage")], "q_id long, ordinal int, text string")
    stages = R.Stages(retrieve=lambda q: q, expand=lambda c: c, build_context=seen, generate=lambda q, c: q.select("q_id", F.concat("text", F.lit(" [1] [7]")).alias("answer")), fuse=lambda q, c: c, rewrite=broken)
    questions = spark.createDataFrame([(1, "asked")], "q_id long, text string")
    answers, _, trace = R.ask(questions, stages)
    assert answers.first().answer == "asked [1] [7]"
    assert "no rewrite" in trace.nodes[0]["fallback"]
    assert [tuple(r) for r in trace.citations.collect()] == [("1", 1)]
    with pytest.raises(Exception, match="no rewrite"):
        R.ask(questions, R.with_stage(stages, rewrite=R.keep, retrieve=broken))


def test_documents_of_no_or_too_many_chunks_are_refused(spark):
    docs = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "document_id string, content_fp string")
    children = spark.createDataFrame([("x",), ("x",), ("y",)], "document_id string")
    codes = W.refused(docs, children, most=1)
    assert sorted(tuple(r) for r in codes.collect()) == [("x", "TOO_MANY_CHUNKS"), ("z", "NO_EXTRACTABLE_TEXT")]
    assert [r[0] for r in W.accepted(docs.select("document_id"), codes).collect()] == ["y"]


def test_objects_and_artifacts(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "a.bin").write_bytes(b"abc")
    row = O.read_objects(spark, f"{tmp_path}/raw").first()
    assert (row.length, row.sha256[:8]) == (3, "ba7816bf")
    assert O.exists(spark, f"{tmp_path}/raw/a.bin")
    assert not O.exists(spark, f"{tmp_path}/raw/b.bin")
    assert O.first_existing(spark, f"{tmp_path}/x", f"{tmp_path}/raw") == f"{tmp_path}/raw"
    assert O.delete(spark, f"{tmp_path}/raw/b.bin") is False
    (tmp_path / "p.json").write_text(json.dumps({"title": "t", "pages": [{"page": 1, "markdown": "m"}]}))
    pages = O.pages_of(O.read_artifact(spark, f"{tmp_path}/p.json", O.PARSED).withColumn("document_id", F.lit("d")))
    assert [(r.document_id, r.page, r.markdown) for r in pages.collect()] == [("d", 1, "m")]
    reply = json.dumps({"chunks": [{"id": "1", "context": "c", "category": "LEGAL"}, {"id": "x"}, {"id": 2}]})
    items = spark.createDataFrame([(reply,), ("{bad",), (None,)], "r string").select(O.parse_enrichment(F.col("r")).alias("i")).collect()
    assert [[(c.id, c.context) for c in r.i] for r in items] == [[(1, "c"), (2, "")], [], []]
    keys = spark.createDataFrame([("raw/a/b.pdf",), ("other/x",), ("raw",)], "k string").select(O.split_key(F.col("k")).alias("s")).collect()
    assert [r.s and tuple(r.s) for r in keys] == [("raw", "a/b.pdf"), None, None]
    O.write_vectors(spark.createDataFrame([("d", [1.0, 2.0])], "id string, embedding array<double>"), f"{tmp_path}/v")
    assert O.read_vectors(spark, f"{tmp_path}/v").schema["embedding"].dataType.simpleString() == "array<float>"


def test_pdf_errors_are_rows(spark):
    def reader(content):
        if content == b"bad":
            raise PdfError("PDF_MALFORMED")
        yield 1, 0, 0, "Cafe\u0301 ", 10.04, True
        yield 1, 0, 0, " ", 30.0, False
        yield 1, 0, 0, "bar", 12.0, True
        yield 1, 1, 0, "  ", 10.0, False
        yield 1, 2, 1, "thin", 9.0, False

    rows = spark.createDataFrame([("a", b"bad"), ("b", b"ok")], "path string, content binary")
    lines = styled_lines(read_pdf_spans(rows, reader)).orderBy("path", "line").collect()
    assert [tuple(r) for r in lines] == [("a", None, None, None, None, None, None, "PDF_MALFORMED"), ("b", 1, 0, 0, "Café  bar", 12.0, True, None), ("b", 1, 1, 1, "thin", 9.0, False, None)]


def run_stream(spark, frame, name, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("s1", "2024-01-01 00:00:00"), ("s1", "2024-01-01 00:01:00"), ("s2", "2024-01-01 00:02:00")], "sha256 string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    assert sorted(r.sha256 for r in run_stream(spark, first_arrivals(stream), "arrivals").collect()) == ["s1", "s2"]
    sessions = run_stream(spark, progress_sessions(stream, "sha256"), "sessions", "complete").collect()
    assert {(r.sha256, r.n) for r in sessions} == {("s1", 2), ("s2", 1)}


def test_stage_machine_as_a_stream(spark, tmp_path):
    events = [("a", 1, "PARSING", "ok", None), ("a", 2, "STRUCTURING", "transient", "x"), ("b", 1, "PARSING", "permanent", "y"), ("b", 2, "PARSING", "ok", None)]
    rows = spark.createDataFrame(events, "document_id string, seq long, stage string, outcome string, error string")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
        got = {r.document_id: (r.status, r.stage, r.attempts) for r in run_stream(spark, stage_states(stream), "states", "update").collect()}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    assert got == {"a": ("RETRYING", "PARSING", 1), "b": ("DEAD_LETTER", None, 0)}
