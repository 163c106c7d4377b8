"""The corpus pipeline stage by stage against brute force, and the registered queries."""

from __future__ import annotations

import random
import re

import pytest

import __spark_entry__
import corpus_pipeline
from lodestone.llm.decontaminate import ERROR_RATE, normal
from lodestone.llm.line_dedup import MIN_LINES, MIN_WORDS
from test_jaccard import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"{a}{b}" for a in ("ran", "tel", "mor", "sib", "cal", "dun", "fes", "gol") for b in ("ta", "no", "ri", "le", "mu", "so")]


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Documents with toxic ones, repeated passages, copies and benchmark items planted in them."""
    rng = random.Random(12)
    text = lambda n: "\n".join(" ".join(rng.choices(WORDS, k=12)) for _ in range(n))
    passage = text(4)
    items = [(i, " ".join(rng.choices(WORDS, k=25))) for i in range(5)]
    docs, toxic, leaks = [], set(), set()
    for i in range(300):
        body = text(rng.randint(3, 8))
        if i % 6 == 0:
            words = body.split(" ")
            for at in rng.sample(range(len(words)), 3):
                words[at] = rng.choice(["zounderel", "xumba", "qwibbler"])
            body = " ".join(words)
            toxic.add(i)
        elif i % 7 == 1:
            body += f"\n{passage}"
        elif i % 11 == 2:
            item = items[i % 5][1]
            body += f" {item[:40]}x{item[40:]} end"
            leaks.add(i)
        docs.append((i, body, "en", f"src{i % 3}", len(body)))
    docs += [(1000 + i, *docs[i][1:]) for i in range(1, 20)]
    docs += [(2000, None, None, None, None), (2001, "", "en", None, 0), (None, "no id at all", "en", "src0", 12)]
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, toxic, leaks, items


def near(pattern, text, budget):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row) <= budget


def test_stages(spark, world):
    folder, toxic, leaks, items = world
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{folder}/out-{name}"
        stage(spark, docs, folder).write.parquet(path)
        steps[name] = (docs.collect(), spark.read.parquet(path))
        docs = steps[name][1]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns

    before, after = steps["toxicity"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after.collect()}
    assert gone == toxic | {i + 1000 for i in toxic if 1 <= i < 20}

    before, after = steps["line_dedup"]
    seen, want = set(), {}
    for r in sorted(before, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        lines = (r.text or "").split("\n")
        drop = set()
        for n in range(1, MIN_LINES + 1):
            for i in range(len(lines) - n + 1):
                window = tuple(lines[i : i + n])
                if n < MIN_LINES and sum(x.count(" ") + 1 for x in window) < MIN_WORDS:
                    continue
                if window in seen:
                    drop |= set(range(i, i + n))
                seen.add(window)
        want[r.doc_id] = None if r.text is None else "\n".join(x for i, x in enumerate(lines) if i not in drop)
    got = {r.doc_id: r for r in after.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got.values())
    assert any(r.text == "" and i not in (None, 2001) for i, r in got.items())

    before, after = steps["near_dedup"]
    rows = [((r.doc_id is not None, r.doc_id or 0), r.text) for r in before]
    kept = brute(rows)
    assert {(r.doc_id is not None, r.doc_id or 0) for r in after.collect()} == kept
    assert len(kept) < len(rows)

    before, after = steps["benchmark_decontamination"]
    held = {r.doc_id for r in before if any(near(normal(t), normal(r.text), int(len(normal(t)) * ERROR_RATE)) for _, t in items)}
    assert {r.doc_id for r in before} - {r.doc_id for r in after.collect()} == held
    assert leaks - toxic <= held | ({i for i in leaks} - {r.doc_id for r in before})
    assert len(held) > 5

    before, after = steps["best_fit_packing"]
    pieces = after.collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in before}
    filled = {}
    for r in pieces:
        filled[r.sequence_id] = filled.get(r.sequence_id, 0) + r.length
    assert max(filled.values()) <= 2048
    assert len(filled) <= -(-sum(filled.values()) // 2048) + 1

    ran = corpus_pipeline.run(spark, folder)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.ids_crc32) for r in ran.collect()) == sorted((r.doc_id is not None, r.doc_id or 0, r.piece, r.ids_crc32) for r in pieces)


def test_all_operators_and_the_pipeline_are_registered():
    names = __spark_entry__.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14))
    assert "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_line_dedup_matches_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()["op2_line_dedup"]).fetchall()
    got = __spark_entry__.queries()["op2_line_dedup"](spark, sf).select("doc_id", "text", "n_lines", "n_removed")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_stages_send_small_batches_to_workers(spark, tmp_path):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.createDataFrame([(i, "some words", "en", "s", 10) for i in range(3)], SCHEMA)
    before = spark.conf.get(key)
    try:
        for given, held in ((10_000, corpus_pipeline.BATCH_ROWS), (0, corpus_pipeline.BATCH_ROWS), (500, 500)):
            spark.conf.set(key, given)
            corpus_pipeline.near_dedup_stage(spark, docs, str(tmp_path))
            assert int(spark.conf.get(key)) == held
    finally:
        spark.conf.set(key, before)
