"""Feedback terms, rewriting and the gate on cases told by hand."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from lodestone.operators.feedback import feedback_terms, rewritten, score_spread
from lodestone.operators import keyword
from lodestone.operators.keyword import Corpus, keyword_bm25
from lodestone.plans import read_path as R


def world(spark):
    texts = ["red apple pie recipe", "apple pie crust butter", "green apple tart", "car engine oil", "engine repair", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    words = [w for t in texts if t for w in set(t.split())]
    frequencies = spark.createDataFrame([(w, words.count(w)) for w in sorted(set(words))], "term string, df long")
    return texts, docs, frequencies


def test_terms_are_weighed_by_shares_and_rarity(spark):
    texts, docs, frequencies = world(spark)
    hits = spark.createDataFrame([(1, 0, 3.0, 1), (1, 1, 1.0, 2), (1, 3, 9.0, 3), (2, 4, 2.0, 1)], "q_id long, doc_id long, score double, rank long")
    questions = spark.createDataFrame([(1, "Apple pie"), (2, "engine"), (3, "nothing")], "q_id long, text string")
    got = {(r.q_id, r.term): r.weight for r in feedback_terms(hits, docs, questions, frequencies, 7, documents=2).collect()}
    want = {(1, "red"): 0.75 / 4, (1, "recipe"): 0.75 / 4, (1, "crust"): 0.25 / 4, (1, "butter"): 0.25 / 4, (2, "repair"): 0.5}
    assert got == {k: round(v * math.log(1 + 7 / 1), 6) for k, v in want.items()}
    few = feedback_terms(hits, docs, questions, frequencies, 7, documents=2, added=2)
    assert [r.text for r in rewritten(questions, few).orderBy("q_id").collect()] == ["Apple pie recipe red", "engine repair", "nothing"]


def test_spread_of_scores(spark):
    hits = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0), (3, 0.0)], "q_id long, score double")
    assert {r.q_id: (r.spread, r.sufficient) for r in score_spread(hits).collect()} == {1: (0.0, False), 2: (0.5, True), 3: (0.0, False)}


def test_stages_with_content(spark):
    _, docs, frequencies = world(spark)
    search = lambda q: keyword_bm25(docs, q)
    rewrite = R.rewrite_by_feedback(search, docs, frequencies, 7, documents=1, added=1)
    questions = spark.createDataFrame([(1, "tart"), (2, "apple")], "q_id long, text string")
    seen = {r.q_id: r.text for r in rewrite(questions).collect()}
    assert seen[1] == "tart green"
    verdict = R.gate_by_spread(search, rewrite, least=0.01)(questions, docs)
    assert not verdict.sufficient
    assert {r.q_id for r in verdict.refined.collect()} == {1, 2}
    assert R.gate_by_spread(search, rewrite, least=0.0)(questions, docs).sufficient
    asked = []

    def retrieve(q):
        asked.append(sorted(r.text for r in q.collect()))
        return search(q)

    stages = R.Stages(retrieve, lambda c: c, lambda held, c: c.select("q_id", F.col("rank").cast("int").alias("ordinal")), lambda q, c: q.select("q_id", F.lit("[1]").alias("answer")), rewrite=lambda q: q, gate=R.gate_by_spread(search, rewrite, 0.01), fuse=lambda q, c: c)
    _, _, trace = R.ask(questions, stages, 2)
    assert trace.iterations == 2 and asked[0] == ["apple", "tart"] and asked[1] != asked[0]


def test_a_corpus_is_split_once_for_all_passes(spark, monkeypatch):
    _, docs, frequencies = world(spark)
    questions = spark.createDataFrame([(1, "Apple pie"), (2, "engine oil"), (3, "nothing"), (4, "green tart apple"), (5, "")], "q_id long, text string")
    want = sorted(map(tuple, keyword_bm25(docs, questions).collect()))
    corpus = Corpus.of(docs)
    assert sorted(map(tuple, corpus.frequencies.collect())) == sorted(map(tuple, frequencies.collect()))
    assert corpus.total == 7
    monkeypatch.setattr(keyword, "_split", None)  # no text is read again
    monkeypatch.setattr(keyword, "document_frequency", None)
    assert sorted(map(tuple, keyword_bm25(corpus, questions).collect())) == want
    monkeypatch.setattr(keyword, "BLOCK", 2)
    assert sorted(map(tuple, keyword_bm25(corpus, questions).collect())) == want


def test_search_rules_out_documents_and_is_brute_force(monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    split = [[w for w in rng.choices(words, weights=[1 / (i + 1) for i in range(300)], k=rng.choice([3, 40, 200]))] for _ in range(3000)] + [[], None]
    rows = [(q, t) for q in range(40) for t in rng.sample(words[: 20 if q % 2 else 300], 1 + q % 7)]
    asked = keyword.Asked.of(rows)
    weight = {t: 1 / (1 + sum(t in (s or []) for s in split)) for t in asked.terms}
    weights = np.array([weight[t] for t in asked.terms])
    batch = pa.RecordBatch.from_arrays([pa.array(range(3002)), pa.array(split, pa.list_(pa.string()))], ["doc_id", "terms"])
    want, pairs = [], 0
    for q in range(40):
        mine = sorted(t for p, t in rows if p == q)
        scored = [(-math.floor(sum(weight[t] * s.count(t) / (s.count(t) + 1 + len(s) / 50) for t in mine) * 1e6 + 0.5) / 1e6, i) for i, s in enumerate(split) if s and set(mine) & set(s)]
        pairs += len(scored)
        want += [(q, i, -score) for score, i in sorted(scored)[:5]]
    part = lambda term, times, length: weights[term] * times / (times + 1 + length / 50)
    taken, before = [], keyword._Best.take
    monkeypatch.setattr(keyword._Best, "take", lambda self, q, *a: (taken.append(len(q)), before(self, q, *a))[1])
    for cells, most in ((1_000_000, 64), (500, 256), (1_000_000, 2_048)):
        monkeypatch.setattr(keyword, "CELLS", cells)
        monkeypatch.setattr(keyword, "SLICE", most)
        taken.clear()
        got = [tuple(r.values()) for b in keyword._searcher(asked, 5, part)(iter([batch])) for r in b.to_pylist()]
        assert sorted(got) == sorted(want)
        assert most > 64 or sum(taken) < pairs / 5


def test_questions_of_a_pass_are_many(spark):
    _, docs, _ = world(spark)
    corpus, asked = Corpus.of(docs), spark.range(5000).selectExpr("id AS q_id", "'red apple' AS text")
    plan = keyword_bm25(corpus, asked)._jdf.queryExecution().analyzed().toString()
    assert "Union" not in plan
