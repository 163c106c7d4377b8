"""The pipeline's near-dedup stage against brute-force Jaccard similarity."""

from __future__ import annotations

import random

import corpus_pipeline
from lodestone.llm.jaccard import keep_one_of_similar

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def runs(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    """doc_ids that stay: the first of each component of similar texts."""
    sets, root = [(i, runs(t)) for i, t in rows], {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a == b or both * 10 >= 8 * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i for i in root if find(i) == i}


def test_stage_drops_edited_copies(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    docs = []
    for i in range(120):
        body = rng.choices(words, k=rng.randint(60, 300))
        docs.append((i, " ".join(body)))
        for k, edits in enumerate(rng.sample(range(12), 3)):
            changed = list(body)
            for at in rng.sample(range(len(body)), edits):
                changed[at] = rng.choice(words)
            docs.append((1000 * (k + 1) + i, " ".join(changed).upper()))
    # A chain: each is similar to the next, its ends are not.
    chain = rng.choices(words, k=400)
    docs += [(5000 + k, " ".join(chain[20 * k : 20 * k + 260])) for k in range(7)]
    docs += [(9000, None), (9001, ""), (9002, " \n"), (9003, "one"), (9004, "One"), (9005, "one two")]
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], SCHEMA).repartition(5)
    out = corpus_pipeline.near_dedup_stage(spark, rows, "").collect()
    want = brute(docs)
    assert {r.doc_id for r in out} == want
    assert len(out) == len(want)
    assert 480 - len([i for i in want if i < 5000]) > 100


def test_every_pair_of_a_bucket_is_compared(spark, monkeypatch):
    """With one band key for all, links that pass by the bucket's hub are still found, and no others."""
    from lodestone.llm import jaccard

    keyed = jaccard._keyed
    monkeypatch.setattr(jaccard, "_keyed", lambda docs: keyed(docs).selectExpr("doc_id", "text_hash", "node", "size", "if(size > 0, array(7L), keys) AS keys"))
    rng = random.Random(8)
    docs = []
    for i in range(12):
        body = [f"x{rng.randrange(10_000)}" for _ in range(100)]
        docs += [(i, " ".join(body)), (100 + i, " ".join([*body[:-1], "end"]))]
    out = keep_one_of_similar(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id for r in out.collect()} == brute(docs) == set(range(12))


def test_candidates_come_from_simhash_too(spark, monkeypatch):
    from lodestone.llm.simhash import fingerprint
    from lodestone.llm import jaccard

    text = " ".join(f"w{i}" for i in range(400))
    rows = [(1, text, "en"), (2, text + " more", "en"), (3, "something else in a few words", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fps = [fingerprint(t) for _, t, _ in rows]
    assert (fps[0] ^ fps[1]).bit_count() <= 2 < (fps[0] ^ fps[2]).bit_count()
    keyed = jaccard._keyed(docs)
    node = {r.doc_id: r.node for r in keyed.collect()}
    pairs = jaccard.simhash_pairs(docs, keyed.selectExpr("node", "struct(doc_id, text_hash) AS first"))
    assert [tuple(r) for r in pairs.collect()] == [tuple(sorted((node[1], node[2])))]
    asked = []
    monkeypatch.setattr(jaccard, "simhash_pairs", lambda *a, f=jaccard.simhash_pairs: asked.append(1) or f(*a))
    assert {r.doc_id for r in jaccard.keep_one_of_similar(docs).collect()} == {1, 3} and asked
