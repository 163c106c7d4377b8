"""Line dedup and sharding against brute force."""

from __future__ import annotations

import random
import zlib

import pytest

from lodestone.llm import histogram, line_dedup
from lodestone.llm.histogram import kth_boundary, splitters
from lodestone.llm.line_dedup import _numbered, dedup_lines, repeated_runs, suffix_ranks
from lodestone.llm.sharding import shard_by_bytes

DOCS = "doc_id long, text string"


def brute_dedup(docs, min_lines, min_words):
    """Delete every line of a run that counts and occurred before, in the order of id and text."""
    seen, out = {}, {}
    for doc_id, text in sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0)):
        lines = text.split("\n")
        gone = set()
        for n in range(1, len(lines) + 1):
            for i in range(len(lines) - n + 1):
                run = lines[i : i + n]
                if n >= min_lines or sum(len(x.split()) for x in run) >= min_words:
                    if seen.setdefault(tuple(run), (doc_id, i)) != (doc_id, i):
                        gone |= set(range(i, i + n))
        out[doc_id] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone))
    return out


@pytest.mark.parametrize(("min_lines", "min_words"), [(1, 9), (3, 5), (6, 2)])
def test_line_dedup_is_brute_force(spark, min_lines, min_words):
    rng = random.Random(min_lines)
    docs = [(i, "\n".join(rng.choice(["a", "b b", "c c c c"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    docs += [(100, "x\n" * 40), (101, docs[3][1]), (102, ""), (103, "\n\n\n\n")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in dedup_lines(spark.createDataFrame(docs, DOCS), min_lines, min_words).collect()}
    assert got == brute_dedup(docs, min_lines, min_words)


def test_line_dedup_edges(spark):
    run = "a\nb\nc"
    rows = [(1, run, 5, "p"), (1, run, 6, "q"), (None, run, 7, None), (2, None, 8, "r"), (3, f"x\n{run}", 9, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_lines int, gone_lines string")
    out = dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "gone_lines", "n_lines", "n_removed"]
    # The null id comes first; the row that repeats id and text is one document with its copy.
    assert sorted(((r.doc_id, r.text, r.gone_lines, r.n_removed) for r in out.collect()), key=str) == sorted([(None, run, None, 0), (1, "", "p", 3), (1, "", "q", 3), (2, None, "r", 0), (3, "x", "s", 3)], key=str)
    assert dedup_lines(docs.limit(0)).count() == 0
    assert dedup_lines(spark.createDataFrame([(1, "w " * 100_000 + "\n")], DOCS)).first().n_lines == 2


def by_brute_force(docs):
    """(doc, line, n) of the maximal runs that occurred before, and the place of the earliest copy."""
    lines = [(d, t.split("\n")) for d, t in sorted(docs)]
    seen, found = {}, []
    for d, text in lines:
        reached = 0
        for i in range(len(text)):
            n = 0
            while i + n < len(text) and (first := seen.get(tuple(text[i : i + n + 1]), (d, i))) < (d, i):
                n, copy = n + 1, first
            for k in range(1, len(text) - i + 1):
                seen.setdefault(tuple(text[i : i + k]), (d, i))
            if n and i + n > reached:
                found.append((d, i, n, *copy))
            reached = max(reached, i + n)
    return found


@pytest.mark.parametrize("seed", (0, 2))
def test_maximal_runs_are_brute_force(spark, seed):
    """Runs of any length come as one interval each, with their earliest copy."""
    rng = random.Random(seed)
    docs = [(i, "\n".join(rng.choice("abcd"[: 2 + seed]) for _ in range(rng.randint(1, 12)))) for i in range(25)]
    long = [f"line {i}" for i in range(37)]
    docs += [(50, "\n".join(long)), (51, "\n".join(["p", *long[3:30], "q", *long[20:]])), (52, "\n".join(long[:36])), (53, "x\n" * 21)]
    got = [tuple(r) for r in repeated_runs(spark.createDataFrame(docs, DOCS)).collect()]
    assert sorted(got) == by_brute_force(docs)
    assert (51, 1, 27, 50, 3) in got and (52, 0, 36, 50, 0) in got


def test_ranks_are_in_suffix_order(spark):
    """Ranks put suffixes in the order of their lines' ids; depths double up to the longest repeat."""
    import hashlib

    docs = [(i, "\n".join(random.Random(i).choice("ab") for _ in range(8))) for i in range(20)] + [(i, "\n".join(map(str, range(40)))) for i in (30, 31)]
    some = spark.createDataFrame(docs, DOCS)
    numbered, room = _numbered(some)
    tables = suffix_ranks(some, numbered)
    assert room == 41 and len(tables) == 6  # 1, 2, 4, 8, 16, 32 lines
    text = [t.split("\n") for _, t in docs]
    for k, rows in enumerate(tables):
        ids = {r.place: tuple(hashlib.md5(x.encode()).digest() for x in text[r.place // room][r.place % room :][: 1 << k]) for r in rows.collect()}
        ordered = sorted(rows.collect(), key=lambda r: r["head"])
        assert all((ids[a.place] < ids[b.place]) == (a["head"] < b["head"]) for a, b in zip(ordered, ordered[1:], strict=False))
        assert all(len(x) == 1 << k for x in ids.values())


@pytest.mark.parametrize("most", [4, 1024])
def test_splitters_are_exact(spark, monkeypatch, most):
    monkeypatch.setattr(histogram, "MAX_BOUNDS", most)
    rng = random.Random(1)
    keys = [(rng.choice([rng.randint(-(1 << 62), 1 << 62), rng.randint(0, 50)]), rng.randint(1, 99)) for _ in range(500)]
    rows = spark.createDataFrame(keys, "key long, weight long")
    total = sum(w for _, w in keys)
    below = lambda b: sum(w for k, w in keys if k < b)
    targets = [total * i // 7 for i in range(1, 7)]
    for target, bound in zip(targets, splitters(rows, targets, 60), strict=True):
        assert abs(below(bound) - target) <= 60 or abs(below(bound) - target) <= max(sum(w for k, w in keys if k == key) for key, _ in keys)
    order = sorted(k for k, _ in keys)
    bound = kth_boundary(rows, 123)
    assert sum(k < bound for k in order) >= 123


def check_shards(rows, shards):
    for s in range(shards):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_sharding(spark):
    rng = random.Random(2)
    docs = [(i, "é" * rng.randint(0, 300)) for i in range(2000)] + [(5000 + i, "hot " * 40) for i in range(1000)]
    rows = shard_by_bytes(spark.createDataFrame(docs, DOCS), range_rows=60).collect()
    texts = dict(docs)
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
    assert max(sizes) - min(sizes) < 0.03 * sum(sizes) / 8
    check_shards(rows, 8)


def test_sharding_edges(spark):
    rows = shard_by_bytes(spark.createDataFrame([(None, None, 1), (1, "a", 2), (1, "a", 3), (2, "", 4)], f"{DOCS}, slot int")).collect()
    assert sorted((r["size"], r.text_crc32) for r in rows) == sorted([(1, 0), (2, zlib.crc32(b"a")), (2, zlib.crc32(b"a")), (1, 0)])
    check_shards(rows, 8)
    assert shard_by_bytes(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("row", [(7, "x" * 999), (None, "same text"), (None, None)])
def test_rows_that_are_equal_are_cut(spark, row):
    """Bytes stay near equal, and no task numbers more than its rows, if all rows are one and the same."""
    other = [(i, "other " * 20) for i in range(200)]
    for docs in ([row] * 2000, [row] * 1000 + other):
        rows = shard_by_bytes(spark.createDataFrame(docs, DOCS), range_rows=100).collect()
        assert len(rows) == len(docs)
        sizes = [sum(r["size"] for r in rows if r.shard == s) for s in range(8)]
        assert max(sizes) - min(sizes) <= 0.03 * sum(sizes) / 8 + 2 * max(r["size"] for r in rows)
        check_shards(rows, 8)


def test_numbering_starts_no_python_workers(spark, monkeypatch):
    joined = []
    plain = line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name: joined.append(df._jdf.queryExecution().optimizedPlan().toString()) or plain(df, name))
    _numbered(spark.createDataFrame([(1, "a"), (2, "b\nc")], "doc_id long, text string"))
    assert "LogicalRDD" not in joined[-1]
    assert "LocalRelation" in joined[-1]
