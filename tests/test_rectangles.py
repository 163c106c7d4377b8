"""Stretches that meet, against comparing all pairs; pieces that know their place."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.tokens import placed_packer
from lodestone.operators.rectangles import overlapping, rectangles


@pytest.mark.parametrize("width", [1, 7, 512])
def test_overlaps_are_those_of_all_pairs(spark, width):
    rng = random.Random(width)
    stretch = lambda most: (a := rng.randint(0, 90), a + rng.randint(0, most))
    left = [(rng.choice("ab"), i, *stretch(40)) for i in range(40)]
    right = [(rng.choice("abc"), i, *stretch(9)) for i in range(60)]
    got = overlapping(spark.createDataFrame(left, "d string, i int, start int, end int"), spark.createDataFrame(right, "d string, j int, start int, end int"), ["d"], width)
    want = sorted((i, j) for d, i, a, b in left for e, j, x, y in right if d == e and max(a, x) < min(b, y))
    assert sorted((r.i, r.j) for r in got.collect()) == want


def test_rectangles_enclose_their_spans(spark):
    chunks = spark.createDataFrame([("d", 0, 0, 10), ("d", 1, 12, 30)], "document_id string, chunk_index long, start int, end int")
    spans = spark.createDataFrame([("d", 1, 0, 0, 6, 1.0, 1.0, 9.0, 2.0), ("d", 1, 0, 7, 14, 0.0, 3.0, 8.0, 4.0), ("d", 2, 0, 15, 40, 2.0, 0.0, 5.0, 1.0), ("e", 1, 0, 0, 50, 0.0, 0.0, 1.0, 1.0)], "document_id string, page int, block int, start int, end int, x0 double, y0 double, x1 double, y1 double")
    got = sorted(tuple(r) for r in rectangles(chunks, spans).collect())
    assert got == [("d", 0, 1, 0, 0.0, 1.0, 9.0, 4.0, 2), ("d", 1, 1, 0, 0.0, 3.0, 8.0, 4.0, 1), ("d", 1, 2, 0, 2.0, 0.0, 5.0, 1.0, 1)]


def test_pieces_know_their_place(spark):
    texts = [(1, "  a bb\n\nccc  d e\tf g "), (2, None), (3, "é 😀 x " * 5)]
    rows = spark.createDataFrame(texts, "i int, t string").select("i", placed_packer()(F.col("t"), 2, 3).alias("p")).collect()
    held = dict(texts)
    for r in rows:
        for p in r.p:
            assert " ".join(held[r.i][p.start : p.end].split()) == p.content
            assert p.token_count == len(p.content.split())
    assert [len(r.p) for r in sorted(rows)] == [2, 0, 5]


def test_a_worker_holds_the_pieces_of_few_texts_at_a_time(spark):
    import inspect

    import pandas as pd

    from lodestone.functions.tokens import TEXTS, placed_packer

    pieces = inspect.getclosurevars(placed_packer()).nonlocals["pieces"].func
    texts = pd.Series([f"one two {i} three" for i in range(1000)])
    found = list(pieces(iter([(texts, pd.Series([1] * 1000), pd.Series([2] * 1000))])))
    assert max(map(len, found)) <= TEXTS < 1000
    assert [[p["content"] for p in row] for row in pd.concat(found)] == [["one two", f"{i} three"] for i in range(1000)]
