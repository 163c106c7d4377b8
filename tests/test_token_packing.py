"""Packing by tokens against packing word by word with the tokenizer itself."""

from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.functions.tokens import WordCosts, bpe_counter, cut_points, token_count, token_packer
from lodestone.plans.write_path import structure
from lodestone.queries import table

PATH = public_tokenizers.path("byte_bpe_50k.json")
TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True  # such strings in a text are text


def cost(text):
    return len(TOKENIZER.encode(text, add_special_tokens=False).ids)


def word_by_word(words, least, most, cost=cost):
    """The rule, a word at a time: (content, tokens)."""
    done, held, tokens = [], [], 0
    for word in words:
        more = cost(" " + word if held else word)
        if held and tokens + more > most:
            done.append((held, tokens))
            held, tokens, more = [], 0, cost(word)
        held = [*held, word]
        tokens += more
    if held:
        done.append((held, tokens))
    if len(done) > 1 and done[-1][1] < least:
        last, n = done.pop()
        done[-1] = (done[-1][0] + last, done[-1][1] + n + cost(" " + last[0]) - cost(last[0]))
    return [(" ".join(w), n) for w, n in done]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=40), st.integers(1, 12), st.integers(1, 20))
def test_cuts_of_any_costs(costs, least, most):
    words = [f"{i}" for i in range(len(costs))]
    table = {w: c for w, c in zip(words, costs, strict=True)}
    counter = lambda texts: [table[t.strip()][0 if t.startswith(" ") else 1] for t in texts]
    behind, alone = WordCosts(counter, kept=3)(words)
    got = [(" ".join(words[a:b]), n) for a, b, n in cut_points(behind, alone, least, most)]
    assert got == word_by_word(words, least, most, lambda t: counter([t])[0])


@pytest.mark.parametrize(("least", "most"), [(100, 200), (5, 9)])
def test_pieces_are_those_of_word_by_word(spark, least, most):
    docs = [(r.doc_id, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").where("doc_id < 60").select("doc_id", "text").collect()]
    docs += [(1000, None), (1001, " \n "), (1002, "từ từ điển " * 50 + "x" * 900), (1003, "<|endoftext|> a")]
    packing = token_packer(bpe_counter(PATH))
    got = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).select("doc_id", packing(F.col("text"), least, most).alias("p")).collect()
    assert {r.doc_id: [tuple(p) for p in r.p] for r in got} == {d: word_by_word((t or "").split(), least, most) for d, t in docs}


def test_structure_holds_its_bands_in_tokens(spark):
    text = "# One\n" + "internationalization of pseudopseudohypoparathyroidism " * 400 + "\n# Two\nshort"
    parsed = spark.createDataFrame([("d", [(1, text)])], "document_id string, pages array<struct<page: int, markdown: string>>")
    parents, children = structure(parsed, token_packer(bpe_counter(PATH)))
    for rows, most in ((parents, 1000), (children, 200)):
        found = rows.collect()
        assert len(found) > 3
        for r in found:
            assert r.token_count <= most + most // 2 - 1  # a merged last piece alone is longer than most
            assert abs(r.token_count - cost(r.content)) <= 1
            assert r.token_count >= 20
    words_only, _ = structure(parsed)
    assert words_only.count() < parents.count()


def test_whole_texts_are_counted(spark):
    rows = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "i int, t string")
    got = rows.select("i", token_count(bpe_counter(PATH))(F.col("t")).alias("n")).collect()
    assert {r.i: r.n for r in got} == {1: cost("hello world"), 2: 0, 3: 0}
