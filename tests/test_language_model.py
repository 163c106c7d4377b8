"""The trigram model on documents it never learned from."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.language_model import LanguageModel, trigrams
from lodestone.queries import QUERIES
from lodestone import queries_plans  # noqa: F401 - registers its queries


def test_held_out_accuracy(spark):
    rows = QUERIES["language_ngrams"](spark, "/root/testdata/sf0.01").where("held_out")
    right = lambda c: F.avg((F.col(c) == F.col("lang")).cast("int"))
    n, ours, words = rows.agg(F.count("*"), right("by_trigrams"), right("by_words")).first()
    print(n, ours, words)
    assert n > 150
    assert ours > 0.97
    assert ours > words


def test_learning_and_odd_texts(spark):
    texts = [("the quick brown fox and the dog", "en"), ("der schnelle braune Fuchs und der Hund", "de"), (None, "en"), ("x", None)] * 3
    model = LanguageModel.learn(spark.createDataFrame(texts, "text string, lang string").repartition(4))
    assert model.languages == ("de", "en")
    assert model.weights.shape == (2, 1 << 15)
    asked = spark.createDataFrame([(1, "The DOG, and the fox!"), (2, "Hund und Fuchs"), (3, ""), (4, None), (5, "123 --"), (6, "x" * 100_000)], "i int, t string")
    got = {r.i: (r.a, r.b) for r in asked.select("i", model.detect(F.col("t")).alias("a"), model.detect(F.col("t"), ("en",)).alias("b")).collect()}
    assert [got[i] for i in range(1, 6)] == [("en", "en"), ("de", "other"), ("other", "other"), ("other", "other"), ("other", "other")]
    assert got[6][0] in model.languages
    assert len(trigrams(" a ")) == 1 and len(trigrams("  ")) == 0
    none = LanguageModel.learn(spark.createDataFrame([], "text string, lang string"))
    assert [r[0] for r in asked.where("i = 1").select(none.detect(F.col("t"))).collect()] == ["other"]


def test_a_worker_makes_objects_of_few_texts_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from lodestone.functions import language_model as L

    batch = pa.RecordBatch.from_pydict({"lang": ["en", "de"] * 1000, "text": [f" t{i} " * 1000 for i in range(2000)]})
    tracemalloc.start()
    read = sum(len(text) for _, text in L._pairs(batch))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert read == sum(map(len, batch.column(1).to_pylist())) and peak < read / 4
