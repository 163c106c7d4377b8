"""Language of a text by a model of its character trigrams, learned from texts of known language.

Trigrams are hashed to a fixed number of buckets, so the model has a known size: a log-probability for each language and
bucket. Learning is one pass that adds up counts in each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.language import OTHER
from lodestone.sources.tables import spread

BUCKETS, SMOOTH = 1 << 15, 0.5
#: More languages than this are an error: the model is on the driver and in every task.
MAX_LANGUAGES = 200
#: Texts that a worker makes Python objects of at a time, however many a batch has.
TEXTS = 128


def letters(text: Column) -> Column:
    """Lower-case letters, anything else as one space, a space at both ends."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " ")), F.lit(" "))


def trigrams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of each trigram of a text, none for one without letters."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)
    mixed = codes[:-2] * np.uint64(0x9E3779B1) ^ codes[1:-1] * np.uint64(0x85EBCA77) ^ codes[2:] * np.uint64(0xC2B2AE3D)
    return ((mixed ^ mixed >> np.uint64(15)) % np.uint64(buckets)).astype(np.int64)


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[str, str]]:
    for at in range(0, batch.num_rows, TEXTS):
        some = batch.slice(at, TEXTS)
        yield from zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # a row a language, a column a bucket

    @classmethod
    def learn(cls, texts: DataFrame, buckets: int = BUCKETS) -> LanguageModel:
        """From ``texts(text, lang)``; rows without either teach nothing. What a task gives is at most a row a language and bucket."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts: dict[str, np.ndarray] = {}
            for batch in batches:
                for lang, text in _pairs(batch):
                    held = counts.setdefault(lang, np.zeros(buckets, np.int64))
                    np.add.at(held, trigrams(text, buckets), 1)
                    if len(counts) > MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
            for lang, held in counts.items():
                some = np.flatnonzero(held)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(held[some])], ["lang", "bucket", "n"])

        known = spread(texts.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", letters(F.col("text")).alias("text")))
        rows = known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        languages = tuple(sorted(rows["lang"].unique()))
        if len(languages) > MAX_LANGUAGES:
            raise ValueError(f"more than {MAX_LANGUAGES} languages")
        table = np.full((len(languages), buckets), SMOOTH)
        for i, lang in enumerate(languages):
            mine = rows[rows["lang"] == lang]
            table[i, mine["bucket"]] += mine["n"]
        return cls(languages, np.log(table / table.sum(axis=1, keepdims=True)) if len(languages) else table)

    def detect(self, text: Column, languages: tuple[str, ...] | None = None) -> Column:
        """The likeliest language; ``other`` outside ``languages``, and for a text without letters."""
        names, weights = self.languages, self.weights

        @F.pandas_udf("string")
        def likeliest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in (b.iloc[at : at + TEXTS] for b in batches for at in range(0, len(b), TEXTS)):
                found = []
                for t in texts:
                    at = trigrams(t, weights.shape[1]) if t.strip() else ()
                    found.append(names[int(weights[:, at].sum(axis=1).argmax())] if len(at) and names else OTHER)
                yield pd.Series(found, index=texts.index, dtype=object)

        code = likeliest(letters(text))
        return code if languages is None else F.when(code.isin(*languages), code).otherwise(F.lit(OTHER))
