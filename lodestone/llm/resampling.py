"""Importance resampling of documents towards a target.

Texts are bags of hashed word unigrams and bigrams. Two generative models, smoothed shares of the buckets, are
counted: one over texts of the target (labelled as good), one over all raw texts. A document's importance weight is the
ratio of its probabilities under the two, so its log is the sum over its n-grams of the models' log ratio. Adding
Gumbel noise and keeping the k largest sums draws k documents without replacement in proportion to their weights. The
noise comes from a hash of the row, so a rerun of a lost task draws the same.

The models have as many buckets as the corpus needs: by Heaps' law distinct words grow as the root of the text, and so
do the buckets. k is as large a share of the rows as the labels call good, unless the caller names another.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.histogram import kth_boundary
from lodestone.llm.shared import materialize

SEED = 20
#: The least buckets, and how many there are to a root of the input's bytes, up to the next power of two.
LEAST_BUCKETS, BUCKETS_PER_ROOT = 1 << 14, 2.0
MAX_LABELLED = 100_000
#: Words of more bytes are hashed each time.
LONG = 80
WEIGHT = "doc_id long, text_crc32 long, log_weight double, n_grams long"


class Hasher:
    """Bucket numbers of a text's unigrams and bigrams; keeps a bounded number of words' hashes."""

    def __init__(self, buckets: int, limit: int = 500_000):
        self.buckets, self.limit, self.known = np.uint64(buckets), limit, {}

    def grams(self, raw: bytes) -> np.ndarray:
        words = raw.lower().split()
        known = self.known
        new = set(words).difference(known)
        for w in new:
            known[w] = zlib.crc32(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        for w in [w for w in new if len(w) > LONG]:
            known.pop(w, None)
        if len(known) > self.limit:
            known.clear()
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(29)
        return (np.concatenate([h, pairs]) % self.buckets).astype(np.int64)


def _count(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts of the buckets over all of ``texts(text)``: one row per task and bucket, added up by Spark."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, counts, held, n = Hasher(buckets), np.zeros(buckets, np.int64), [], 0
        for batch in batches:
            for text in batch.column(0):
                held.append(hasher.grams((text.as_py() or "").encode()))
                n += len(held[-1])
                if n >= buckets:  # so a text costs what its words cost, however many buckets there are
                    counts += np.bincount(np.concatenate(held), minlength=buckets)
                    held, n = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=buckets)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    found = texts.select("text").mapInArrow(tally, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row for each bucket at most
    counts[found.column("bucket").to_numpy()] = found.column("n").to_numpy()
    return counts


def bucket_count(docs: DataFrame) -> int:
    """Buckets for all of ``docs(text)``: twice the root of its bytes, up to the next power of two."""
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    return max(LEAST_BUCKETS, 1 << math.ceil(math.log2(BUCKETS_PER_ROOT * math.sqrt(n_bytes) + 1)))


def _judged(labels: DataFrame) -> DataFrame:
    """``(doc_id, quality)`` with an id once; it is good if all its labels that aren't null say so."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))


def good_share(labels: DataFrame) -> float:
    """The share of labelled ids that are good; 1 where nothing is labelled."""
    n, good = _judged(labels).agg(F.count("*"), F.count_if(F.col("quality") == 1)).first()
    return good / n if n else 1.0


def log_ratio(docs: DataFrame, labels: DataFrame, buckets: int, max_labelled: int = MAX_LABELLED) -> np.ndarray:
    """Log of target share over raw share for each bucket.

    The target are documents that ``labels(doc_id, quality)`` marks 1, at most ``max_labelled`` labels by hash; the
    raw model counts every document. Without a target the ratio is 0.
    """
    good = _judged(labels).where("quality = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled).select("doc_id")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # One number a row, and max_labelled at most.
    target = _count(texts.join(F.broadcast(good), "doc_id", "left_semi"), buckets)
    if not target.any():
        return np.zeros(buckets)
    raw = _count(texts, buckets)
    smooth = lambda c: (c + 1.0) / (c.sum() + buckets)
    return np.log(smooth(target)) - np.log(smooth(raw))


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """``WEIGHT`` of each row; a text without words has weight 0, the log of 1."""
    ratio = ratio.astype(np.float32)  # what each task receives

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(len(ratio))
        for batch in batches:
            rows = []
            for text in batch.column(1):
                raw = (text.as_py() or "").encode()
                grams = hasher.grams(raw)
                rows.append((zlib.crc32(raw), float(ratio[grams].sum(dtype=np.float64)), len(grams)))
            crc, weight, n = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(crc, pa.int64()), pa.array(weight, pa.float64()), pa.array(n, pa.int64())], ["doc_id", "text_crc32", "log_weight", "n_grams"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(weigh, WEIGHT)


def gumbel(seed: int = SEED) -> Column:
    """Standard Gumbel noise from a hash of the row and the seed."""
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32", F.lit(seed)), 12) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def _ordered(x: Column) -> Column:
    """A long that falls as ``x`` rises: fixed point, 2^-24 apart up to sums of 2^38."""
    return F.round(-F.greatest(F.least(x, F.lit(2.0**38)), F.lit(-(2.0**38))) * float(1 << 24)).cast("long")


def resample(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int | None = None, seed: int = SEED) -> DataFrame:
    """A share of ``docs(doc_id, text)`` drawn: doc_id, log_weight, n_grams, gumbel_key; k = ceil(share * rows).

    ``share`` is that of the good among ``labels(doc_id, quality)`` where it is not given, ``buckets`` what the bytes
    of the texts ask for. The k-th largest key is found by exact histograms, not by a sort. Rows that tie with it at
    2^-24 are all kept, so repeated rows are kept or left together. A null text is empty and has log weight 0; null
    ids are drawn like others; without labels all rows are kept; other columns are ignored; an empty table gives no
    rows.
    """
    share = good_share(labels) if share is None else share
    ratio = log_ratio(docs, labels, buckets or bucket_count(docs))
    weighed = materialize(log_weights(docs, ratio).withColumn("gumbel_key", F.col("log_weight") + gumbel(seed)), "weighed")
    n = weighed.count()
    k = math.ceil(share * n)
    rows = weighed.withColumn("key", _ordered(F.col("gumbel_key")))
    kept = rows.where(F.col("key") < kth_boundary(rows, k)) if 0 < k < n else rows
    return kept.select("doc_id", "log_weight", "n_grams", "gumbel_key")
