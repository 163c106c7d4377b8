"""SimHash near-duplicates by anchor-point covering.

Anchors are triples of codewords of the binary Golay code [23,12], which is perfect: every 23-bit word lies within 3
bits of exactly one codeword. A fingerprint's 64 bits are three such words, the last with five zeros before its 18
bits. A fingerprint's home is its nearest anchor. It is replicated to every anchor within covering radius plus
threshold: codewords at 3 + a, 3 + b and 3 + c bits, a + b + c at most the threshold. Of two fingerprints that
differ in at most that many bits, each so has a copy at the other's home, and they are compared there. No link is
missed, and the join's output is links alone. A codeword goes by its 12 message bits, so an anchor is 36 bits: a
billion fingerprints leave most of them with one home or none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.graph import components
from lodestone.llm.shared import discard, materialize

SHINGLE, BITS, SEED = 3, 2, 42
#: Fixed values of the Golay code: its length, its covering radius and x^11+x^10+x^6+x^5+x^4+x^2+1, which generates it.
GOLAY_LENGTH, GOLAY_RADIUS, GOLAY_POLYNOMIAL = 23, 3, 0b110001110101
CHUNK = 50_000


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The SimHash of a whole text: words between ASCII white space, A-Z lower-cased, shingles hashed by XXH64."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined = b" ".join(words)
    starts, at = [], 0
    for w in words:
        starts.append(at)
        at += len(w) + 1
    ends = [s - 1 for s in starts[shingle:]] + [len(joined)]
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, n, CHUNK):
        hashes = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[a : a + CHUNK], ends[a : a + CHUNK], strict=False)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``(doc_id, text_hash, fp)`` for each row of ``docs(doc_id, text)``, fp the fingerprint as a signed long."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.array(fps, dtype=np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(hashed, "doc_id long, text_hash long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generating polynomial."""
    left = words.astype(np.int64)
    for bit in range(GOLAY_LENGTH - 1, 10, -1):
        left = np.where(left >> bit & 1, left ^ (GOLAY_POLYNOMIAL << (bit - 11)), left)
    return left


@lru_cache(maxsize=4)
def _patterns(excess: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome a row of the words within covering radius plus ``excess`` that have it, and one of their excess.

    A word xor these gives the codewords around it. The first of a row has excess 0 and is the only one of it; rows are
    filled up with an excess that is too large.
    """
    words = np.array([sum(1 << b for b in bits) for n in range(GOLAY_RADIUS + excess + 1) for bits in combinations(range(GOLAY_LENGTH), n)], dtype=np.int64)
    over = np.maximum(np.bitwise_count(words).astype(np.int8) - GOLAY_RADIUS, 0).astype(np.int8)
    syndromes = _syndromes(words)
    order = np.lexsort((over, syndromes))
    row = syndromes[order]
    column = np.arange(len(row)) - np.searchsorted(row, row)
    found = np.zeros((2048, column.max() + 1), dtype=np.int64)
    spent = np.full(found.shape, excess + 1, dtype=np.int8)
    found[row, column], spent[row, column] = words[order], over[order]
    return found, spent


def _words(fps: np.ndarray) -> tuple[np.ndarray, ...]:
    """The three words of each fingerprint."""
    return tuple(fps >> n * GOLAY_LENGTH & (1 << min(GOLAY_LENGTH, 64 - n * GOLAY_LENGTH)) - 1 for n in range(3))


def _anchor(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of three codewords: each is told by what stands before its 11 check bits."""
    return a >> 11 << 24 | b >> 11 << 12 | c >> 11


def homes(fps: np.ndarray) -> np.ndarray:
    """The nearest anchor of each fingerprint."""
    leader = _patterns(0)[0][:, 0]
    return _anchor(*(word ^ leader[_syndromes(word)] for word in _words(fps)))


def anchors(fps: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``fps`` and anchors: every anchor within covering radius plus ``bits`` of each."""
    words, over = _patterns(bits)
    parts = _words(fps)
    at = [_syndromes(p) for p in parts]
    first, second, third = (over[r] for r in at)
    k, i, j = np.nonzero(first[:, :, None] + second[:, None, :] <= bits)
    pair, l = np.nonzero((first[k, i] + second[k, j])[:, None] + third[k] <= bits)
    k, i, j = k[pair], i[pair], j[pair]
    return k, _anchor(*(words[r[k], n] ^ p[k] for r, n, p in zip(at, (i, j, l), parts, strict=True)))


def links(distinct: DataFrame, bits: int = BITS) -> DataFrame:
    """``(u, v)``, u < v: the pairs of different fingerprints in ``distinct(fp)`` that differ in at most ``bits`` bits."""

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(homes(batch.column(0).to_numpy())), batch.column(0)], ["anchor", "fp"])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                fps = batch.column(0).slice(at, 2_000).to_numpy()
                k, found = anchors(fps, bits)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(fps[k])], ["anchor", "other"])

    here = distinct.select("fp").mapInArrow(home, "anchor long, fp long")
    there = distinct.select("fp").mapInArrow(around, "anchor long, other long")
    near = here.hint("merge").join(there, "anchor").where((F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= bits))
    return near.select(F.least("fp", "other").alias("u"), F.greatest("fp", "other").alias("v")).distinct()


def _grouped(docs: DataFrame, bits: int, shingle: int, seed: int) -> DataFrame:
    """``(doc_id, text_hash, fp, root, component_id)`` for each row; root is the group's fingerprint."""
    hashed = materialize(fingerprints(docs, shingle, seed), "fingerprints")
    nodes = materialize(hashed.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    # What is joined grows with the input: never broadcast, whatever its size.
    rooted = components(links(nodes, bits)).select(F.col("node").alias("fp"), "root").hint("merge")
    placed = nodes.join(rooted, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = materialize(placed, "placed")
    least = materialize(placed.groupBy("root").agg(F.min("first").alias("component_id")), "least")
    named = materialize(placed.join(least.hint("merge"), "root").select("fp", "root", "component_id"), "named")
    discard(nodes, placed, least)
    return hashed.join(named.hint("merge"), "fp")


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, fingerprint (16 hex digits), component_id.

    ``component_id`` is the smallest doc_id reachable by links, null where all of them are null. Equal fingerprints
    are one node, whatever the number of copies. A null text is empty; fingerprint zero links like any other.
    Repeated rows come back as often as they came; other columns are ignored; an empty table gives no rows.
    """
    return _grouped(docs, bits, shingle, seed).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
