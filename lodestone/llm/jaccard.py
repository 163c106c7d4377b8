"""Near copies by the Jaccard similarity of their shingles: candidates by MinHash bands, links by exact comparison.

A document is the set of its runs of five words. Signatures of 32 bands of 5 minima find candidates: two sets of
similarity 0.8 share a band with probability 1 - (1 - 0.8^5)^32, all but 3 in a million, and more similar ones more
surely. Pairs of fingerprints that link by SimHash (``lodestone.llm.simhash``, anchor points) are candidates, too: those
of near copies, whichever bands they share. (For the 11 bits by which texts of similarity 0.8 differ, anchors would need
870,000 copies of each fingerprint, so bands find those.) Every link is then verified on the whole sets.

Members of a band's bucket are compared with its hub first, the member with the least share of shingles of its own.
A second pass compares the pairs of members that this leaves in different components, found by prefixes: sets of the
similarity share a shingle among the rarest of each, early enough in both. Nothing is lost by that, so components are
those of the whole graph of links between members, while copies of one text with edits of their own are compared with
their hub alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.graph import components
from lodestone.llm.shared import discard, materialize, spare
from lodestone.llm.simhash import fingerprints
from lodestone.llm.simhash import links as simhash_links

SHINGLE, TENTHS, SEED = 5, 8, 42
BANDS, ROWS = 32, 5
CHUNK = 2_000


def shingles(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The distinct XXH64 hashes, in order, of runs of words between ASCII white space, A-Z lower-cased; a shorter text is one run."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((xxh64_intdigest(b" ".join(words[i : i + shingle]), seed) for i in range(n)), dtype=np.uint64, count=n))


def band_keys(hashes: np.ndarray, seed: int = SEED) -> list[int]:
    """One signed long for each band: the hash of the least values of the set under the band's multipliers."""
    from xxhash import xxh64_intdigest

    by = np.random.default_rng(seed).integers(0, 2**64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
    least = np.full(BANDS * ROWS, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[at : at + CHUNK, None] * by).min(axis=0))
    bands = least.reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(band.tobytes(), i) for i, band in enumerate(bands)], dtype=np.uint64).view(np.int64).tolist()


def _keyed(docs: DataFrame) -> DataFrame:
    """``(doc_id, text_hash, node, size, keys)`` for each row; equal shingle sets are one node, and an empty set has no keys."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                nodes, sizes, keys = [], [], []
                for text in some.column(1):
                    found = shingles(text.as_py())
                    nodes.append(xxh64_intdigest(found.tobytes(), SEED))
                    sizes.append(len(found))
                    keys.append(band_keys(found) if len(found) else [])
                columns = [some.column(0), some.column(2), pa.array(np.array(nodes, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "node", "size", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(hashed, "doc_id long, text_hash long, node long, size long, keys array<long>")


def _rows_of(docs: DataFrame, chosen: DataFrame, how: str, *keep: str) -> DataFrame:
    """``docs`` joined to ``chosen(doc_id, text_hash, ...)`` by both; ``keep`` are further columns of ``chosen``."""
    doc, text_hash = spare(docs, "chosen_doc_id"), spare(docs, "chosen_text_hash")
    chosen = chosen.select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text_hash), *keep)
    # What is chosen grows with the input: never broadcast, whatever its size.
    return docs.join(chosen.hint("merge"), F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(text_hash)), how)


def _sets(docs: DataFrame, nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``(node, set)`` of ``members(node)``, made again from one text of each."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                some = batch.slice(at, 500)
                sets = [shingles(t.as_py()).view(np.int64) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(sets, pa.list_(pa.int64()))], ["node", "set"])

    chosen = nodes.join(members.select("node").distinct().hint("merge"), "node", "left_semi").select("first.doc_id", "first.text_hash", "node")
    return _rows_of(docs.select("doc_id", "text"), chosen, "inner", "node").select("node", "text").mapInArrow(listed, "node long, set array<long>")


def _links(sets: DataFrame, pairs: DataFrame, tenths: int) -> DataFrame:
    """Those of ``pairs(u, v)`` whose sets have the similarity."""
    a, b = (sets.select(F.col("node").alias(n), F.col("set").alias(c)).hint("merge") for n, c in (("u", "a"), ("v", "b")))
    shared, total = F.size(F.array_intersect("a", "b")), F.size("a") + F.size("b")
    # shared / (total - shared) >= tenths / 10; rows that repeat both doc_id and text give a node's set more than once
    return pairs.join(a, "u").join(b, "v").where((10 + tenths) * shared >= tenths * total).select("u", "v").distinct()


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("u"), F.greatest(a, b).alias("v")]


def simhash_pairs(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(u, v)``, u < v: candidates by SimHash among ``nodes(node, first)``, whose fingerprint is that of their first text.

    The least node of a fingerprint stands for it: the others are paired with it, and it with those of the fingerprints
    that link to its own.
    """
    texts = nodes.select("node", F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash")).hint("merge")
    of_text = fingerprints(docs).join(texts, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash").eqNullSafe(F.col("hash"))))
    nodes = materialize(of_text.select("node", "fp").distinct(), "node-fingerprints")
    hubs = materialize(nodes.groupBy("fp").agg(F.min("node").alias("hub")), "simhash-hubs")
    same = nodes.join(hubs.hint("merge"), "fp").where("node <> hub").select(*_ordered("node", "hub"))
    of = lambda fp, hub: hubs.select(F.col("fp").alias(fp), F.col("hub").alias(hub)).hint("merge")
    near = simhash_links(hubs).join(of("u", "a"), "u").join(of("v", "b"), "v").select(*_ordered("a", "b"))
    out = materialize(same.unionByName(near).distinct(), "simhash-pairs")
    discard(hubs, nodes)
    return out


def _roots(docs: DataFrame, nodes: DataFrame, keyed: DataFrame, tenths: int) -> DataFrame:
    """``(node, root)`` of the nodes that have links."""
    spread = materialize(keyed.where("size > 0").select("node", "size", F.explode("keys").alias("key")).distinct(), "bands")
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    together = materialize(spread.join(shared.hint("merge"), "key"), "buckets")
    by_simhash = simhash_pairs(docs, nodes)
    members = together.select("node").unionByName(by_simhash.select(F.explode(F.array("u", "v")).alias("node")))
    sets = materialize(_sets(docs, nodes, members), "sets")
    # Shingles that no other member has are in no intersection: what a set can share is the rest.
    single = sets.distinct().select("node", F.explode("set").alias("hash")).groupBy("hash").agg(F.count("*").alias("n"), F.min("node").alias("node")).where("n = 1")
    alone = single.groupBy("node").agg(F.count("*").alias("alone"))
    common = materialize(together.join(alone.hint("merge"), "node", "left").select("key", "node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common")), "common")
    hubs = common.groupBy("key").agg(F.max(F.struct((F.col("common") / F.col("size")).alias("share"), "node", "size", "common")).alias("hub"))
    members = materialize(common.join(hubs.hint("merge"), "key"), "members")
    discard(spread, together, common)

    def may_link(size: str, common: str) -> Column:
        return (10 + tenths) * F.least("common", common) >= tenths * (F.col("size") + F.col(size))

    tried = members.where((F.col("node") != F.col("hub.node")) & may_link("hub.size", "hub.common")).select(*_ordered("node", "hub.node"))
    tried = materialize(tried.unionByName(by_simhash).distinct(), "hub-pairs")
    discard(by_simhash)
    first = materialize(_links(sets, tried, tenths), "hub-links")

    # Members' shingles with the rarest first: of a pair that has the similarity, the first one in both lies so early in
    # each that what follows is long enough.
    hashes = sets.distinct().select("node", F.explode("set").alias("hash"))
    counts = hashes.groupBy("hash").agg(F.count("*").alias("n"))
    ranked = hashes.join(counts.hint("merge"), "hash").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("n", "hash"))).alias("order"))
    early = ranked.select("node", F.size("order").alias("size"), F.posexplode("order").alias("pos", "at")).withColumn("rest", F.col("size") - F.col("pos"))
    early = early.where((F.col("at.n") > 1) & (10 * F.col("rest") >= tenths * F.col("size"))).select("node", "size", "rest", F.col("at.hash").alias("key"))
    placed = early.join(components(first).hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialize(placed, "placed")
    most = placed.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key")
    most = most.agg(F.count("*").alias("roots"), F.max(F.struct("n", "root")).getField("root").alias("most")).where("roots > 1").drop("roots")
    mixed = materialize(placed.join(most.hint("merge"), "key"), "mixed")
    few = mixed.where("root <> most").select("key", *(F.col(c).alias(f"{c}_a") for c in ("node", "size", "rest", "root")))
    apart = (F.col("root") != F.col("root_a")) & ((F.col("root") == F.col("most")) | (F.col("node") < F.col("node_a")))
    enough = (10 + tenths) * F.least("rest", "rest_a") >= tenths * (F.col("size") + F.col("size_a"))
    left = few.join(mixed.hint("merge"), "key").where(apart & enough).select(*_ordered("node", "node_a")).distinct()
    left = materialize(left.join(tried.hint("merge"), ["u", "v"], "left_anti"), "other-pairs")
    second = materialize(_links(sets, left, tenths), "other-links")

    roots = materialize(components(first.unionByName(second)), "roots")
    discard(members, sets, tried, placed, mixed, left, first, second)
    return roots


def keep_one_of_similar(docs: DataFrame, tenths: int = TENTHS) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document of each group: the first by doc_id, then by text.

    Documents link whose five-word shingles have a Jaccard similarity of ``tenths`` / 10 or more; groups are connected
    components. Texts without words are alike. Rows that repeat both doc_id and text are one document. A null id comes
    before others.
    """
    keyed = materialize(_keyed(docs), "shingled")
    nodes = materialize(keyed.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")), "nodes")
    rooted = nodes.join(_roots(docs, nodes, keyed, tenths).hint("merge"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("kept")).select("kept.doc_id", "kept.text_hash")
    kept = materialize(kept, "kept")
    discard(keyed, nodes)
    return _rows_of(docs, kept, "left_semi")
