"""Shards of near-equal bytes by histogram sort, as DataFrame operations throughout.

Rows are ordered by a key: high bits from the text's hash, then bits from the id's, the lowest from the row's place
in the input. So equal texts lie together, yet a group of any size can be cut where the tolerance asks for it, be its
rows as alike as they may. Splitters come from exact counts of the bytes below candidate boundaries; each row is then
exchanged once. Further splitters, from exact counts of rows, cut a shard into ranges of as many rows as a task takes,
so its slots are numbered by several tasks, each from the exact count of rows in the ranges before it.
"""

from __future__ import annotations

import math
from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.histogram import LOW, bucket_of, count_below, splitters
from lodestone.llm.shared import materialize

SHARDS = 8
TEXT_BITS, ID_BITS, ROW_BITS = 30, 20, 13
#: Ranges are one expression; with more rows than these take at ``range_rows``, ranges grow.
MAX_RANGES = 2048


def _keyed(docs: DataFrame) -> DataFrame:
    high = lambda x, bits: F.shiftrightunsigned(x, 64 - bits)
    row = F.xxhash64(F.monotonically_increasing_id())  # parts rows that are equal in all else; written once, so that it stays
    key = F.shiftleft(high(F.xxhash64("text"), TEXT_BITS), ID_BITS + ROW_BITS).bitwiseOR(F.shiftleft(high(F.xxhash64("doc_id"), ID_BITS), ROW_BITS)).bitwiseOR(high(row, ROW_BITS))
    return docs.select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32(F.encode("text", "UTF-8")), F.lit(0).cast("long")).alias("text_crc32"), key.alias("key"),
    )


def shard_by_bytes(docs: DataFrame, shards: int = SHARDS, tolerance: float = 0.01, range_rows: int = 131_072) -> DataFrame:
    """Deal ``docs(doc_id, text)`` to shards 0 to ``shards - 1`` whose bytes are near equal.

    Returns doc_id, size (UTF-8 bytes and 1; a null text has none), text_crc32 (0 for a null text), law, shard, slot
    (gapless from 0 in each shard) and grown_shard (null under this law). ``tolerance`` is the share of a shard's
    bytes by which a splitter may be off; a row that weighs more than that is never cut. ``range_rows``: rows to a
    task, about. Rows with null or repeated ids and equal texts are dealt like others, and rows that are equal in both
    to as many shards as their bytes ask for; which of them goes where depends on their place in the input. An empty
    table gives no rows; other columns are ignored.
    """
    keyed = materialize(_keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))), "shard-keys")
    total, n = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cuts = sorted(splitters(keyed.select("key", F.col("size").alias("weight")), [total * k // shards for k in range(1, shards)], max(1, int(total / shards * tolerance)))) if n else [0] * (shards - 1)
    more = min(math.ceil(n / range_rows), MAX_RANGES - shards)
    fine = splitters(keyed.select("key", F.lit(1).cast("long").alias("weight")), [n * k // more for k in range(1, more)], max(1, n // more // 4)) if more > 1 else []
    bounds = sorted(cuts + fine)
    first = [0, *(count_below(keyed.select("key", F.col("size").alias("weight")), bounds).rows if bounds else [])]  # rows before each range
    owner = [bisect_right(cuts, b) for b in [LOW, *bounds]]
    start = {shard: rows for shard, rows in reversed(list(zip(owner, first, strict=True)))}
    base = keyed.sparkSession.createDataFrame([(r, shard, rows - start[shard]) for r, (shard, rows) in enumerate(zip(owner, first, strict=True))], "range int, shard int, base long")
    place = F.row_number().over(Window.partitionBy("range").orderBy("key", "doc_id", "size", "text_crc32"))
    # As many rows as ranges: of a known size.
    dealt = keyed.withColumn("range", bucket_of(F.col("key"), bounds)).withColumn("place", place).join(F.broadcast(base), "range")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("base") + F.col("place") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
