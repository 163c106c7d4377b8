"""Best-fit packing of token pieces into sequences by hierarchical residual packing.

Each partition packs its items best-fit, longest first, and emits bins that are full or nearly so. What it could not
fill goes on as items, one per bin, to fewer partitions for another best-fit round, up a tree until one partition is
left. A partition's items are bounded by ``limit``: where more underfull bins than that remain (say all of them hold
just over half), there are more partitions, and rounds end when one merges next to nothing.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import materialize
from lodestone.llm.tokens import ID, encoder

CAPACITY, END_ID = 2048, 0
#: Words a task keeps the ids of.
WORDS = 300_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
BIN = "used int, pieces array<struct<doc_id: bigint, piece: int, start: bigint, length: bigint, ids_crc32: bigint>>"


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, words: int = WORDS) -> DataFrame:
    """The pieces of each document: its ids and the end id, cut every ``capacity`` ids. A null text is empty.

    ``words``: as many a task keeps the ids of; fewer take less memory and more time.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, step = encoder(tokenizer, words), np.array([end_id], dtype=ID).tobytes(), capacity * ID.itemsize
        try:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    rows = []
                    for doc_id, raw in zip(batch.column(0).slice(at, 200).to_pylist(), enc.encode(batch.column(1).slice(at, 200).to_pylist()), strict=True):
                        raw += end
                        for k, cut_at in enumerate(range(0, len(raw), step)):
                            piece = raw[cut_at : cut_at + step]
                            rows.append((doc_id, k, k * capacity, len(piece) // ID.itemsize, zlib.crc32(piece)))
                    columns = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])
        finally:  # Spark deals tasks to all its idle workers in turn: each would hold as many words
            enc.forget()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, PIECE)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers, longest item first, each into the fullest bin that has room for it."""
    open_bins: list[list[list[int]]] = [[] for _ in range(capacity + 1)]  # by room left
    rooms = 0  # bit r: a bin with room r is open
    bins: list[list[int]] = []
    for item in sorted(range(len(lengths)), key=lengths.__getitem__, reverse=True):
        need = lengths[item]
        if fitting := rooms >> need:
            room = need + (fitting & -fitting).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, []
            bins.append(chosen)
        chosen.append(item)
        if left := room - need:
            open_bins[left].append(chosen)
            rooms |= 1 << left
    return bins


def _pack_round(items: DataFrame, capacity: int, nearly: int) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        used, lists = table.column(0).to_numpy(), table.column(1).combine_chunks()
        bins = best_fit(used.tolist(), capacity)
        order = np.fromiter((i for b in bins for i in b), np.int64, len(used))
        taken = lists.take(pa.array(order))
        sizes = np.diff(taken.offsets.to_numpy())
        ends = np.cumsum([len(b) for b in bins])
        offsets = np.concatenate([[0], np.cumsum(sizes)[ends - 1]]).astype(np.int32)
        filled = np.add.reduceat(used[order], np.concatenate([[0], ends[:-1]])).astype(np.int32)
        for at in range(0, len(bins), 5_000):
            upto = min(at + 5_000, len(bins))
            values = taken.flatten().slice(offsets[at], offsets[upto] - offsets[at])
            yield pa.RecordBatch.from_arrays([pa.array(filled[at:upto]), pa.ListArray.from_arrays(pa.array(offsets[at : upto + 1] - offsets[at]), values), pa.array(filled[at:upto] >= nearly)], ["used", "pieces", "done"])

    return items.mapInArrow(pack, f"{BIN}, done boolean")


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, nearly: float = 0.995, fan_in: int = 8, limit: int = 200_000) -> DataFrame:
    """Assign each piece its ``sequence_id`` and ``offset``. Pieces that fill a sequence are one by themselves.

    ``limit``: items a task packs at once. The driver only learns the number of underfull bins after a round.
    """
    short = pieces.where(F.col("length") < capacity)
    items = short.select(F.col("length").cast("int").alias("used"), F.array(F.struct(*pieces.columns)).alias("pieces"))
    full = pieces.where(F.col("length") >= capacity).select(F.col("length").cast("int").alias("used"), F.array(F.struct(*pieces.columns)).alias("pieces"))
    closed, n = [full], items.count()
    parts = max(math.ceil(n / limit), min(pieces.sparkSession.sparkContext.defaultParallelism, math.ceil(n / 10_000)), 1)
    while n:
        packed = materialize(_pack_round(items.repartition(parts), capacity, int(capacity * nearly)), "packed-bins")
        rest = packed.where(~F.col("done"))
        left = rest.count()
        closed.append(packed.where("done").drop("done"))
        if not left or parts == 1 or (parts <= math.ceil(n / limit) and left > 0.98 * n):
            closed.append(rest.drop("done"))
            break
        items, n, parts = rest.drop("done"), left, max(math.ceil(left / limit), math.ceil(parts / fan_in))
    bins = closed[0]
    for more in closed[1:]:
        bins = bins.unionByName(more)
    laid = F.posexplode("pieces").alias("slot", "p")
    before = F.aggregate(F.slice("pieces", F.lit(1), F.col("slot")), F.lit(0).cast("long"), lambda s, x: s + x["length"])
    return bins.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", "pieces", laid).select("p.*", "sequence_id", before.alias("offset"))


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID, words: int = WORDS, **kw) -> DataFrame:
    """Pack ``docs(doc_id, text)``; return doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null ids and repeated rows are packed like any others; an empty text is its end id alone; an empty table gives no
    rows; other columns are ignored.
    """
    return pack_pieces(materialize(cut_pieces(docs, capacity, tokenizer, end_id, words), "pieces"), capacity, **kw)
