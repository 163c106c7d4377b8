"""Where a chunk stands on its pages: character offsets of chunks met with those of a page's spans.

Both are cut into bins of characters, so what meets is found by an equal join on document and bin, not by comparing every
chunk with every span. A pair that shares several bins counts in the one where its overlap begins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a bin: about a chunk's share of a page, so that neither side is in many bins.
BIN = 512


def overlapping(left: DataFrame, right: DataFrame, key: Sequence[str], width: int = BIN) -> DataFrame:
    """Rows of ``left`` and ``right`` of equal ``key`` whose stretches ``start`` to ``end``, end exclusive, have a character in common.

    Each pair once. Stretches of ``right`` come as ``other_start`` and ``other_end``; other columns differ in name. Empty ones meet nothing.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor((F.col(b) - 1) / width)))
    mine = left.where(F.col("start") < F.col("end")).withColumn("_bin", bins("start", "end"))
    theirs = right.withColumnsRenamed({"start": "other_start", "end": "other_end"}).where("other_start < other_end").withColumn("_bin", bins("other_start", "other_end"))
    met = mine.join(theirs, [*key, "_bin"]).where("start < other_end AND other_start < end")
    return met.where(F.col("_bin") == F.floor(F.greatest("start", "other_start") / width)).drop("_bin")


def rectangles(chunks: DataFrame, spans: DataFrame, width: int = BIN) -> DataFrame:
    """``(document_id, chunk_index, page, block, x0, y0, x1, y1, spans)``: a rectangle for each block that a chunk has text in.

    ``chunks(document_id, chunk_index, start, end)``; ``spans(document_id, page, block, start, end, x0, y0, x1, y1)``, both in
    characters of the document's text.
    """
    met = overlapping(chunks.select("document_id", "chunk_index", "start", "end"), spans.select("document_id", "page", "block", "start", "end", "x0", "y0", "x1", "y1"), ["document_id"], width)
    return met.groupBy("document_id", "chunk_index", "page", "block").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.count("*").alias("spans"))
