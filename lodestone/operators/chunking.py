"""Documents to parent and child chunks.

With words as tokens everything happens inside a row, by array functions: no shuffle, no window. Chunk numbers are
positions in a document's filtered arrays, so they are dense and follow document order. Other tokenizers are packed
by an Arrow UDF.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import let, word_count, words

PARENT, CHILD, DROP_BELOW = (500, 1000), (100, 200), 20


def pack_counted(text: Column, least: int, most: int) -> Column:
    """Pieces of ``most`` words as (content, token_count); a last one of fewer than ``least`` joins the one before it."""

    def cut(all_words: Column) -> Column:
        n = F.size(all_words)
        full = F.ceil(n / most).cast("int")
        count = F.when((full > 1) & (n - (full - 1) * most < least), full - 1).otherwise(full)

        def piece(i: Column) -> Column:
            length = F.when(i == count - 1, n - i * most).otherwise(F.lit(most)).cast("int")
            return F.struct(F.array_join(F.slice(all_words, i * most + 1, length), " ").alias("content"), length.alias("token_count"))

        return F.when(n > 0, F.transform(F.sequence(F.lit(0), count - 1), piece)).otherwise(F.array().cast("array<struct<content: string, token_count: int>>"))

    return let(words(text), cut)


def pack(text: Column, least: int, most: int) -> Column:
    return F.transform(pack_counted(text, least, most), lambda p: p["content"])


def kept_counted(pieces: Column, drop_below: int = DROP_BELOW) -> Column:
    return F.filter(pieces, lambda p: p["token_count"] >= drop_below)


def kept(pieces: Column, drop_below: int = DROP_BELOW) -> Column:
    return F.filter(pieces, lambda p: word_count(p) >= drop_below)


def pack_words(text_words: list[str], cost: Callable[[str], int], least: int, most: int) -> list[str]:
    """``pack`` for a tokenizer where a word's cost depends on the space before it. A longer word is a piece alone."""
    pieces: list[list[str]] = []
    sizes: list[int] = []
    for word in text_words:
        more = cost(" " + word)
        if pieces and sizes[-1] + more <= most:
            pieces[-1].append(word)
            sizes[-1] += more
        else:
            pieces.append([word])
            sizes.append(cost(word))
    if len(pieces) > 1 and sizes[-1] < least:
        last = pieces.pop()
        pieces[-1] += last
    return [" ".join(p) for p in pieces]


def packer(cost: Callable[[str], int], least: int, most: int) -> Callable[[Column], Column]:
    """``pack`` by an injected token cost, Arrow batches at a time."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def packed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack_words((t or "").split(), cost, least, most))

    return packed


def parent_chunks(sections: DataFrame, band: tuple[int, int] = PARENT, drop_below: int = DROP_BELOW) -> DataFrame:
    """Parents of ``sections(document_id, body, ...)``, one section per row; the other columns are carried along."""
    pieces = sections.withColumn("content", F.explode(kept(pack(F.col("body"), *band), drop_below))).drop("body")
    return pieces.withColumn("token_count", word_count(F.col("content")).cast("long"))


def chunk_document(docs: DataFrame, parent: tuple[int, int] = PARENT, child: tuple[int, int] = CHILD, drop_below: int = DROP_BELOW) -> DataFrame:
    """Children of ``docs(document_id, text)``: document_id, parent_index, chunk_index, token_count, content.

    A parent may own no child; a dropped parent takes its children with it.
    """
    parents = kept_counted(pack_counted(F.col("text"), *parent), drop_below)
    owned = F.flatten(F.transform(parents, lambda p, i: F.transform(kept_counted(pack_counted(p["content"], *child), drop_below), lambda c: F.struct(i.cast("long").alias("parent_index"), c.alias("piece")))))
    rows = docs.select("document_id", F.posexplode(owned).alias("chunk_index", "chunk"))
    return rows.select("document_id", "chunk.parent_index", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("chunk.piece.token_count").cast("long").alias("token_count"), "chunk.piece.content")


def estimated_tokens(token_count: Column, default: int = 150) -> Column:
    """The sum of chunks' token counts, those of unknown size at ``default`` each."""
    return F.coalesce(F.sum(F.coalesce(token_count, F.lit(default))), F.lit(0)).cast("long")


def batches(rows: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """``batch`` numbers of ``size`` rows within each key, in order: what a provider is called with at once."""
    from pyspark.sql import Window

    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size).cast("long"))
