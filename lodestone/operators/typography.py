"""Markdown from typography: lines with their type size and weight to pages with headings.

Input is ``spans(document_id, page, line, block, text, size, bold)``, a row for each line of a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How much larger than body text a heading is set, how long it may be, and the openings of bold headings by rank.
SIZE_RATIO, HEADING_MAX, DEEPEST = 1.15, 200, 6
STRUCTURE = (r"(?iu)^(phần|phan)\s+\S+", r"(?iu)^(chương|chuong)\s+[ivxlcdm\d]+\b", r"(?iu)^(mục|muc)\s+\d+\b", r"(?iu)^(điều|dieu)\s+\d+")


def style_groups(spans: DataFrame) -> DataFrame:
    """Neighbouring lines of one block in the same type as one row: a heading that wraps is one heading."""
    order = Window.partitionBy("document_id", "page").orderBy("line")
    style = F.struct("block", "size", "bold")
    changed = F.coalesce(style != F.lag(style).over(order), F.lit(True))
    numbered = spans.withColumn("_new", changed.cast("int")).withColumn("group", F.sum("_new").over(order))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda s: s["text"])
    return numbered.groupBy("document_id", "page", "group").agg(F.first("size").alias("size"), F.first("bold").alias("bold"), lines.alias("lines"))


def body_size(spans: DataFrame) -> DataFrame:
    """The size most characters of a document are set in; of equals the one seen first."""
    seen = F.min(F.struct("page", "line"))
    weighed = spans.groupBy("document_id", "size").agg(F.sum(F.length("text")).alias("chars"), seen.alias("first"))
    best = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("chars"), "first"))
    return weighed.withColumn("_best", best).where("_best = 1").select("document_id", F.col("size").alias("body_size"))


def structural_rank(text: Column) -> Column:
    """1 for the highest opening, 0 for none."""
    rank = F.lit(0)
    for k in reversed(range(len(STRUCTURE))):
        rank = F.when(text.rlike(STRUCTURE[k]), k + 1).otherwise(rank)
    return rank


def markdown_pages(spans: DataFrame) -> DataFrame:
    """``(document_id, page, markdown)``: headings by how prominent their style is in the whole document."""
    groups = style_groups(spans).join(body_size(spans), "document_id")
    text = F.array_join("lines", " ")
    rank = structural_rank(text)
    is_heading = (F.length(text) <= HEADING_MAX) & ((F.col("size") >= F.col("body_size") * SIZE_RATIO) | (F.col("bold") & (rank > 0)))
    key = F.when(is_heading, F.struct((-F.col("size")).alias("size"), (-F.col("bold").cast("int")).alias("bold"), rank.alias("rank")))
    keyed = groups.withColumn("key", key)
    levels = keyed.where("key IS NOT NULL").select("document_id", "key").distinct()
    levels = levels.withColumn("level", F.least(F.dense_rank().over(Window.partitionBy("document_id").orderBy("key")), F.lit(DEEPEST)))
    written = keyed.join(levels, ["document_id", "key"], "left")
    line = F.when(F.col("level").isNotNull(), F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), text)).otherwise(F.array_join("lines", "\n"))
    rows = written.select("document_id", "page", "group", line.alias("line"))
    return rows.groupBy("document_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group", "line"))), lambda s: s["line"]), "\n").alias("markdown"))


def is_scanned(chars: Column, pages: Column, least: int = 100) -> Column:
    """Whether a document has too little text for its pages; one without pages counts as scanned."""
    return F.when(pages == 0, True).otherwise(chars / pages < least)


def pages_to_read(pages: DataFrame, read_all: bool = False) -> DataFrame:
    """The pages that go to OCR: all of a scanned document or if asked for, else those with tables or images."""
    per = Window.partitionBy("document_id")
    scanned = is_scanned(F.sum(F.length("markdown")).over(per), F.count("*").over(per))
    chosen = F.lit(read_all) | scanned | F.coalesce(F.col("has_table") | F.col("has_image"), F.lit(False))
    return pages.withColumn("to_read", chosen)


def merge_read(pages: DataFrame, read: DataFrame) -> DataFrame:
    """Pages with what OCR read laid over them; a page that was refused keeps its text at confidence 0."""
    joined = pages.join(read.select("document_id", "page", F.col("markdown").alias("_read"), F.lit(True).alias("_tried")), ["document_id", "page"], "left")
    refused = F.col("_tried").isNotNull() & F.col("_read").isNull()
    return joined.select("document_id", "page", F.coalesce("_read", "markdown").alias("markdown"), F.when(F.col("_read").isNotNull(), "ocr").otherwise("text").alias("source"), F.when(refused, 0.0).otherwise(1.0).alias("confidence"))
