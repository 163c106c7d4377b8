"""Parsed documents to chunks with vectors, in stages that know what they were made from.

Each stage's rows keep the fingerprint of their input. A stage runs for documents whose output is missing or stale;
so a changed input makes everything after it stale, and nothing has to be deleted first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.language import detect_language
from lodestone.functions.outline import sections
from lodestone.functions.text import contextualize, sanitize
from lodestone.functions.vectors import well_formed
from lodestone.operators.chunking import CHILD, DROP_BELOW, PARENT, kept_counted, pack_counted, parent_chunks
from lodestone.operators.ingest import fingerprint, positional_join, replace_documents, stale
from lodestone.plans.chain import Chain, Stage
from lodestone.plans.providers import Embedder, Enricher, embed, enrich, stub_enricher

MAX_CHUNKS = 5000


#: Pieces of a text, least and most tokens, as (content, token_count): by words, or by a tokenizer's tokens (``functions.tokens.token_packer``).
Packing = Callable[[Column, int, int], Column]


def structure(parsed: DataFrame, packing: Packing = pack_counted) -> tuple[DataFrame, DataFrame]:
    """Parents and children of ``parsed(document_id, pages array<struct<page, markdown, ...>>)``: see ``parents_of`` and ``children_of``."""
    parents = parents_of(parsed, packing)
    return parents, children_of(parents, packing)


def parents_of(parsed: DataFrame, packing: Packing = pack_counted) -> DataFrame:
    """document_id, chunk_index, content, token_count, page_start, page_end, heading_path, language. Numbers are dense over what is kept, in document order."""
    cleaned = F.transform(F.array_sort(F.col("pages")), lambda p: sanitize(p["markdown"]))
    numbers = parsed.select("document_id", F.transform(F.array_sort(F.col("pages")), lambda p: p["page"]).alias("numbers"))
    split = sections(parsed, cleaned).join(numbers, "document_id").withColumn("page_number", F.get("numbers", F.col("page") - 1)).drop("numbers")
    pieces = split.select("document_id", "page", "section", "page_number", "heading_path", F.posexplode(kept_counted(packing(F.col("body"), *PARENT))).alias("piece", "packed"))
    place = Window.partitionBy("document_id").orderBy("page", "section", "piece")
    parents = pieces.withColumn("chunk_index", (F.row_number().over(place) - 1).cast("long"))
    return parents.select("document_id", "chunk_index", "packed.content", F.col("packed.token_count").cast("long").alias("token_count"), F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"), "heading_path", detect_language(F.col("packed.content")).alias("language"))


def children_of(parents: DataFrame, packing: Packing = pack_counted) -> DataFrame:
    """document_id, parent_index, chunk_index, content, token_count, page_number, heading_path, language, numbered like parents."""
    owned = parents.select("document_id", F.col("chunk_index").alias("parent_index"), F.posexplode(kept_counted(packing(F.col("content"), *CHILD))).alias("piece", "packed"), F.col("page_start").alias("page_number"), "heading_path", "language")
    order = Window.partitionBy("document_id").orderBy("parent_index", "piece")
    children = owned.withColumn("chunk_index", (F.row_number().over(order) - 1).cast("long"))
    return children.select("document_id", "parent_index", "chunk_index", "packed.content", F.col("packed.token_count").cast("long").alias("token_count"), "page_number", "heading_path", "language")


def without_text(documents: DataFrame, children: DataFrame) -> DataFrame:
    """Documents of which no child is left: their error is final."""
    return documents.join(children.select("document_id").distinct(), "document_id", "left_anti").withColumn("error_code", F.lit("NO_EXTRACTABLE_TEXT"))


def too_many_chunks(children: DataFrame, most: int = MAX_CHUNKS) -> DataFrame:
    return children.groupBy("document_id").agg(F.count("*").alias("chunks")).where(F.col("chunks") > most)


def refused(documents: DataFrame, children: DataFrame, most: int = MAX_CHUNKS) -> DataFrame:
    """``(document_id, error_code)`` of documents that go no further: without text, or of more than ``most`` chunks."""
    over = too_many_chunks(children, most).select("document_id", F.lit("TOO_MANY_CHUNKS").alias("error_code"))
    return without_text(documents.select("document_id"), children).unionByName(over)


def accepted(rows: DataFrame, refusals: DataFrame) -> DataFrame:
    return rows.join(refusals.select("document_id"), "document_id", "left_anti")


def contextualized(children: DataFrame, enriched: DataFrame, documents: DataFrame) -> DataFrame:
    """Children with context, category and the text that is embedded and stored; every child must be enriched."""
    joined = positional_join(children, enriched, ["document_id", "chunk_index"]).join(documents.select("document_id", "title"), "document_id")
    return joined.withColumn("contextualized", contextualize(F.col("title"), F.col("heading_path"), F.col("context"), F.col("content")))


def child_rows(contextual: DataFrame, vectors: DataFrame, parents: DataFrame, dim: int | None = None) -> DataFrame:
    """Rows as they are stored: ids are made from the natural key, so a rerun makes the same ones.

    With ``dim``, vectors that are not well formed fail the write.
    """
    checked = vectors if dim is None else vectors.where(F.assert_true(well_formed(F.col("embedding"), dim), F.lit("a vector is of another width, not finite or not of length one")).isNull())
    with_vectors = positional_join(contextual, checked, ["document_id", "chunk_index"])
    owners = parents.select("document_id", F.col("chunk_index").alias("parent_index"), row_id("parent").alias("parent_id"))
    return with_vectors.join(owners, ["document_id", "parent_index"]).withColumn("child_id", row_id("child"))


def row_id(kind: str):
    return F.sha2(F.concat_ws("|", F.lit(kind), "document_id", F.col("chunk_index").cast("string")), 256)


def persist(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """The stored table after a document's rows replace what it had: rerun with the same rows, it is the same."""
    return replace_documents(existing, rows)


def to_run(documents: DataFrame, outputs: DataFrame, *content: str) -> DataFrame:
    """Documents whose stage has to run: no output, or one of another content."""
    return stale(documents.select("document_id", fingerprint(*content).alias("input_fp")), outputs)


STORED = (
    "document_id string, kind string, id string, parent_id string, chunk_index long, content string, contextualized string, token_count long, page_number int, "
    "heading_path string, language string, category string, embedding array<float>, status string, error_code string"
)
PARENTS = "document_id string, chunk_index long, content string, token_count long, page_start int, page_end int, heading_path string, language string"
CHILDREN = "document_id string, parent_index long, chunk_index long, content string, token_count long, page_number int, heading_path string, language string"


def stored(parents: DataFrame, children: DataFrame, documents: DataFrame, refusals: DataFrame) -> DataFrame:
    """A document's parents, children and status as rows of one table, told apart by ``kind``: written as one, they are there as one.

    A refused document has its status alone.
    """
    names = [c.split()[0] for c in STORED.split(", ")]
    fill = lambda rows, kind, **more: rows.withColumns({"kind": F.lit(kind), **more}).select(*((F.col(c) if c in rows.columns or c in ("kind", *more) else F.lit(None)).cast(t).alias(c) for c, t in (d.split(" ", 1) for d in STORED.split(", "))))
    state = documents.select("document_id").join(refusals, "document_id", "left")
    status = F.when(F.col("error_code").isNull(), "COMPLETED").otherwise("FAILED")
    rows = fill(accepted(parents, refusals), "parent", id=row_id("parent"), page_number=F.col("page_start"))
    rows = rows.unionByName(fill(accepted(children, refusals), "child", id=F.col("child_id")))
    return rows.unionByName(fill(state, "document", status=status)).select(names)


def ingest_chain(spark: SparkSession, root: str, dim: int, enricher: Enricher = stub_enricher, embedder: Embedder | None = None, max_chunks: int = MAX_CHUNKS, packing: Packing = pack_counted, step_units: int | None = None) -> Chain:
    """From ``documents(document_id, content_fp, title, pages)`` to stored rows, in stages that can each be cut short.

    Chunks are enriched and embedded one by one as far as their providers let; a document is stored once both are whole.
    """

    def vectors(t: dict[str, DataFrame]) -> DataFrame:
        enriched = t["enriched"].join(t["children"], ["document_id", "chunk_index"], "left_semi")
        return embed(contextualized(t["children"], enriched, t["documents"]), None, dim, embedder)

    def store(t: dict[str, DataFrame]) -> DataFrame:
        documents = t["documents"]
        mine = {n: rows.join(documents.select("document_id"), "document_id", "left_semi") for n, rows in t.items()}
        rows = child_rows(contextualized(mine["children"], mine["enriched"], documents), mine["vectors"], mine["parents"], dim)
        return stored(mine["parents"], rows, documents, refused(documents, mine["children"], max_chunks))

    chunk = ("chunk_index",)
    return Chain(spark, root, [
        Stage("parents", lambda t: parents_of(t["documents"], packing), PARENTS),
        Stage("children", lambda t: children_of(t["parents"], packing), CHILDREN, ("parents",)),
        Stage("enriched", lambda t: enrich(t["children"], None, enricher), "document_id string, chunk_index long, context string, category string", ("children",), chunk),
        Stage("vectors", vectors, "document_id string, chunk_index long, embedding array<float>", ("children", "enriched", "documents"), chunk),
        Stage("stored", store, STORED, ("documents", "parents", "children", "enriched", "vectors")),
    ], step_units)


__all__ = ["DROP_BELOW", "Stage", "accepted", "child_rows", "children_of", "contextualized", "ingest_chain", "parent_chunks", "parents_of", "persist", "refused", "row_id", "stored", "structure", "to_run", "too_many_chunks", "without_text"]
