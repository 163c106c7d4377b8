"""Providers of what a query engine can't compute: embeddings, enrichment, answers, OCR. Offline stubs are the default.

Calls that cost money or differ from one time to the next are made once: their results are written to a table, and
what is already there is not asked for again.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.language import coerced
from lodestone.functions.vectors import normalized, stub_embedding
from lodestone.operators.ingest import pending
from lodestone.sources.objects import CATEGORIES

ENRICH_BATCH, EMBED_BATCH, SOLO_TRIES = 20, 100, 2


class Enricher(Protocol):
    def __call__(self, chunks: Sequence[dict]) -> list[dict]:
        """``{id, context, category}`` for ``{id, heading, content}``; ids may be missing."""


class Embedder(Protocol):
    def __call__(self, texts: Sequence[str]) -> list[list[float]]: ...


class RateLimited(Exception):
    """The provider asks to come back later; what was read so far stands."""


def stub_enricher(chunks: Sequence[dict]) -> list[dict]:
    return [{"id": c["id"], "context": (c["heading"] or "")[:80], "category": "OTHER"} for c in chunks]


def enrich_batch(chunks: Sequence[dict], provider: Enricher, tries: int = SOLO_TRIES) -> tuple[list[dict], bool]:
    """A row for each chunk: the batch's good items, then each missing one asked for alone, then an empty context.

    And whether the provider asked to come back later; then only chunks that were answered have a row.
    """
    got: dict[int, dict] = {}
    try:
        got |= {c["id"]: c for c in provider(chunks)}
        for chunk in chunks:
            for _ in range(tries):
                if chunk["id"] in got:
                    break
                got |= {c["id"]: c for c in provider([chunk]) if c["id"] == chunk["id"]}
    except RateLimited:
        return [got[c["id"]] for c in chunks if c["id"] in got], True
    return [got.get(c["id"], {"id": c["id"], "context": "", "category": "OTHER"}) for c in chunks], False


def enrich(chunks: DataFrame, done: DataFrame | None = None, provider: Enricher = stub_enricher, size: int = ENRICH_BATCH) -> DataFrame:
    """``(document_id, chunk_index, context, category)`` of the chunks that ``done`` has not, of all without it; categories are a closed set.

    A task whose provider is ``RateLimited`` ends with what it has. The rest is still pending, and the next call,
    with these rows among ``done``, asks for that alone.
    """

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size].reset_index(drop=True)
                asked = [{"id": i, "heading": h, "content": c} for i, h, c in zip(part.index, part["heading_path"], part["content"], strict=True)]
                rows, limited = enrich_batch(asked, provider)
                rows.sort(key=lambda r: r["id"])
                if rows:  # a provider may be limited before it has answered anything
                    yield part.loc[[r["id"] for r in rows], ["document_id", "chunk_index"]].assign(context=[r["context"] for r in rows], category=[r["category"] for r in rows])
                if limited:
                    return

    wanted = _not_in(chunks.select("document_id", "chunk_index", "heading_path", "content"), done)
    asked = wanted.mapInPandas(call, "document_id string, chunk_index long, context string, category string")
    return asked.withColumn("category", coerced(F.col("category"), CATEGORIES, "OTHER"))


def _not_in(rows: DataFrame, done: DataFrame | None) -> DataFrame:
    return rows if done is None else pending(rows, done, ["document_id", "chunk_index"])


def embed(texts: DataFrame, done: DataFrame | None, dim: int, provider: Embedder | None = None, size: int = EMBED_BATCH) -> DataFrame:
    """``(document_id, chunk_index, embedding)`` of the rows that ``done`` has not. Without a provider, the stub's vectors.

    A ``RateLimited`` provider ends a task with what it has, as in ``enrich``.
    """
    wanted = _not_in(texts.select("document_id", "chunk_index", "contextualized"), done)
    if provider is None:
        return wanted.select("document_id", "chunk_index", stub_embedding(F.col("contextualized"), dim).cast("array<float>").alias("embedding"))

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                try:
                    vectors = provider(part["contextualized"].tolist())
                except RateLimited:
                    return
                if len(vectors) != len(part) or any(len(v) != dim for v in vectors):
                    raise ValueError("the provider returned vectors of another number or width")
                yield part[["document_id", "chunk_index"]].assign(embedding=vectors)

    return wanted.mapInPandas(call, "document_id string, chunk_index long, embedding array<float>")


def embed_questions(questions: DataFrame, dim: int, provider: Embedder | None = None, size: int = EMBED_BATCH) -> DataFrame:
    """``questions(q_id, text, ...)`` with ``embedding`` of length one, by the provider or the stub. Blank ones have none."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    if provider is None:
        return questions.withColumn("embedding", F.when(~blank, stub_embedding(F.col("text"), dim)))
    schema = T.StructType([*questions.schema, T.StructField("embedding", T.ArrayType(T.DoubleType()))])

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                asked = [t for t in part["text"] if t and t.strip()]
                vectors = iter(provider(asked) if asked else [])
                yield part.assign(embedding=[list(map(float, next(vectors))) if t and t.strip() else None for t in part["text"]])

    return questions.mapInPandas(call, schema).withColumn("embedding", normalized(F.col("embedding")))


class Completer(Protocol):
    def __call__(self, prompts: Sequence[str]) -> list[str]:
        """An answer for each prompt, in order."""


def stub_completer(prompts: Sequence[str]) -> list[str]:
    """The last line of each prompt, citing the first passage."""
    return [f"{p.splitlines()[-1] if p else ''} [1]" for p in prompts]


def complete(prompts: DataFrame, provider: Completer = stub_completer, size: int = ENRICH_BATCH) -> DataFrame:
    """``prompts(q_id, prompt, ...)`` with ``answer``; null prompts have none. Reads no more than a batch ahead."""
    schema = T.StructType([*prompts.schema, T.StructField("answer", T.StringType())])

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), size):
                part = frame.iloc[at : at + size]
                said = iter(provider([p for p in part["prompt"] if p is not None]))
                yield part.assign(answer=[None if p is None else next(said) for p in part["prompt"]])

    return prompts.mapInPandas(call, schema)


def read_pages(pages: DataFrame, reader: Callable[[bytes], str | None], in_flight: int = 4, deadline: float | None = None, clock: Callable[[], float] = time.time) -> DataFrame:
    """``(document_id, page, markdown)`` by OCR; null where the page was refused.

    ``in_flight`` tasks are all that call the reader at a time. Pages that would begin past ``deadline``, in seconds
    of ``clock``, have no row: they are pending, and a later call reads them.
    """

    def call(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(len(frame)):
                if deadline is not None and clock() >= deadline:
                    return
                one = frame.iloc[at : at + 1]
                yield one[["document_id", "page"]].assign(markdown=[reader(bytes(i)) for i in one["image"]])

    return pages.select("document_id", "page", "image").repartition(in_flight).mapInPandas(call, "document_id string, page int, markdown string")


def trying_again(reader: Callable[[bytes, int], str | None], tries: int = 3, is_loop: Callable[[str], bool] | None = None) -> Callable[[bytes], str | None]:
    """An OCR reader that is asked up to ``tries`` times; it gets the number of the try, to sample warmer after a loop.

    None is the server's refusal of the page and is not tried again.
    """

    def read(image: bytes) -> str | None:
        text: str | None = None
        for attempt in range(tries):
            try:
                text = reader(image, attempt)
            except OSError:
                if attempt + 1 == tries:
                    raise
                continue
            if text is None or not (is_loop and is_loop(text)):
                return text
        return text

    return read


def in_input_order(reply: list[dict]) -> list[list[float]]:
    """Vectors of a provider's reply by their index, whatever order they came in."""
    return [r["embedding"] for r in sorted(reply, key=lambda r: r["index"])]
