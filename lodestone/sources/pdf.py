"""A PDF source. The page reader is injected; without one, pymupdf is used where it is installed.

A document that can't be read is a row with an ``error_code``, not an error: malformed, encrypted or too long.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith
from pyspark.sql.types import StructType

from lodestone.functions.text import nfc, strip

MAX_PAGES = 500
LINES = "path string, page int, line int, block int, text string, size double, bold boolean, error_code string"
SPANS = f"{LINES}, span int"
#: A reader gives (page, line, block, text, size, bold) of each span in order, and raises PdfError where it can't.
Span = tuple[int, int, int, str, float, bool]
Reader = Callable[[bytes], Iterator[Span]]


class PdfError(Exception):
    """``code`` is PDF_MALFORMED, PDF_ENCRYPTED or PDF_TOO_MANY_PAGES."""

    def __init__(self, code: str):
        super().__init__(code)
        self.code = code


def pymupdf_reader(content: bytes, max_pages: int = MAX_PAGES) -> Iterator[Span]:
    """Spans by pymupdf. Of the blocks of a page, type 0 are text and type 1 images."""
    try:
        import pymupdf
    except ImportError as e:
        raise RuntimeError("reading PDFs needs pymupdf or a reader of your own") from e
    try:
        document = pymupdf.open(stream=content, filetype="pdf")
    except Exception as e:  # the library's errors have no common base
        raise PdfError("PDF_MALFORMED") from e
    if document.needs_pass:
        raise PdfError("PDF_ENCRYPTED")
    if document.page_count > max_pages:
        raise PdfError("PDF_TOO_MANY_PAGES")
    for page in document:
        pieces = page.get_text("dict", flags=pymupdf.TEXT_PRESERVE_WHITESPACE | pymupdf.TEXT_PRESERVE_LIGATURES)["blocks"]
        text_lines = ((b["number"], line["spans"]) for b in pieces if b["type"] == 0 for line in b["lines"])
        for number, (block, spans) in enumerate(text_lines):
            for s in spans:
                yield page.number + 1, number, block, s["text"], s["size"], bool(s["flags"] & pymupdf.TEXT_FONT_BOLD) or "bold" in s["font"].lower()


def styled_lines(spans: DataFrame) -> DataFrame:
    """Lines of ``read_pdf_spans`` as ``LINES``: their spans joined in order, the largest size, bold if all of it is.

    Spans of white space alone have no say in style; lines of nothing else go. Text is composed Unicode. Lines are
    numbered by page without gaps. A row with an error stays as it is.
    """
    seen = F.trim("text") != ""
    style = F.struct(F.max(F.when(seen, F.round("size", 1))).alias("size"), F.min(F.when(seen, F.col("bold"))).alias("bold"))
    text = strip(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "text"))), lambda s: s["text"]), ""))
    lines = spans.groupBy("path", "page", "block", "line", "error_code").agg(text.alias("text"), style.alias("style")).where("text <> '' OR error_code IS NOT NULL")
    order = F.row_number().over(Window.partitionBy("path", "page").orderBy("line")) - 1
    return lines.select("path", "page", F.when(F.col("error_code").isNull(), order).alias("line"), "block", nfc(F.nullif("text", F.lit(""))).alias("text"), "style.size", "style.bold", "error_code")


def read_pdf_spans(objects: DataFrame, reader: Reader = pymupdf_reader) -> DataFrame:
    """``SPANS`` of ``objects(path, content)``: a row for each span, or one with the error."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows = [(path, *r, None, i) for i, r in enumerate(reader(bytes(content)))]
                except PdfError as e:
                    rows = [(path, *[None] * 6, e.code, None)]
                if rows:
                    yield pd.DataFrame(rows, columns=[c.split()[0] for c in SPANS.split(", ")])

    return objects.select("path", "content").mapInPandas(parse, SPANS)


# -- Pages as a data source -------------------------------------------------------------------------------------------

#: Bytes of a file that a task reads the pages of, about: a file of ten times as many is ten tasks.
RANGE_BYTES = 4 << 20


class PagedDocument(Protocol):
    """An open document; pages count from 0."""

    page_count: int

    def spans(self, page: int) -> Iterator[tuple[int, int, str, float, bool]]:
        """(line, block, text, size, bold) of each span of a page in order."""


@dataclass
class PageRange(InputPartition):
    """The ``part``-th of ``parts`` equal shares of a file's pages, however many it turns out to have."""

    path: str
    part: int
    parts: int


class PdfPagesReader(DataSourceReader):
    def __init__(self, uri: str, opener: Callable[[bytes], PagedDocument], range_bytes: int, max_pages: int):
        self.uri, self.opener, self.range_bytes, self.max_pages = uri, opener, range_bytes, max_pages
        self.only: set[str] | None = None
        self.prefixes: list[str] = []

    def partitions(self) -> list[PageRange]:
        """Shares of files by their sizes; no file is opened for it."""
        system, folder = fs.FileSystem.from_uri(self.uri)
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        named = sorted((f"{self.uri.rstrip('/')}/{i.path[len(folder) :].lstrip('/')}", i.size) for i in found if i.type == fs.FileType.File and i.extension.lower() == "pdf")
        wanted = [(p, n) for p, n in named if (self.only is None or p in self.only) and all(p.startswith(x) for x in self.prefixes)]
        out = [PageRange(p, k, parts) for p, n in wanted for parts in (max(1, -(-n // self.range_bytes)),) for k in range(parts)]
        return out or [PageRange("", 0, 1)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        if not partition.path:
            return
        system, path = fs.FileSystem.from_uri(partition.path)
        with system.open_input_file(path) as file:
            content = file.read()
        try:
            document = self.opener(content)
            if document.page_count > self.max_pages:
                raise PdfError("PDF_TOO_MANY_PAGES")
        except PdfError as e:
            if partition.part == 0:  # one row a file
                yield (partition.path, *[None] * 6, e.code, None)
            return
        first, last = (document.page_count * k // partition.parts for k in (partition.part, partition.part + 1))
        for page in range(first, last):
            for number, (line, block, text, size, bold) in enumerate(document.spans(page)):
                yield partition.path, page + 1, line, block, text, float(size), bool(bold), None, number


class FilteredPdfPagesReader(PdfPagesReader):
    """The reader where Spark pushes filters; it refuses one that could take them where it doesn't."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on the path decide which files are planned; others are left to Spark."""
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                named = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.only = named if self.only is None else self.only & named
            elif isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.prefixes.append(f.value)
            else:
                yield f


def pdf_pages(opener: Callable[[bytes], PagedDocument], name: str = "pdf_pages") -> type[DataSource]:
    """A data source to register: ``spark.read.format(name).load(folder)`` gives ``SPANS`` of the folder's files.

    Options: range_bytes, max_pages, and pushdown, ``true`` where ``spark.sql.python.filterPushdown.enabled`` is: filters on
    the path then choose the files that are planned.
    """

    class PdfPages(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SPANS

        def reader(self, schema: StructType) -> PdfPagesReader:
            kind = FilteredPdfPagesReader if self.options.get("pushdown", "false") == "true" else PdfPagesReader
            return kind(self.options["path"], opener, int(self.options.get("range_bytes", RANGE_BYTES)), int(self.options.get("max_pages", MAX_PAGES)))

    return PdfPages
