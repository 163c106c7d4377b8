"""Text expressions. All are built-in column functions; tokenizers other than words are injected by the caller."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

FENCE = r"(?s)```.*?```"
CITATION = r"\[(\d+(?:\s*,\s*\d+)*)\]"
QUOTE_CHARS = 280


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end; ``trim`` takes spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text: Column) -> Column:
    """The white-space separated words."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def word_count(text: Column) -> Column:
    """The default token count: one for each word. A null text has none."""
    return F.coalesce(F.size(words(text)), F.lit(0))


def token_counter(encode: Callable[[str], list]) -> Callable[[Column], Column]:
    """A token count by any tokenizer, Arrow batches at a time."""

    @F.pandas_udf(T.IntegerType())
    def count(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(encode(t)) if t else 0).astype("int32")

    return count


def sanitize(markdown: Column) -> Column:
    """Runs of blank lines become one, outside fenced code; blocks and fences are joined by a blank line."""
    fences = F.regexp_extract_all(markdown, F.lit(f"({FENCE})"), 1)
    blocks = F.transform(F.split(markdown, FENCE, -1), lambda b: strip(F.regexp_replace(b, r"\n{3,}", "\n\n")))
    parts = F.flatten(F.transform(blocks, lambda b, i: F.array(b, F.get(fences, i))))
    return F.array_join(F.filter(parts, lambda p: p.isNotNull() & (p != "")), "\n\n")


def _filled(*columns: Column) -> list[Column]:
    return [F.nullif(c, F.lit("")) for c in columns]


def contextualize(title: Column, heading: Column, context: Column, content: Column) -> Column:
    """What is embedded for a chunk, and stored beside its vector: where it stands, what it is about, what it says."""
    (where,) = _filled(F.concat_ws(" > ", *_filled(title, heading)))
    return strip(F.concat_ws("\n\n", where, *_filled(context, content)))


def quote(matched: Column, passage: Column, chars: int = QUOTE_CHARS) -> Column:
    """What a citation shows: the start of the matched child, or else of the passage."""
    return F.left(F.coalesce(F.nullif(matched, F.lit("")), passage), F.lit(chars))


def cited_ordinals(answer: Column) -> Column:
    """The numbers in ``[1]`` and ``[1, 2]`` markers, each at its first use."""
    groups = F.regexp_extract_all(answer, F.lit(CITATION), 1)
    numbers = F.flatten(F.transform(groups, lambda g: F.split(g, r"\s*,\s*")))
    return F.array_distinct(F.filter(F.transform(numbers, lambda n: n.try_cast("long")), lambda n: n.isNotNull()))


def squash(text: Column) -> Column:
    """For comparing a quote with a text: lower case, white space runs as one space. See ``nfc`` for Unicode forms."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Composed Unicode; there is no built-in."""
    return texts.str.normalize("NFC")


def plain_line(line: Column) -> Column:
    """A line of markdown as text: no heading marks, tags or emphasis."""
    bare = F.regexp_replace(F.regexp_replace(strip(line), r"^#{1,6}\s*", ""), r"<[^>]+>", " ")
    return F.regexp_replace(bare, r"^[ *_\t]+|[ *_\t]+$", "")


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.left(text, F.lit(1))), F.lower(F.substr(text, F.lit(2))))


def unglue(text: Column) -> Column:
    """Headings that were run together, ``**A****B**``, on lines of their own; masked numbers stay."""
    return F.regexp_replace(text, r"(?<=[^\s*])\*{4}(?=[^\s*])", "**\n**")


def display_name(title: Column, filename: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(title), F.lit("")), filename)


def format_bytes(n: Column) -> Column:
    """Bytes as B, KB or MB."""
    scaled = lambda by, unit: F.concat(F.format_number(n / by, 1), F.lit(f" {unit}"))
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, scaled(1024, "KB")).otherwise(scaled(1024 * 1024, "MB"))


def stage_progress(done: Column, total: Column) -> Column:
    """The share of a stage that is done, 1 at most; null while the total is unknown."""
    return F.when(total > 0, F.least(F.lit(1.0), done / total))


def url_encode(text: Column) -> Column:
    """Percent-encoding with spaces as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
