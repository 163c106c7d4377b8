"""Benchmark decontamination by pigeonhole edit matching.

A test item occurs in a document if some stretch of it is within the item's error budget, a share of its length, in
edits. Cut into one piece more than the budget, an item with so few errors has a piece without any. All pieces of all
items are found in one pass of an Aho-Corasick automaton; each hit says where the item would lie, and only there
Myers' bit-parallel distance is computed. Texts are compared in lower case with white space runs as one space.

Pieces are leaves of a tree. A node of n pieces has a budget of n - 1 errors, which is one more than its two children
have together: where a node keeps its budget, so does a child, down to a leaf without errors. A hit is thus compared
node by node on the way up, and is given up at the first node that is over its budget; most are at the leaf's parent.
No occurrence is lost by that.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ERROR_RATE = 0.1
#: Characters of test items that one pass over the documents looks for; more items mean more passes.
BLOCK_CHARS = 4_000_000
#: Mask tables a worker keeps.
MASKS = 20_000
LEAKS = "doc_id long, item_id long, distance int, start long, stop long"
SPACE = re.compile(r"\s+")


def normal(text: str | None) -> str:
    return SPACE.sub(" ", (text or "").lower()).strip()


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """``budget + 1`` pieces of near-equal length that make up the item, with their offsets."""
    cuts = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


@lru_cache(maxsize=100_000)
def nodes_above(leaf: int, leaves: int) -> tuple[tuple[int, int], ...]:
    """The nodes over a leaf as ranges of leaves, its parent first and the root last."""
    lo, hi, way = 0, leaves, []
    while hi - lo > 1:
        way.append((lo, hi))
        middle = (lo + hi) // 2
        lo, hi = (lo, middle) if leaf < middle else (middle, hi)
    return tuple(reversed(way))


def masks(pattern: str) -> dict[str, int]:
    found: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        found[c] |= 1 << i
    return dict(found)


def myers(pattern_masks: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """The least edits between the pattern and a stretch of ``text``, and the first end (exclusive) that has them.

    ``anchored``: the stretch begins where ``text`` does. The pattern's column is one integer, whatever its length.
    """
    every, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, edits, carry = every, 0, m, int(anchored)
    best, at = m, 0
    for j, c in enumerate(text, 1):
        equal = pattern_masks.get(c, 0)
        down = equal | minus
        across = (((equal & plus) + plus) ^ plus) | equal
        up = minus | (every & ~(across | plus))
        less = plus & across
        if up & top:
            edits += 1
        elif less & top:
            edits -= 1
        up = up << 1 | carry
        plus = (less << 1 | ~(down | up)) & every
        minus = up & down & every
        if edits < best:
            best, at = edits, j
    return best, at


def stands_alone(text: str, start: int, stop: int) -> bool:
    """Whether neither end of a stretch lies inside a word."""
    return not (start and text[start - 1].isalnum() and text[start].isalnum()) and not (stop < len(text) and text[stop - 1].isalnum() and text[stop].isalnum())


class ItemMatcher:
    """Finds items in texts; built once in a worker for a block of items."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float = ERROR_RATE):
        import ahocorasick

        self.items, self.budgets = items, [math.floor(len(t) * error_rate) for _, t in items]
        self.kept: dict[tuple[int, int, int], dict[str, int]] = {}
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for k, ((_, text), budget) in enumerate(zip(items, self.budgets, strict=True)):
            for i, (_, piece) in enumerate(pieces(text, budget)):
                places[piece].append((k, i))
        for piece, found in places.items():
            self.automaton.add_word(piece, (len(piece), found))
        if places:
            self.automaton.make_automaton()
        self.any = bool(places)

    def _masks(self, k: int, a: int, b: int) -> dict[str, int]:
        """The masks of ``item[a:b]``, kept in one table of bounded size."""
        if (k, a, b) not in self.kept:
            if len(self.kept) >= MASKS:
                self.kept.clear()
            self.kept[k, a, b] = masks(self.items[k][1][a:b])
        return self.kept[k, a, b]

    def _holds(self, text: str, k: int, leaf: int, place: int) -> bool:
        """Whether every node between a leaf that was hit and the root keeps its budget; ``place`` is the item's start."""
        item, n = self.items[k][1], self.budgets[k] + 1
        way = nodes_above(leaf, n)
        if not way:
            return True
        # The parent's other part has at most ``spare`` errors: of spare + 1 chunks one has none, and is moved by no more.
        (lo, hi), size = way[0], len(item)
        spare = hi - lo - 1
        a, b = (size * (leaf + 1) // n, size * hi // n) if leaf == lo else (size * lo // n, size * leaf // n)
        x = a
        for c in range(1, spare + 2):
            y = a + (b - a) * c // (spare + 1)
            if text.find(item[x:y], max(0, place + x - spare), max(0, place + y + spare)) >= 0:
                break
            x = y
        else:
            return False
        for lo, hi in way[:-1]:
            a, b, budget = size * lo // n, size * hi // n, hi - lo - 1
            window = text[max(0, place + a - budget) : max(0, place + b + budget)]
            if myers(self._masks(k, a, b), b - a, window)[0] > budget:
                return False
        return True

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """(item number, edits, start, stop) of the best occurrence of each item in a normalized text."""
        if not self.any:
            return []
        starts: dict[int, set[int]] = defaultdict(set)
        for end, (n, found) in self.automaton.iter(text):
            for k, leaf in found:
                place = end + 1 - n - len(self.items[k][1]) * leaf // (self.budgets[k] + 1)
                if place not in starts.get(k, ()) and self._holds(text, k, leaf, place):
                    starts[k].add(place)
        out = []
        for k, places in starts.items():
            item, budget, best = self.items[k][1], self.budgets[k], None
            ordered = sorted(places)
            if not budget:  # hits are the whole item; it counts where no word goes on beyond it
                at = next((a for a in ordered if stands_alone(text, a, a + len(item))), None)
                if at is not None:
                    out.append((k, 0, at, at + len(item)))
                continue
            at = 0
            while at < len(ordered):
                upto = at  # places whose windows overlap are one window
                while upto + 1 < len(ordered) and ordered[upto + 1] - ordered[upto] <= 2 * budget:
                    upto += 1
                a, b = max(0, ordered[at] - budget), ordered[upto] + len(item) + budget
                edits, stop = myers(self._masks(k, 0, len(item)), len(item), text[a:b])
                if edits <= budget and (best is None or edits < best[0]):
                    _, back = myers(masks(item[::-1]), len(item), text[a : a + stop][::-1], anchored=True)
                    best = (edits, a + stop - back, a + stop)
                at = upto + 1
            if best:
                out.append((k, *best))
        return sorted(out)


def find_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``LEAKS``: a row for each row of ``docs(doc_id, text)`` and each item of ``benchmark(item_id, text)`` it holds.

    ``distance`` is the least number of edits, start and stop (exclusive) the first such stretch in the normalized
    text. Items that are null or blank occur nowhere; items too short for an error are matched exactly and as whole
    words. Null ids come back as they are, repeated rows have rows of their own, other columns are ignored; an empty
    benchmark or table gives no rows.
    """
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for listed in _item_blocks(benchmark, block_chars):
        more = source.mapInArrow(_searcher(listed, error_rate), LEAKS)
        found = more if found is None else found.unionByName(more)
    return found


def drop_leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs``, with all their columns, in which no item occurs."""
    at = docs.columns.index("text")

    def without(listed: list[tuple[int | None, str]]):
        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = ItemMatcher(listed, error_rate)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.find(normal(t.as_py())) for t in batch.column(at)], pa.bool_()))

        return keep

    for listed in _item_blocks(benchmark, block_chars):
        docs = docs.mapInArrow(without(listed), docs.schema)
    return docs


def _item_blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    """The normalized items that aren't blank, about ``block_chars`` characters at a time; one block at least."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(chars / block_chars))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block).collect()
        yield [(r.item_id, t) for r in rows if (t := normal(r.text))]


def _searcher(listed: list[tuple[int | None, str]], error_rate: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = ItemMatcher(listed, error_rate)
        for batch in batches:
            rows = [(i.as_py(), listed[k][0], edits, a, b) for i, t in zip(batch.column(0), batch.column(1), strict=True) for k, edits, a, b in matcher.find(normal(t.as_py()))]
            if rows:
                columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], [c.split()[0] for c in LEAKS.split(", ")])

    return search
