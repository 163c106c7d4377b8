"""Chunks by the tokens of a BPE tokenizer: costs of words, and greedy packing over running sums of them.

A word costs what it costs behind a space, but at the start of a piece what it costs alone. Words are costed once for a
batch of texts, pieces are found by binary search in the running sums, so no text is encoded again as a piece grows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = re.compile(r"\S+")
PIECES = "array<struct<content: string, token_count: int>>"
#: Words a worker keeps the costs of; longer ones than ``LONG`` characters are costed each time.
KEPT, LONG = 200_000, 64
#: Texts whose pieces a worker holds at a time, however many a batch has.
TEXTS = 128

#: The tokens of each of some strings, each encoded by itself.
Counter = Callable[[Sequence[str]], list[int]]


def bpe_counter(path: str) -> Callable[[], Counter]:
    """A maker of counters by the tokenizer file at ``path``, which every executor has; it is opened where it is used."""

    def make() -> Counter:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(list(texts), add_special_tokens=False)]

    return make


class WordCosts:
    """Costs of words behind a space and alone, by a counter; those of recent words are kept."""

    def __init__(self, counter: Counter, kept: int = KEPT):
        self.counter, self.kept, self.known = counter, kept, {}

    def __call__(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        missing = list(dict.fromkeys(w for w in words if w not in self.known))
        fresh = {}
        for at in range(0, len(missing), 1000):
            part = missing[at : at + 1000]
            counts = self.counter([f" {w}" for w in part] + part)
            fresh |= {w: (counts[i], counts[len(part) + i]) for i, w in enumerate(part)}
        both = np.array([self.known.get(w) or fresh[w] for w in words], dtype=np.int64).reshape(-1, 2)
        if len(self.known) + len(fresh) > self.kept:
            self.known = {}
        self.known |= {w: c for w, c in fresh.items() if len(w) <= LONG}
        return both[:, 0], both[:, 1]


def cut_points(behind: np.ndarray, alone: np.ndarray, least: int, most: int) -> list[tuple[int, int, int]]:
    """``(start, stop, tokens)`` of pieces of up to ``most`` tokens; a word of more is a piece alone, a last piece of fewer than ``least`` joins the one before."""
    sums = np.concatenate([[0], np.cumsum(behind)])
    pieces, at = [], 0
    while at < len(behind):
        room = most - int(alone[at]) + int(sums[at + 1])
        stop = max(at + 1, int(np.searchsorted(sums, room, side="right")) - 1)
        pieces.append((at, stop, int(alone[at] + sums[stop] - sums[at + 1])))
        at = stop
    if len(pieces) > 1 and pieces[-1][2] < least:
        start, stop, tokens = pieces.pop()
        first, _, held = pieces[-1]
        pieces[-1] = (first, stop, held + int(behind[start] - alone[start]) + tokens)
    return pieces


def _some(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[tuple[pd.Series, ...]]:
    """The rows of all batches, ``TEXTS`` at a time."""
    return (tuple(c.iloc[at : at + TEXTS] for c in columns) for columns in batches for at in range(0, len(columns[0]), TEXTS))


def token_packer(maker: Callable[[], Counter]) -> Callable[[Column, int, int], Column]:
    """``pack_counted`` by tokens: pieces as (content, token_count). White space between words becomes one space."""

    @F.pandas_udf(PIECES)
    def pieces(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        costs = WordCosts(maker())
        for texts, least, most in _some(batches):
            out = []
            for text, a, b in zip(texts, least, most, strict=True):
                words = (text or "").split()
                cuts = cut_points(*costs(words), a, b) if words else []
                out.append([{"content": " ".join(words[start:stop]), "token_count": n} for start, stop, n in cuts])
            yield pd.Series(out, index=texts.index, dtype=object)

    return lambda text, least, most: pieces(text, F.lit(least), F.lit(most))


PLACED = "array<struct<content: string, token_count: int, start: int, end: int>>"


def placed_packer(maker: Callable[[], Counter] | None = None) -> Callable[[Column, int, int], Column]:
    """``token_packer`` whose pieces know where they stand in the text: ``start`` and ``end`` in code points, end exclusive. Without a tokenizer a word is a token."""

    @F.pandas_udf(PLACED)
    def pieces(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        costs = WordCosts(maker() if maker else lambda words: [1] * len(words))
        for texts, least, most in _some(batches):
            out = []
            for text, a, b in zip(texts, least, most, strict=True):
                words = list(WORD.finditer(text or ""))
                cuts = cut_points(*costs([w[0] for w in words]), a, b) if words else []
                out.append([{"content": " ".join(w[0] for w in words[i:j]), "token_count": n, "start": words[i].start(), "end": words[j - 1].end()} for i, j, n in cuts])
            yield pd.Series(out, index=texts.index, dtype=object)

    return lambda text, least, most: pieces(text, F.lit(least), F.lit(most))


def token_count(maker: Callable[[], Counter]) -> Callable[[Column], Column]:
    """The tokens of a whole text, as a context's budget counts them; a null text has none."""

    @F.pandas_udf("int")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = maker()
        for texts in batches:
            counts = [n for at in range(0, len(texts), 200) for n in counter([t or "" for t in texts.iloc[at : at + 200]])]
            yield pd.Series(counts, index=texts.index, dtype="int32")

    return count
