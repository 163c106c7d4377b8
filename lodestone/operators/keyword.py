"""Keyword search: term frequency and BM25 for batches of questions, headings, titles.

The asked terms, not the corpus, are what a task is sent, in passes of a stated number of questions. Terms are counted
inside the row, and a task gives no more than the best documents of each question.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.scratch import written
from lodestone.sources.tables import spread

K1, B = 1.2, 0.75
PLACES = 6
#: Questions of a pass; documents that are read at a time, at first, when nothing is ruled out, and at most; sums that are made at a time.
BLOCK, FIRST, SLICE, CELLS = 32_768, 32, 2_048, 1_000_000


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def postings(docs: DataFrame) -> DataFrame:
    """The inverted index of ``docs(doc_id, text)``: (term, doc_id, tf, doc_length). Raw content, no added context."""
    split = docs.select("doc_id", terms(F.col("text")).alias("terms"))
    each = split.select("doc_id", F.size("terms").cast("long").alias("doc_length"), F.explode("terms").alias("term"))
    return each.groupBy("term", "doc_id", "doc_length").agg(F.count("*").alias("tf"))


def query_terms(questions: DataFrame) -> DataFrame:
    """``(q_id, term)``, each once, of ``questions(q_id, text)``."""
    return questions.select("q_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))


@dataclass
class Asked:
    """The questions of a pass: which terms they have, and for each term the questions that have it."""

    q_ids: list[int]
    terms: list[str]
    starts: np.ndarray  # where a term's questions begin in ``asking``
    asking: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Asked:
        q_ids, words = sorted({q for q, _ in rows}), sorted({t for _, t in rows})
        q_at, t_at = {q: i for i, q in enumerate(q_ids)}, {t: i for i, t in enumerate(words)}
        pairs = np.array(sorted((t_at[t], q_at[q]) for q, t in rows), dtype=np.int64).reshape(-1, 2)
        return cls(q_ids, words, np.searchsorted(pairs[:, 0], np.arange(len(words) + 1)), pairs[:, 1])

    def counts(self, split: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, number of the term and how often it occurs, for the asked terms of each row's words."""
        number = pc.fill_null(pc.index_in(split.flatten(), value_set=pa.array(self.terms, pa.string())), -1).to_numpy()
        row = np.repeat(np.arange(len(split)), pc.fill_null(pc.list_value_length(split), 0).to_numpy())
        some = number >= 0
        key, times = np.unique(row[some] * len(self.terms) + number[some], return_counts=True)
        return key // max(1, len(self.terms)), key % max(1, len(self.terms)), times


#: What a term that occurs so often in a text of so many words adds to its score.
Part = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Corpus:
    """Documents split once for many passes: ``split(doc_id, terms)`` and ``frequencies(term, df)``, both written, how many there are and their mean length."""

    split: DataFrame
    frequencies: DataFrame
    total: int
    mean: float

    @classmethod
    def of(cls, docs: DataFrame) -> Corpus:
        split, _ = written(_split(docs), "split-texts")
        frequencies, _ = written(split.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df")), "frequencies")
        total, texts, words = split.agg(F.count("*"), F.count("terms"), F.sum(F.when(F.col("terms").isNotNull(), F.size("terms")))).first()
        return cls(split, frequencies, total, (words or 0) / max(1, texts))

    def having(self, asked: Asked) -> np.ndarray:
        """For each asked term how many documents have it; the asked terms alone come to the driver."""
        words = self.split.sparkSession.createDataFrame([(t,) for t in asked.terms], "term string")
        found = {r.term: r.df for r in self.frequencies.join(words, "term").collect()}
        return np.array([found.get(t, 0) for t in asked.terms], np.float64)


def _split(docs: DataFrame) -> DataFrame:
    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", terms(F.col("text")).alias("terms"))


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start, as many as its size says."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


class _Best:
    """The ``top`` documents of each of ``n`` questions so far, ties by id; where there are fewer, -inf stands for the rest."""

    def __init__(self, n: int, top: int) -> None:
        self.top, self.ids, self.scores = top, np.full((n, top), np.iinfo(np.int64).max), np.full((n, top), -np.inf)

    def least(self) -> np.ndarray:
        return self.scores[:, -1]

    def take(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        some = np.unique(q)
        q = np.concatenate([np.repeat(some, self.top), q])
        ids, scores = np.concatenate([self.ids[some].ravel(), ids]), np.concatenate([self.scores[some].ravel(), scores])
        order = np.lexsort((ids, -scores, q))
        q = q[order]
        kept = order[np.arange(len(q)) - np.searchsorted(q, q) < self.top]
        self.ids[some], self.scores[some] = ids[kept].reshape(-1, self.top), scores[kept].reshape(-1, self.top)


def _searcher(asked: Asked, top: int, part: Part):
    """A document is scored for a question only if it has a term without which it can't be among the question's best so far.

    What a term adds at most is known for each slice of documents. The terms that add least, and together less than the
    last of a question's best has, don't make a candidate; a candidate that the others make good enough is scored by all.
    """
    n, n_terms = len(asked.q_ids), len(asked.terms)
    order = np.argsort(asked.asking, kind="stable")
    of, term_of = asked.asking[order], np.repeat(np.arange(n_terms), np.diff(asked.starts))[order]  # question and term, in this order
    begin, fan = np.searchsorted(of, np.arange(n)), np.bincount(of, minlength=n)

    def candidates(bound: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Which of the questions' terms make candidates."""
        most = bound[term_of]
        some = np.flatnonzero((most > 0) & (np.bincount(of, most, n) >= least)[of])
        some = some[np.lexsort((most[some], of[some]))]
        upto = np.cumsum(most[some])
        first = np.searchsorted(of[some], of[some])
        return np.sort(some[upto - upto[first] + most[some][first] >= least[of[some]]])

    def score(best: _Best, ids: np.ndarray, row: np.ndarray, term: np.ndarray, value: np.ndarray) -> None:
        by_term = np.argsort(term, kind="stable")
        key, value, rows = (term * len(ids) + row)[by_term], value[by_term], row[by_term]
        opens = np.flatnonzero(np.diff(term[by_term], prepend=-1))
        bound, start, size = np.zeros(n_terms), np.zeros(n_terms, np.int64), np.zeros(n_terms, np.int64)
        here = term[by_term][opens]
        bound[here], start[here], size[here] = np.maximum.reduceat(value, opens), opens, np.diff(np.append(opens, len(key)))
        least = best.least() - 10.0**-PLACES
        some = candidates(bound, least)
        load, all_load = np.bincount(of[some], size[term_of[some]], n), np.bincount(of, size[term_of], n)
        wide = load * fan * 2 > all_load + len(ids) / 4  # to add all terms is cheaper than to look them up
        some = np.union1d(some, np.flatnonzero(wide[of] & (size[term_of] > 0)))
        rest = np.bincount(of, bound[term_of], n) - np.bincount(of[some], bound[term_of[some]], n)  # what the other terms add at most
        load = np.bincount(of[some], size[term_of[some]], n)
        whole = np.bincount(of[some], minlength=n) == np.bincount(of, size[term_of] > 0, n)  # no other term is here
        dense = load > len(ids) / 16
        for full in (True, False):
            each = some[dense[of[some]] == full]
            work = np.cumsum(np.where(np.diff(of[each], prepend=-1), load[of[each]] + full * len(ids), 0)) // CELLS
            cuts = [*np.flatnonzero(np.diff(work, prepend=-1)).tolist(), len(each)]  # a question's terms stay together
            for x, y in zip(cuts, cuts[1:], strict=False):
                mine, t = of[each[x:y]], term_of[each[x:y]]
                asks, nth = np.unique(mine, return_inverse=True)
                posting = ranges(start[t], size[t])
                cell = np.repeat(nth * len(ids), size[t]) + rows[posting]
                if full:
                    sums = np.bincount(cell, value[posting], len(asks) * len(ids)).reshape(len(asks), len(ids))
                    cell = np.flatnonzero((sums > 0) & (sums >= (least - rest)[asks][:, None]))
                    sums = sums.ravel()[cell]
                else:
                    cell, at = np.unique(cell, return_inverse=True)
                    sums = np.bincount(at, value[posting], len(cell))
                    kept = sums >= (least - rest)[asks[cell // len(ids)]]
                    cell, sums = cell[kept], sums[kept]
                q, d = asks[cell // len(ids)], cell % len(ids)
                part_of = np.flatnonzero(~whole[q])
                sums[part_of] = all_terms(q[part_of], d[part_of], key, value, len(ids))
                scores = np.floor(sums * 10.0**PLACES + 0.5) / 10.0**PLACES  # halves go up, as in SQL
                more = scores >= best.least()[q]
                best.take(q[more], ids[d[more]], scores[more])

    def all_terms(q: np.ndarray, d: np.ndarray, key: np.ndarray, value: np.ndarray, docs: int) -> np.ndarray:
        """The sums of pairs over all terms of the question."""
        wanted = term_of[ranges(begin[q], fan[q])] * docs + np.repeat(d, fan[q])
        at = np.minimum(np.searchsorted(key, wanted), len(key) - 1)
        return np.bincount(np.repeat(np.arange(len(q)), fan[q]), np.where(key[at] == wanted, value[at], 0.0), len(q))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, rows = _Best(n, top), FIRST
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                ids, split = (batch.column(c).slice(at, rows) for c in (0, 1))
                row, term, times = asked.counts(split)
                lengths = pc.fill_null(pc.list_value_length(split), 0).to_numpy()
                if len(row):
                    score(best, ids.to_numpy(), row, term, part(term, times, lengths[row]))
                at, rows = at + rows, min(2 * rows, SLICE)
        question, place = np.nonzero(best.scores > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(np.array(asked.q_ids, np.int64)[question]), pa.array(best.ids[question, place]), pa.array(best.scores[question, place])], ["q_id", "doc_id", "score"])

    return search


def _passes(questions: DataFrame, passes: int) -> Iterator[Asked]:
    """The questions, dealt to ``passes`` passes."""
    rows = query_terms(questions.select(F.col("q_id").cast("long").alias("q_id"), "text"))
    for n in range(passes):
        yield Asked.of([tuple(r) for r in (rows.where(F.pmod(F.xxhash64("q_id"), F.lit(passes)) == n) if passes > 1 else rows).collect()])


def _ranked(split: DataFrame, questions: DataFrame, top: int, part_for: Callable[[Asked], Part]) -> DataFrame:
    """Terms of ``split(doc_id, terms)`` are counted and scored where a document is read, and only the ``top`` of a question and task are shuffled."""
    found, passes = None, max(1, math.ceil(questions.count() / BLOCK))
    for asked in _passes(questions, passes):
        more = split.mapInArrow(_searcher(asked, top, part_for(asked)), "q_id long, doc_id long, score double")
        if passes > 1:  # a pass is done, and its questions forgotten, before the next is asked
            more, _ = written(more, "keyword-pass")
        found = more if found is None else found.unionByName(more)
    order = Window.partitionBy("q_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)


def keyword_tf(docs: DataFrame, questions: DataFrame, top: int = 10) -> DataFrame:
    """Documents by the sum of the asked terms' share of their words."""
    return _ranked(_split(docs), questions, top, lambda _: lambda term, times, length: times / length)


def document_frequency(docs: DataFrame, asked: Asked) -> tuple[int, float, np.ndarray]:
    """Documents, their mean length, and for each asked term how many have it: a row for each task and term is added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        having, texts, words = np.zeros(len(asked.terms), np.int64), 0, 0
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                split = batch.column(0).slice(at, SLICE)
                having += np.bincount(asked.counts(split)[1], minlength=len(having))
                texts += len(split) - split.null_count
                words += pc.sum(pc.list_value_length(split)).as_py() or 0
        some = np.flatnonzero(having)
        yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1, -2], pa.int64()), pa.array([*having[some].tolist(), texts, words], pa.int64())], ["term", "n"])

    rows = {r[0]: r[1] for r in _split(docs).select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n")).collect()}
    return docs.count(), rows.get(-2, 0) / max(1, rows.get(-1, 0)), np.array([rows.get(t, 0) for t in range(len(asked.terms))], np.float64)


def keyword_bm25(docs: DataFrame | Corpus, questions: DataFrame, top: int = 10, k1: float = K1, b: float = B) -> DataFrame:
    """Documents by BM25: a pass over the texts for the corpus counts of the asked terms, and one for the scores.

    Of a ``Corpus`` the counts are known, and no text is split again: for questions of many passes, or of many searches.
    """

    def part_for(asked: Asked) -> Part:
        n, mean, having = (docs.total, docs.mean, docs.having(asked)) if isinstance(docs, Corpus) else document_frequency(docs, asked)
        idf = np.log(1 + (n - having + 0.5) / (having + 0.5))
        return lambda term, times, length: idf[term] * times * (k1 + 1) / (times + k1 * (1 - b + b * length / mean))

    return _ranked(docs.split if isinstance(docs, Corpus) else _split(docs), questions, top, part_for)


def browse(chunks: DataFrame, heading: str) -> DataFrame:
    """Chunks under a heading path: at it or below it."""
    path = F.col("heading_path")
    return chunks.where((path == heading) | F.startswith(path, F.lit(f"{heading} > ")))


def title_search(documents: DataFrame, question: str, top: int = 10) -> DataFrame:
    """Documents whose title or file name has the question's words, those with most of them first."""
    asked = F.array_distinct(terms(F.lit(question)))
    named = terms(F.concat_ws(" ", "title", "filename"))
    hits = documents.withColumn("score", F.size(F.array_intersect(asked, named)).cast("long"))
    return hits.where("score > 0").orderBy(F.desc("score"), "document_id").limit(top)
