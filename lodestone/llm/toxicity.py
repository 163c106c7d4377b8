"""Toxicity scores from a lexicon learned from labels and matched by Levenshtein automata.

The lexicon is a trie of whole words and of stems (any word that begins with one). It is intersected with the
Levenshtein automata of its terms: a state is the set of (trie node, errors) that a prefix of a token can be at, and
is made a deterministic state when a token first reaches it. So a token is read once, whatever the number of terms,
and most are given up after a few letters. Terms of up to 4 letters and stems match exactly, of 5 to 7 within one
edit, longer ones within two. Words within reach of a term that clean training texts use are exceptions. Tokens with
digits, underscores or symbols among their letters (``m0ron``) are read a second time as a whole.

A word is a term if it is far more frequent in toxic texts than in clean ones, the excess is significant among as many
words as were counted, and a share of all toxic texts has it: words of a few texts and of their near copies are none.

Each hit counts by its term's log odds, less for edits, and by its context window: a hit inside quotation marks or
soon after a word of reporting counts as quoted and weighs little, one near an address of the reader weighs more.
A logistic curve fitted to the training texts turns the sums into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import discard, materialize

WORD = re.compile(r"[^\W\d_]+")
SPELLED = re.compile(r"[\w*@$!]+")
SYMBOLS, LEAST_LETTERS = "_*@$!", 3
FOLDS = 5
#: Bound of what is learned from: labelled rows, and texts of them. All that the driver collects are counts of their words.
MAX_LABELLED = 100_000
#: A term is in this share of the toxic texts and this many times more frequent there than in clean ones; CHANCE are
#: expected to be so by chance among all words. Of a stem's hits, no word has more than ONE_WORD.
SUPPORT, SURE, CHANCE, ONE_WORD = 0.015, 20, 1e-3, 0.7
EDIT_WEIGHT, QUOTED_WEIGHT, ADDRESS_WEIGHT, WINDOW = 0.5, 0.25, 1.25, 48
OPENING, CLOSING = "\"“„«‹‘", "\"”“»›’"
REPORTING = frozenset("said says wrote writes quoted quotes called reported claims disait écrit cité appelé sagte schrieb zitierte nannte dijo escribió citó llamó".split())
ADDRESS = frozenset("you your du dich dein ihr tu te toi vous tú usted ustedes".split())

Term = tuple[str, bool, float]  # letters, whether a stem, log odds
DEAD = 0


def reach(term: str, stem: bool) -> int:
    """Edits within which a term is matched."""
    return 0 if stem or len(term) < 5 else 1 if len(term) < 8 else 2


class LexiconAutomaton:
    """``match(token)``: the best (term number, edits), or None."""

    def __init__(self, terms: list[Term]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.budget = [0]
        for number, (letters, stem, _) in enumerate(terms):
            node, most = 0, reach(letters, stem)
            self.budget[0] = max(self.budget[0], most)
            for c in letters:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.budget.append(0)
                node = self.children[node][c]
                self.budget[node] = max(self.budget[node], most)
            if self.ends[node] is None or stem:
                self.ends[node] = number
        self.alphabet = {c for node in self.children for c in node}
        self.numbers: dict[object, int]
        self.members: list[object]
        self.moves: list[dict[str, int]]
        self.accepts: list[tuple[int, int] | None]
        self.forget()

    def forget(self) -> None:
        """Back to the first state; others are made again as tokens reach them."""
        self.numbers, self.members, self.moves, self.accepts = {frozenset(): DEAD}, [frozenset()], [{}], [None]
        self.start = self._state({0: 0}) if self.terms else DEAD

    def _state(self, nodes: dict[int, int], found: tuple[int, int] | None = None) -> int:
        """The state of these nodes and all that skipped letters lead to; ``found``: a stem that was read already."""
        todo = list(nodes.items())
        while todo:
            node, errors = todo.pop()
            if nodes[node] < errors:
                continue
            for child in self.children[node].values():
                if errors + 1 <= self.budget[child] and errors + 1 < nodes.get(child, 99):
                    nodes[child] = errors + 1
                    todo.append((child, errors + 1))
        best = found
        for node, errors in nodes.items():
            number = self.ends[node]
            if number is not None and errors <= reach(*self.terms[number][:2]):
                if self.terms[number][1]:
                    found = best = (number, 0)
                elif best is None or errors < best[1]:
                    best = (number, errors)
        key = ("stem", found[0]) if found else frozenset(nodes.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.members)
            self.members.append(key)
            self.moves.append({})
            self.accepts.append(best)
        return self.numbers[key]

    def _move(self, state: int, c: str) -> int:
        members = self.members[state]
        if isinstance(members, tuple):
            to = state  # whatever follows a stem
        else:
            after: dict[int, int] = {}
            for node, errors in members:
                same = self.children[node].get(c)
                if same is not None and errors < after.get(same, 99):
                    after[same] = errors
                if errors + 1 <= self.budget[node] and errors + 1 < after.get(node, 99):
                    after[node] = errors + 1
                for child in self.children[node].values():
                    if child != same and errors + 1 <= self.budget[child] and errors + 1 < after.get(child, 99):
                        after[child] = errors + 1
            to = self._state(after) if after else DEAD
        self.moves[state][c] = to
        return to

    def match(self, token: str) -> tuple[int, int] | None:
        state = self.start
        for c in token:
            if state == DEAD:
                return None
            if c not in self.alphabet:
                c = "\0"
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
        return self.accepts[state]


@dataclass
class ToxicityModel:
    terms: list[Term] = field(default_factory=list)
    exceptions: frozenset[str] = frozenset()
    curve: tuple[float, ...] = (0.0, 0.0, 0.0)  # constant, by log sum, by density
    limit: int = 200_000  # words whose match a worker keeps
    states: int = 50_000  # states of the automaton that it keeps

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _ready(self) -> None:
        if "_automaton" not in self.__dict__:
            self._automaton, self._seen, self._hits = LexiconAutomaton(self.terms), set(), {}

    def hits_among(self, words: set[str]) -> dict[str, tuple[int, int]]:
        """Of these words those that match a term, with the term's number and the edits."""
        self._ready()
        for w in words - self._seen:
            found = self._automaton.match(w)
            if found and not (found[1] and w in self.exceptions):
                self._hits[w] = found
        self._seen |= words
        if len(self._automaton.members) > self.states:
            self._automaton.forget()
        hits = {w: self._hits[w] for w in words & self._hits.keys()}
        if len(self._seen) > self.limit:
            self._seen.clear()
            self._hits.clear()
        return hits

    def features(self, text: str | None) -> tuple[float, float, int, int]:
        """Log of the hits' weighted sum, the sum to a hundred words, hits and how many of them are quoted."""
        lower = (text or "").lower()
        words = WORD.findall(lower)
        whole = {w: spelled for w in set(SPELLED.findall(lower)) if not w.isalpha() and (spelled := respelled(w))}
        hits = self.hits_among(set(words).union(whole.values()))
        if not hits:
            return 0.0, 0.0, 0, 0
        found = [(*m.span(), hits[m[0]]) for m in WORD.finditer(lower) if m[0] in hits]
        if any(spelled in hits for spelled in whole.values()):
            plain = [(a, b) for a, b, _ in found]
            for m in SPELLED.finditer(lower):  # where no word in it is a hit of its own
                if (hit := hits.get(whole.get(m[0], ""))) and not any(m.start() <= a and b <= m.end() for a, b in plain):
                    found.append((*m.span(), hit))
        total, n_quoted = 0.0, 0
        for start, stop, (number, edits) in found:
            quoted, addressed = context(lower, start, stop)
            n_quoted += quoted
            total += self.terms[number][2] * EDIT_WEIGHT**edits * (QUOTED_WEIGHT if quoted else ADDRESS_WEIGHT if addressed else 1.0)
        n = len(found)
        return math.log1p(total), total * 100 / (len(words) + 20), n, n_quoted

    def score(self, features: tuple[float, ...]) -> float:
        z = self.curve[0] + self.curve[1] * features[0] + self.curve[2] * features[1]
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def respelled(token: str) -> str:
    """A token with letters around digits or symbols, without symbols at its ends; empty for other tokens."""
    body = token.strip(SYMBOLS)
    return body if not body.isalpha() and sum(map(str.isalpha, body)) >= LEAST_LETTERS else ""


def context(lower: str, start: int, stop: int) -> tuple[bool, bool]:
    """Whether the window around a hit shows a quotation, and whether it addresses the reader."""
    before, after = lower[max(0, start - WINDOW) : start], lower[stop : stop + WINDOW]
    near = WORD.findall(before)[-4:]
    opened = max(before.rfind(c) for c in OPENING)
    quoted = opened >= 0 and any(c in after for c in CLOSING) and before.count('"', opened) % 2 == (before[opened] == '"')
    return quoted or not REPORTING.isdisjoint(near), not ADDRESS.isdisjoint([*near, *WORD.findall(after)[:2]])


def in_held_out_fold(doc_id: Column) -> Column:
    """Whether a document is never learned from: crc32 of its id as text, mod 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % FOLDS == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, text, text_hash, toxic, row)`` of labelled documents outside the held-out fold, at most ``max_rows`` labels, taken by hash.

    ``row`` numbers them once they are written. An id with two labels is toxic if one of them says so; a null label is none.
    """
    named = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isNotNull() & ~in_held_out_fold(F.col("doc_id")))
    some = named.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # Two numbers a row, and max_rows at most.
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    return joined.select("doc_id", "text", F.md5("text").alias("text_hash"), "toxic", F.monotonically_increasing_id().alias("row"))


def each_text_once(rows: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """``(text, toxic)`` with the copies of a text as one row, toxic if one of them is; at most ``max_rows`` texts, taken by hash."""
    first = rows.groupBy("text_hash").agg(F.min("row").alias("row"), F.max("toxic").alias("toxic")).orderBy("text_hash").limit(max_rows)
    # Two numbers a text, and max_rows at most.
    return rows.drop("toxic").join(F.broadcast(first.select("row", "toxic")), "row").select("text", "toxic")


def _word_counts(train: DataFrame) -> DataFrame:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = Counter(), Counter()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[toxic > 0].update(set(WORD.findall(text.lower())))
            words = list(counts[0] | counts[1])
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())], ["word", "toxic", "clean"])

    return train.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _significant(among: int, n_toxic: int, n_clean: int) -> Callable[[DataFrame, int], DataFrame]:
    """Picks counted rows of enough toxic texts, too many for chance by Chernoff's bound; ``excess`` is its exponent."""
    share = n_toxic / (n_toxic + n_clean)

    def pick(counted: DataFrame, times: int) -> DataFrame:
        q = F.col("toxic") / (F.col("toxic") + F.col("clean"))
        excess = F.col("toxic") * F.log(q / share) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - q) / (1 - share))).otherwise(0.0)
        enough = (F.col("toxic") >= times * SUPPORT * n_toxic) & (q > share)
        return counted.where(enough).withColumn("excess", excess).where(F.col("excess") > times * math.log(max(among, 1) / CHANCE))

    return pick


def _log_odds(n_toxic: int, n_clean: int) -> Column:
    return F.log((F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> ToxicityModel:
    """Learn lexicon, exceptions and curve from ``max_rows`` labels and texts at most; copies of a text count once."""
    labelled = materialize(training_rows(docs, labels, max_rows), "toxic-train")
    train = each_text_once(labelled, max_rows)
    n_toxic, n_clean = train.agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    prior = math.log((n_toxic + 1) / (n_clean + 1))
    if not n_toxic or not n_clean:
        discard(labelled)
        return ToxicityModel(curve=(prior, 0.0, 0.0))
    words = materialize(_word_counts(train), "toxic-words")
    sure = math.log(SURE)
    tell = _significant(words.count(), n_toxic, n_clean)
    heads = words.select(F.explode(F.transform(F.sequence(F.lit(4), F.lit(7)), lambda n: F.when(F.length("word") > n, F.substring("word", F.lit(1), n)))).alias("head"), "toxic", "clean").where("head IS NOT NULL")
    heads = heads.groupBy("head").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.max("toxic").alias("most"))
    heads = tell(heads, 2).where(F.col("most") <= ONE_WORD * F.col("toxic")).withColumn("odds", _log_odds(n_toxic, n_clean)).where(F.col("odds") >= sure + math.log(2))
    stems: dict[str, Term] = {}
    shorter: set[str] = set()
    for r in heads.orderBy(F.desc("excess"), F.length("head"), "head").collect():
        beginnings = {r.head[:n] for n in range(4, len(r.head) + 1)}
        if r.head not in shorter and stems.keys().isdisjoint(beginnings):  # of stems that begin alike the one that tells most
            stems[r.head] = (r.head, True, min(r.odds, 8.0))
            shorter |= beginnings
    found = tell(words, 1).withColumn("odds", _log_odds(n_toxic, n_clean)).where(F.col("odds") >= sure)
    found = [(r.word, False, min(r.odds, 8.0)) for r in found.orderBy(F.desc("excess"), "word").collect()]
    whole = [t for t in found if stems.keys().isdisjoint(t[0][:n] for n in range(4, 8))]  # others are words of a stem
    model = ToxicityModel([*whole, *stems.values()])

    def within_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ws = batch.column(0).to_pylist()
            hits = model.hits_among(set(ws))
            yield batch.filter(pa.array([hits.get(w, (0, 0))[1] > 0 for w in ws], pa.bool_()))

    near = words.mapInArrow(within_reach, words.schema).where(F.col("clean") > 0).where(_log_odds(n_toxic, n_clean) < sure)
    model.exceptions = frozenset(r.word for r in near.select("word").collect())

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t)[:2] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64()), batch.column(1)], ["a", "b", "toxic"])

    described = train.mapInArrow(describe, "a double, b double, toxic int").groupBy("a", "b", (F.col("toxic") > 0).alias("toxic")).count()
    points = np.array(sorted(tuple(r) for r in described.collect()), dtype=np.float64).reshape(-1, 4)  # no more than texts
    model.curve = _logistic(points[:, :2], points[:, 2] > 0, points[:, 3])
    discard(labelled, words)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> tuple[float, ...]:
    """Newton's method on the regularised log loss of points that each count so many times."""
    x = np.column_stack([np.ones(len(x)), x])
    w, penalty = np.zeros(x.shape[1]), np.diag([1e-6, ridge, ridge])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (times * p * (1 - p))) @ x + penalty, x.T @ (times * (y - p)) - penalty @ w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


SCORE = "doc_id long, score double, predicted int, n_hits int, n_quoted int"
COLUMNS = ("doc_id", "held_out", "score", "predicted", "n_hits", "n_quoted")


def score_with(model: ToxicityModel, docs: DataFrame) -> DataFrame:
    """``COLUMNS`` of each row of ``docs(doc_id, text)``."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.features(t.as_py()) for t in batch.column(1)]
            s = [model.score(v) for v in x]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64()), pa.array([int(v >= 0.5) for v in s], pa.int32()), pa.array([v[2] for v in x], pa.int32()), pa.array([v[3] for v in x], pa.int32())], ["doc_id", "score", "predicted", "n_hits", "n_quoted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scored, SCORE).withColumn("held_out", in_held_out_fold(F.col("doc_id"))).select(*COLUMNS)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """Score every row of ``docs(doc_id, text)`` by a model learned from ``labels(doc_id, toxic)``.

    A null text is empty and scores as a text without hits; repeated rows score alike; null ids are held out; without
    labels of both kinds every score is the base rate; other columns are ignored.
    """
    return score_with(fit(docs, labels, max_rows), docs)


def keep_clean(model: ToxicityModel, docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that the model does not predict toxic."""
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(model.features(t.as_py())) < 0.5 for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
