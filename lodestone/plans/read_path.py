"""Questions to cited answers: replaceable stages over a batch of questions, each DataFrame to DataFrame.

Rewrite runs once; plan to gate may run again with a refined question while the gate asks for more. Only rewrite,
plan, fuse, gate and reflect have an empty version to fall back to: the others have nothing to return that would not
be an answer made of nothing. What a stage returns is computed before the next one runs, so that a stage that fails on
its rows falls back like one that fails to plan, and its time is its own.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import cited_ordinals, strip
from lodestone.functions.vectors import normalized
from lodestone.operators.candidates import BUDGET, build_context, collapse_to_parents, expand_parents, fuse
from lodestone.operators.feedback import LEAST_SPREAD, feedback_terms, rewritten, score_spread
from lodestone.operators.knn import OVER_FETCH, TOP_K, knn_batch
from lodestone.sources.scratch import drop, written


@dataclass(frozen=True)
class Verdict:
    sufficient: bool = True
    refined: DataFrame | None = None  # questions to go on with


@dataclass
class Trace:
    nodes: list[dict] = field(default_factory=list)
    iterations: int = 0
    citations: DataFrame | None = None  # (q_id, citation_count) of the answers
    tables: list[tuple[DataFrame, str]] = field(default_factory=list)  # what stages returned, as written, and where

    def drop_tables(self, *but: DataFrame | None) -> None:
        """Delete what was written, except the tables that are named."""
        kept = [(df, path) for df, path in self.tables if any(df is b for b in but)]
        for df, path in self.tables:
            if not any(path == p for _, p in kept):
                drop(df.sparkSession, path)
        self.tables = kept

    def record(self, node: str, started: float, **detail: Any) -> None:
        self.nodes.append({"node": node, "ms": int((time.perf_counter() - started) * 1000), **detail})

    @property
    def total_ms(self) -> int:
        return sum(n["ms"] for n in self.nodes)


def keep(questions: DataFrame, *_: Any) -> DataFrame:
    """The empty version of rewrite, plan and reflect: what came goes on."""
    return questions


def cut(_: DataFrame, candidates: DataFrame, top_k: int = TOP_K) -> DataFrame:
    """The empty version of fuse: the first ``top_k`` by rank."""
    return candidates.where(F.col("rank") <= top_k)


def enough(*_: Any) -> Verdict:
    return Verdict()


EMPTY = {"rewrite": keep, "plan": keep, "fuse": cut, "gate": enough, "reflect": keep}


def settled(out: Any, trace: Trace) -> Any:
    """``out`` with its table written to the shared folder: a lost executor costs no second call of a provider."""
    if isinstance(out, DataFrame):
        out, path = written(out, "stage")
        trace.tables.append((out, path))
    elif isinstance(out, Verdict) and out.refined is not None:
        out = replace(out, refined=settled(out.refined, trace))
    return out


@dataclass(frozen=True)
class Stages:
    retrieve: Callable[[DataFrame], DataFrame]
    expand: Callable[[DataFrame], DataFrame]
    build_context: Callable[[DataFrame | None, DataFrame], DataFrame]
    generate: Callable[[DataFrame, DataFrame], DataFrame]
    rewrite: Callable[[DataFrame], DataFrame] = keep
    plan: Callable[[DataFrame], DataFrame] = keep
    fuse: Callable[[DataFrame, DataFrame], DataFrame] = cut
    gate: Callable[[DataFrame, DataFrame], Verdict] = enough
    reflect: Callable[[DataFrame, DataFrame], DataFrame] = keep

    def run(self, name: str, trace: Trace, *args: Any) -> Any:
        started = time.perf_counter()
        try:
            out = settled(getattr(self, name)(*args), trace)
        except Exception as e:
            if name not in EMPTY:
                trace.record(name, started, error=f"{type(e).__name__}: {e}")
                raise
            out = settled(EMPTY[name](*args), trace)
            trace.record(name, started, fallback=str(e))
        else:
            trace.record(name, started)
        return out


def ask(questions: DataFrame, stages: Stages, max_iterations: int = 1, trace: Trace | None = None) -> tuple[DataFrame, DataFrame, Trace]:
    """(answers, context, trace) of ``questions(q_id, text, ...)``. Out of iterations it answers with what it has.

    Stages' tables are deleted at the end, but for those that are returned; ``trace.drop_tables()`` deletes these when
    they have been read.
    """
    trace = Trace() if trace is None else trace
    context: DataFrame | None = None
    questions = stages.run("rewrite", trace, questions)
    for iteration in range(1, max_iterations + 1):
        plan = stages.run("plan", trace, questions)
        candidates = stages.run("fuse", trace, questions, stages.run("retrieve", trace, plan))
        context = stages.run("build_context", trace, context, stages.run("expand", trace, candidates))
        verdict = stages.run("gate", trace, questions, context)
        trace.iterations = iteration
        if verdict.sufficient:
            break
        questions = verdict.refined if verdict.refined is not None else questions
    answers = stages.run("reflect", trace, stages.run("generate", trace, questions, context), context)
    trace.citations = citation_counts(answers, context)
    trace.drop_tables(answers, context)
    return answers, context, trace


def citation_counts(answers: DataFrame, context: DataFrame) -> DataFrame | None:
    """``(q_id, citation_count)``: the passages an answer cites, of those it was given."""
    if not {"q_id", "answer"} <= set(answers.columns) or not {"q_id", "ordinal"} <= set(context.columns):
        return None
    cited = answers.select("q_id", F.explode(cited_ordinals(F.col("answer"))).alias("ordinal"))
    there = cited.join(context.select("q_id", F.col("ordinal").cast("long").alias("ordinal")), ["q_id", "ordinal"], "left_semi").groupBy("q_id").agg(F.count("*").alias("n"))
    return answers.join(there, "q_id", "left").select(F.col("q_id").cast("string").alias("q_id"), F.coalesce("n", F.lit(0)).cast("int").alias("citation_count"))


def rewrite_by_feedback(search: Callable[[DataFrame], DataFrame], docs: DataFrame, frequencies: DataFrame, total: int, **sizes: int) -> Callable[[DataFrame], DataFrame]:
    """A rewrite stage: the words that a first ``search`` of the questions suggests are added to them. See ``feedback_terms``."""
    return lambda questions: rewritten(questions, feedback_terms(search(questions), docs, questions, frequencies, total, **sizes))


def gate_by_spread(search: Callable[[DataFrame], DataFrame], rewrite: Callable[[DataFrame], DataFrame], least: float = LEAST_SPREAD) -> Callable[[DataFrame, DataFrame], Verdict]:
    """A gate stage: questions whose scores hardly differ are asked again as ``rewrite`` has them, the others as they are."""

    def gate(questions: DataFrame, _: DataFrame) -> Verdict:
        weak = questions.join(score_spread(search(questions), least).where("sufficient"), "q_id", "left_anti")
        if weak.isEmpty():
            return Verdict()
        return Verdict(False, questions.join(weak.select("q_id"), "q_id", "left_anti").unionByName(rewrite(weak)))

    return gate


#: A retriever gives (q_id, child_id, rank, score, source) for questions.
Retriever = Callable[[DataFrame], DataFrame]


def vector_retriever(children: DataFrame, over_fetch: int = OVER_FETCH, where: Column | None = None, embed: Callable[[DataFrame], DataFrame] | None = None) -> Retriever:
    """Nearest children of ``children(child_id, embedding)``; the filter and the limit come before any join.

    ``embed`` makes vectors of questions that have none (``providers.embed_questions``). Vectors of questions are
    brought to length one here, as those of children are when they are stored.
    """
    corpus = (children if where is None else children.where(where)).select(F.col("child_id").alias("vec_id"), "embedding")

    def search(questions: DataFrame) -> DataFrame:
        asked = questions if embed is None or "embedding" in questions.columns else embed(questions)
        return knn_batch(asked.withColumn("embedding", normalized(F.col("embedding"))), corpus, over_fetch).withColumnRenamed("vec_id", "child_id").withColumn("source", F.lit("vector"))

    return search


def in_language(language: str) -> Column:
    """A filter for ``vector_retriever``: children of one language. Off unless a caller asks for it."""
    return F.col("language") == language


def retrieve_all(retrievers: list[Retriever]) -> Retriever:
    """All candidates of all retrievers, each with its source."""

    def search(questions: DataFrame) -> DataFrame:
        found = [r(questions) for r in retrievers]
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return out

    return search


def fuse_by_rank(top_k: int = TOP_K) -> Callable[[DataFrame, DataFrame], DataFrame]:
    return lambda _, candidates: fuse(candidates, ["q_id"], "child_id", top=top_k)


def expand_with(children: DataFrame, parents: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """Collapse candidates to parents; text and heading are the parent's, the reference stays the child's."""
    held = children.select("child_id", "parent_id", "document_id", "page_number", "content")

    def expand(candidates: DataFrame) -> DataFrame:
        return expand_parents(collapse_to_parents(candidates.join(held, "child_id")), parents)

    return expand


def context_within(budget: int = BUDGET, cost: Callable[[Column], Column] | None = None) -> Callable[[DataFrame | None, DataFrame], DataFrame]:
    """A token budget over the passages' own text; labels of the prompt don't count."""
    from lodestone.functions.text import word_count

    count = cost or word_count

    def build(previous: DataFrame | None, candidates: DataFrame) -> DataFrame:
        fresh = build_context(candidates.withColumn("cost", count(strip(F.col("text")))), ["q_id"], "parent_id", budget, previous)
        return fresh if previous is None else previous.unionByName(fresh, allowMissingColumns=True)

    return build


def with_stage(stages: Stages, **changed: Callable) -> Stages:
    """``stages`` with some replaced by name."""
    return replace(stages, **changed)
