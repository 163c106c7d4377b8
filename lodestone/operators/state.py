"""Folds over event logs: stage machine, token buckets, progress, outages, traces."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAGES = ("PARSING", "STRUCTURING", "ENRICHING", "EMBEDDING", "PERSISTING")
MAX_ATTEMPTS, STALLED_AFTER_S, MAX_BACKOFF_S, OUTAGE_LIMIT_S = 3, 600, 300, 1800


def fold_stages(events: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Where each document stands after ``events(document_id, seq, stage, outcome, error)``.

    Outcomes are ok, transient, permanent and deferred. Transient failures count attempts and the last allowed one
    dead-letters; a permanent one dead-letters at once and counts none; a deferral changes nothing. What comes after
    a dead letter is ignored. Running counts over a window, so a log of any length is never one value.
    """
    order = Window.partitionBy("document_id").orderBy("seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    outcome = F.col("outcome")
    counted = events.withColumn("attempts", F.count_if(outcome == "transient").over(upto))
    dead = (outcome == "permanent") | ((outcome == "transient") & (F.col("attempts") >= max_attempts))
    marked = counted.withColumn("dead", dead).withColumn("over", F.coalesce(F.max(F.col("dead").cast("int")).over(before), F.lit(0)))
    live = marked.where("over = 0 AND outcome <> 'deferred'")
    failed = outcome.isin("transient", "permanent")
    last = live.groupBy("document_id").agg(
        F.max_by(F.struct("outcome", "stage", "dead"), "seq").alias("last"), F.count_if(outcome == "transient").alias("attempts"),
        F.max_by("stage", F.when(outcome == "ok", F.col("seq"))).alias("stage"),
        F.max_by("stage", F.when(failed, F.col("seq"))).alias("failed_stage"), F.max_by("error", F.when(failed, F.col("seq"))).alias("last_error"),
    )
    status = F.when(F.col("last.dead"), "DEAD_LETTER").when(F.col("last.outcome") != "ok", "RETRYING").when(F.col("last.stage") == STAGES[-1], "COMPLETED").otherwise(F.col("last.stage"))
    return last.select("document_id", status.alias("status"), "stage", "attempts", "failed_stage", "last_error")


def may_reopen(status: Column, force: bool = False) -> Column:
    """Whether a document may be run again: it is at rest, or the caller insists."""
    return F.lit(True) if force else status.isin("COMPLETED", "DEAD_LETTER")


@dataclass
class Bucket:
    """A token bucket as of its last request."""

    tokens: float
    at_ms: int

    def take(self, at_ms: int, tokens: int, capacity: int, refill: float) -> tuple[bool, int]:
        """Whether the request passes, and how many ms until it could; -1 if it never can."""
        if tokens > capacity:
            return False, -1
        # A clock that goes back adds nothing and takes nothing.
        self.tokens = min(capacity, self.tokens + max(0, at_ms - self.at_ms) * refill / 1000)
        self.at_ms = at_ms
        if self.tokens >= tokens:
            self.tokens -= tokens
            return True, 0
        return False, -1 if refill <= 0 else int(-((self.tokens - tokens) * 1000 // refill))


def token_bucket(requests: DataFrame) -> DataFrame:
    """``allowed`` and ``wait_ms`` of each of ``requests(key, seq, at_ms, tokens, capacity, refill_per_sec)``.

    A bucket starts full. Rows are dealt by key and sorted, then streamed through: a key's log is never held at once.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, bucket = None, Bucket(0, 0)
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if key is None or r.key != key:
                    key, bucket = r.key, Bucket(r.capacity, r.at_ms)
                out.append((r.key, r.seq, *bucket.take(r.at_ms, r.tokens, r.capacity, r.refill_per_sec)))
            yield pd.DataFrame(out, columns=["key", "seq", "allowed", "wait_ms"])

    dealt = requests.select("key", "seq", "at_ms", "tokens", "capacity", "refill_per_sec").repartition("key").sortWithinPartitions("key", "seq")
    return dealt.mapInPandas(run, "key string, seq long, allowed boolean, wait_ms long")


def backoff_seconds(retries: Column, most: int = MAX_BACKOFF_S) -> Column:
    return F.least(F.pow(F.lit(2.0), retries), F.lit(float(most))).cast("long")


def stalled(events: DataFrame, key: str, ts: str, after: int = STALLED_AFTER_S) -> DataFrame:
    """The silences of each key longer than ``after`` seconds: when it began, when it ended, how long it was."""
    previous = F.lag(ts).over(Window.partitionBy(key).orderBy(ts, "event_id"))
    gaps = events.withColumn("since", previous).withColumn("gap_s", F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.col("since").cast("timestamp")))
    return gaps.where(F.col("gap_s") > after).select(key, "since", F.col(ts).alias("until"), "gap_s")


def stalled_at(at: Column, now: Column, after: int = STALLED_AFTER_S) -> Column:
    """Whether progress reported ``at`` has gone silent by ``now``; both in seconds."""
    return (now - at) > after


def report_progress(progress: DataFrame, reports: DataFrame) -> DataFrame:
    """``progress(document_id, stage, done, total, at)`` after ``reports``: the last of each document counts, done never above total."""
    last = reports.groupBy("document_id").agg(F.max_by(F.struct("stage", "done", "total", "at"), F.struct("at", "done")).alias("r")).select("document_id", "r.*")
    held = progress.join(last.select("document_id"), "document_id", "left_anti").unionByName(last)
    return held.withColumn("done", F.least("done", "total"))


def clear_progress(progress: DataFrame, ended: DataFrame) -> DataFrame:
    """Progress without the documents in ``ended``."""
    return progress.join(ended.select("document_id"), "document_id", "left_anti")


def stage_counts(chunks: DataFrame, done: DataFrame, stage: str) -> DataFrame:
    """``(document_id, stage, done, total)`` of a stage that works chunk by chunk: what is finished and what there is."""
    finished = done.groupBy("document_id").agg(F.count("*").alias("done"))
    total = chunks.groupBy("document_id").agg(F.count("*").alias("total")).join(finished, "document_id", "left")
    return total.select("document_id", F.lit(stage).alias("stage"), F.coalesce("done", F.lit(0)).cast("long").alias("done"), "total")


def outages(events: DataFrame, limit: int = OUTAGE_LIMIT_S) -> DataFrame:
    """Outages of each ``events(key, seq, at_s, ok)``: the first failure starts one, a success ends it.

    ``failed``: it lasted past ``limit`` seconds, so its failures count as the document's own.
    """
    island = F.count_if(F.col("ok")).over(Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    down = events.withColumn("_island", island).where(~F.col("ok"))
    runs = down.groupBy("key", "_island").agg(F.min("at_s").alias("began"), F.max("at_s").alias("last"), F.count("*").alias("failures"))
    return runs.select("key", "began", "last", "failures", (F.col("last") - F.col("began") > limit).alias("failed"))


def traces(nodes: DataFrame) -> DataFrame:
    """A row for each question of ``nodes(q_id, seq, node, ms)``: total time and the nodes in order, as JSON."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "node", "ms"))), lambda n: F.struct(n["node"].alias("node"), n["ms"].alias("ms")))
    return nodes.groupBy("q_id").agg(F.sum("ms").cast("long").alias("total_ms"), F.to_json(listed).alias("nodes"))
