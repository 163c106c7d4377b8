"""Documents as they arrive: each file once, progress that falls silent, the stage machine as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.state import MAX_ATTEMPTS, STAGES, STALLED_AFTER_S


def as_event_time(rows: DataFrame, column: str) -> DataFrame:
    """Timestamps without a zone can't carry a watermark; they are read in the session's zone."""
    return rows.withColumn(column, F.col(column).cast("timestamp"))


def first_arrivals(arrivals: DataFrame, key: str = "sha256", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once: what makes a file's pipeline start once. State is kept for ``late``."""
    return as_event_time(arrivals, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def progress_sessions(events: DataFrame, key: str, ts: str = "ts", gap_s: int = STALLED_AFTER_S, late: str = "10 minutes") -> DataFrame:
    """Runs of progress without a silence longer than ``gap_s``: (key, start, end, n)."""
    timed = as_event_time(events, ts).withWatermark(ts, late)
    runs = timed.groupBy(F.session_window(ts, f"{gap_s} seconds").alias("w"), key).agg(F.count("*").alias("n"))
    return runs.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


STATE = "status string, stage string, attempts int, failed_stage string, last_error string"


def step(state: tuple, stage: str, outcome: str, error: str | None, max_attempts: int = MAX_ATTEMPTS) -> tuple:
    """The state after an event; a dead letter stays one, a deferral changes nothing."""
    status, done, attempts, failed, last = state
    if status == "DEAD_LETTER" or outcome == "deferred":
        return state
    if outcome == "ok":
        return ("COMPLETED" if stage == STAGES[-1] else stage, stage, attempts, failed, last)
    attempts += outcome == "transient"
    dead = outcome == "permanent" or attempts >= max_attempts
    return ("DEAD_LETTER" if dead else "RETRYING", done, attempts, stage, error)


class StageMachine(StatefulProcessor):
    """Per document: status, stage, attempts, last failure."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else ("QUEUED", None, 0, None, None)
        for r in pd.concat(rows).sort_values("seq").itertuples(index=False):
            state = step(state, r.stage, r.outcome, r.error)
        self.state.update(state)
        yield pd.DataFrame([(key[0], *state)], columns=["document_id", *(c.split()[0] for c in STATE.split(", "))])

    def close(self) -> None:
        pass


def stage_states(events: DataFrame) -> DataFrame:
    """The state of each document that a micro-batch's ``events(document_id, seq, stage, outcome, error)`` touch."""
    return events.groupBy("document_id").transformWithStateInPandas(StageMachine(), f"document_id string, {STATE}", "Update", "None")
