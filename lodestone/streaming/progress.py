"""Progress as it comes in: what is running, what has fallen silent, what is forgotten. State is a row a document, timers do the rest."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.operators.state import STALLED_AFTER_S
from lodestone.streaming.arrivals import as_event_time

#: Seconds without a report after which a document's progress is forgotten.
FORGOTTEN_AFTER_S = 3600
HELD = "stage string, done long, total long, at_ms long"
SEEN = "document_id string, stage string, done long, total long, state string, at timestamp"
RUNNING, STALLED, FORGOTTEN = "RUNNING", "STALLED", "FORGOTTEN"


class ProgressWatch(StatefulProcessor):
    """Per document the last report; a timer that is put off by each report tells of silence, a later one ends the state."""

    def __init__(self, stalled_after_s: int, forgotten_after_s: int):
        self.stalled_ms, self.forgotten_ms = stalled_after_s * 1000, forgotten_after_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", HELD)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = pd.concat(rows).sort_values(["at_ms", "done"]).iloc[-1]
        held = self.last.get() if self.last.exists() else None
        if held is not None and held[3] > newest["at_ms"]:
            return
        if held is not None:
            self._forget_timers(held[3])
        at = int(newest["at_ms"])
        self.last.update((newest["stage"], int(newest["done"]), int(newest["total"]), at))
        self.handle.registerTimer(at + self.stalled_ms)
        yield self._row(key, RUNNING, at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.last.get()[3]
        fired = expiredTimerInfo.getExpiryTimeInMs()
        if fired == at + self.stalled_ms:
            self.handle.registerTimer(at + self.forgotten_ms)
            yield self._row(key, STALLED, fired)
        else:
            yield self._row(key, FORGOTTEN, fired)
            self.last.clear()

    def _forget_timers(self, at: int) -> None:
        for due in (at + self.stalled_ms, at + self.forgotten_ms):
            self.handle.deleteTimer(due)

    def _row(self, key, state: str, at_ms: int) -> pd.DataFrame:
        stage, done, total, _ = self.last.get()
        return pd.DataFrame({"document_id": [key[0]], "stage": [stage], "done": [done], "total": [total], "state": [state], "at": [pd.Timestamp(at_ms, unit="ms")]})

    def close(self) -> None:
        pass


def watch_progress(reports: DataFrame, ts: str = "at", late: str = "1 minute", stalled_after_s: int = STALLED_AFTER_S, forgotten_after_s: int = FORGOTTEN_AFTER_S) -> DataFrame:
    """``SEEN`` of a stream of ``reports(document_id, stage, done, total, at)``: each batch's last report of a document, and its silences as the watermark passes them."""
    timed = as_event_time(reports, ts).withWatermark(ts, late)
    slim = timed.select("document_id", "stage", F.col("done").cast("long").alias("done"), F.col("total").cast("long").alias("total"), F.unix_millis(ts).alias("at_ms"), ts)
    return slim.groupBy("document_id").transformWithStateInPandas(ProgressWatch(stalled_after_s, forgotten_after_s), SEEN, "Append", "EventTime")
