"""Restoring translations from the cache once registrations have calmed down: timers in keyed state."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.changelog import ChangeLog

#: Fixed value: how long no registration may come before the cache is asked.
CALM_MS = 300
#: What an event may be: a source that is registered, translations that a user clears, a document that is opened anew.
EVENTS = ("register", "clear", "reset")
DUE = "doc_id long, id string, key string"


class Restorer(StatefulProcessor):
    def __init__(self, calm_ms: int, by_event: bool):
        self.calm, self.by_event = calm_ms, by_event

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getMapState("pending", "id string", "key string")
        self.tried = handle.getMapState("tried", "id string", "yes boolean")
        self.held = handle.getValueState("held", "suppressed boolean")

    def _suppressed(self) -> bool:
        return bool(self.held.exists() and self.held.get()[0])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        due, latest = None, None
        for r in sorted(rows, key=lambda r: (r.at_ms, EVENTS.index(r.event), r.id or "")):
            latest = r.at_ms
            if r.event == "register":
                if not self.tried.containsKey((r.id,)) and not self.pending.containsKey((r.id,)):
                    self.pending.updateValue((r.id,), (r.key,))
                    due = latest
            else:  # who clears wants new translations, so the cache stays out until the document is opened anew
                self.tried.clear()
                if r.event == "reset":
                    self.pending.clear()
                self.held.update((r.event == "clear",))
                due = None
        if due is not None and not self._suppressed():
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            now = due if self.by_event else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(now + self.calm)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self._suppressed():
            return
        for (ident,), (cache_key,) in list(self.pending.iterator()):
            self.pending.removeKey((ident,))
            self.tried.updateValue((ident,), (True,))
            yield Row(doc_id=key[0], id=ident, key=cache_key)

    def close(self) -> None:
        pass


def due_for_restore(stream: DataFrame, calm_ms: int = CALM_MS, by_event: bool = False) -> DataFrame:
    """(doc_id, id, key) that the cache is to be asked for, from events (doc_id, event, id, key, at): each id once, when no
    registration of its document has come for calm_ms.

    Time is the cluster's clock, or with `by_event` that of the events, of which the stream needs a watermark on `at`.
    `clear` suppresses restoring and forgets what has been tried, `reset` forgets everything. Start it within keyed_state.
    """
    rows = stream.select("doc_id", "event", "id", "key", "at", F.unix_millis("at").alias("at_ms")).where(F.col("event").isin(*EVENTS))
    return rows.groupBy("doc_id").transformWithState(Restorer(calm_ms, by_event), DUE, "Append", "EventTime" if by_event else "ProcessingTime")


def found(due: DataFrame, cache: ChangeLog) -> DataFrame:
    """(doc_id, id, text) of those that the cache has now; for a batch, such as foreachBatch gives."""
    return due.join(cache.state().select("key", "text"), "key").select("doc_id", "id", "text")
