"""Progress of runs at a bearable pace: batches are merged, and the last value of a run always gets through."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Fixed value: the least time between two values of a run that is not at its end.
EVERY_MS = 120


class ThrottledProgress(StreamingQueryListener):
    """Hands `emit` the progress (run, seq, total, done, failed) of runs, newest of a batch only, and of a run not more
    often than every_ms unless it is at its end. What is held back comes with a later batch, at the latest when the query
    ends, however it ends.

    The driver holds a row for each run that is under way.
    """

    def __init__(self, emit: Callable[[Row], None], every_ms: int = EVERY_MS, clock: Callable[[], float] = lambda: time.monotonic() * 1000):
        self.emit, self.every, self.clock = emit, every_ms, clock
        self.last: dict[str, float] = {}
        self.held: dict[str, Row] = {}
        self.ids: set[str] = set()
        self.lock = threading.Lock()

    def start(self, stream: DataFrame, checkpoint: str, **trigger: object) -> StreamingQuery:
        stream.sparkSession.streams.addListener(self)
        query = stream.writeStream.foreachBatch(self.merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": f"{self.every} milliseconds"})).start()
        self.ids.add(str(query.id))
        return query

    def merge(self, rows: DataFrame, batch: int) -> None:
        newest = rows.groupBy("run").agg(F.max_by(F.struct("run", "seq", "total", "done", "failed"), "seq").alias("r")).select("r.*").collect()  # a row a run
        with self.lock:
            for r in newest:
                if r.run not in self.held or self.held[r.run].seq < r.seq:
                    self.held[r.run] = r
            now = self.clock()
            for run, r in list(self.held.items()):
                ended = r.done + r.failed >= r.total
                if ended or now - self.last.get(run, float("-inf")) >= self.every:
                    self._out(run, now)
                    if ended:
                        self.last.pop(run, None)

    def _out(self, run: str, now: float) -> None:
        self.last[run] = now
        self.emit(self.held.pop(run))

    def flush(self) -> None:
        with self.lock:
            for run in list(self.held):
                self._out(run, self.clock())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) in self.ids:
            self.flush()
