"""Streams: idempotent registration, and pages that carry state from one to the next."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..operators.settled import shared_folder

PAGE = "heads boolean, closes boolean, width double, tail string, head string, head_plain boolean"
STATES = "doc_id long, page_index int, in_references boolean, width_so_far double, tail_before string, head string, head_plain boolean"
#: Early pages of a batch that are held at once, and what is left before the first page.
EARLY, NOTHING = 256, (0, False, 0.0, None)
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries that start within keep their state in RocksDB, which states of many keys and timers need."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def register(stream: DataFrame) -> DataFrame:
    """First write of an id wins; blank sources are skipped."""
    return stream.where("trim(source) <> ''").dropDuplicates(["id"])


class PageOrder(StatefulProcessor):
    """Hands on a document's pages in order: early ones wait in a map by page, and what a page leaves to the next is one
    value. With patience, a page that does not come for so long after the last that did is passed over."""

    def __init__(self, patience_ms: int | None):
        self.patience = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "page_index int", PAGE)
        self.left = handle.getValueState("left", "following int, open boolean, width double, tail string")

    def _ready(self, key: tuple, left: tuple, early: dict, stored: bool) -> Iterator[Row]:
        """The pages that are next, from `early` or the store; returns what they leave."""
        following, open_, width, tail = left
        while True:
            if following in early:
                page = early.pop(following)
            elif stored and self.waiting.containsKey((following,)):
                page = self.waiting.getValue((following,))
                self.waiting.removeKey((following,))
            else:
                return following, open_, width, tail
            heads, closes, own, last, head, plain = page
            open_ = heads or (open_ and not closes)
            width = max(width, own)
            yield Row(doc_id=key[0], page_index=following, in_references=open_, width_so_far=width, tail_before=tail, head=head, head_plain=plain)
            tail, following = last, following + 1

    def _keep(self, early: dict) -> None:
        for page in [*early]:
            self.waiting.updateValue((page,), early.pop(page))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # the store is another process, so a page that comes in its turn, or a little early, never goes there
        left, stored, early = self.left.get() or NOTHING, self.waiting.exists(), {}
        for r in rows:
            page = r.page_index
            if page < left[0] or page in early or (stored and self.waiting.containsKey((page,))):
                continue
            early[page] = (bool(r.heads), bool(r.closes), float(r.width or 0.0), r.tail, r.head, bool(r.head_plain))
            if page == left[0]:
                left = yield from self._ready(key, left, early, stored)
            elif len(early) > EARLY:
                self._keep(early)
                stored = True
        self._keep(early)
        left = yield from self._ready(key, left, early, stored)
        self.left.update(left)
        if self.patience is not None:
            self._wait(timerValues)

    def _wait(self, timerValues) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if self.waiting.exists():
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        early = [k[0] for k in self.waiting.keys()]
        if not early:
            return
        _, open_, width, _ = self.left.get() or NOTHING
        # the page before is not there, so no paragraph goes on from it
        left = yield from self._ready(key, (min(early), open_, width, None), {}, True)
        self.left.update(left)
        self._wait(timerValues)

    def close(self) -> None:
        pass


def ordered_pages(stream: DataFrame, patience_ms: int | None = None) -> DataFrame:
    """Per document, from pages (doc_id, page_index, heads, closes, width, tail, head, head_plain) that may come in any
    order: whether a reference section is open after each page, the widest page so far, and the tail of the paragraph
    that the page before may leave open. Pages wait until all before them have come, or with patience_ms (processing
    time) until that long after the last arrival. A page that comes twice counts once. Start it within keyed_state.

    What a document keeps is its waiting pages, each an entry of its own, and four values.
    """
    rows = stream.select("doc_id", "page_index", "heads", "closes", "width", "tail", "head", "head_plain")
    mode = "None" if patience_ms is None else "ProcessingTime"
    return rows.groupBy("doc_id").transformWithState(PageOrder(patience_ms), STATES, "Append", mode)


def going_on(pages: DataFrame) -> DataFrame:
    """Of ordered pages those whose first paragraph goes on from the page before."""
    hit = F.col("head_plain") & F.rtrim("tail_before").rlike(X.OPEN_END) & F.ltrim("head").rlike(X.CONTINUES)
    return pages.where(hit).select("doc_id", "page_index", F.length("tail_before").cast("long").alias("tail_chars"), F.length("head").cast("long").alias("head_chars"))


def run_available(stream: DataFrame, scratch: str | None = None) -> DataFrame:
    """Runs a stream over what is there and returns its output as a table; scratch must be a shared folder on a cluster.

    The folder is removed when the session ends.
    """
    spark = stream.sparkSession
    base = scratch or shared_folder(spark)
    path = f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    with keyed_state(spark):
        query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")
