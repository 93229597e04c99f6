"""One translation run, from cache to port to cache: what is cached never reaches the port, every key is asked once.

Requests of one key (source and settings) are one question. Answers are kept one file a key, in the run's journal, as soon
as they are there: a task that is tried again, or a run of that name that is started again, finds them and asks for the
rest alone. A cancelled run keeps what is answered. At its end the answers go to the cache as one batch of the run's name,
which no repetition writes twice.

The journal is written by tasks, through Arrow's file systems: it has to be a URI that they reach, such as a shared folder.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .changelog import ChangeLog
from .enrich import Translator, wait_ms
from .library import keep_recent
from .settled import settled
from .store import MAX_ENTRIES, MAX_ENTRY, run_status

OUTCOME = "key string, state string, text string, error_kind string, attempts int"


class Busy(RuntimeError):
    """Another run has the journal."""


def asked(port: Translator, key: str, source: str, attempts: int, base_ms: float, sleep: Callable[[float], None]) -> dict | None:
    """The outcome of one question; none if the port cancelled it.

    Errors with a `kind` are the port's own and outcomes, those of input and output count as `network`; any other is a
    fault of the program and ends the task. Kinds worth it are tried again; an outcome without text reports all attempts.
    """
    kind = None
    for used in range(1, attempts + 1):
        try:
            return {"key": key, "state": "done", "text": port.translate(source), "error_kind": None, "attempts": used}
        except Exception as e:
            kind = getattr(e, "kind", "network" if isinstance(e, OSError) else None)
            if kind is None:
                raise
            if kind == "aborted":
                return None
            if kind not in X.RETRYABLE or used == attempts:
                break
            sleep(wait_ms(key, used, getattr(e, "retry_after_ms", None), base_ms) / 1000)
    return {"key": key, "state": "failed", "text": None, "error_kind": kind, "attempts": attempts}


def _journalled(batches: Iterator[pd.DataFrame], uri: str, port: Callable[[], Translator], attempts: int, base_ms: float, sleep: Callable[[float], None]) -> Iterator[pd.DataFrame]:
    from pyarrow import fs

    files, root = fs.FileSystem.from_uri(uri)
    own = None
    for batch in batches:
        for key, source in zip(batch["key"], batch["source"], strict=True):
            digest = hashlib.sha1(key.encode()).hexdigest()
            folder, name = f"{root}/{digest[:2]}", f"{root}/{digest[:2]}/{digest}.json"
            if files.get_file_info(name).type == fs.FileType.File:
                continue
            own = own or port()
            outcome = asked(own, key, source, attempts, base_ms, sleep)
            if outcome is None:
                continue
            files.create_dir(folder, recursive=True)
            with files.open_output_stream(f"{name}.draft") as out:
                out.write(json.dumps(outcome).encode())
            files.move(f"{name}.draft", name)
        yield batch[["key"]].iloc[:0]


class TranslationRun:
    """A run of a name over `cache`, a change log with key, text and at.

    `port` makes each task's translator. `concurrency` tasks ask at once at most. Another thread may cancel().
    """

    def __init__(
        self, cache: ChangeLog, name: str, port: Callable[[], Translator], journal: str, provider: str = "mock", model: str = "m", language: str = "zh", prompt: int = 1,
        attempts: int = 3, base_ms: float = 800.0, concurrency: int = 8, sleep: Callable[[float], None] = time.sleep,
    ):
        self.cache, self.name, self.port, self.sleep = cache, name, port, sleep
        self.settings = (provider, model, language, prompt)
        self.attempts, self.base_ms, self.concurrency = attempts, base_ms, concurrency
        self.journal = f"{journal.rstrip('/')}/{name}" if urlsplit(journal).scheme else f"file://{journal.rstrip('/')}/{name}"
        self.tag = f"translation-{name}"
        self.stopped = threading.Event()

    def cancel(self) -> None:
        """Stops the run's jobs, those that run and those that would begin."""
        self.stopped.set()
        self.cache.spark.sparkContext.cancelJobsWithTag(self.tag)

    def _held(self, path: str):
        context = self.cache.spark.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(context._jsc.hadoopConfiguration()), path

    def _ask(self, misses: DataFrame) -> None:
        uri, port, attempts, base_ms, sleep = self.journal, self.port, self.attempts, self.base_ms, self.sleep
        run = lambda batches: _journalled(batches, uri, port, attempts, base_ms, sleep)
        context = misses.sparkSession.sparkContext
        context.addJobTag(self.tag)
        try:
            if not self.stopped.is_set():
                # by key, so that a task that is tried again has the same keys
                misses.repartition(self.concurrency, "key").mapInPandas(run, "key string").write.format("noop").mode("overwrite").save()
        except Exception:
            if not self.stopped.is_set():
                raise
        finally:
            context.removeJobTag(self.tag)

    def run(self, requests: DataFrame, now_ms: int, resume: bool = False) -> tuple[DataFrame, DataFrame]:
        """Statuses (id, state, text, warning, error_kind, attempts) of requests (id, source), and the run's one row of
        counts with its status.

        States are `cached`, `done`, `failed` and `cancelled`. Of equal questions the one of the smallest id is `done`,
        the others find it in the cache; a question that fails fails for all. A source of null is asked as empty. Counts
        are the scheduler's: `done` has the cached ones too, the hit rate is theirs among all. With `resume` the journal
        of a run that died is taken over, else Busy is raised.
        """
        spark = requests.sparkSession
        files, lock = self._held(f"{self.journal}.lock")
        if not files.createNewFile(lock) and not resume:
            raise Busy(f"{lock} is there: the run is on, or take it over with resume")
        try:
            files.mkdirs(self._held(self.journal)[1])
            source = F.coalesce("source", F.lit(""))
            keyed = settled(requests.select(F.col("id").cast("string").alias("id"), source.alias("source")).withColumn("key", X.cache_key(*self.settings, F.col("source"))))
            empty = spark.createDataFrame([], "key string, hit string")
            hits = settled(self.cache.state().select("key", F.col("text").alias("hit")).join(keyed.select("key"), "key", "left_semi") if self.cache.exists() else empty)
            misses = keyed.join(hits, "key", "left_anti").groupBy("key").agg(F.min("source").alias("source"), F.min("id").alias("first"))
            misses = settled(misses)
            self._ask(misses.select("key", "source"))
            outcomes = spark.read.schema(OUTCOME).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").json(self.journal)
            outcomes = settled(outcomes.join(misses.select("key", "first"), "key"))
            answers = outcomes.where((F.col("state") == "done") & (F.length("text") <= MAX_ENTRY))
            if not self.stopped.is_set() or answers.limit(1).count():
                self.cache.append(answers.select("key", "text", F.lit(now_ms).cast("long").alias("at")), f"{self.name}-{now_ms}")
            statuses = self._statuses(keyed, hits, outcomes)
            return statuses, self.counts(statuses)
        finally:
            files.delete(lock, False)

    def _statuses(self, keyed: DataFrame, hits: DataFrame, outcomes: DataFrame) -> DataFrame:
        out = keyed.join(hits, "key", "left").join(outcomes.withColumnRenamed("text", "answer").withColumnRenamed("state", "outcome"), "key", "left")
        hit, again = F.col("hit").isNotNull(), (F.col("outcome") == "done") & (F.col("id") != F.col("first"))
        state = F.when(hit | again, "cached").otherwise(F.coalesce("outcome", F.lit("cancelled")))
        used = F.when(state == "cached", 0).otherwise(F.coalesce("attempts", F.lit(self.attempts)))
        return out.select(
            "id", state.alias("state"), F.coalesce("hit", "answer").alias("text"), F.when(state == "done", X.quality_warning(F.col("source"), F.col("answer"))).alias("warning"),
            F.when(state == "cancelled", "aborted").otherwise(F.when(~hit, F.col("error_kind"))).alias("error_kind"), used.cast("int").alias("attempts"),
        )

    @staticmethod
    def counts(statuses: DataFrame) -> DataFrame:
        """(total, done, cached, failed, cancelled, hit_rate, status), one row."""
        some = lambda *s: F.count_if(F.col("state").isin(*s))
        out = statuses.agg(F.count("*").alias("total"), some("done", "cached").alias("done"), some("cached").alias("cached"), some("failed").alias("failed"), some("cancelled").alias("cancelled"))
        rate = F.when(F.col("total") > 0, F.col("cached") / F.col("total")).otherwise(0.0)
        return run_status(out.withColumn("hit_rate", rate))


def start(run: TranslationRun, sources: DataFrame, translations: DataFrame, now_ms: int, resume: bool = False) -> tuple[DataFrame, DataFrame]:
    """Translates the registered sources (id, source) without a translation (id, text); returns the translations with the
    new ones, and the counts. Of an id the translation that is there stays."""
    statuses, counts = run.run(sources.join(translations.select("id"), "id", "left_anti"), now_ms, resume)
    fresh = settled(statuses).where(F.col("state").isin("done", "cached")).select("id", "text")
    return translations.select("id", "text").unionByName(fresh), counts


def evict(cache: ChangeLog, now_ms: int, limit: int = MAX_ENTRIES) -> bool:
    """Takes all but the `limit` newest entries out of the cache, of equal times those of smaller keys stay; False if
    that is done already under this time."""
    state = cache.state().select("key", "at")
    kept = keep_recent(state, limit).select("key")
    gone = state.join(kept, "key", "left_anti").select("key", F.lit(now_ms).cast("long").alias("at"))
    return cache.append(gone, f"evict-{now_ms}", gone=True)
