"""Streams: pages in any order, restoring after a calm, subscriptions, progress at a bearable pace."""

import datetime
import time

from pyspark.sql import functions as F

from quirespark.operators.changelog import ChangeLog
from quirespark.streaming import feed, pages, restore
from quirespark.streaming.progress import ThrottledProgress

PAGES = "doc_id long, page_index int, heads boolean, closes boolean, width double, tail string, head string, head_plain boolean"
EVENTS = "doc_id long, event string, id string, key string, at timestamp"


def page(doc, k, tail=None, head=None, plain=True, heads=False, closes=False, width=1.0):
    return (doc, k, heads, closes, width, tail, head, plain)


def written(spark, folder, kind, *batches):
    """A file for each batch, in order."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05 if k else 0)
    return spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(folder)


def test_pages_in_any_order_carry_the_tail(spark, tmp_path):
    stream = written(
        spark, str(tmp_path / "in"), PAGES,
        [page(1, 2, "third ends.", "and goes on", width=2.0), page(2, 0, "ends.", "start")],
        [page(1, 0, "first is open", "start", heads=True, width=5.0), page(1, 3, None, "no more")],
        [page(1, 1, "second goes", "and so", closes=True), page(2, 1, "x", "next", False), page(1, 0, "again", "again")],
    )
    out = pages.run_available(pages.ordered_pages(stream), f"file://{tmp_path}/out").collect()
    got = {(r.doc_id, r.page_index): (r.in_references, r.width_so_far, r.tail_before) for r in out}
    assert got == {
        (1, 0): (True, 5.0, None), (1, 1): (False, 5.0, "first is open"), (1, 2): (False, 5.0, "second goes"), (1, 3): (False, 5.0, "third ends."),
        (2, 0): (False, 1.0, None), (2, 1): (False, 1.0, "ends."),
    }
    on = pages.going_on(spark.createDataFrame(out, pages.STATES))
    assert sorted((r.doc_id, r.page_index) for r in on.collect()) == [(1, 1), (1, 2)]


def test_a_page_that_never_comes_is_passed_over(spark, tmp_path):
    folder = str(tmp_path / "in")
    stream = written(spark, folder, PAGES, [page(1, 0, "open", "x"), page(1, 2, "t", "goes on"), page(1, 3, "u", "v")])
    with pages.keyed_state(spark):
        query = pages.ordered_pages(stream, patience_ms=500).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("late").count() < 3:
            time.sleep(0.3)
        got = [(r.page_index, r.tail_before) for r in spark.table("late").orderBy("page_index").collect()]
    finally:
        query.stop()
    assert got == [(0, None), (2, None), (3, "t")]


def at(ms):
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(milliseconds=ms)


def test_restore_waits_for_calm_and_tries_once(spark, tmp_path):
    event = lambda doc, what, ident, ms: (doc, what, ident, f"k{ident}", at(ms))
    stream = written(
        spark, str(tmp_path / "in"), EVENTS,
        [event(1, "register", "a", 0), event(1, "register", "b", 250), event(2, "register", "x", 0), event(2, "clear", None, 10)],
        [event(1, "register", "c", 500), event(2, "register", "y", 500), event(3, "register", "m", 500)],  # 500 < 250 + 300, so calm has not come
        [event(3, "reset", None, 700), event(9, "register", "clock", 1500)],
        [event(1, "register", "a", 1600), event(1, "register", "d", 1700), event(2, "reset", None, 1700), event(2, "register", "z", 1750), event(9, "register", "clock", 2500)],
        [event(9, "register", "clock", 9000)],
        [event(9, "register", "clock", 9001)],
    )
    due = restore.due_for_restore(stream.withWatermark("at", "0 seconds"), by_event=True)
    got = pages.run_available(due, f"file://{tmp_path}/out").where("doc_id < 9")
    assert sorted((r.doc_id, r.id, r.key) for r in got.collect()) == [(1, "a", "ka"), (1, "b", "kb"), (1, "c", "kc"), (1, "d", "kd"), (2, "z", "kz")]
    cache = ChangeLog(spark, str(tmp_path / "cache"), ["key"], ["at"], buckets=2)
    cache.append(spark.createDataFrame([("ka", "A", 1), ("kq", "Q", 1)], "key string, text string, at long"), "1")
    assert [tuple(r) for r in restore.found(got, cache).collect()] == [(1, "a", "A")]


def test_only_subscribed_keys_that_changed_are_told(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "t"), ["id"], ["at"], buckets=2)
    put = lambda name, *rows: log.append(spark.createDataFrame(list(rows), "id string, text string, at long, change string"), name)
    put("1", ("a", "A", 1, "own"), ("b", "B", 1, "own"), ("c", "C", 1, "own"), ("n", None, 1, "own"))
    put("2", ("a", "A2", 2, "own"), ("b", "B", 2, "own"), ("d", "D", 2, "own"), ("n", "N", 2, "own"))
    log.append(spark.createDataFrame([("c", 3)], "id string, at long"), "3", gone=True)
    new = feed.changed(log, 1)
    assert {(r.id, r.text, r.change_) for r in new.collect()} == {("a", "A2", "changed"), ("c", None, "removed"), ("d", "D", "added"), ("n", "N", "changed")}
    subs = spark.createDataFrame([("s", "a"), ("s", "a"), ("s", "b"), ("t", "d"), ("t", "c")], "subscriber string, id string")
    assert sorted((r.subscriber, r.id) for r in feed.notified(new, subs, ["id"]).collect()) == [("s", "a"), ("t", "c"), ("t", "d")]
    assert feed.changed(log, 3).count() == 0 and feed.changed(log, 0, 1).count() == 4


def test_progress_is_thinned_and_the_last_value_comes(spark, tmp_path):
    kind = "run string, seq long, total long, done long, failed long"
    stream = written(
        spark, str(tmp_path / "in"), kind,
        [("a", 1, 9, 1, 0), ("a", 2, 9, 2, 0), ("b", 1, 2, 0, 0)], [("a", 3, 9, 3, 0), ("b", 2, 2, 1, 1)], [("a", 4, 9, 4, 0)], [("a", 5, 9, 5, 1)],
    )
    told, now = [], [0.0]

    def clock():
        now[0] += 30  # a batch asks once
        return now[0]

    own = ThrottledProgress(told.append, clock=clock)
    query = own.start(stream, str(tmp_path / "c"), availableNow=True)
    query.awaitTermination()
    until = time.time() + 20
    while own.held and time.time() < until:
        time.sleep(0.1)
    spark.streams.removeListener(own)
    # a: first at once, the last when the query ends, before 120 ms are over; b is at its end 30 ms after its first
    assert [(r.run, r.done + r.failed) for r in told if r.run == "a"] == [("a", 2), ("a", 6)] and [(r.run, r.done + r.failed) for r in told if r.run == "b"] == [("b", 0), ("b", 2)]
