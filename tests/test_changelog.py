"""The stored change log: batches, versions, tombstones, compaction, replays and writers that meet."""

import threading

import pytest
from pyspark.sql import functions as F

from quirespark.operators.changelog import BUCKET, ChangeLog

ROWS = "id string, title string, seq long, k long"


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def held(df):
    return sorted((r.id, r.title, r.k) for r in df.collect())


def test_write_reread_compact_and_replay(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "papers"), ["id"], ["seq"], buckets=4)
    assert not log.exists() and log.version()[0] == 0
    with pytest.raises(ValueError, match="no rows"):
        log.state()
    assert log.append(rows(spark, ("a", "A", 1, 7), ("b", "B", 1, 7), (None, "none", 1, 7)), "one")
    assert log.append(rows(spark, ("a", "A2", 2, 8)), "two")
    assert log.append(spark.createDataFrame([("b", 3)], "id string, seq long"), "three", gone=True)
    want = [("a", "A2", 8)]
    some = lambda df: held(df.where("id is not null"))
    assert some(log.state()) == want and held(log.state(1).where("id is not null")) == [("a", "A", 7), ("b", "B", 7)]
    # a repeated batch is not written, a late older row changes nothing, not even a key that was taken out
    assert not log.append(rows(spark, ("a", "X", 9, 9)), "two")
    assert log.append(rows(spark, ("b", "late", 2, 1), ("a", "late", 1, 1)), "late") and some(log.state()) == want
    again = ChangeLog(spark, str(tmp_path / "papers"), ["id"], ["seq"], buckets=4)
    assert some(again.state()) == want
    assert again.compact() and not again.compact()
    assert some(log.state()) == want and log.version()[1]["batches"] == []
    assert log.append(rows(spark, ("b", "late", 2, 1)), "later") and some(log.state()) == want
    assert log.vacuum() == 4 and some(log.state()) == want
    assert log.append(rows(spark, ("b", "back", 4, 1)), "back") and some(log.state()) == [*want, ("b", "back", 1)]


def test_lookup_reads_one_bucket(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "t"), ["id"], ["seq"], buckets=4)
    log.append(spark.range(40).select(F.col("id").cast("string").alias("id"), F.lit("t").alias("title"), F.lit(1).cast("long").alias("seq"), F.col("id").alias("k")), "b1")
    found = log.lookup(id="17")
    assert held(found) == [("17", "t", 17)] and log.lookup(id="none").count() == 0
    plan = found._jdf.queryExecution().toString()
    assert f"PartitionFilters: [isnotnull({BUCKET}" in plan


def test_changes_between_versions_outlive_a_compaction(spark, tmp_path):
    log = ChangeLog(spark, str(tmp_path / "t"), ["id"], ["seq"], buckets=2)
    log.append(rows(spark, ("a", "A", 1, 1)), "1")
    log.append(rows(spark, ("b", "B", 2, 1)), "2")
    log.compact()
    log.append(rows(spark, ("c", "C", 3, 1)), "3")
    assert held(log.changes(1)) == [("b", "B", 1), ("c", "C", 1)] and held(log.changes(1, 2)) == [("b", "B", 1)] and held(log.changes(3)) == [("c", "C", 1)]


def test_writers_that_meet_and_new_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    errors = []

    def write(n):
        try:
            ChangeLog(spark, path, ["id"], ["seq"], buckets=2).append(rows(spark, (str(n), "T", n, n)), f"w{n}")
        except Exception as e:
            errors.append(e)

    several = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    for t in several:
        t.start()
    for t in several:
        t.join()
    log = ChangeLog(spark, path, ["id"], ["seq"], buckets=2)
    assert not errors and [r[0] for r in held(log.state())] == ["0", "1", "2", "3"] and log.version()[0] == 4
    log.append(spark.createDataFrame([("9", 9, "new")], "id string, seq long, more string"), "wide")
    assert {(r.id, r.more) for r in log.state().collect()} == {*((str(n), None) for n in range(4)), ("9", "new")}
