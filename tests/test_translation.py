"""The translation run: faults and retries, equal questions, cache before and after, a lost worker, a cancelled run."""

import subprocess
import sys
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quirespark.functions import text as X
from quirespark.operators.changelog import ChangeLog
from quirespark.operators.translation import Busy, TranslationRun, evict, start
from tests.faulty import FaultyPort

REPO = str(Path(__file__).parent.parent)


@pytest.fixture
def place(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    port = FaultyPort(str(tmp_path / "calls"))
    cache = ChangeLog(spark, str(tmp_path / "cache"), ["key"], ["at"], buckets=2)
    return lambda name, **more: TranslationRun(cache, name, lambda: port, str(tmp_path / "journal"), base_ms=1.0, concurrency=2, **more), port, cache


def requests(spark, **sources):
    return spark.createDataFrame(list(sources.items()), "id string, source string")


def told(statuses):
    return {r.id: (r.state, r.error_kind, r.attempts) for r in statuses.collect()}


def test_hash_in_lockstep(spark):
    rng = __import__("random").Random(3)
    texts = ["", "hello", "plain networks", "𝒙é中", *("".join(rng.choices("abcé中", k=rng.randint(0, 60))) for _ in range(30)), None, "z" * 5000]

    def slow(t):
        h = 0xCBF29CE484222325
        raw = (t or "").encode("utf-16-be")
        for k in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[k : k + 2])) * 1099511628211) % 2**64
        return f"{h:016x}"

    assert X._fnv1a(texts) == [slow(t) for t in texts] and slow("hello") == "a430d84680aabd0b"
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert [r.h for r in df.select("k", X.fnv1a(F.col("t")).alias("h")).orderBy("k").collect()] == [slow(t) for t in texts]


def test_kinds_retries_and_equal_questions(spark, place):
    run, port, cache = place
    rows = requests(spark, a="a text", b="a text", c="[[401]] no", d="[[429]] later", e="[[500]] later", f="[[EMPTY]] x", g="[[ABORT]] x", h="[[LOST]] x", i="[[401]] no", j=None)
    statuses, counts = run("one").run(rows, 5)
    assert told(statuses) == {
        "a": ("done", None, 1), "b": ("cached", None, 0), "c": ("failed", "auth", 3), "d": ("done", None, 3), "e": ("done", None, 3), "f": ("failed", "empty", 3),
        "g": ("cancelled", "aborted", 3), "h": ("failed", "network", 3), "i": ("failed", "auth", 3), "j": ("done", None, 1),
    }
    assert tuple(counts.first()) == (10, 5, 1, 4, 1, 0.1, "cancelled")
    assert port.calls("a text") == 1 and port.calls("[[401]] no") == 1 and port.calls("[[EMPTY]] x") == 3 and port.calls("[[429]] later") == 3
    # the second run finds everything that was answered, and asks again for what was not
    before = port.calls()
    statuses, counts = run("two").run(requests(spark, a="a text", d="[[429]] later", z="new"), 6)
    assert told(statuses) == {"a": ("cached", None, 0), "d": ("cached", None, 0), "z": ("done", None, 1)} and port.calls() == before + 1
    assert counts.first().hit_rate == pytest.approx(2 / 3) and cache.state().count() == 5


def test_the_same_run_again_asks_nothing(spark, place):
    run, port, cache = place
    rows = requests(spark, a="a text", c="[[401]] no")
    first = told(run("one").run(rows, 5)[0])
    calls, version = port.calls(), cache.version()[0]
    statuses, _ = run("one").run(rows, 5)
    assert port.calls() == calls and cache.version()[0] == version and first["a"] == ("done", None, 1)
    assert told(statuses) == {"a": ("cached", None, 0), "c": ("failed", "auth", 3)}


def test_faults_of_the_program_end_the_run_and_it_goes_on_where_it_was(spark, place):
    run, port, _ = place
    sources = {f"k{k}": f"text {k}" for k in range(6)}
    with pytest.raises(Exception, match="a fault of the program"):
        run("one").run(requests(spark, bug="[[BUG]] x", **sources), 5)
    answered = port.calls() - port.calls("[[BUG]] x")
    statuses, _ = run("one").run(requests(spark, **sources), 5)
    assert {s for s, *_ in told(statuses).values()} == {"done"}
    assert all(port.calls(s) == 1 for s in sources.values()) and answered <= 6


def test_one_run_at_a_time(spark, place, tmp_path):
    run, *_ = place
    (tmp_path / "journal").mkdir()
    (tmp_path / "journal/one.lock").write_text("")
    with pytest.raises(Busy):
        run("one").run(requests(spark, a="x"), 5)
    assert told(run("one").run(requests(spark, a="x"), 5, resume=True)[0]) == {"a": ("done", None, 1)}
    assert not (tmp_path / "journal/one.lock").exists()


def test_cancelling_keeps_what_is_done(spark, place):
    run, port, cache = place
    own = run("one")
    rows = requests(spark, **{f"k{k}": f"text {k}" for k in range(5)}, y="[[SLOW]] y", z="[[SLOW]] z")

    def stop():
        until = time.time() + 40
        while time.time() < until and not (port.calls("[[SLOW]] y") and port.calls("[[SLOW]] z")):
            time.sleep(0.1)
        own.cancel()

    other = threading.Thread(target=stop)
    other.start()
    statuses, counts = own.run(rows, 5)
    other.join()
    got = told(statuses)
    asked = {k for k in range(5) if port.calls(f"text {k}")}
    assert got["y"] == ("cancelled", "aborted", 3) and counts.first().status == "cancelled"
    assert {k for k in range(5) if got[f"k{k}"][0] == "done"} == asked and cache.state().count() == len(asked) if asked else True


def test_start_translates_what_is_pending(spark, place):
    run, port, _ = place
    sources = requests(spark, a="a text", b="b text")
    out, counts = start(run("one"), sources, spark.createDataFrame([("a", "old")], "id string, text string"), 5)
    assert {(r.id, r.text) for r in out.collect()} == {("a", "old"), ("b", "译译译")} and counts.first().total == 1 and port.calls() == 1


def test_eviction_keeps_the_newest(spark, place):
    _, _, cache = place
    cache.append(spark.createDataFrame([(f"k{k}", f"t{k}", k // 2) for k in range(7)], "key string, text string, at long"), "b")
    assert evict(cache, 9, limit=3) and not evict(cache, 9, limit=3)
    assert sorted(r.key for r in cache.state().collect()) == ["k4", "k5", "k6"]
    cache.append(spark.createDataFrame([("k0", "again", 10)], "key string, text string, at long"), "c")
    assert cache.compact() and sorted((r.key, r.text) for r in cache.state().collect()) == [("k0", "again"), ("k4", "t4"), ("k5", "t5"), ("k6", "t6")]


SCRIPT = """
import sys
from pyspark.sql import SparkSession
from quirespark.operators.changelog import ChangeLog
from quirespark.operators.translation import TranslationRun
from tests.faulty import FaultyPort
base = sys.argv[1]
spark = SparkSession.builder.master("local[2,4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
rows = spark.createDataFrame([*((f"k{k}", f"text {k}") for k in range(20)), ("die", "[[DIE]] x")], "id string, source string")
run = TranslationRun(ChangeLog(spark, base + "/cache", ["key"], ["at"]), "one", lambda: FaultyPort(base + "/calls"), base + "/journal", concurrency=2)
print("STATES", sorted({r.state for r in run.run(rows, 5)[0].collect()}))
"""


def test_a_lost_worker_asks_nothing_twice(tmp_path):
    """A worker process dies in the midst of its keys; the task is tried again elsewhere."""
    (tmp_path / "calls").mkdir()
    said = subprocess.run([sys.executable, "-c", SCRIPT, str(tmp_path)], cwd=REPO, env={**__import__("os").environ, "PYTHONPATH": REPO}, capture_output=True, text=True, timeout=240)
    assert "STATES ['done']" in said.stdout, said.stderr[-3000:]
    port = FaultyPort(str(tmp_path / "calls"))
    assert port.calls("[[DIE]] x") == 2 and all(port.calls(f"text {k}") == 1 for k in range(20))
