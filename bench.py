"""Times the headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one line of JSON.

A query is run once to warm up and then three times at most, fewer where that would take longer than $BENCH_SECONDS in
all; its figure is the median. Shuffle bytes are those that tasks have written in a timed run. The hit rate is that of a
second translation run over an unchanged table.
"""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quirespark.operators.changelog import ChangeLog
from quirespark.operators.settled import shared_folder
from quirespark.operators.translation import TranslationRun
from quirespark.plans.catalogue import Tagged
from quirespark.plans.queries import QUERIES

HEADLINE = (
    "q_items", "q_gutters", "q_lines", "q_paragraphs", "q_body_font", "q_block_style", "q_formula_mark", "q_continuation", "q_fnv_cache_key", "q_cache_hits", "q_scope_counts", "q_upsert_latest",
    "q_reference_intervals", "q_table_groups", "q_flow_sweep", "q_change_log",
)
SECONDS = float(os.environ.get("BENCH_SECONDS", "600"))


def shuffled(spark: SparkSession) -> int:
    """Bytes that tasks have written to shuffles so far, from the status store."""
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteBytes() for k in range(stages.size()))


def hit_rate(spark: SparkSession, sf: str) -> float:
    folder = f"{shared_folder(spark)}/bench-{time.time_ns()}"
    cache = ChangeLog(spark, f"{folder}/cache", ["key"], ["at"])
    rows = spark.read.parquet(f"{sf}/conversations.parquet").limit(500).select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("source"))
    for now in (1, 2):
        _, counts = TranslationRun(cache, f"run{now}", Tagged, f"{folder}/journal").run(rows, now)
    return counts.first()["hit_rate"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    settings = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    began, took, moved = time.time(), {}, {}

    def timed(name: str) -> float:
        start = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.time() - start

    for name in HEADLINE:
        first = timed(name)
        left, times = (SECONDS - (time.time() - began)) / len(HEADLINE), []
        for _ in range(3):
            if times and sum(times) + times[-1] > max(left, 0) * 2 + first:
                break
            before = shuffled(spark)
            times.append(timed(name))
            moved[name] = shuffled(spark) - before
        took[name] = round(median(times), 3)
    out = {"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf, "shuffle_bytes": moved, "second_run_hit_rate": hit_rate(spark, sf)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
