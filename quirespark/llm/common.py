"""Helpers shared by the corpus operators: scratch tables, Arrow batches and words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that one Python step holds at once, and bytes of an Arrow batch between the JVM and Python; both
#: bound memory whatever the rows.
STEP_CHARS, BATCH_BYTES = 1_000_000, 2 << 20
#: Bytes of a Parquet row group of scratch tables, which each writing task holds.
ROW_GROUP = 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_BYTES at most, for this session from now on; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).lower().removesuffix("b")
    units = {"k": 10, "m": 20, "g": 30}
    size = int(now[:-1]) << units[now[-1]] if now[-1] in units else int(now)
    if size <= 0 or size > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, as in tests in one process, a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quirespark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back, which cuts its lineage.

    The table is removed when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def ids_and_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The two columns that the operators read, as (doc_id long, text string); other columns never matter."""
    bounded_batches(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def steps(batches: Iterator[pa.RecordBatch], chars: int = STEP_CHARS) -> Iterator[tuple[list, list[str]]]:
    """Ids and whole texts (null: empty) of each step of at most `chars` characters, or of one longer text."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py() or ""
            if ids and size + len(t) > chars:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
        if ids:
            yield ids, texts


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows that are sorted by `key`, in batches of about `most` bytes that never cut a group; one group at least."""
    held, size = [], 0

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        last = batch.column(key)[-1]
        if size < most or held[0].column(key)[0] == last:
            continue
        rows = joined()
        cut = pa.compute.index(rows.column(key), last).as_py()
        yield rows.slice(0, cut)
        held = [rows.slice(cut)]
        size = held[0].nbytes
    if held:
        yield joined()


def words(text: str) -> list[bytes]:
    r"""Words [^\x20\x09-\x0D]+ in UTF-8: bytes.split() cuts at exactly those six characters."""
    return text.encode().split()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
