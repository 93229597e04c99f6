"""A stored table as a log of changes: appended batches, a pointer to what counts, snapshots by compaction.

Writers only ever add files. A version is a small JSON file that names the snapshot and the batches behind it; the newest
version is the pointer. It is put in place by a rename that fails where the name is taken, so of two writers one retries,
and readers see whole batches or none. Every batch has a name, and a name that is in the log is not written twice: a
retried writer, or a stream that repeats its last batch, changes nothing.

Files are laid out in buckets of the key, so a lookup by key reads one bucket of each batch, and a compaction is a
shuffle by bucket. The file system has to rename files in one step, as HDFS and local ones do.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .library import latest

GONE, BUCKET, PART = "_gone", "_bucket", "_part"
EMPTY = {"snapshot": None, "batches": [], "schema": None, "applied": []}
#: Tries of a writer that others overtake; names of batches that a compaction keeps. A batch that is older and repeated
#: all the same leaves the state as it is, since its rows lose to later ones of their keys.
TRIES, KEPT_NAMES = 20, 1000


class ChangeLog:
    """The log at `path`. Of rows of one `key` the last by `order` counts; rows with `gone` take their key out."""

    def __init__(self, spark: SparkSession, path: str, key: list[str], order: list[str], buckets: int = 32):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    def _fs(self, name: str = ""):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def version(self) -> tuple[int, dict]:
        """The newest version's number and content; 0 before the first write."""
        fs, folder = self._fs("versions")
        names = [x.getPath().getName()[:-5] for x in fs.listStatus(folder)] if fs.exists(folder) else []
        number = max((int(n) for n in names if n.isdigit()), default=0)
        return number, self._content(number)

    def _content(self, number: int) -> dict:
        if number == 0:
            return EMPTY
        return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.path}/versions/{number}.json").collect()))  # one short file

    def _put(self, number: int, content: dict) -> bool:
        """Whether the version is ours: somebody else's of that number stays."""
        fs, target = self._fs(f"versions/{number}.json")
        _, draft = self._fs(f"drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(json.dumps(content).encode())
        out.close()
        fs.mkdirs(target.getParent())
        jvm = self.spark.sparkContext._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, options)
        except Exception:
            if not fs.exists(target):
                raise
            fs.delete(draft, False)
            return False
        return True

    def _bucket(self, key: list) -> Column:
        return F.pmod(F.xxhash64(*key), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, kind: str) -> str:
        """Rows in files by bucket, under a folder of their own; what a failed try has left is never named."""
        name = f"{PART}={kind}-{uuid.uuid4().hex}"
        bucketed = rows.withColumn(BUCKET, self._bucket(self.key))
        bucketed.repartition(self.buckets, BUCKET).sortWithinPartitions(BUCKET, *self.key).write.partitionBy(BUCKET).parquet(f"{self.path}/data/{name}")
        return name

    def append(self, changes: DataFrame, batch: str, gone: bool = False) -> bool:
        """Adds a batch of full rows, or with `gone` of keys to take out; False if a batch of that name is there.

        Rows to take out need the columns of key and order. New columns may be added later; older rows have nulls there.
        """
        written = None
        for _ in range(TRIES):
            number, content = self.version()
            if batch in content["applied"]:
                return False
            if written is None:
                written = self._write(changes.withColumn(GONE, F.lit(gone)), "batch")
                schema = changes.schema
            if content["schema"]:
                known = {f["name"] for f in content["schema"]["fields"]}
                merged = {"type": "struct", "fields": content["schema"]["fields"] + [f for f in schema.jsonValue()["fields"] if f["name"] not in known]}
            else:
                merged = schema.jsonValue()
            now = content | {"batches": [*content["batches"], written], "applied": [*content["applied"], batch], "schema": merged}
            if self._put(number + 1, now):
                return True
        raise RuntimeError(f"{self.path}: overtaken {TRIES} times")

    def _read(self, version: dict, folders: list[str] | None = None) -> DataFrame:
        """The rows of a version's files, or of some folders, with `_gone` and the bucket, by which files are left out."""
        if version["schema"] is None:
            raise ValueError(f"{self.path} has no rows yet")
        fields = StructType.fromJson(version["schema"]).fields
        kinds = StructType([StructField(f.name, f.dataType, True) for f in fields]).add(GONE, "boolean").add(PART, "string").add(BUCKET, "integer")
        if folders is None:
            folders = [f for f in (version["snapshot"], *version["batches"]) if f]
        return self.spark.read.schema(kinds).option("basePath", f"{self.path}/data").parquet(*[f"{self.path}/data/{f}" for f in folders]) if folders else self.spark.createDataFrame([], kinds)

    def _latest(self, rows: DataFrame) -> DataFrame:
        return latest(rows, self.key, [*self.order, GONE]).drop(BUCKET, PART)

    def exists(self) -> bool:
        return self.version()[0] > 0

    def state(self, version: int | None = None) -> DataFrame:
        """The rows in force, now or at a version."""
        content = self.version()[1] if version is None else self._content(version)
        return self._latest(self._read(content)).where(~F.col(GONE)).drop(GONE)

    def lookup(self, **key: object) -> DataFrame:
        """The row in force of one key, from the files of its bucket alone."""
        rows = self._read(self.version()[1])
        own = [F.lit(key[k]).cast(rows.schema[k].dataType) for k in self.key]
        bucket = self.spark.range(1).select(self._bucket(own)).first()[0]
        rows = rows.where(F.col(BUCKET) == bucket)
        for k, value in zip(self.key, own, strict=True):
            rows = rows.where(F.col(k) == value)
        return self._latest(rows).where(~F.col(GONE)).drop(GONE)

    def changes(self, since: int, until: int | None = None) -> DataFrame:
        """The rows of all batches that came behind version `since`, up to `until`, with `_gone`; compactions do not
        matter, but for vacuum()."""
        newest, now = self.version()
        until = newest if until is None else until
        before = set(self._content(since)["batches"])
        added = dict.fromkeys(b for v in range(since + 1, until + 1) for b in self._content(v)["batches"] if b not in before)
        return self._read(now, list(added)).drop(BUCKET, PART)

    def compact(self) -> bool:
        """Writes the state as a snapshot in place of the batches so far; batches that come meanwhile stay behind it.

        Taken-out keys stay as such in the snapshot, so that an older change of theirs, should it come late, stays out.
        """
        number, now = self.version()
        if not now["batches"]:
            return False
        written = self._write(self._latest(self._read(now)), "snapshot")
        done = set(now["batches"])
        for _ in range(TRIES):
            number, newer = self.version()
            if newer["snapshot"] != now["snapshot"]:
                return False  # another compaction was faster
            if self._put(number + 1, newer | {"snapshot": written, "batches": [b for b in newer["batches"] if b not in done], "applied": newer["applied"][-KEPT_NAMES:]}):
                return True
        raise RuntimeError(f"{self.path}: overtaken {TRIES} times")

    def vacuum(self) -> int:
        """Removes batches and snapshots that the newest version does not name; readers of older ones must be done, and
        no writer at work."""
        _, now = self.version()
        named = {now["snapshot"], *now["batches"]}
        fs, folder = self._fs("data")
        old = [x.getPath() for x in fs.listStatus(folder) if x.getPath().getName() not in named] if fs.exists(folder) else []
        return sum(bool(fs.delete(p, True)) for p in old)
