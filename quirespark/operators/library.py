"""Catalogue operators: upserts, deletions, filters, counts, tags and cache eviction as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last change of each key: a full-row upsert over an append-only log.

    Rows that are equal in key and order are one, whichever comes first.
    """
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    at = apart(changes, "at")
    return changes.withColumn(at, F.row_number().over(w)).where(F.col(at) == 1).drop(at)


def apart(rows: DataFrame, name: str) -> str:
    """A name for a column of the operator's own that no column of rows has, case ignored."""
    taken = {c.lower() for c in rows.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(rows: DataFrame, tombstones: DataFrame, key: list[str]) -> DataFrame:
    """Idempotent deletion."""
    return rows.join(tombstones, key, "left_anti")


def delete_collection(papers: DataFrame, collection: str) -> DataFrame:
    """Takes a collection out of every paper that has it."""
    return papers.withColumn("collection_ids", F.array_remove("collection_ids", collection))


def toggle_collection(papers: DataFrame, collection: str) -> DataFrame:
    has = F.array_contains("collection_ids", collection)
    return papers.withColumn("collection_ids", F.when(has, F.array_remove("collection_ids", collection)).otherwise(F.array_append("collection_ids", F.lit(collection))))


def filter_papers(papers: DataFrame, scope: str = "all", query: str = "") -> DataFrame:
    """Papers of a scope (all, uncategorised or a collection) whose title or a tag contains the query, case ignored."""
    if scope == "uncategorised":
        papers = papers.where(F.size("collection_ids") == 0)
    elif scope != "all":
        papers = papers.where(F.array_contains("collection_ids", scope))
    q = query.strip().lower()
    if q:
        papers = papers.where(F.contains(F.lower("title"), F.lit(q)) | F.exists("tags", lambda t: F.contains(F.lower(t), F.lit(q))))
    return papers.orderBy(F.desc("last_opened_at"), "id")


def scope_counts(papers: DataFrame) -> DataFrame:
    """Papers by scope: all, uncategorised and each collection, in one pass."""
    scopes = F.concat(F.array(F.lit("all")), F.when(F.size("collection_ids") == 0, F.array(F.lit("uncategorised"))).otherwise(F.col("collection_ids")))
    return papers.select(F.explode(scopes).alias("scope")).groupBy("scope").agg(F.count("*").alias("n"))


def distinct_tags(tags: Column) -> Column:
    """Trimmed tags without blanks; of those equal but for case the first."""
    trimmed = F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: t != "")
    return F.aggregate(trimmed, F.array().cast("array<string>"), lambda out, t: F.when(F.exists(out, lambda o: F.lower(o) == F.lower(t)), out).otherwise(F.array_append(out, t)))


def same_tags(a: Column, b: Column) -> Column:
    lower = lambda c: F.sort_array(F.transform(c, lambda t: F.lower(t)))
    return lower(a) == lower(b)


def keep_recent(entries: DataFrame, limit: int = 2000) -> DataFrame:
    """The `limit` entries used last; a top-k, so each task sends `limit` rows at most."""
    return entries.groupBy("key").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "key").limit(limit)


def title_of(metadata: Column, first_page: Column, file_name: Column) -> Column:
    usable = lambda c: F.when((F.length(F.trim(c)) > 0) & (F.length(F.trim(c)) <= 300), F.trim(c))
    return F.coalesce(usable(metadata), usable(first_page), F.regexp_replace(file_name, r"(?i)\.pdf$", ""))


def relative_day(at_ms: Column, now_ms: Column) -> Column:
    days = F.floor((now_ms - at_ms) / 86_400_000)
    return F.when(days <= 0, "today").when(days == 1, "yesterday").when(days < 30, F.concat(days.cast("string"), F.lit(" days"))).otherwise(F.date_format(F.timestamp_millis(at_ms), "M-d"))


def retry_after_ms(header: Column) -> Column:
    """Seconds to milliseconds; only positive finite values count."""
    s = header.try_cast("double")
    return F.when((s > 0) & (s < 1e15), (s * 1000).cast("long"))


def progress_percent(done: Column, failed: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(100 * (done + failed) / total + 0.5)).otherwise(0)
