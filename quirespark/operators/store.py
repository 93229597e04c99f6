"""The catalogue as change logs: tables of rows with a key and a sequence number, read as their latest state.

Edits are rows appended to a log, so writers never rewrite each other's files; the state is the last row of each key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .library import apart, distinct_tags, keep_recent, latest, same_tags
from .settled import settled

#: Bounds and defaults of settings, the cache's longest entry and its size, presets of providers.
SETTINGS = {"concurrency": (1, 32, 8), "max_attempts": (1, 8, 3), "base_delay_ms": (100, 30_000, 800)}
MAX_ENTRY, MAX_ENTRIES = 20_000, 2000


def open_documents(spark: SparkSession, path: str, name: str = "*.pdf") -> DataFrame:
    """Files as (path, modificationTime, length, content), the scan of a document source."""
    return spark.read.format("binaryFile").option("pathGlobFilter", name).load(path)


def document_source(spark: SparkSession, kind: str, path: str, ident: str | None = None) -> DataFrame:
    """Documents from a fixture or catalogue table (Parquet), one row of the library by id, or files of a folder or URL."""
    if kind in ("fixture", "library"):
        rows = spark.read.parquet(path)
        return rows.where(F.col("id") == ident) if kind == "library" and ident is not None else rows
    if kind in ("file", "url"):
        return open_documents(spark, path, ident or "*")
    raise ValueError(f"unknown source {kind}")


def by_id(rows: DataFrame, ident: object, key: str = "id") -> DataFrame:
    return rows.where(F.col(key) == F.lit(ident))


def newest_first(papers: DataFrame) -> DataFrame:
    return papers.orderBy(F.desc("last_opened_at"), F.desc("seq"), "id")


def last_opened(papers: DataFrame) -> DataFrame:
    return newest_first(papers).limit(1)


def by_creation(collections: DataFrame) -> DataFrame:
    """Collections with their `place` from 1: oldest first, of equal times the smaller id, missing values last."""
    collections = collections.drop("place")
    placed = _placed(collections, [F.col(c).asc_nulls_last() for c in ("created_at", "id")], "place", apart(collections, "of_all"))
    return placed.select(*collections.columns, "place")


def decoded(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """JSON text columns as arrays of the given types; what does not parse, and null, is an empty array."""
    return rows.withColumns({c: F.coalesce(F.from_json(c, f"array<{t}>"), F.array().cast(f"array<{t}>")) for c, t in columns.items()})


def cache_entries(lines: DataFrame, column: str = "line") -> DataFrame:
    """(key, text, at) of JSON lines; malformed ones and those without a text are left out, a missing time is 0."""
    e = lines.select(F.from_json(column, "key string, text string, at long", {"mode": "PERMISSIVE"}).alias("e")).select("e.*")
    return e.where("key is not null and text is not null").withColumn("at", F.coalesce("at", F.lit(0).cast("long")))


def clamped_int(value: Column, least: int, most: int, default: int) -> Column:
    """Rounded half up and kept within bounds; what is no finite number is the default."""
    number = value.try_cast("double")
    sound = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
    return F.when(sound, F.least(F.lit(most).cast("double"), F.greatest(F.lit(least).cast("double"), F.floor(number + 0.5).cast("double"))).cast("long")).otherwise(F.lit(default).cast("long"))


def valid_settings(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: clamped_int(F.col(c), *bounds) for c, bounds in SETTINGS.items()})


def repaired_providers(settings: DataFrame, presets: DataFrame, default_provider: str, default_model: str) -> DataFrame:
    """Settings whose base URL belongs to another provider, or is a local proxy's, get their provider's; a default model
    of another provider gives way to the provider's own. Presets (provider, origin, model) are few."""
    own = presets.select("provider", F.col("origin").alias("own_origin"), F.col("model").alias("own_model"))
    foreign = presets.select(F.col("origin").alias("base_url"), F.col("provider").alias("foreign")).dropDuplicates(["base_url"])
    out = settings.join(own, "provider", "left").join(foreign, "base_url", "left")
    wrong = F.col("own_origin").isNotNull() & ((F.col("foreign").isNotNull() & (F.col("foreign") != F.col("provider"))) | F.startswith(F.col("base_url"), F.lit("/api/llm")))
    model = F.when((F.col("provider") != default_provider) & (F.col("model") == default_model), F.coalesce("own_model", "model")).otherwise(F.col("model"))
    return out.withColumn("base_url", F.when(wrong, F.col("own_origin")).otherwise(F.col("base_url"))).withColumn("model", model).select(*settings.columns)


def upsert(table: DataFrame, changes: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Full-row upsert: the union's last row of each key."""
    return latest(table.unionByName(changes), key, order)


def migrated(target: DataFrame, source: DataFrame) -> DataFrame:
    """The target, or where that is empty a copy of the source, which stays."""
    filled = apart(source, "filled")
    some = target.limit(1).select(F.lit(True).alias(filled))
    copied = source.withColumn(filled, F.lit(True)).join(F.broadcast(some), filled, "left_anti")  # one row at most
    return target.unionByName(copied.drop(filled))


def cache_write(entries: DataFrame, writes: DataFrame, longest: int = MAX_ENTRY, limit: int = MAX_ENTRIES) -> DataFrame:
    """(key, text, at) after writes: too long texts are not kept, of a key the last entry, and of all the `limit` newest."""
    rows = latest(entries.unionByName(writes.where(F.length("text") <= longest)), ["key"], ["at", "text"])
    return rows.join(keep_recent(rows.select("key", "at"), limit).select("key"), "key", "left_semi")


def _placed(rows: DataFrame, order: list[Column], place: str, of_all: str, parts: int = 256) -> DataFrame:
    """Rows with their place from 1 in the order, and the number of all rows.

    Rows are dealt by ranges of the order; each range is ranked by itself, behind the number of rows in the ranges
    before it, so the one ordered sum runs over `parts` ranges.
    """
    part, before, inside = (apart(rows, c) for c in ("part", "before", "inside"))
    ranged = rows.repartitionByRange(parts, *order).withColumn(part, F.spark_partition_id())
    ranged = settled(ranged)  # a range is found by a sample, so it is dealt out once
    sizes = ranged.groupBy(part).agg(F.count("*").alias(before))
    up_to = F.sum(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(part, F.coalesce(up_to, F.lit(0)).alias(before), F.sum(before).over(Window.partitionBy()).alias(of_all))
    ranked = ranged.withColumn(inside, F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    ranked = ranked.join(F.broadcast(sizes), part)  # a row a range
    return ranked.select(*rows.columns, (F.col(before) + F.col(inside)).alias(place), of_all)


def newer_half(entries: DataFrame, parts: int = 256) -> DataFrame:
    """What is left after a quota error: the older half, rounded down, goes; of equal times the smaller keys first."""
    place, of_all = apart(entries, "place"), apart(entries, "of_all")
    placed = _placed(entries, [F.col("at"), F.col("key")], place, of_all, parts)
    return placed.where(F.col(place) > F.floor(F.col(of_all) / 2)).select(*entries.columns)


def to_base64(data: Column) -> Column:
    """In one line; the function cuts into lines of 76."""
    return F.regexp_replace(F.base64(data), r"[\r\n]", "")


def from_base64(text: Column) -> Column:
    """Bytes; blanks are skipped, padding may stand at the end alone, anything else gives null."""
    bare = F.regexp_replace(text, r"[ \n\r\t]", "")
    body = F.regexp_replace(bare, "=+$", "")
    # a lone last character carries no whole byte
    body = F.when(F.length(body) % 4 == 1, F.substring(body, 1, F.length(body) - 1)).otherwise(body)
    return F.when(bare.rlike(r"^[A-Za-z0-9+/]*=*$"), F.unbase64(F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), "=")))


def normalized(papers: DataFrame, now_ms: int = 0) -> DataFrame:
    """Catalogue rows with every missing field at its default."""
    c = F.col
    empty = lambda t: F.array().cast(f"array<{t}>")
    return papers.select(
        "id", F.coalesce("title", "file_name", F.lit("未命名")).alias("title"), F.coalesce("file_name", F.lit("")).alias("file_name"),
        *[F.coalesce(c(n), F.lit(d)).cast("long").alias(n) for n, d in (("byte_length", 0), ("page_count", 0))],
        F.coalesce("added_at", "last_opened_at", F.lit(now_ms)).alias("added_at"), F.coalesce("last_opened_at", "added_at", F.lit(now_ms)).alias("last_opened_at"),
        F.coalesce(c("last_page"), F.lit(1)).cast("long").alias("last_page"), F.coalesce("collection_ids", empty("string")).alias("collection_ids"), F.coalesce("tags", empty("string")).alias("tags"),
    )


def add_papers(papers: DataFrame, added: DataFrame) -> DataFrame:
    """Papers with those added: one that has the file's name and length already takes its page count and opening time.

    `added` has id, title, file_name, byte_length, page_count and at; of equal files the one added last counts.
    """
    fresh = latest(added, ["file_name", "byte_length"], ["at", "id"])
    key = ["file_name", "byte_length"]
    known = papers.join(fresh.select(*key, F.col("page_count").alias("pages"), "at"), key, "left")
    known = known.withColumn("page_count", F.coalesce("pages", "page_count")).withColumn("last_opened_at", F.coalesce("at", "last_opened_at"))
    rows = fresh.join(papers.select(*key), key, "left_anti").withColumns({"added_at": F.col("at"), "last_opened_at": F.col("at"), "last_page": F.lit(1).cast("long")})
    return known.select(*papers.columns).unionByName(rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast(papers.schema[c].dataType).alias(c) for c in papers.columns]))


def set_progress(papers: DataFrame, changes: DataFrame) -> DataFrame:
    """The last page of each paper from (id, page, at, seq); a page that is the same already changes nothing, a new one
    also opens the paper again. Changes of a paper count in order."""
    w = Window.partitionBy("id").orderBy("seq")
    first = papers.groupBy("id").agg(F.max("last_page").alias("first_page"))
    steps = changes.select("id", "page", "at", "seq").join(first, "id")
    moved = steps.withColumn("was", F.coalesce(F.lag("page").over(w), F.col("first_page"))).where("page <> was")
    to = apart(papers, "to")
    last = moved.groupBy("id").agg(F.max_by(F.struct("page", "at"), "seq").alias(to))
    out = papers.join(last, "id", "left")
    return out.withColumn("last_page", F.coalesce(F.col(to)["page"], "last_page")).withColumn("last_opened_at", F.coalesce(F.col(to)["at"], "last_opened_at")).select(*papers.columns)


def create_collections(collections: DataFrame, wanted: DataFrame) -> DataFrame:
    """Collections with the wanted (id, name, created_at) added; blank names and names that exist, case ignored, are not."""
    key = lambda c: F.lower(F.trim(c))
    rows = wanted.where(F.trim("name") != "").select("id", F.trim("name").alias("name"), "created_at", key("name").alias("k"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("created_at", "id"))).where("n = 1")
    fresh = rows.join(collections.select(key("name").alias("k")), "k", "left_anti")
    return collections.unionByName(fresh.select("id", "name", "created_at"))


def rename_collections(collections: DataFrame, names: DataFrame) -> DataFrame:
    """New names (id, new_name, seq) for collections that exist; blank ones change nothing, names need not be unique."""
    last = names.where(F.trim("new_name") != "").groupBy("id").agg(F.max_by(F.trim("new_name"), "seq").alias("to"))
    return collections.join(last, "id", "left").withColumn("name", F.coalesce("to", "name")).select(*collections.columns)


def _last_wanted(wanted: DataFrame, value: str, name: str) -> DataFrame:
    """(id, name): one wanted value of each id, of the greatest `seq` where there is one, else the greatest value."""
    rank = F.struct("seq", value) if "seq" in wanted.columns else F.col(value)
    return wanted.groupBy("id").agg(F.max_by(value, rank).alias(name))


def set_tags(papers: DataFrame, wanted: DataFrame) -> DataFrame:
    """New tag sets (id, new_tags, maybe seq); a set that is equal but for case and order changes nothing. `changed`
    tells. Of several sets of a paper the last counts, so papers never multiply."""
    own = apart(papers, "clean")
    last = _last_wanted(wanted, "new_tags", own)
    out = papers.join(last.select("id", distinct_tags(F.col(own)).alias(own)), "id", "left")
    changed = F.col(own).isNotNull() & ~((F.size(own) == F.size("tags")) & same_tags(F.col(own), F.col("tags")))
    tags = F.when(changed, F.col(own)).otherwise(F.col("tags"))
    return out.select(*[tags.alias(c) if c == "tags" else c for c in papers.columns if c != "changed"], changed.alias("changed"))


def add_tag(tags: Column, tag: Column) -> Column:
    """The tags with one more, trimmed; blank and known ones, by case, change nothing."""
    t = F.trim(tag)
    return F.when((t == "") | F.array_contains(tags, t), tags).otherwise(F.array_append(tags, t))


def remove_tag(tags: Column, tag: Column) -> Column:
    return F.filter(tags, lambda t: t != tag)


def override_state(changes: DataFrame) -> DataFrame:
    """(doc_id, anchor, kind) in force after changes (doc_id, anchor, kind, seq): `auto` takes an override back, and
    changes without a document count for nothing. This is also what is exported."""
    return latest(changes.where("doc_id is not null"), ["doc_id", "anchor"], ["seq"]).where("kind <> 'auto'").select("doc_id", "anchor", "kind")


def replaced_overrides(papers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Papers with new override lists (id, new_overrides, maybe seq); equal lists, in order, change nothing. `changed`
    tells. Of several lists of a paper the last counts."""
    own = apart(papers, "wanted")
    out = papers.join(_last_wanted(wanted, "new_overrides", own), "id", "left")
    changed = F.col(own).isNotNull() & ~F.col("overrides").eqNullSafe(F.col(own))
    now = F.when(changed, F.col(own)).otherwise(F.col("overrides"))
    return out.select(*[now.alias(c) if c == "overrides" else c for c in papers.columns if c != "changed"], changed.alias("changed"))


def registered_with(requests: DataFrame, sources: DataFrame) -> DataFrame:
    """Whether each (id, text) is registered with just that text; repeated sources count once."""
    known = sources.select("id", "text", F.lit(True).alias("known")).distinct()
    return requests.select("id", "text").join(known, ["id", "text"], "left").select("id", "text", F.coalesce("known", F.lit(False)).alias("registered"))


def pending(sources: DataFrame, translations: DataFrame) -> DataFrame:
    """Registered sources that have no translation yet."""
    return sources.join(translations.select("id"), "id", "left_anti")


def unregistered(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Retraction: sources, translations, warnings or errors without those of the ids."""
    return rows.join(ids.select("id").distinct(), "id", "left_anti")


def restored(sources: DataFrame, translations: DataFrame, cache: DataFrame, attempted: DataFrame | None = None) -> DataFrame:
    """Translations that the cache gives back to sources (id, key) without one; an id is tried once."""
    left = pending(sources, translations)
    if attempted is not None:
        left = left.join(attempted.select("id"), "id", "left_anti")
    return left.join(cache.select("key", "text"), "key").select("id", "text")


def timed_out(message: Column) -> Column:
    return message.rlike(r"(?i)timed?\s?out|超时")


def run_status(summary: DataFrame) -> DataFrame:
    """How a run ended: cancelled if anything was, failed if anything was, else done."""
    status = F.when(F.col("cancelled") > 0, "cancelled").when(F.col("failed") > 0, "failed").otherwise("done")
    return summary.withColumn("status", status)
