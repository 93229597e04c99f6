"""Registered queries of the catalogue, the translation store and box geometry, each beside its DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import enrich, library, store
from ..operators.changelog import ChangeLog
from ..operators.settled import shared_folder
from ..operators.translation import TranslationRun
from ..streaming import feed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _papers(s: SparkSession, d: str) -> DataFrame:
    """Documents as catalogue rows: two tags, a collection, opening times that tie."""
    return _read(s, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.split("text", "\n")[0].alias("title"), F.concat(F.lit("f"), F.col("doc_id") % 50, F.lit(".pdf")).alias("file_name"), (F.col("n_chars") % 7).alias("byte_length"),
        F.lit(3).cast("long").alias("page_count"), F.lit(0).cast("long").alias("added_at"), (F.col("n_chars") % 97).alias("last_opened_at"), (F.col("doc_id") % 4 + 1).alias("last_page"), F.array("source").alias("collection_ids"), F.array("lang", "source").alias("tags"), F.col("doc_id").alias("seq"),
    )


_PAPERS = """papers as (select doc_id::varchar as id, string_split(text, chr(10))[1] as title, 'f' || doc_id % 50 || '.pdf' as file_name, n_chars % 7 as byte_length, 3::bigint as page_count, 0::bigint as added_at,
  n_chars % 97 as last_opened_at, doc_id % 4 + 1 as last_page, lang, source, doc_id as seq, doc_id from documents)"""


@_query("with " + _PAPERS + " select id, title, last_opened_at from papers order by last_opened_at desc, seq desc, id limit 1")
def q_last_opened(s: SparkSession, d: str) -> DataFrame:
    return store.last_opened(_papers(s, d)).select("id", "title", "last_opened_at")


@_query("with " + _PAPERS + " select id, title, last_page from papers where id = '17'")
def q_paper_by_id(s: SparkSession, d: str) -> DataFrame:
    return store.by_id(_papers(s, d), "17").select("id", "title", "last_page")


@_query("select source as id, min(doc_id) as created_at, row_number() over (order by min(doc_id), source) as place from documents group by source")
def q_collections_by_creation(s: SparkSession, d: str) -> DataFrame:
    return store.by_creation(_read(s, d, "documents").groupBy(F.col("source").alias("id")).agg(F.min("doc_id").alias("created_at")))


_LOGGED = """e as (select user_id, event_id, event_type, value, (event_id % 5)::int as b from events),
  s3 as (select * from e where b < 3 and not (b = 2 and event_id % 7 = 0) qualify row_number() over (partition by user_id order by event_id desc) = 1),
  t as (select user_id, max(event_id) as seq from e where b = 3 and event_id % 2 = 0 group by 1),
  s5 as (select * from e where b in (0, 1, 2, 4) and not (b = 2 and event_id % 7 = 0) qualify row_number() over (partition by user_id order by event_id desc) = 1)"""


def _log(s: SparkSession, d: str) -> ChangeLog:
    """Users' last events as a log of five batches: the fourth takes users out, the second is written twice, and a
    compaction comes in between."""
    log = ChangeLog(s, f"{shared_folder(s)}/log-{uuid.uuid4().hex}", ["user_id"], ["event_id"], buckets=8)
    e = _read(s, d, "events").select("user_id", "event_id", "event_type", "value")
    for k in (0, 1, 1, 2):
        log.append(e.where((F.col("event_id") % 5 == k) & ~((F.col("event_id") % 5 == 2) & (F.col("event_id") % 7 == 0))), f"b{k}")
    log.compact()
    log.append(e.where("event_id % 5 = 3 and event_id % 2 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id")), "b3", gone=True)
    log.append(e.where("event_id % 5 = 4"), "b4")
    return log


@_query("with " + _LOGGED + " select s5.user_id, event_id, event_type, value from s5 left join t on t.user_id = s5.user_id where seq is null or event_id > seq")
def q_change_log(s: SparkSession, d: str) -> DataFrame:
    return _log(s, d).state()


@_query("with " + _LOGGED + """, n as (select s5.* from s5 left join t on t.user_id = s5.user_id where seq is null or event_id > seq)
  select 'even' as subscriber, coalesce(n.user_id, o.user_id) as user_id, n.event_id, case when o.user_id is null then 'added' when n.user_id is null then 'removed' else 'changed' end as change
  from n full join s3 o on o.user_id = n.user_id where coalesce(n.user_id, o.user_id) % 2 = 0 and not (n.user_id is not null and o.user_id is not null and n.event_type is not distinct from o.event_type and n.value is not distinct from o.value)""")
def q_subscribed(s: SparkSession, d: str) -> DataFrame:
    """What the last two batches have changed for one who subscribes to users of even ids."""
    log = _log(s, d)
    wanted = _read(s, d, "events").where("user_id % 2 = 0").select(F.lit("even").alias("subscriber"), "user_id")
    return feed.notified(feed.changed(log, log.version()[0] - 2), wanted, ["user_id"]).select("subscriber", "user_id", "event_id", "change")


@_query("""select event_id, case when event_id % 3 = 0 then 2::bigint else 0::bigint end as n_tags, case when event_id % 3 = 0 then event_type end as first_tag from events""")
def q_decode_rows(s: SparkSession, d: str) -> DataFrame:
    e = _read(s, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), F.col("event_type"), F.lit('","x"]'))).when(F.col("event_id") % 3 == 1, "not json").alias("tags"))
    out = store.decoded(e, {"tags": "string"})
    return out.select("event_id", F.size("tags").cast("long").alias("n_tags"), F.get("tags", F.lit(0)).alias("first_tag"))


@_query("""select event_id::varchar as key, event_type as text, case when event_id % 4 = 2 then 0 else event_id end as "at" from events where event_id % 4 in (0, 2)""")
def q_cache_load(s: SparkSession, d: str) -> DataFrame:
    e, k = _read(s, d, "events"), F.col("event_id") % 4
    at = F.when(k == 2, F.lit("")).otherwise(F.concat(F.lit(',"at":'), F.col("event_id").cast("string")))
    whole = F.concat(F.lit('{"key":"'), F.col("event_id").cast("string"), F.lit('","text":"'), F.col("event_type"), F.lit('"'), at, F.lit("}"))
    line = F.when(k == 1, F.lit("{broken")).when(k == 3, F.concat(F.lit('{"key":"'), F.col("event_id").cast("string"), F.lit('"}'))).otherwise(whole)
    return store.cache_entries(e.select(line.alias("line")))


@_query("""select event_id, case when event_id % 5 = 0 then 8 else least(32, greatest(1, floor(value / 10 + 0.5))) end::bigint as concurrency,
  case when event_id % 5 = 1 then 3 else least(8, greatest(1, floor(value / 100 + 0.5))) end::bigint as max_attempts, least(30000, greatest(100, floor(value * 40 + 0.5)))::bigint as base_delay_ms from events""")
def q_settings_valid(s: SparkSession, d: str) -> DataFrame:
    e, v = _read(s, d, "events"), F.col("value")
    rows = e.select("event_id", F.when(F.col("event_id") % 5 == 0, "many").otherwise((v / 10).cast("string")).alias("concurrency"), F.when(F.col("event_id") % 5 == 1, F.lit(None)).otherwise((v / 100).cast("string")).alias("max_attempts"), (v * 40).cast("string").alias("base_delay_ms"))
    return store.valid_settings(rows)


@_query("""with p(provider, origin, model) as (values ('a', 'https://a', 'ma'), ('b', 'https://b', 'mb')),
  s as (select event_id, (['a', 'b', 'c'])[event_id % 3 + 1] as provider, (['https://a', 'https://b', '/api/llm/x', 'https://own'])[event_id % 4 + 1] as base_url, (['ma', 'mine'])[event_id % 2 + 1] as model from events)
  select event_id, s.provider, case when p.origin is not null and (base_url like '/api/llm%' or exists (select 1 from p q where q.origin = base_url and q.provider <> s.provider)) then p.origin else base_url end as base_url,
    case when s.provider <> 'a' and s.model = 'ma' then coalesce(p.model, s.model) else s.model end as model from s left join p using (provider)""")
def q_provider_repair(s: SparkSession, d: str) -> DataFrame:
    pick = lambda m, *xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("event_id") % m + 1).cast("int"))
    rows = _read(s, d, "events").select("event_id", pick(3, "a", "b", "c").alias("provider"), pick(4, "https://a", "https://b", "/api/llm/x", "https://own").alias("base_url"), pick(2, "ma", "mine").alias("model"))
    presets = s.createDataFrame([("a", "https://a", "ma"), ("b", "https://b", "mb")], "provider string, origin string, model string")
    return store.repaired_providers(rows, presets, "a", "ma")


@_query("select source as id, max(doc_id) as seq, arg_max(lang, doc_id) as name from documents group by source union all select 'own', -1, 'kept'")
def q_upsert_collections(s: SparkSession, d: str) -> DataFrame:
    changes = _read(s, d, "documents").select(F.col("source").alias("id"), F.col("doc_id").alias("seq"), F.col("lang").alias("name"))
    table = s.createDataFrame([("own", -1, "kept"), ("src1", -1, "old")], "id string, seq long, name string")
    return store.upsert(table, changes, ["id"], ["seq"])


@_query("select 'empty' as target, n_nationkey, n_name from nation union all select 'filled', 99, 'there'")
def q_migrate(s: SparkSession, d: str) -> DataFrame:
    source = _read(s, d, "nation").select("n_nationkey", "n_name")
    filled = s.createDataFrame([(99, "there")], source.schema)
    out = [store.migrated(t, source).select(F.lit(n).alias("target"), "n_nationkey", "n_name") for n, t in (("empty", filled.limit(0)), ("filled", filled))]
    return out[0].union(out[1])


@_query("""with a as (select (doc_id % 300)::varchar as key, doc_id as "at", length(text) as n from documents where length(text) <= 20000),
  l as (select * from a qualify row_number() over (partition by key order by "at" desc) = 1)
  select key, "at", n from l order by "at" desc, key limit 100""")
def q_cache_write(s: SparkSession, d: str) -> DataFrame:
    rows = _read(s, d, "documents").select((F.col("doc_id") % 300).cast("string").alias("key"), "text", F.col("doc_id").alias("at"))
    old = rows.where("at % 3 = 0 and length(text) <= 20000")
    return store.cache_write(old, rows.where("at % 3 <> 0"), limit=100).select("key", "at", F.length("text").cast("long").alias("n"))


@_query("""with e as (select event_id::varchar as key, event_id // 10 as "at" from events),
  r as (select *, row_number() over (order by "at", key) as k, count(*) over () as n from e) select key, "at" from r where k > n // 2""")
def q_cache_newer_half(s: SparkSession, d: str) -> DataFrame:
    return store.newer_half(_read(s, d, "events").select(F.col("event_id").cast("string").alias("key"), F.floor(F.col("event_id") / 10).alias("at")))


@_query("""select doc_id, base64(encode(text)) as b64, md5(text) as restored, null::varchar as broken from documents""")
def q_base64(s: SparkSession, d: str) -> DataFrame:
    b = store.to_base64(F.encode("text", "utf-8"))
    rows = _read(s, d, "documents").select("doc_id", b.alias("b64"))
    back = F.md5(store.from_base64(F.regexp_replace("b64", "(.{60})", "$1\n")))
    return rows.select("doc_id", "b64", back.alias("restored"), F.md5(store.from_base64(F.concat(F.lit("A=="), F.col("b64"), F.lit("A")))).alias("broken"))


@_query("""select doc_id::varchar as id, coalesce(case when doc_id % 2 = 0 then source end, case when doc_id % 3 = 0 then lang end, '未命名') as title, case when doc_id % 3 = 0 then lang else '' end as file_name,
  coalesce(case when doc_id % 5 = 0 then n_chars end, 0) as byte_length, coalesce(case when doc_id % 7 = 0 then 9 end, case when doc_id % 2 = 0 then 4 end, 77)::bigint as added_at, 1::bigint as last_page, 0::bigint as n_tags from documents""")
def q_normalize_meta(s: SparkSession, d: str) -> DataFrame:
    own = lambda m, c: F.when(F.col("doc_id") % m == 0, c)
    rows = _read(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), own(2, F.col("source")).alias("title"), own(3, F.col("lang")).alias("file_name"), own(5, F.col("n_chars")).alias("byte_length"), F.lit(None).cast("long").alias("page_count"), own(7, F.lit(9)).cast("long").alias("added_at"), own(2, F.lit(4)).cast("long").alias("last_opened_at"), F.lit(None).cast("long").alias("last_page"), F.lit(None).cast("array<string>").alias("collection_ids"), F.lit(None).cast("array<string>").alias("tags"))
    return store.normalized(rows, 77).select("id", "title", "file_name", "byte_length", F.col("added_at").cast("long").alias("added_at"), "last_page", F.size("tags").cast("long").alias("n_tags"))


@_query("with " + _PAPERS + """, old as (select * from papers where doc_id % 10 = 0 qualify row_number() over (partition by file_name, byte_length order by doc_id) = 1),
  f as (select *, 1000 + doc_id as "at" from papers where doc_id % 10 <> 0 or doc_id % 20 = 0 qualify row_number() over (partition by file_name, byte_length order by "at" desc, id desc) = 1)
  select o.id, o.file_name, o.byte_length, coalesce(f.doc_id % 9, 3)::bigint as page_count, coalesce(f."at", o.last_opened_at) as last_opened_at, o.last_page from old o left join f using (file_name, byte_length)
  union all select f.id, f.file_name, f.byte_length, f.doc_id % 9, f."at", 1 from f anti join old using (file_name, byte_length)""")
def q_add_papers(s: SparkSession, d: str) -> DataFrame:
    p = _papers(s, d)
    old = library.latest(p.where("seq % 10 = 0").withColumn("back", -F.col("seq")), ["file_name", "byte_length"], ["back"]).drop("back")
    added = p.where("seq % 10 <> 0 or seq % 20 = 0").select("id", "title", "file_name", "byte_length", (F.col("seq") % 9).alias("page_count"), (F.col("seq") + 1000).alias("at"))
    return store.add_papers(old, added).select("id", "file_name", "byte_length", "page_count", "last_opened_at", "last_page")


@_query("with " + _PAPERS + """, c as (select user_id::varchar as id, event_id % 4 + 1 as page, 5000 + event_id as "at", event_id as seq from events),
  st as (select c.*, coalesce(lag(page) over (partition by c.id order by c.seq), p.last_page) as was from c join papers p on p.id = c.id),
  l as (select id, arg_max(page, seq) as page, arg_max("at", seq) as "at" from st where page <> was group by id)
  select p.id, coalesce(l.page, p.last_page) as last_page, coalesce(l."at", p.last_opened_at) as last_opened_at from papers p left join l on l.id = p.id""")
def q_set_progress(s: SparkSession, d: str) -> DataFrame:
    e = _read(s, d, "events").select(F.col("user_id").cast("string").alias("id"), (F.col("event_id") % 4 + 1).alias("page"), (F.col("event_id") + 5000).alias("at"), F.col("event_id").alias("seq"))
    return store.set_progress(_papers(s, d), e).select("id", "last_page", "last_opened_at")


@_query("""with k as (select lower(source) as k, min(doc_id) as created_at from documents where doc_id % 6 <> 0 group by 1)
  select 'c0' as id, 'SRC1' as name, -1::bigint as created_at union all select created_at::varchar, k.k, created_at from k where k <> 'src1'""")
def q_create_collections(s: SparkSession, d: str) -> DataFrame:
    table = s.createDataFrame([("c0", "SRC1", -1)], "id string, name string, created_at long")
    padded = F.when(F.col("doc_id") % 6 == 0, F.lit("  ")).otherwise(F.concat(F.lit(" "), F.col("source")))
    wanted = _read(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), padded.alias("name"), F.col("doc_id").alias("created_at"))
    return store.create_collections(table, wanted)


@_query("""with n as (select source as id, arg_max(lang || doc_id, doc_id) as t from documents where doc_id % 3 <> 0 group by 1)
  select s.id, coalesce(n.t, 'old') as name from (select distinct source as id from documents) s left join n using (id)""")
def q_rename_collections(s: SparkSession, d: str) -> DataFrame:
    docs = _read(s, d, "documents")
    table = docs.select(F.col("source").alias("id"), F.lit("old").alias("name")).distinct()
    new = F.when(F.col("doc_id") % 3 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("lang"), F.col("doc_id").cast("string"), F.lit(" ")))
    return store.rename_collections(table, docs.select(F.col("source").alias("id"), new.alias("new_name"), F.col("doc_id").alias("seq")))


@_query("""select doc_id::varchar as id, case when doc_id % 4 = 0 then 'new|Tag' else lang || '|' || source end as tags, doc_id % 4 = 0 as changed from documents""")
def q_set_tags(s: SparkSession, d: str) -> DataFrame:
    wanted = _read(s, d, "documents").where("doc_id % 4 < 2").select(F.col("doc_id").cast("string").alias("id"), F.when(F.col("doc_id") % 4 == 0, F.array(F.lit("new"), F.lit(" Tag "), F.lit("NEW"), F.lit(""))).otherwise(F.array(F.upper("source"), F.upper("lang"))).alias("new_tags"))
    return store.set_tags(_papers(s, d), wanted).select("id", F.array_join("tags", "|").alias("tags"), "changed")


@_query("""select doc_id::varchar as id, lang || '|' || source || case when doc_id % 3 = 0 then '|' || upper(lang) else '' end as added, case when doc_id % 2 = 0 then source else lang || '|' || source end as removed from documents""")
def q_edit_tags(s: SparkSession, d: str) -> DataFrame:
    p, k = _papers(s, d), F.col("seq")
    tag = F.when(k % 3 == 0, F.concat(F.lit(" "), F.upper(F.col("tags")[0]))).when(k % 3 == 1, F.col("tags")[1]).otherwise(" ")
    gone = F.when(k % 2 == 0, F.col("tags")[0]).otherwise(F.upper(F.col("tags")[0]))
    return p.select("id", F.array_join(store.add_tag(F.col("tags"), tag), "|").alias("added"), F.array_join(store.remove_tag(F.col("tags"), gone), "|").alias("removed"))


@_query("""select doc_id::varchar as id, case when doc_id % 3 = 0 then '' when doc_id % 3 = 1 then source || '|src1' else source end as collections from documents where source <> 'src1'""")
def q_toggle_collection(s: SparkSession, d: str) -> DataFrame:
    p = _papers(s, d).where(~F.array_contains("collection_ids", "src1"))
    own = p.where("seq % 3 = 0").withColumn("collection_ids", F.array(F.lit("src1")))
    both = library.toggle_collection(own.unionByName(p.where("seq % 3 = 1")), "src1").unionByName(p.where("seq % 3 = 2"))
    return both.select("id", F.array_join("collection_ids", "|").alias("collections"))


@_query("""select user_id as doc_id, (event_id % 5)::varchar as anchor, event_type as kind from events
  qualify row_number() over (partition by user_id, event_id % 5 order by event_id desc) = 1 and event_type <> 'click'""")
def q_override_state(s: SparkSession, d: str) -> DataFrame:
    e = _read(s, d, "events")
    rows = e.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 5).cast("string").alias("anchor"), F.when(F.col("event_type") == "click", "auto").otherwise(F.col("event_type")).alias("kind"), F.col("event_id").alias("seq"))
    lost = rows.withColumn("doc_id", F.lit(None).cast("long")).withColumn("seq", F.col("seq") + 10**9)
    return store.override_state(rows.unionByName(lost))


@_query("""select doc_id::varchar as id, case when doc_id % 3 = 0 then 'b,a' else 'a,b' end as overrides, doc_id % 3 = 0 as changed from documents""")
def q_replace_overrides(s: SparkSession, d: str) -> DataFrame:
    p = _read(s, d, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array(F.lit("a"), F.lit("b")).alias("overrides"))
    k = F.col("id").cast("long") % 3
    wanted = p.where(k < 2).select("id", F.when(k == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b"))).alias("new_overrides"))
    return store.replaced_overrides(p, wanted).select("id", F.array_join("overrides", ",").alias("overrides"), "changed")


@_query("select doc_id as id, doc_id % 2 = 0 as registered from documents")
def q_registered(s: SparkSession, d: str) -> DataFrame:
    docs = _read(s, d, "documents").select(F.col("doc_id").alias("id"), "text")
    known = docs.where("id % 4 <> 3").withColumn("text", F.when(F.col("id") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit(" "))))
    return store.registered_with(docs, known).select("id", "registered")


@_query("select doc_id as id from documents where doc_id % 3 <> 0 and doc_id % 5 <> 0")
def q_pending(s: SparkSession, d: str) -> DataFrame:
    docs = _read(s, d, "documents").select(F.col("doc_id").alias("id"))
    left = store.unregistered(docs, docs.where("id % 5 = 0"))
    return store.pending(left, docs.where("id % 3 = 0"))


@_query("select doc_id as id, source || lang as text from documents where doc_id % 3 <> 0 and doc_id % 7 <> 0 and lang <> 'en'")
def q_restore(s: SparkSession, d: str) -> DataFrame:
    docs = _read(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat("source", "lang").alias("key"), "lang")
    cache = docs.where("lang <> 'en'").select("key", F.col("key").alias("text")).distinct()
    return store.restored(docs.select("id", "key"), docs.where("id % 3 = 0"), cache, docs.where("id % 7 = 0"))


@_query("select event_id, event_id % 4 in (0, 1, 3) as timed_out from events")
def q_timed_out(s: SparkSession, d: str) -> DataFrame:
    m = F.element_at(F.array(*map(F.lit, ("Request TIMED OUT", "timeout of 3 s", "refused", "请求超时"))), (F.col("event_id") % 4 + 1).cast("int"))
    return _read(s, d, "events").select("event_id", store.timed_out(m).alias("timed_out"))


@_query("""with r as (select user_id, count_if(event_id % 4 = 0) as done, count_if(event_id % 4 = 1) as cached, count_if(event_id % 4 = 2 and user_id % 3 = 0) as failed, count_if(event_id % 4 = 3 and user_id % 2 = 0) as cancelled, count(*) as total from events group by 1)
  select user_id, case when cancelled > 0 then 'cancelled' when failed > 0 then 'failed' else 'done' end as status, floor(100 * (done + cached + failed) / total + 0.5)::bigint as percent from r""")
def q_run_status(s: SparkSession, d: str) -> DataFrame:
    k, u = F.col("event_id") % 4, F.col("user_id")
    some = lambda c: F.count_if(c)
    r = _read(s, d, "events").groupBy("user_id").agg(some(k == 0).alias("done"), some(k == 1).alias("cached"), some((k == 2) & (u % 3 == 0)).alias("failed"), some((k == 3) & (u % 2 == 0)).alias("cancelled"), F.count("*").alias("total"))
    return store.run_status(r).select("user_id", "status", library.progress_percent(F.col("done") + F.col("cached"), F.col("failed"), F.col("total")).cast("long").alias("percent"))


@_query("""select doc_id, case when doc_id % 3 = 0 then trim(string_split(text, chr(10))[1], ' ') when doc_id % 3 = 1 then 'First page' else 'Paper' end as title,
  case when doc_id % 40 = 0 then 'today' when doc_id % 40 = 1 then 'yesterday' when doc_id % 40 < 30 then (doc_id % 40)::varchar || ' days' else strftime(make_timestamp((1700000000 - (doc_id % 40) * 86400) * 1000000), '%-m-%-d') end as day,
  case when doc_id % 4 = 0 then 1500::bigint end as retry_ms from documents where doc_id % 3 <> 0 or length(trim(string_split(text, chr(10))[1], ' ')) between 1 and 300""")
def q_labels_of_papers(s: SparkSession, d: str) -> DataFrame:
    k, docs = F.col("doc_id"), _read(s, d, "documents")
    first = F.split("text", "\n")[0]
    title = library.title_of(F.when(k % 3 == 0, first).otherwise(" "), F.when(k % 3 == 1, "First page"), F.lit("Paper.PDF"))
    day = library.relative_day(F.lit(1_700_000_000_000).cast("long") - (k % 40) * 86_400_000, F.lit(1_700_000_000_000).cast("long"))
    header = F.element_at(F.array(*map(F.lit, ("1.5", "-1", "soon", "0"))), (k % 4 + 1).cast("int"))
    return docs.where((k % 3 != 0) | F.length(F.trim(first)).between(1, 300)).select("doc_id", title.alias("title"), day.alias("day"), library.retry_after_ms(header).alias("retry_ms"))


def _boxes(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    return _read(s, d, "events").select("event_id", (k % 13 - 3).cast("double").alias("x"), (k % 11 - 2).cast("double").alias("y"), (k % 5).cast("double").alias("w"), (k % 7).cast("double").alias("h"), F.lit(4.0).alias("bx"), F.lit(3.0).alias("by"), F.lit(5.0).alias("bw"), F.lit(4.0).alias("bh"))


_BOXES = """b as (select event_id, (event_id % 13 - 3)::double as x, (event_id % 11 - 2)::double as y, (event_id % 5)::double as w, (event_id % 7)::double as h, 4.0::double as bx, 3.0::double as by_, 5.0::double as bw, 4.0::double as bh from events)"""


@_query("with " + _BOXES + """, r as (select *, greatest(x, bx) as rx, greatest(y, by_) as ry, least(x + w, bx + bw) - greatest(x, bx) as rw, least(y + h, by_ + bh) - greatest(y, by_) as rh from b)
  select event_id, case when rw > 0 and rh > 0 then rx end as rx, case when rw > 0 and rh > 0 then ry end as ry, case when rw > 0 and rh > 0 then rw end as rw, case when rw > 0 and rh > 0 then rh end as rh,
    greatest(x, 0) as cx, greatest(y, 0) as cy, least(x + w, 8) - greatest(x, 0) as cw, least(y + h, 6) - greatest(y, 0) as ch, x >= -2 and y >= -2 and x + w <= 10 and y + h <= 8 as inside from r""")
def q_box_parts(s: SparkSession, d: str) -> DataFrame:
    b = _boxes(s, d)
    own, other = G.box(), tuple(F.col("b" + c) for c in "xywh")
    part, cut = G.intersection(own, other), G.clamped(own, F.lit(8.0), F.lit(6.0))
    return b.select("event_id", *[part[c].alias("r" + c) for c in "xywh"], *[c.alias("c" + n) for c, n in zip(cut, "xywh", strict=True)], G.inside_page(own, F.lit(8.0), F.lit(6.0)).alias("inside"))


@_query("with " + _BOXES + """ select event_id, len(list_filter([0, 1, 2], lambda k: x < ([2.0, 5.0, 9.0])[k + 1] and x + w > ([0.0, 2.0, 5.0])[k + 1])) as n_covered,
  list_filter([0, 1, 2], lambda k: x < ([2.0, 5.0, 9.0])[k + 1] and x + w > ([0.0, 2.0, 5.0])[k + 1])[1]::int as home from b""")
def q_covered_columns(s: SparkSession, d: str) -> DataFrame:
    bounds = F.array(*map(F.lit, (0.0, 2.0, 5.0, 9.0)))
    out = _boxes(s, d).withColumn("covered", G.covered_columns(F.col("x"), F.col("w"), bounds))
    return out.select("event_id", F.size("covered").cast("long").alias("n_covered"), F.get("covered", F.lit(0)).alias("home"))


@_query("""with t as (select event_id, (event_id % 3 * 3)::double as a, (event_id % 2 * 4)::double as b, (event_id % 5)::double as c, (event_id % 4 * 2)::double as d, event_id % 10 as e, event_id % 9 as f from events)
  select event_id, case when c = 0 and d = 0 then 12.0::double else round(1.5 * sqrt(c * c + d * d), 9) end as font_size, (100 - 1.5 * f)::double as baseline, (1.5 * e)::double as x,
    round(100 - 1.5 * f - case when c = 0 and d = 0 then 12 else 1.5 * sqrt(c * c + d * d) end, 9) as y, 10.5::double as w, round(1.15 * case when c = 0 and d = 0 then 12 else 1.5 * sqrt(c * c + d * d) end, 9) as h,
    sqrt(a * a + b * b) > 0 and (abs(b) > sqrt(a * a + b * b) * 0.05 or abs(c) > sqrt(a * a + b * b) * 0.05) as turned from t""")
def q_run_geometry(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    t = _read(s, d, "events").select("event_id", *[c.cast("double").alias(n) for n, c in zip("abcdef", (k % 3 * 3, k % 2 * 4, k % 5, k % 4 * 2, k % 10, k % 9), strict=True)])
    m = [F.col(c) for c in "abcdef"]
    view = [F.lit(v) for v in (1.5, 0.0, 0.0, -1.5, 0.0, 100.0)]
    tx = G.compose(view, m)
    size = G.font_size(tx, F.lit(8.0), 1.5)
    x, y, w, h = G.run_box(tx, F.lit(7.0), F.lit(8.0), 1.5)
    r = lambda c: F.round(c, 9)
    return t.select("event_id", r(size).alias("font_size"), G.baseline(tx).alias("baseline"), x.alias("x"), r(y).alias("y"), w.alias("w"), r(h).alias("h"), G.turned(*m[:3]).alias("turned"))


@_query("with " + _BOXES + """ select event_id, round(least(100 / greatest(w, 1), 1.5), 9) as scale, least(x, x + w) * 2 + 1 as tx, 3 * h as th from b""")
def q_slice_scale(s: SparkSession, d: str) -> DataFrame:
    b = _boxes(s, d)
    x, y, w, h = G.transformed([F.lit(v) for v in (2.0, 0.0, 0.0, 3.0, 1.0, 0.0)], F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h"))
    return b.select("event_id", F.round(G.display_scale(F.greatest(F.col("w"), F.lit(1.0)), 100.0), 9).alias("scale"), x.alias("tx"), h.alias("th"))


@_query("""with s as (select doc_id, lang, source from documents) select doc_id, case when doc_id % 4 = 3 then null when doc_id % 4 = 0 then lang || '!' else source || '?' end as target from s""")
def q_preview_fill(s: SparkSession, d: str) -> DataFrame:
    b = _read(s, d, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.concat("lang", F.lit("!"))).alias("target"), F.concat("source", F.lit("?")).alias("stand_in"), (F.col("doc_id") % 4 == 3).alias("is_tail"))
    return b.select("doc_id", enrich.previewed(F.col("target"), F.col("stand_in"), F.col("is_tail")).alias("target"))


@_query(r"""select doc_id, length(regexp_replace(text, '[^一-鿿㐀-䶿　-〿豈-﫿＀-￯]', '', 'g')) as n_cjk, round(case when length(regexp_replace(text, '\s', '', 'g')) = 0 then 0 else length(regexp_replace(text, '[^±×÷∂∇−Ͱ-Ͽ←-⇿∀-⋿]', '', 'g'))::double / length(regexp_replace(text, '\s', '', 'g')) end, 9) as math_ratio from documents""")
def q_character_kinds(s: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return _read(s, d, "documents").select("doc_id", X.count_of(t, X.CJK).alias("n_cjk"), F.round(X.math_ratio(t), 9).alias("math_ratio"))


class Tagged:
    """The port of q_translate_run: the text behind a character, so that every answer is known."""

    def translate(self, source: str) -> str:
        return "中" + source


@_query("""with t as (select conv_id || '-' || turn as id, coalesce(text, '') as text, conv_id % 3 = 0 as early from conversations),
  f as (select text, bool_or(early) as early, min(id) as first from t group by text)
  select id, case when f.early or id <> first then 'cached' else 'done' end as state, '中' || t.text as text, case when f.early or id <> first then 0 else 1 end as attempts from t join f using (text)""")
def q_translate_run(s: SparkSession, d: str) -> DataFrame:
    """Two runs over one cache: the second finds what the first has asked, and its own repeated texts."""
    folder = f"{shared_folder(s)}/translations-{uuid.uuid4().hex}"
    cache = ChangeLog(s, f"{folder}/cache", ["key"], ["at"])
    t = _read(s, d, "conversations").select("conv_id", F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("text").alias("source"))
    for name, rows, now in (("early", t.where("conv_id % 3 = 0"), 1), ("all", t, 2)):
        statuses, _ = TranslationRun(cache, name, Tagged, f"{folder}/journal").run(rows, now)
    return statuses.select("id", "state", "text", "attempts")
