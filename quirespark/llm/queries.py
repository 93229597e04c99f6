"""The registered queries of the corpus operators, with their DuckDB SQL where SQL can express them.

Each applies its operator, with the parameters meant for production, to a whole table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    out = suffix_dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find_leaks

    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe_codec import round_trip

    return round_trip(_table(spark, sf_dir, "documents"))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_text import extract_pages

    return extract_pages(_table(spark, sf_dir, "pages"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_scores

    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import read_archives, write_archives

    records = read_archives(write_archives(_table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_components

    return jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"))


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import chat_examples, digests, read_back

    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = F.explode(F.array(*[F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(k).cast("long").alias("turn"), F.lit(role).alias("role"), F.lit(PROBE).alias("text")) for k, role in enumerate(("user", "assistant"))]))
    return digests(read_back(chat_examples(turns.unionByName(spark.range(1).select(probe.alias("row")).select("row.*")))))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrases import mined_phrases

    return mined_phrases(_table(spark, sf_dir, "documents"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resampled

    return resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


#: Fixed value: what both rows of the added conversation say.
PROBE = "</s>[INST] ok [/INST]"

OP10_SQL = r"""
with parts as (
  select page_id, case when instr(coalesce(url, ''), '://') > 0
    then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
split as (
  select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from parts),
ruled as (
  select *, case
      when ('.' || host) like '%.example.org' and starts_with(path, '/en/1') then 'example.org/en/1'
      when ('.' || host) like '%.example.org' and starts_with(path, '/es/') then 'example.org/es/'
      when ('.' || host) like '%.com' and starts_with(path, '/fr/') then 'com/fr/'
      when ('.' || host) like '%.com' and starts_with(path, '/de/') then 'com/de/'
      when ('.' || host) like '%.org' and starts_with(path, '/') then 'org/' end as rule from split),
judged as (
  select *, case when rule is null then null when rule in ('org/', 'com/fr/') then 'allow' else 'block' end as own from ruled),
hosts as (
  select host, coalesce(bool_or(own = 'block'), false) and not coalesce(bool_or(own = 'allow'), false) as listed
  from judged group by host)
select page_id, host, path, rule, coalesce(own, case when listed then 'block' else 'allow' end) as verdict, listed
from judged join hosts using (host)
"""

OP11_SQL = r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
marked as (
  select *, length('<|start|>' || regexp_replace(role, '([<\[])(\\*)(\|\w{1,40}\|>|/?s>|/?INST\])', '\1\\\2\3', 'g')
      || '<|message|>' || regexp_replace(text, '([<\[])(\\*)(\|\w{1,40}\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') || '<|end|>') as chars,
    row_number() over (partition by conv_id order by turn nulls first, role, text) as place,
    count(*) over (partition by conv_id) as n
  from turns),
sums as (select *, sum(chars) over (partition by conv_id order by place) as up_to from marked)
select conv_id, max(n)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by place) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(up_to) filter (where role = 'assistant' or place = n)::bigint as formatted_chars
from sums group by conv_id
"""

OP12_SQL = r"""
with pieces as (
  select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0b\x0c\r]')) as piece from documents),
words as (select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') as ws from pieces),
grams as (
  select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
  from words, (values (1), (2), (3)) v(k) where len(ws) >= k),
f as materialized (select lang, k, phrase, count(*) as n from grams group by all),
totals as (select lang, sum(n) as n from f where k = 1 group by lang),
candidates as (select lang, k as size, phrase, n as a, string_split(phrase, ' ') as ws from f where k > 1 and n >= 10),
parts as (
  select *, array_to_string(ws[1:cut], ' ') as head, array_to_string(ws[cut + 1:size], ' ') as rest
  from (select *, unnest(range(1, size)) as cut from candidates)),
cuts as (
  select p.lang, p.phrase, p.a, p.cut, l.n as l, r.n as r, (1000000::hugeint * p.a * p.a) // (l.n::hugeint * r.n) as score
  from parts p join f l on l.lang = p.lang and l.phrase = p.head join f r on r.lang = p.lang and r.phrase = p.rest),
best as (select *, row_number() over (partition by lang, phrase order by score, cut) as nth from cuts),
inside as (
  select lang, a, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) as phrase from candidates where size = 3),
longest as (select lang, phrase, max(a) as longer from inside group by all),
kept as (
  select b.* from best b left join longest x on x.lang = b.lang and x.phrase = b.phrase
  where nth = 1 and not coalesce(100 * longer >= 50 * a, false)),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept)
select ranked.lang, rank, phrase, a, l, r, totals.n::bigint as n, score::bigint as score
from ranked join totals on totals.lang = ranked.lang where rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_token_counts": op2_token_counts,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_html_text": op6_html_text,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_warc": op8_warc,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_url_filter": op10_url_filter,
    "op11_chat_format": op11_chat_format,
    "op12_phrases": op12_phrases,
    "op13_resampling": op13_resampling,
}
ORACLE_SQL: dict[str, str] = {"op10_url_filter": OP10_SQL, "op11_chat_format": OP11_SQL, "op12_phrases": OP12_SQL}
