"""Registered queries of page analysis: tables, figures and the document flow, with DuckDB SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import assembly, crosspage, figures, flow, layout, pages, tables
from ..operators.settled import settled
from ..sources import adapter
from . import oracle

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PAGE = ["doc_id", "page_index"]


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _items(s: SparkSession, d: str) -> DataFrame:
    """The adapter's runs, of which every fourth document's have a dot behind each second letter, so that its rows look
    like a table's cells, and those of every third line of each fifth document `=` behind each character, like formulas."""
    items = adapter.items(s.read.parquet(f"{d}/documents.parquet"))
    cells, formula = F.regexp_replace("str", "([A-Za-z]{2})", "$1."), F.regexp_replace("str", r"([^\n])", "$1=")
    shaped = F.when(F.col("doc_id") % 4 == 0, cells).when((F.col("doc_id") % 5 == 1) & (F.col("line_ord") % 3 == 1), formula).otherwise(F.col("str"))
    return items.withColumn("str", shaped)


STYLE_SQL = oracle._with(oracle.SHAPED_STYLE)


def _bounds() -> Column:
    return F.array(F.lit(0.0), F.lit(459.0), F.lit(918.0))


def _graphics(items: DataFrame) -> DataFrame:
    return adapter.graphics(items.select(*PAGE).distinct())


def _columned(s: SparkSession, d: str) -> DataFrame:
    return layout.upright(_items(s, d)).withColumn("column_index", F.when(F.col("x") < 459, 0).otherwise(1))


def _numbered(s: SparkSession, d: str, spans: bool = False, again: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Runs, numbered lines and body fonts; lines that are read again, beside what is made of them here, are worked out once."""
    items = _columned(s, d)
    numbered = assembly.paragraph_lines(assembly.lines(items, spans))
    return items, settled(numbered) if again else numbered, layout.body_font(items)


def _styled(s: SparkSession, d: str, spans: bool = False, lines: bool = False, again: bool = True) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The same with styled blocks; `lines` and `again` say whether lines, or blocks, are read more than once."""
    items, numbered, body = _numbered(s, d, spans, lines)
    blocks = layout.mark_formulas(layout.block_style(assembly.blocks_of(numbered), body, _bounds(), layout.heading_fonts(items, body)))
    return items, numbered, body, settled(blocks) if again else blocks


@_query(STYLE_SQL + """, c as (select n.*, body_font, len(regexp_extract_all(n.text, '[A-Za-z]{3,}')) as words from numbered n
    join (select doc_id, page_index, column_index, block from styled where not formula and not numeric and heading_level = 0) using (doc_id, page_index, column_index, block) join body using (doc_id, page_index)),
  g as (select doc_id, page_index, column_index, baseline_y, x - gap / 2 as centre from before where gap >= 5),
  r as (select c.*, (select count(*) from g where g.doc_id = c.doc_id and g.page_index = c.page_index and g.column_index = c.column_index and g.baseline_y = c.baseline_y) as n_wide from c where n_items >= 3),
  o as (select *, coalesce((y - lag(y) over w > 2 * body_font)::int, 0) as new_ from (select * exclude (g) from r where n_wide >= 2) window w as (partition by doc_id, page_index, column_index order by y, line_index)),
  p as (select *, sum(new_) over (partition by doc_id, page_index, column_index order by y, line_index rows unbounded preceding)::bigint as g from o),
  k as (select p.doc_id, p.page_index, p.column_index, p.g, centre, p.baseline_y from p join g using (doc_id, page_index, column_index, baseline_y)),
  ch as (select *, sum(cut) over (partition by doc_id, page_index, column_index, g order by centre, baseline_y rows unbounded preceding) as chain from
    (select *, coalesce((centre - lag(centre) over (partition by doc_id, page_index, column_index, g order by centre, baseline_y) > 16)::int, 0) as cut from k)),
  best as (select doc_id, page_index, column_index, g, max(n) as best from (select doc_id, page_index, column_index, g, chain, count(*) as n from ch group by all) group by all),
  grp as (select doc_id, page_index, column_index, g, count(*) as n, count(*) filter (where words <= 4) as sparse, avg(words) as words, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h from p group by all)
  select doc_id, page_index, column_index, g, n, sparse, best::int as best, x, y, w, h from grp join best using (doc_id, page_index, column_index, g) where n >= 3 and sparse >= n * 0.6::double and words <= 4 and best >= greatest(2, ceil(n * 0.6::double))""")
def q_table_groups(s: SparkSession, d: str) -> DataFrame:
    _, numbered, body, blocks = _styled(s, d, lines=True)
    return tables.row_groups(tables.candidates(numbered, blocks, body), 5.0).select(*PAGE, "column_index", "g", "n", "sparse", "best", "x", "y", "w", "h")


@_query()
def q_table_regions(s: SparkSession, d: str) -> DataFrame:
    _, numbered, body, blocks = _styled(s, d, lines=True)
    return tables.table_regions(numbered, blocks, body, 5.0).drop("ys")


@_query(STYLE_SQL + """, sz as (select doc_id, page_index, floor(2 * font_size + 0.5) / 2 as body_font, sum(length(text))::bigint as weight, min(read_order) as f from styled where is_body_text and length(text) > 0 group by all)
  select doc_id, page_index, body_font, weight from sz where body_font > 0 qualify row_number() over (partition by doc_id, page_index order by weight desc, f) = 1""")
def q_refined_body_font(s: SparkSession, d: str) -> DataFrame:
    return layout.refined_body_font(_styled(s, d, again=False)[3])


@_query(STYLE_SQL + """, sz as (select doc_id, page_index, floor(2 * font_size + 0.5) / 2 as again, sum(length(text))::bigint as weight, min(read_order) as f from styled where is_body_text and length(text) > 0 group by all),
  b2 as (select doc_id, page_index, again from sz where again > 0 qualify row_number() over (partition by doc_id, page_index order by weight desc, f) = 1),
  n as (select s.*, case when is_body_text and again is not null then floor(font_size / again * 1000 + 0.5) / 1000 else font_scale end as fs, is_body_text and again is not null as own from styled s left join b2 using (doc_id, page_index))
  select doc_id, page_index, column_index, block, fs as font_scale, case when own then case when fs >= 1.3 then 2 when fs >= 1.06::double then 1 else 0 end else heading_level end as heading_level from n""")
def q_refined_style(s: SparkSession, d: str) -> DataFrame:
    blocks = _styled(s, d)[3]
    return layout.refine_style(blocks, layout.refined_body_font(blocks)).select(*PAGE, "column_index", "block", "font_scale", "heading_level")


@_query(STYLE_SQL + "select doc_id, page_index, column_index, block, dominant_font, gap_count from blocks")
def q_dominant_font(s: SparkSession, d: str) -> DataFrame:
    return assembly.blocks_of(_numbered(s, d)[1]).select(*PAGE, "column_index", "block", "dominant_font", "gap_count")


@_query(STYLE_SQL + """, f as (select * from styled where formula)
  select doc_id, page_index, column_index, block from styled s where formula or (n_lines <= 3 and length(text) <= 40 and is_body_text and translatable and heading_level = 0 and exists (
    select 1 from f where f.doc_id = s.doc_id and f.page_index = s.page_index and f.column_index = s.column_index and least(s.y + s.h, f.y + f.h) - greatest(s.y, f.y) >= 2))""")
def q_formula_blocks(s: SparkSession, d: str) -> DataFrame:
    return layout.absorb_fragments(_styled(s, d, again=False)[3]).where("formula").select(*PAGE, "column_index", "block")


@_query(STYLE_SQL + "select doc_id, page_index, column_index, block, is_body_text and translatable and not formula as translated from styled")
def q_translatable(s: SparkSession, d: str) -> DataFrame:
    return _styled(s, d, again=False)[3].select(*PAGE, "column_index", "block", (F.col("is_body_text") & F.col("translatable")).alias("translated"))


_GRAPHIC_STYLE = STYLE_SQL + "," + oracle._GRAPHICS


@_query(_GRAPHIC_STYLE + """, m as (select n.doc_id, n.page_index, n.column_index, n.line_index, n.block,
    bool_or(g.y <= n.y + n.h and n.y <= g.y + g.h and abs(g.x + g.w - n.x) <= 20) as l, bool_or(g.y <= n.y + n.h and n.y <= g.y + g.h and abs(g.x - n.x - n.w) <= 20) as r,
    bool_or(g.x <= n.x + n.w and n.x <= g.x + g.w and abs(g.y + g.h - n.y) <= 20) as a, bool_or(g.x <= n.x + n.w and n.x <= g.x + g.w and abs(g.y - n.y - n.h) <= 20) as b
    from numbered n left join graphics g on g.doc_id = n.doc_id and g.page_index = n.page_index and g.ord < 5 group by all)
  select doc_id, page_index, column_index, block, avg((coalesce(l and r, false) or coalesce(a and b, false))::int) as share from m group by all""")
def q_enclosed(s: SparkSession, d: str) -> DataFrame:
    items, numbered, _ = _numbered(s, d)
    return figures.touched_blocks(numbered, figures.figure_paths(_graphics(items)), 20.0)


@_query(_GRAPHIC_STYLE + """, f as (select doc_id, page_index, 60.0::double as rx, 80.0::double as ry, 340.0::double as rw, 60.0::double + 40 * (page_index % 3) as rh from pages_),
  c as (select s.*, greatest(0, least(x + w, rx + rw) - greatest(x, rx)) * greatest(0, least(y + h, ry + rh) - greatest(y, ry)) / (w * h) >= 0.5 as cov from styled s join f using (doc_id, page_index))
  select doc_id, page_index, column_index, block, case when cov and is_body_text and not formula then 'graphics-region' else figure_reason end as figure_reason, is_body_text and not (cov and is_body_text and not formula) as is_body_text from c""")
def q_region_covers_block(s: SparkSession, d: str) -> DataFrame:
    items, _, _, blocks = _styled(s, d)
    box = items.select(*PAGE).distinct().select(*PAGE, F.lit(60.0).alias("x"), F.lit(80.0).alias("y"), F.lit(340.0).alias("w"), (60.0 + 40 * (F.col("page_index") % 3)).alias("h"))
    return figures.covered_blocks(blocks, box, "graphics-region").select(*PAGE, "column_index", "block", "figure_reason", "is_body_text")


@_query("""with b as (select event_id, user_id as doc_id, (event_id % 4)::int as page_index, (event_id % 1000 - 50)::double as x, (event_id % 1300 - 90)::double as y, (event_id % 950)::double as w, (event_id % 1250)::double as h from events),
  c as (select doc_id, page_index, greatest(x, 0) as x, greatest(y, 0) as y, least(x + w, 918) - greatest(x, 0) as w, least(y + h, 1188) - greatest(y, 0) as h from b) select * from c where w >= 40 and h >= 40 and w * h <= 0.85 * 918 * 1188""")
def q_bitmap_regions(s: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    images = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("doc_id"), (k % 4).cast("int").alias("page_index"), (k % 1000 - 50).cast("double").alias("x"), (k % 1300 - 90).cast("double").alias("y"), (k % 950).cast("double").alias("w"), (k % 1250).cast("double").alias("h"))
    return figures.bitmap_regions(images, 918.0, 1188.0)


@_query(oracle._with(oracle._GRAPHICS) + " select doc_id, page_index, ord, x, y from graphics where ord < 5")
def q_figure_paths(s: SparkSession, d: str) -> DataFrame:
    return figures.figure_paths(_graphics(_items(s, d))).select(*PAGE, "ord", "x", "y")


@_query(oracle._with(oracle._GRAPHICS) + """, c as (select doc_id, page_index, count(*) as n from graphics group by all), m as (select doc_id, page_index, case when max(n) > 5 then count(*) else count(*) filter (where ord < 5) end as n,
    case when max(n) > 5 then min(x) else min(x) filter (where ord < 5) end as x from graphics join c using (doc_id, page_index) group by doc_id, page_index) select doc_id, page_index, x, n from m where n >= 4""".replace("max(n)", "max(c.n)"))
def q_crowded_figures(s: SparkSession, d: str) -> DataFrame:
    return figures.clusters(_graphics(_items(s, d)), crowded=5).select(*PAGE, "x", "n")


@_query()
def q_figure_regions(s: SparkSession, d: str) -> DataFrame:
    items = _columned(s, d)
    body = layout.body_font(items)
    return figures.figure_regions([figures.clusters(_graphics(items)).select(*PAGE, "x", "y", "w", "h")], items, body, 918.0, 1188.0)


@_query(oracle._with(oracle._GRAPHICS) + """, t as (select doc_id, page_index, avg(((ord + page_index) % 2 = 0)::int) >= 0.5 as ok from graphics where ord < 5 group by all)
  select doc_id, page_index, x, y, w, h from graphics join t using (doc_id, page_index) where ord < 5 and ok union all select doc_id, page_index, 1.0::double, 2, 50, 60 from pages_ where page_index = 0 union all select doc_id, page_index, 5.0::double, 6, 70, 80 from pages_ where page_index = 1""")
def q_slice_geometry(s: SparkSession, d: str) -> DataFrame:
    g = _graphics(_items(s, d))
    paths = g.where("ord < 5")
    trust = layout.geometry_trust(g, paths.withColumn("ink", (F.col("ord") + F.col("page_index")) % 2 == 0))
    box = lambda p, *v: g.select(*PAGE).distinct().where(F.col("page_index") == p).select(*PAGE, *[F.lit(float(x)).alias(c) for c, x in zip("xywh", v, strict=True)])
    return figures.trusted_geometry(paths, box(0, 1, 2, 50, 60), box(1, 5, 6, 70, 80), trust)


@_query(oracle._with(oracle._GRAPHICS) + " select doc_id, page_index + 1000 as page_index from pages_ where page_index % 2 = 1")
def q_scanned_pages(s: SparkSession, d: str) -> DataFrame:
    items = _items(s, d)
    blank = items.select("doc_id", (F.col("page_index") + 1000).alias("page_index"), (F.col("page_index") % 2).alias("odd")).where("odd = 1").drop("odd")
    return figures.scanned_pages(items.select(*PAGE).union(blank), items)


@_query(oracle._with(oracle._UP) + """, b as (select doc_id, page_index, max(x + w) - min(x) as w from items group by all), r as (select *, max(w) over (partition by doc_id order by page_index rows unbounded preceding) as widest from b)
  select doc_id, page_index, widest, greatest(coalesce(case when page_index % 2 = 0 then widest end, 0), case when page_index % 3 > 0 then w else 918 end) as reading from r""")
def q_reading_width(s: SparkSession, d: str) -> DataFrame:
    bounds = figures.widest_so_far(_items(s, d).groupBy(*PAGE).agg((F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w")))
    width = flow.reading_width(F.when(F.col("page_index") % 3 > 0, F.col("w")).otherwise(0.0), F.lit(918.0), F.when(F.col("page_index") % 2 == 0, F.col("widest")))
    return bounds.select(*PAGE, "widest", width.alias("reading"))


@_query(oracle._with(oracle._UP) + " select distinct doc_id, page_index, font_name, font_name like '%Medi%' as bold, font_name like '%Ital%' as italic, false as math_font from items where font_size <> 9 union all select distinct doc_id, page_index, font_name, true, false, false from items where font_size = 9")
def q_font_traits(s: SparkSession, d: str) -> DataFrame:
    items = _items(s, d)
    small = s.createDataFrame([("NimbusRomNo9L-ReguItal", True, False)], "font_name string, bold boolean, italic boolean")
    own = items.where("font_size <> 9")
    out = assembly.with_traits(own).select(*PAGE, "font_name", "bold", "italic", "math_font")
    return out.unionByName(assembly.with_traits(items.where("font_size = 9"), small).select(out.columns)).distinct()


def _spanned(s: SparkSession, d: str) -> DataFrame:
    """Conversations with spans: the first three characters bold, the fifth to ninth a lowered formula that overlaps
    another, one more formula further on; spans end with the text, and empty ones are none."""
    text = F.coalesce("text", F.lit(""))
    n = F.length(text)

    def one(a: int, b: int, bold: bool, script: str | None, math: bool) -> Column:
        return F.struct(F.lit(a).alias("start"), F.least(F.lit(b), n).alias("stop"), F.lit(bold).alias("bold"), F.lit(False).alias("italic"), F.lit(script).cast("string").alias("script"), F.lit(math).alias("math"))

    spans = F.array(one(0, 3, True, None, False), one(4, 9, False, "sub", True), one(7, 12, False, None, True), one(14, 17, False, None, True))
    return s.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", text.alias("text"), F.filter(spans, lambda x: x["stop"] > x["start"]).alias("spans"))


@_query("""with t as (select conv_id, turn, coalesce(text, '') as text from conversations)
  select conv_id, turn, case when length(text) <= 4 then text when length(text) <= 14 then substr(text, 1, 4) || '[[MATH_0]]' || substr(text, 13)
      else substr(text, 1, 4) || '[[MATH_0]]' || substr(text, 13, 2) || '[[MATH_1]]' || substr(text, 18) end as masked,
    case when length(text) <= 4 then '' when length(text) <= 14 then substr(text, 5, 8) else substr(text, 5, 8) || '|' || substr(text, 15, 3) end as pieces from t""")
def q_mask_spans(s: SparkSession, d: str) -> DataFrame:
    m = assembly.masked_math(F.col("text"), F.col("spans"))
    return _spanned(s, d).select("conv_id", "turn", m["masked"].alias("masked"), F.array_join(m["pieces"], "|").alias("pieces"))


@_query("""with t as (select conv_id, turn, coalesce(text, '') as text from conversations),
  parts as (select conv_id, turn, [substr(text, 1, 3), substr(text, 4, 1), substr(text, 5, 5), substr(text, 10)] as raw from t),
  safe as (select conv_id, turn, list_transform(raw, lambda p: replace(replace(replace(p, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) as p from parts)
  select conv_id, turn, case when p[1] = '' then '' else '<strong>' || p[1] || '</strong>' end || p[2] || case when p[3] = '' then '' else '<sub>' || p[3] || '</sub>' end || p[4] as html from safe""")
def q_render_spans(s: SparkSession, d: str) -> DataFrame:
    # spans of a block never overlap, so the one that does is left out
    spans = F.filter("spans", lambda x: x["start"] != 7)
    return _spanned(s, d).select("conv_id", "turn", assembly.rendered(F.col("text"), spans).alias("html"))


@_query()
def q_line_spans(s: SparkSession, d: str) -> DataFrame:
    items = layout.upright(_items(s, d)).withColumn("column_index", F.when(F.col("x") < 459, 0).otherwise(1))
    lines = assembly.lines(items).select(*PAGE, "column_index", "line_index", F.explode_outer("spans").alias("s")).where("s is not null")
    return lines.select(*PAGE, "column_index", "line_index", "s.*")


@_query("""with recursive e as (select user_id as doc_id, event_id as ord, (event_id * 37 % 900)::double as y, ([0, 5, 19, 20, 25, 60, 120])[event_id % 7 + 1]::double as h, event_id % 11 = 3 as figure,
    event_id % 4 > 0 or event_id % 11 = 3 as is_home, event_id % 3 > 0 and event_id % 11 <> 3 as body, event_id % 13 = 5 and event_id % 11 <> 3 as formula, event_id % 9 = 2 as spans, (event_id % 2 * 10)::double as x, (100 - event_id % 2 * 10)::double as w from events),
  g as (select user_id as doc_id, (event_id * 53 % 950)::double as y, (event_id * 53 % 950 + event_id % 40)::double as y1 from events where event_id % 5 = 0),
  iv as (select *, y + h as y1, row_number() over (partition by doc_id order by y, y + h, ord) as k from e),
  ends as (select doc_id, min(y) as top, max(y1) as bottom from (select doc_id, y, y1 from iv union all select doc_id, y, y1 from g) group by 1),
  walk as (select doc_id, 0::bigint as k, top as cursor from ends union all
    select w.doc_id, iv.k, case when iv.y1 > case when figure then y else greatest(cursor, y) end then iv.y1 else cursor end from walk w join iv on iv.doc_id = w.doc_id and iv.k = w.k + 1),
  steps as (select iv.*, cursor, case when figure then y else greatest(cursor, y) end as start from walk w join iv on iv.doc_id = w.doc_id and iv.k = w.k + 1),
  last as (select doc_id, arg_max(k, k) as k, arg_max(cursor, k) as cursor, bottom from walk join ends using (doc_id) group by doc_id, bottom),
  gaps as (select doc_id, k, cursor as a, y as b, false as is_last from steps where y > cursor union all select doc_id, k + 1, cursor, bottom, true from last where bottom > cursor),
  seen as (select *, exists (select 1 from g where g.doc_id = gaps.doc_id and g.y1 > a + 0.5 and g.y < b - 0.5) as drawn from gaps),
  raw as (select doc_id, k, 0 as part, case when drawn then 'image' else 'skip' end as kind, a as y0, b as y1, 0.0::double as x, 100.0::double as w, -1 as block, -1 as bc from seen where drawn or not is_last
    union all select doc_id, k, 1, case when not is_home then 'skip' when body and not formula then 'text' when formula then 'formula' else 'image' end, start, y1,
      case when is_home and (spans or figure or formula) then x else 0 end, case when is_home and (spans or figure or formula) then w else 100 end,
      case when is_home and body and not formula then ord else -1 end, case when is_home and body and not formula then 0 else -1 end from steps where y1 > start
    union all select doc_id, k + 1, 2, 'end', bottom, bottom, 0, 100, -1, -1 from last),
  bands as (select *, row_number() over (partition by doc_id order by k, part) as n from raw),
  run as (select doc_id, 0::bigint as n, null::double as oy, null::double as ox, null::double as ow, null::double as sy, null::double as sx, null::double as sw, null::double as sh from ends union all
    select b.doc_id, b.n, case kind when 'text' then y1 when 'image' then case when oy is null or ox <> x or ow <> w then y0 else oy end end, case when kind in ('text', 'image') then x end, case when kind in ('text', 'image') then w end,
      case when (kind <> 'image' or ox <> x or ow <> w) and y0 - oy >= 20 then oy end, ox, ow, y0 - oy from run r join bands b on b.doc_id = r.doc_id and b.n = r.n + 1),
  made as (select doc_id, n, 0 as o, 'slice' as kind, sx as x, sy as y, sw as w, sh as h, false as scale_to_text, -1 as block, -1 as block_column from run where sy is not null
    union all select doc_id, n, 1, case kind when 'text' then 'text' else 'slice' end, x, y0, w, y1 - y0, kind = 'formula', block, bc from bands where kind in ('text', 'formula')),
  sums as (select doc_id, (select count(*) from steps where steps.doc_id = ends.doc_id and y1 > start and not is_home) as skipped, coalesce((select sum(b - a) from seen where seen.doc_id = ends.doc_id and not drawn), 0) as dropped from ends)
  select doc_id, row_number() over (partition by doc_id order by n, o) - 1 as seq, kind, x, y, w, h, scale_to_text, block::int as block, block_column, skipped, dropped from made join sums using (doc_id)""")
def q_flow_sweep(s: SparkSession, d: str) -> DataFrame:
    """The sweep alone, over columns whose intervals overlap, nest and leave gaps, one a user."""
    k, yes = F.col("event_id"), F.col("event_id") % 11 == 3
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("doc_id"), k)
    y, heights = (k * 37 % 900).cast("double"), F.array(*map(F.lit, (0.0, 5.0, 19.0, 20.0, 25.0, 60.0, 120.0)))
    interval = F.struct(
        y.alias("y"), (y + F.element_at(heights, (k % 7 + 1).cast("int"))).alias("y1"), k.cast("int").alias("ord"), (k % 2 * 10).cast("double").alias("x"), (100 - k % 2 * 10).cast("double").alias("w"),
        ((k % 4 > 0) | yes).alias("is_home"), ((k % 3 > 0) & ~yes).alias("body"), ((k % 13 == 5) & ~yes).alias("formula"), yes.alias("figure"), (k % 9 == 2).alias("spans"), k.cast("int").alias("block"), F.lit(0).alias("column_index"),
    )
    graphic = F.when(k % 5 == 0, F.struct(F.lit(0.0).alias("x"), (k * 53 % 950).cast("double").alias("y"), F.lit(10.0).alias("w"), (k % 40).cast("double").alias("h")))
    columns = e.groupBy("doc_id").agg(F.sort_array(F.collect_list(interval)).alias("intervals"), F.collect_list(graphic).alias("graphics"))
    edge = lambda f, name, value: f(F.concat(F.transform("intervals", lambda v: v[name]), F.transform("graphics", value)))
    columns = columns.select(
        "doc_id", F.lit(0).alias("page_index"), F.lit(0).alias("column_index"), F.lit(0.0).alias("left"), F.lit(100.0).alias("right"),
        edge(F.array_min, "y", lambda g: g["y"]).alias("top"), edge(F.array_max, "y1", lambda g: g["y"] + g["h"]).alias("bottom"), "intervals", "graphics",
    )
    return flow.nodes(columns).drop("page_index", "column_index")


@_query(STYLE_SQL + r""", e as (select doc_id, page_index, arg_max({'t': text, 'c': column_index, 'b': block}, read_order) filter (where heading_level = 0 and not formula) as tail,
    arg_min({'t': text, 'c': column_index, 'b': block, 'p': heading_level = 0 and not formula}, read_order) as head from styled where is_body_text and translatable and not formula group by all)
  select h.doc_id, h.page_index, h.head.c as column_index, h.head.b as block, t.tail.c as tail_column, t.tail.b as tail_block, t.tail.t || ' ' || h.head.t as text
  from e h join e t on t.doc_id = h.doc_id and t.page_index = h.page_index - 1 where h.head.p and regexp_matches(rtrim(t.tail.t), '[A-Za-z0-9,;\-–—]$') and regexp_matches(ltrim(h.head.t), '^[a-z,;]')""")
def q_continued_units(s: SparkSession, d: str) -> DataFrame:
    units = crosspage.continued_units(_styled(s, d, spans=True)[3])
    return units.select(*PAGE, "column_index", "block", "tail_column", "tail_block", "text")


@_query()
def q_flow_texts(s: SparkSession, d: str) -> DataFrame:
    """Text nodes with units over page ends, reading widths and stand-ins where every third page has no translation."""
    items, _, _, blocks = _styled(s, d, spans=True)
    bounds = items.select(*PAGE).distinct().withColumn("bounds", _bounds())
    none = _graphics(items).limit(0)
    content = figures.widest_so_far(blocks.groupBy(*PAGE).agg((F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w")))
    widths = content.select(*PAGE, flow.reading_width(F.col("w"), F.lit(918.0), F.col("widest")).alias("reading"))
    units = settled(crosspage.continued_units(blocks))
    real = crosspage.translation_sources(blocks, units).where("page_index % 3 > 0")
    real = real.select(*PAGE, "column_index", "block", F.concat(F.lit("T:"), X.unmasked(F.col("source"), F.col("pieces"))).alias("target"))
    made = flow.text_nodes(flow.page_flow(blocks, none, none, none, bounds), blocks, real, None, units, widths, F.concat(F.lit("S:"), F.col("preview")))
    return made.where("kind = 'text'").select(*PAGE, "column_index", "seq", "block", "source", "target", "continues", "is_tail", F.size("pieces").alias("n_pieces"), "width")


@_query()
def q_flow_nodes(s: SparkSession, d: str) -> DataFrame:
    items, numbered, body, blocks = _styled(s, d, spans=True, lines=True)
    paths = _graphics(items)
    found = figures.figure_regions([figures.clusters(paths).select(*PAGE, "x", "y", "w", "h")], items, body, 918.0, 1188.0)
    bounds = items.select(*PAGE).distinct().withColumn("bounds", _bounds())
    nodes = flow.page_flow(layout.absorb_fragments(blocks), settled(tables.table_regions(numbered, blocks, body, 5.0)), settled(found), paths, bounds)
    return nodes.drop("skipped", "dropped")


@_query()
def q_flow_stats(s: SparkSession, d: str) -> DataFrame:
    items, _, body, blocks = _styled(s, d, spans=True)
    paths = _graphics(items)
    found = figures.figure_regions([figures.clusters(paths).select(*PAGE, "x", "y", "w", "h")], items, body, 918.0, 1188.0)
    bounds = items.select(*PAGE).distinct().withColumn("bounds", _bounds())
    found = settled(found)
    none = found.limit(0)
    made = flow.text_nodes(flow.page_flow(blocks, none, found, paths, bounds), blocks, blocks.select(*PAGE, "column_index", "block", F.col("text").alias("target")))
    return flow.flow_stats(made, blocks, found, paths)


@_query()
def q_analyze_pages(s: SparkSession, d: str) -> DataFrame:
    items = _items(s, d)
    return pages.analyze_pages(items, paths=_graphics(items), cell_gap=5.0).blocks.select(*PAGE, "column_index", "block", F.col("text"), "font_scale", "heading_level", "is_body_text", "translatable", "formula", "reason", "figure_reason", X.anchor(F.col("page_index"), F.col("text")).alias("anchor"))
