"""DuckDB SQL for the registered queries, built from shared common table expressions."""

from __future__ import annotations

from ..sources.adapter import ITEMS_SQL

_UP = """
up as (select * from items where not rotated),
cols as (select *, case when x < 459 then 0 else 1 end as column_index from up)
"""
_COVER = """
up as (select * from items where not rotated),
spans as (select doc_id, page_index, greatest(floor(x / 2), 0)::int as a, least(ceil((x + w) / 2) - 1, 458)::int as b from up),
pages_ as (select distinct doc_id, page_index from spans where b >= a),
hits as (select doc_id, page_index, unnest(generate_series(a, b)) as bucket from spans where b >= a),
counts as (select doc_id, page_index, bucket::int as bucket, count(*) as n from hits group by all),
cover as (select p.doc_id, p.page_index, s.bucket::int as bucket, coalesce(c.n, 0) as n
  from pages_ p cross join (select unnest(generate_series(0, 458)) as bucket) s
  left join counts c on c.doc_id = p.doc_id and c.page_index = p.page_index and c.bucket = s.bucket),
slides as (select doc_id, page_index, bucket, sum(n) over w as total, count(*) over w as k from cover
  window w as (partition by doc_id, page_index order by bucket rows between current row and 7 following) qualify k = 8),
peaks as (select *, max(total) over (partition by doc_id, page_index) as peak from slides),
low as (select *, bucket - row_number() over (partition by doc_id, page_index order by bucket) as run from peaks where peak > 0 and total < 0.3 * peak),
runs as (select doc_id, page_index, min(bucket) as first, max(bucket) as last, min(total) as least, (min(bucket) + max(bucket) + 1) / 2 * 2.0::double as split_x
  from low group by doc_id, page_index, run having count(*) >= 5),
gutters as (select doc_id, page_index, split_x, least::bigint as least from runs where split_x > 0.15::double * 918 and split_x < 0.85::double * 918
  qualify row_number() over (partition by doc_id, page_index order by least, first) = 1)
"""
# rows of the adapter are 16 px apart, more than half of any size, so a line is a baseline, and has runs of one size
_CJK = r"[\x{3000}-\x{303F}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
_TRIM = r"'^[\s\x{FEFF}\x{00A0}\x{3000}]+|[\s\x{FEFF}\x{00A0}\x{3000}]+$', '', 'g'"
_LINES = _UP + rf""",
before as (select *, lag(str) over w as ps, x - lag(x + w) over w as gap from cols window w as (partition by doc_id, page_index, column_index, baseline_y order by x, line_ord, word_ord)),
parted as (select *, case when ps is null or (ps like '%-' and regexp_matches(str, '^[a-z]')) or gap <= 0.15::double * font_size or regexp_matches(ps, '{_CJK}$') or regexp_matches(str, '^{_CJK}') then '' else ' ' end || str as piece from before),
lines as (
  select doc_id, page_index, column_index, (dense_rank() over (partition by doc_id, page_index, column_index order by baseline_y) - 1)::int as line_index,
    regexp_replace(string_agg(piece, '' order by x, line_ord, word_ord), {_TRIM}) as text, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h,
    baseline_y, max(font_size) as font_size, count(*) as n_items, (count(*) filter (where gap > 0.3::double * font_size)) as n_gaps from parted group by doc_id, page_index, column_index, baseline_y)
"""
_BLOCKS = _LINES + rf""",
gapped as (select *, y - lag(y + h) over w as gap, lag(font_size) over w as was from lines window w as (partition by doc_id, page_index, column_index order by line_index)),
usual as (select doc_id, page_index, column_index, coalesce(quantile_cont(gap, 0.5) filter (where gap > 0), 0) as usual, coalesce(nullif(quantile_cont(h, 0.5), 0), 1) as height from gapped group by all),
opened as (select g.*, coalesce(gap > greatest(1.6::double * usual, 0.25::double * height) or (was > 0 and abs(font_size - was) > 0.2::double * was), false) as opens from gapped g join usual using (doc_id, page_index, column_index)),
grouped as (select *, sum(opens::int) over (partition by doc_id, page_index, column_index order by line_index) as g, nullif(regexp_extract(text, '^\s*\[([0-9]{{1,3}})\]', 1), '')::int as number, floor(x / 2 + 0.5) * 2 as edge from opened),
entered as (select *, number is not null and number > coalesce(max(number) over (w rows between unbounded preceding and 1 preceding), -1) as entry, row_number() over w = 1 as first_ from grouped
  window w as (partition by doc_id, page_index, column_index, g order by line_index)),
shared as (select doc_id, page_index, column_index, g, edge as shared from (select doc_id, page_index, column_index, g, edge, count(*) as n, min(line_index) as f from entered group by all)
  qualify row_number() over (partition by doc_id, page_index, column_index, g order by n desc, f) = 1),
sizes as (select doc_id, page_index, column_index, g, count(*) as n, coalesce(nullif(quantile_cont(font_size, 0.5), 0), 1) as size, min(x) as left_, (count(*) filter (where entry)) as n_entries from entered group by all),
hung as (select doc_id, page_index, column_index, g, (count(*) filter (where x <= left_ + size * 0.25::double)) as n_flush, (count(*) filter (where x > left_ + size * 0.5::double)) as n_deep from entered join sizes using (doc_id, page_index, column_index, g) group by all),
cut as (select e.*, opens or (not first_ and case when n_entries >= 3 then entry when n < 4 then false when n_flush >= 2 and 2 * n_flush < n and n_deep >= 2 then x <= left_ + size * 0.25::double
  else x > shared + size * 0.8::double end) as cut from entered e join shared using (doc_id, page_index, column_index, g) join sizes using (doc_id, page_index, column_index, g) join hung using (doc_id, page_index, column_index, g)),
numbered as (select *, sum(cut::int) over (partition by doc_id, page_index, column_index order by line_index)::bigint as block from cut),
beside as (select *, lag(text) over w as pt, lead(text) over w as nt from numbered window w as (partition by doc_id, page_index, column_index, block order by line_index)),
pieces as (select *, case when pt is null or (pt like '%-' and regexp_matches(text, '^[a-z]')) or regexp_matches(pt, '{_CJK}$') or regexp_matches(text, '^{_CJK}') then '' else ' ' end
  || case when text like '%-' and regexp_matches(coalesce(nt, ''), '^[a-z]') then left(text, length(text) - 1) else text end as piece from beside),
worn as (select c.doc_id, c.page_index, c.column_index, block, line_index, c.font_size, font_name, length(str) as n, row_number() over (partition by c.doc_id, c.page_index, c.column_index order by line_index, c.x, line_ord, word_ord) as k
  from cols c join numbered l using (doc_id, page_index, column_index, baseline_y)),
fonts as (select doc_id, page_index, column_index, block, font_name as dominant_font from (select doc_id, page_index, column_index, block, font_name, sum(n) as n, min(k) as k from worn group by all)
  qualify row_number() over (partition by doc_id, page_index, column_index, block order by n desc, k) = 1),
middle as (select doc_id, page_index, column_index, block, quantile_cont(font_size, 0.5) as font_size from worn group by all),
blocks as (select b.*, m.font_size, f.dominant_font, column_index * 10000 + block as read_order from (
    select doc_id, page_index, column_index, block, string_agg(piece, '' order by line_index) as text, min(x) as x, min(y) as y,
      max(x + w) - min(x) as w, max(y + h) - min(y) as h, count(*) as n_lines, sum(n_gaps)::bigint as gap_count from pieces group by doc_id, page_index, column_index, block) b
  join fonts f using (doc_id, page_index, column_index, block) join middle m using (doc_id, page_index, column_index, block))
"""
_FONT = """,
weights as (select doc_id, page_index, floor(2 * font_size + 0.5) / 2 as body_font, sum(length(str))::bigint as weight, min((line_ord, word_ord)) as first from up group by all),
body as (select doc_id, page_index, body_font, weight from weights qualify row_number() over (partition by doc_id, page_index order by weight desc, first) = 1)
"""
_STYLE = _BLOCKS + _FONT + r""",
heads as (select doc_id, page_index, font_name as dominant_font, true as is_bold from (select doc_id, page_index, font_name, quantile_cont(font_size, 0.5) as m from up group by all) join body using (doc_id, page_index) where m >= 1.15::double * body_font),
wide as (select doc_id, page_index, (case when x < 459 then 0 else 1 end) as column_index, min(x) as l, max(x + w) as r from blocks where (x < 459 and x + w > 0)::int + (x < 918 and x + w > 459)::int = 1 group by all),
scaled as (select b.*, font_size / body_font as scale, w / case when l is null then w else greatest(1, r - l) end as ratio, coalesce(is_bold, false) as bold,
  regexp_matches(regexp_replace(text, '^\s+|\s+$', '', 'g'), '(?i)^([0-9]{1,4}|[ivxlcdm]{1,6})$') as numeric
  from blocks b join body using (doc_id, page_index) left join wide using (doc_id, page_index, column_index) left join heads using (doc_id, page_index, dominant_font)),
headed as (select *, floor(scale * 1000 + 0.5) / 1000 as font_scale, floor(ratio * 100 + 0.5) / 100 as width_ratio, floor(gap_count / n_lines * 100 + 0.5) / 100 as gaps_per_line,
  case when numeric then 0 when scale >= 1.3 then 2 when scale >= 1.06::double then 1 else 0 end as heading_level from scaled),
reasoned as (select *, case when scale < 0.85::double then 'font-size' when heading_level = 0 and ratio < 0.35::double then 'narrow' end as figure_reason from headed),
marked as (select *, figure_reason is null as is_body_text, not numeric as translatable, length(regexp_replace(text, '\s', '', 'g')) as n_chars,
  length(regexp_replace(text, '[^=+<>{}±×÷∂∇−Ͱ-Ͽ←-⇿∀-⋿]', '', 'g')) as n_strong,
  len(list_filter(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda q: not list_contains(['sin','cos','tan','cot','sec','csc','log','ln','lg','exp','min','max','arg','sup','inf','det','dim','lim','mod','gcd','lcm','var','std','relu','sig','sgn','softmax'], lower(q)))) as long_words,
  regexp_matches(text, '\(([0-9]{1,3}[a-z]?)\)\s*\.?\s*$') as numbered_ from reasoned),
styled as (select *, is_body_text and translatable and heading_level = 0 and n_chars > 0 and n_lines <= 8 and case when numbered_ then n_strong * 100 >= n_chars * 10
  else long_words = 0 and n_strong * 100 >= n_chars * (case when n_lines = 1 then 30 else 25 end) end as formula from marked)
"""
_GRAPHICS = """
pages_ as (select distinct doc_id, page_index from items),
frame(ord, bx, y, w, h) as (values (0, 100.0, 100.0, 80.0, 40.0), (1, 100.0, 145.0, 80.0, 40.0), (2, 95.0, 100.0, 2.0, 85.0), (3, 183.0, 100.0, 2.0, 85.0), (4, 100.0, 190.0, 80.0, 1.0), (5, 500.0, 700.0, 200.0, 1.0)),
graphics as (select doc_id, page_index, ord, (bx + 10 * page_index)::double as x, y::double as y, w::double as w, h::double as h from pages_ cross join frame where page_index % 3 > 0 or ord = 5)
"""
_FNV = """'v1|mock|m|zh|p1|' || printf('%016x', list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(string_split({0}, ''), lambda c: unicode(c)::uhugeint)), lambda h, u: (xor(h, u) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint)::ubigint)"""


def _with(*parts: str) -> str:
    return "with " + ITEMS_SQL + "," + ",".join(p.lstrip().removeprefix(",") for p in parts)


_LONG = "with l as (select doc_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::int as i, length(unnest(string_split(text, chr(10)))) as n from documents)"
_PAPERS = """papers as (select doc_id::varchar as id, string_split(text, chr(10))[1] as title, source, lang, n_chars from documents)"""
_ANCHOR = r"page_index::varchar || '|' || substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 40)"

# runs of some documents read like cells or formulas, with nothing taken away
SHAPED = r"""(select * replace (case when doc_id % 4 = 0 then regexp_replace(str, '([A-Za-z]{2})', '\1.', 'g')
  when doc_id % 5 = 1 and line_ord % 3 = 1 then regexp_replace(str, '([^\n])', '\1=', 'g') else str end as str) from items)"""
SHAPED_STYLE = _STYLE.replace("from items where not rotated", f"from {SHAPED} where not rotated")

ORACLE_SQL = {
    "q_items": _with("x_ as (select 1)") + " select * from items",
    "q_not_rotated": _with(_UP) + " select doc_id, page_index, count(*) as n from up group by all",
    "q_page_bounds": _with(_UP) + " select doc_id, page_index, min(x) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h from items group by all",
    "q_column_coverage": _with(_COVER) + " select doc_id, page_index, bucket, n from cover where n > 0",
    "q_coverage_window": _with(_COVER) + " select doc_id, page_index, bucket, total::bigint as total from slides where total > 0",
    "q_gutters": _with(_COVER) + " select * from gutters",
    "q_assign_columns": _with(_COVER) + " select doc_id, page_index, case when split_x is null or x + w / 2 < split_x then 0 else 1 end as column_index, count(*) as n, max(x) as x_max from up left join gutters using (doc_id, page_index) group by all",
    "q_lines": _with(_LINES) + " select doc_id, page_index, column_index, line_index, text, x, y, w, h, baseline_y, font_size, n_items, n_gaps from lines",
    "q_paragraphs": _with(_BLOCKS) + " select * from blocks",
    "q_body_font": _with(_UP + _FONT) + " select * from body",
    "q_heading_fonts": _with(_UP + _FONT) + " select doc_id, page_index, font_name, m as median from (select doc_id, page_index, font_name, quantile_cont(font_size, 0.5) as m from up group by all) join body using (doc_id, page_index) where m >= 1.15::double * body_font",
    "q_block_style": _with(_STYLE) + " select doc_id, page_index, column_index, block, font_scale, width_ratio, gaps_per_line, bold, numeric, heading_level, figure_reason, is_body_text from styled",
    "q_formula_mark": _with(SHAPED_STYLE) + """, f as (select * from styled where formula)
      select doc_id, page_index, column_index, block from styled s where formula or (n_lines <= 3 and length(text) <= 40 and is_body_text and translatable and heading_level = 0 and exists (
        select 1 from f where f.doc_id = s.doc_id and f.page_index = s.page_index and f.column_index = s.column_index
          and least(s.y + s.h, f.y + f.h) - greatest(s.y, f.y) >= 2))""",
    "q_front_matter": _with(_STYLE) + r""", p0 as (select * from styled where page_index = 0),
      title as (select doc_id, y as title_y, read_order as title_order from p0 where y <= 0.4 * 1188 and font_scale >= 1.3
        qualify row_number() over (partition by doc_id order by font_scale desc, read_order) = 1),
      below as (select * from p0 join title using (doc_id) where y > title_y),
      lim as (select doc_id, min(y) as limit_y from below where regexp_matches(trim(text), '(?i)^(abstract|摘要|概要|summary)')
        or (font_scale < 1.15 and width_ratio >= 0.85 and length(text) >= 80) group by 1)
      select doc_id, read_order, y, title_y, limit_y from below join lim using (doc_id) where y < limit_y and read_order <> title_order""",
    "q_reference_intervals": _with(_STYLE) + r""", r as (select doc_id, page_index, read_order, column_index, block, doc_id % 5 = 0 and read_order = 1 as own,
        case when doc_id % 5 = 0 and read_order = 1 then 'References' else text end as t, font_scale, heading_level from styled),
      f as (select *, t = 'References' and own or (regexp_matches(trim(t), '(?i)^(references|bibliography)$') and (font_scale >= 1.05 or heading_level > 0)) as opens,
        heading_level > 0 and not regexp_matches(trim(t), '^\s*(\[[0-9]{1,3}\]|[0-9]{1,3}\.)') as closes from r),
      g as (select doc_id, list({'o': opens, 'c': closes} order by page_index, read_order) as l from f group by 1)
      select doc_id, n from (select doc_id, list_reduce(list_prepend({'s': false, 'n': 0::bigint}, list_transform(l, lambda x: {'s': x.o, 'n': case when x.c then 1 else 0 end::bigint})),
        lambda a, x: {'s': case when a.s then x.n = 0 else x.s end, 'n': a.n + case when a.s and x.n = 0 then 1 else 0 end::bigint}).n as n from g) where n > 0""",
    "q_table_rows": _with(_UP) + """, e as (select *, lag(x + w) over (partition by doc_id, page_index, column_index, baseline_y order by x, line_ord, word_ord) as e from cols)
      select doc_id, page_index, column_index, baseline_y, count(*) as n_items, sum(case when x - e >= 5 then 1 else 0 end)::bigint as n_gaps from e group by 1, 2, 3, 4 having n_items >= 3 and n_gaps >= 2""",
    "q_shared_boundaries": _with(_UP) + """, e as (select *, lag(x + w) over (partition by doc_id, page_index, column_index, baseline_y order by x, line_ord, word_ord) as e from cols),
      g as (select doc_id, page_index, column_index, baseline_y, (e + x) / 2 as centre from e where x - e >= 5),
      c as (select *, coalesce((centre - lag(centre) over (partition by doc_id, page_index, column_index order by centre, baseline_y) > 16)::int, 0) as cut from g),
      i as (select *, sum(cut) over (partition by doc_id, page_index, column_index order by centre, baseline_y rows unbounded preceding) as chain from c),
      n as (select doc_id, page_index, column_index, chain, count(*) as n from i group by all),
      b as (select doc_id, page_index, column_index, max(n) as best from n group by all),
      r as (select doc_id, page_index, column_index, count(distinct baseline_y) as n_rows from g group by all)
      select doc_id, page_index, column_index, n_rows, best, best >= greatest(2, ceil(n_rows * 0.6::double)) as shared from b join r using (doc_id, page_index, column_index)""",
    "q_geometry_trust": _with(_GRAPHICS) + """, s as (select doc_id, page_index, avg(((ord + page_index) % 2 = 0)::int) as share from graphics where ord < 5 group by all)
      select doc_id, page_index, coalesce(share, 1.0::double) as share, coalesce(share, 1.0::double) >= 0.5 as trusted from pages_ left join s using (doc_id, page_index)""",
    "q_self_check": _with(_BLOCKS) + """, v as (select *, case column_index when 0 then x < -1 or x + w > 460 else x < 458 or x + w > 919 end as over, (x < 459 and x + w > 0)::int + (x < 918 and x + w > 459)::int >= 2 as several,
        case when h > 0 then (lead(y) over w - y - h) / h end as space, lag(column_index) over (partition by doc_id, page_index order by read_order) as bc from blocks window w as (partition by doc_id, page_index, column_index order by read_order)),
      b as (select doc_id, page_index, count(*) as n_blocks, (count(*) filter (where over and several)) as spanning, (count(*) filter (where over and not several)) as out_of_column, floor(coalesce(quantile_cont(space, 0.5), 0) * 100 + 0.5) / 100 as median_gap,
        (count(*) filter (where space < 1)) as tight, not coalesce(bool_or(column_index < bc), false) as monotonic from v group by all),
      o as (select doc_id, page_index, (count(*) filter (where gap < -2)) as overlaps from before group by all),
      l as (select doc_id, page_index, count(*) as n_lines, floor(quantile_cont(h, 0.5) * 10 + 0.5) / 10 as line_height from lines group by all),
      c as (select doc_id, page_index, count(*) as n_items, sum(case when column_index = 0 then 1 else 0 end)::bigint as n_left, floor(quantile_cont(font_size, 0.5) * 10 + 0.5) / 10 as size from cols group by all)
      select * from c join b using (doc_id, page_index) join o using (doc_id, page_index) join l using (doc_id, page_index)""",
    "q_continuation": _with(_STYLE) + r""", e as (select doc_id, page_index, arg_max(text, read_order) filter (where heading_level = 0 and not formula) as tail, arg_min(text, read_order) as head, arg_min(heading_level = 0 and not formula, read_order) as plain
        from styled where is_body_text and translatable and not formula group by all),
      l as (select *, lag(tail) over w as before, lag(page_index) over w as pb from e window w as (partition by doc_id order by page_index))
      select doc_id, page_index, length(before) as tail_chars, length(head) as head_chars from l where pb = page_index - 1 and plain and regexp_matches(rtrim(before), '[A-Za-z0-9,;\-–—]$') and regexp_matches(ltrim(head), '^[a-z,;]')""",
    "q_overrides": _with(_STYLE) + f""", a as (select * replace (translatable and not formula as translatable), case when formula then 'formula' when numeric then 'numeric' end as reason, {_ANCHOR} as anchor, doc_id + page_index + block as n from styled),
      k as (select doc_id, anchor, max((['body','figure','formula','reference','auto','table'])[(n // 4) % 6 + 1]) filter (where (n // 4) % 6 <> 4) as kind from a where n % 4 = 0 group by all)
      select doc_id, page_index, read_order, anchor, kind,
        case kind when 'body' then true when 'figure' then false when 'table' then false else is_body_text end as eff_body,
        case when kind is null then translatable else kind = 'body' end as eff_translatable,
        case kind when 'body' then false when 'formula' then true else formula end as eff_formula,
        case kind when 'body' then null when 'figure' then 'graphics-region' when 'table' then 'table-region' else figure_reason end as eff_figure_reason,
        case kind when 'body' then null when 'formula' then 'formula' when 'reference' then 'references' else reason end as eff_reason
      from a left join k using (doc_id, anchor)""",
    "q_bbox_pairs_overlap": _with(_GRAPHICS) + """, g as (select doc_id, page_index, ord, x - 3 as x, y - 3 as y, w + 6 as w, h + 6 as h from graphics),
      p as (select a.doc_id, a.page_index, a.ord as a, b.ord as b, (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) as area, a.w * a.h as own
        from g a join g b on a.doc_id = b.doc_id and a.page_index = b.page_index and a.ord < b.ord and a.x < b.x + b.w and b.x < a.x + a.w and a.y < b.y + b.h and b.y < a.y + a.h)
      select doc_id, page_index, a, b, area, round(area / own, 6) as coverage from p""",
    "q_figure_clusters": _with(_GRAPHICS) + """ select doc_id, page_index, part as cluster, min(x + 40 * part) as x, min(y) as y, max(x + w) - min(x) as w, max(y + h) - min(y) as h, count(*) as n from graphics, (values (0), (10)) p(part) where ord < 5 group by all""",
    "q_formula_features": r"""select conv_id, turn, length(regexp_replace(text, '\s', '', 'g')) as n_chars, length(regexp_replace(text, '[^=+<>{}()±×÷∂∇−Ͱ-Ͽ←-⇿∀-⋿]', '', 'g')) as n_math,
      length(regexp_replace(text, '[^=+<>{}±×÷∂∇−Ͱ-Ͽ←-⇿∀-⋿]', '', 'g')) as n_strong,
      len(list_filter(regexp_extract_all(text, '[A-Za-z]{3,}'), lambda q: not list_contains(['sin','cos','tan','cot','sec','csc','log','ln','lg','exp','min','max','arg','sup','inf','det','dim','lim','mod','gcd','lcm','var','std','relu','sig','sgn','softmax'], lower(q)))) as long_words,
      regexp_matches(text, '\(([0-9]{1,3}[a-z]?)\)\s*\.?\s*$') as numbered from conversations""",
    "q_drawing_boxes": _LONG + """ select doc_id, i as ord, 'path' as kind, sum(n % 7) over (partition by doc_id order by i)::double as x, 2.0::double * (i + 1) as y, 4.0::double as w, (n % 5 + 1)::double as h from l""",
    "q_fnv_cache_key": "select doc_id, " + _FNV.format("text") + " as key from documents",
    "q_mask": r"""with m as (select doc_id, list_aggregate(list_transform(string_split_regex(text, '\d+'), lambda p, i: case when i > 1 then '[[MATH_' || (i - 2) || ']]' else '' end || p), 'string_agg', '') as m,
        len(regexp_extract_all(text, '\d+')) as n from documents)
      select doc_id, md5(case when doc_id % 3 = 0 then replace(m, '[[MATH_0]]', '') else m end) as masked_md5, n as n_pieces, not (doc_id % 3 = 0 and n > 0) as restored, (doc_id % 3 = 0 and n > 0)::bigint as missing from m""",
    "q_merge_masked": r"""with m as (select conv_id, turn, text, len(regexp_extract_all(text, '\d+')) as n from conversations),
      l as (select *, lag(text) over w as ht, lag(n) over w as hn from m window w as (partition by conv_id order by turn))
      select conv_id, turn, list_aggregate(list_transform(string_split_regex(ht, '\d+'), lambda p, i: case when i > 1 then '[[MATH_' || (i - 2 + n) || ']]' else '' end || p), 'string_agg', '') || ' ' ||
        list_aggregate(list_transform(string_split_regex(text, '\d+'), lambda p, i: case when i > 1 then '[[MATH_' || (i - 2) || ']]' else '' end || p), 'string_agg', '') as merged from l where ht is not null""",
    "q_quality": r"""with c as (select doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) as n from documents)
      select doc_id, case doc_id % 4 when 0 then 'empty' when 1 then case when n = 0 then 'empty' else 'no-cjk' end
        when 2 then case when n >= 40 and 4 < n then 'short' end else case when n >= 40 and 1800 > n * 5 then 'long' when n >= 40 and 3600 < n then 'short' end end as warning from c""",
    "q_cache_hits": "select doc_id, text in (select text from documents where doc_id % 2 = 0) as hit from documents",
    "q_run_summary": "select count(*) as total, (count(*) filter (where event_id % 4 = 0)) as done, (count(*) filter (where event_id % 4 = 1)) as cached, (count(*) filter (where event_id % 4 = 2)) as failed, (count(*) filter (where event_id % 4 = 3)) as cancelled, round((count(*) filter (where event_id % 4 = 1)) / count(*), 6) as hit_rate from events",
    "q_http_classify": """with e as (select ([200, 401, 403, 429, 500, 503, 404])[event_id % 7 + 1] as status, event_id % 3 + 1 as attempt from events),
      k as (select case when status in (401, 403) then 'auth' when status = 429 then 'rate-limit' when status >= 500 then 'server' else 'bad-request' end as kind, attempt from e where status <> 200)
      select kind, kind in ('rate-limit', 'server') as retryable, attempt, count(*) as n, sum(800.0::double * (1 << (attempt - 1)::int)) as wait_ms from k group by all""",
    "q_lru_keep": "select user_id::varchar as key, max(event_id) as at from events group by 1 order by max(event_id) desc, key limit 100",
    "q_library_filter": "with " + _PAPERS + " select id, title from papers where source = 'src3' and (contains(lower(title), 'the') or contains(lower(lang), 'the') or contains(lower(source), 'the'))",
    "q_scope_counts": "with " + _PAPERS + " select 'all' as scope, count(*) as n from papers union all select case when source = 'src7' then 'uncategorised' else source end, count(*) from papers group by 1",
    "q_tags_dedupe": """with t as (select doc_id::varchar as id, unnest([lang, upper(lang), ' ' || source, ' ']) as tag, generate_subscripts([1, 2, 3, 4], 1) as i from documents),
      f as (select id, lower(trim(tag)) as k, arg_min(trim(tag), i) as tag, min(i) as i from t where trim(tag) <> '' group by all)
      select id, string_agg(tag, '|' order by i) as tags from f group by id""",
    "q_dedup_papers": "select source, n_chars, max(doc_id) as doc_id from documents group by 1, 2",
    "q_upsert_latest": "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
    "q_delete_rows": "select c_custkey, c_nationkey from customer where c_custkey not in (select o_custkey from orders)",
    "q_stream_register": "select distinct user_id::varchar as id, 'x' as source from events",
    "q_stream_page_state": _LONG + """, g as (select *, max(case when n % 5 = 0 then i end) over w as o, max(case when n % 7 = 0 then i end) over w as c, max(n) over w as m
        from l window w as (partition by doc_id order by i))
      select doc_id, i as page_index, o is not null and (c is null or c <= o) as in_references, m::double as width_so_far from g""",
}
ORACLE_SQL["q_stream_continuation"] = ORACLE_SQL["q_continuation"]
_THREE = _COVER.replace("from items where", "from (select * replace (30.0::double + 290 * (line_ord % 3) + (x - case when x < 459 then 75 else 463 end) * 0.75::double as x) from items) where").replace("order by least, first) = 1", "order by least, first) <= 2")
ORACLE_SQL["q_three_columns"] = _with(_THREE) + """, s as (select *, row_number() over (partition by doc_id, page_index order by split_x) as column_index from gutters),
  c as (select up.doc_id, up.page_index, x, (select count(*) from s where s.doc_id = up.doc_id and s.page_index = up.page_index and split_x <= x + w / 2) as column_index from up)
  select doc_id, page_index, column_index, runs, l as left, split_x, least from (select doc_id, page_index, column_index, count(*) as runs, min(x) as l from c group by all) left join s using (doc_id, page_index, column_index)"""
