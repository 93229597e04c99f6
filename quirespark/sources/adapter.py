"""The layout adapter: documents as positioned text runs.

Words are laid out in two columns of 60 rows a page. Coordinates are halves, so results are exact in doubles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

PAGE_WIDTH, PAGE_HEIGHT = 918.0, 1188.0
ROWS, WIDTH, TOP, PITCH = 60, 240, 90.0, 16.0
LEFT = (75.0, 463.0)


@F.arrow_udf(ArrayType(IntegerType()))
def _begins(words: pa.Array) -> pa.Array:
    """Where each word of a line begins, in characters, with a blank behind each word."""
    n = pc.list_value_length(words).to_numpy(zero_copy_only=False)
    sizes = pc.utf8_length(pc.list_flatten(words)).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    edges = np.concatenate(([0], np.cumsum(n)))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    return pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ends[:-1] - np.repeat(ends[edges[:-1]], n), pa.int32()))


def _lines(documents: DataFrame, begins: Column) -> DataFrame:
    """Lines with words: size, words, what `begins` makes of them as `at`, and the row of the document that they begin in."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_ord", "line")).where(F.length(F.trim("line")) > 0)
    n = F.col("doc_id") + F.col("line_ord")
    size = F.when(F.col("line_ord") == 0, 16.0).when(n % 11 == 0, 6.0).when(n % 7 == 0, 9.0).otherwise(10.0)
    words = F.filter(F.split("line", " "), lambda w: w != "")
    lines = lines.select("doc_id", "line_ord", size.alias("font_size"), words.alias("words")).where(F.size("words") > 0)
    lines = lines.withColumn("at", begins)
    lines = lines.withColumn("n_rows", F.floor(F.element_at("at", -1) * F.col("font_size") / 2 / WIDTH) + 1)
    before = Window.partitionBy("doc_id").orderBy("line_ord").rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("row0", F.coalesce(F.sum(F.col("n_rows") + 1).over(before), F.lit(0)))


def items(documents: DataFrame) -> DataFrame:
    """Runs of (doc_id, page_index): line and word ordinals, box, baseline, size, font, rotated."""
    runs = _lines(documents, _begins("words")).select("doc_id", "line_ord", "font_size", "row0", "at", F.posexplode("words").alias("word_ord", "str"))
    runs = runs.withColumn("c", F.get("at", F.col("word_ord")) * F.col("font_size") / 2).withColumn("v", F.floor(F.col("c") / WIDTH))
    runs = runs.withColumn("row", F.col("row0") + F.col("v"))
    in_page = F.col("row") % (2 * ROWS)
    column = F.floor(in_page / ROWS)
    baseline = TOP + PITCH * (in_page % ROWS)
    n = F.col("doc_id") + F.col("line_ord")
    font = F.when(F.col("font_size") == 16, "NimbusRomNo9L-Medi").when(F.col("font_size") == 9, "NimbusRomNo9L-ReguItal").otherwise("NimbusRomNo9L-Regu")
    return runs.select(
        "doc_id",
        F.floor(F.col("row") / (2 * ROWS)).cast("int").alias("page_index"),
        "line_ord", "word_ord",
        "str",
        (F.when(column == 0, LEFT[0]).otherwise(LEFT[1]) + F.col("c") - F.col("v") * WIDTH).alias("x"),
        (baseline - F.col("font_size")).alias("y"),
        (F.length("str") * F.col("font_size") / 2).alias("w"),
        F.col("font_size").alias("h"),
        baseline.alias("baseline_y"),
        "font_size",
        font.alias("font_name"),
        (n % 97 == 0).alias("rotated"),
    )


def graphics(pages: DataFrame) -> DataFrame:
    """Five frame boxes on two of three pages of (doc_id, page_index), and a lone rule on each."""
    frame = [(100.0, 100.0, 80.0, 40.0), (100.0, 145.0, 80.0, 40.0), (95.0, 100.0, 2.0, 85.0), (183.0, 100.0, 2.0, 85.0), (100.0, 190.0, 80.0, 1.0), (500.0, 700.0, 200.0, 1.0)]
    boxes = F.array(*[F.struct(F.lit(k).alias("ord"), *[F.lit(v).alias(n) for n, v in zip("xywh", b, strict=True)]) for k, b in enumerate(frame)])
    rows = pages.select("doc_id", "page_index", F.explode(boxes).alias("b")).where((F.col("page_index") % 3 > 0) | (F.col("b.ord") == 5))
    return rows.select("doc_id", "page_index", "b.ord", (F.col("b.x") + 10 * F.col("page_index")).alias("x"), "b.y", "b.w", "b.h")


#: The same runs in DuckDB SQL.
ITEMS_SQL = """
raw_lines as (
  select doc_id, i - 1 as line_ord, l as line from (
    select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i
    from documents) where length(trim(l, ' ')) > 0),
sized as (
  select doc_id, line_ord, list_filter(string_split(line, ' '), lambda w: w <> '') as words,
    case when line_ord = 0 then 16.0::double when (doc_id + line_ord) % 11 = 0 then 6.0::double
      when (doc_id + line_ord) % 7 = 0 then 9.0::double else 10.0::double end as font_size from raw_lines),
words as (
  select doc_id, line_ord, font_size, unnest(words) as str, generate_subscripts(words, 1) - 1 as word_ord from sized),
offsets as (
  select *, coalesce(sum((length(str) + 1) * font_size / 2) over (partition by doc_id, line_ord order by word_ord
      rows between unbounded preceding and 1 preceding), 0)::double as c from words),
line_rows as (
  select doc_id, line_ord, floor(max(c) / 240)::bigint + 2 as used from offsets group by all),
starts as (
  select doc_id, line_ord, coalesce(sum(used) over (partition by doc_id order by line_ord
      rows between unbounded preceding and 1 preceding), 0)::bigint as row0 from line_rows),
placed as (
  select o.*, floor(c / 240)::bigint as v, row0 + floor(c / 240)::bigint as row from offsets o join starts using (doc_id, line_ord)),
items as (
  select doc_id, (row // 120)::int as page_index, line_ord::int as line_ord, word_ord::int as word_ord, str,
    case when (row % 120) // 60 = 0 then 75.0 else 463.0 end::double + c - v * 240 as x,
    90.0::double + 16.0::double * (row % 60) - font_size as y, length(str) * font_size / 2 as w, font_size as h,
    90.0::double + 16.0::double * (row % 60) as baseline_y, font_size,
    case font_size when 16 then 'NimbusRomNo9L-Medi' when 9 then 'NimbusRomNo9L-ReguItal' else 'NimbusRomNo9L-Regu' end as font_name,
    (doc_id + line_ord) % 97 = 0 as rotated from placed)
"""
