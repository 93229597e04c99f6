"""The registered queries of the layout, enrichment, catalogue and stream operators, with their DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..operators import enrich, layout, library, regions
from ..operators.settled import settled, shared_folder
from ..sources import adapter, drawing
from ..streaming import pages as streams
from . import analysis, catalogue
from .oracle import ORACLE_SQL as LAYOUT_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = catalogue.QUERIES | analysis.QUERIES
ORACLE_SQL: dict[str, str] = LAYOUT_SQL | catalogue.ORACLE_SQL | analysis.ORACLE_SQL


def _query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _read(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def _items(s: SparkSession, d: str) -> DataFrame:
    return adapter.items(_read(s, d, "documents"))


def _columned(s: SparkSession, d: str) -> DataFrame:
    """Runs with the adapter's own column."""
    return layout.upright(_items(s, d)).withColumn("column_index", F.when(F.col("x") < 459, 0).otherwise(1))


def _blocks(s: SparkSession, d: str) -> DataFrame:
    return layout.paragraphs(layout.lines(_columned(s, d), spans=False))


def _bounds() -> Column:
    """Bounds of the adapter's two columns."""
    return F.array(F.lit(0.0), F.lit(459.0), F.lit(918.0))


def _styled(s: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    items = _items(s, d) if items is None else items
    body = layout.body_font(items)
    columned = layout.upright(items).withColumn("column_index", F.when(F.col("x") < 459, 0).otherwise(1))
    blocks = layout.paragraphs(layout.lines(columned, spans=False))
    return layout.mark_formulas(layout.block_style(blocks, body, _bounds(), layout.heading_fonts(items, body)))


def _graphics(s: SparkSession, d: str) -> DataFrame:
    return adapter.graphics(_items(s, d).select("doc_id", "page_index").distinct())


def _papers(s: SparkSession, d: str) -> DataFrame:
    doc = _read(s, d, "documents")
    return doc.select(F.col("doc_id").cast("string").alias("id"), F.split("text", "\n")[0].alias("title"), F.array(F.col("source")).alias("collection_ids"), F.array("lang", F.upper("lang"), F.concat(F.lit(" "), F.col("source")), F.lit(" ")).alias("tags"), F.col("n_chars").alias("last_opened_at"))


@_query
def q_items(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d)


@_query
def q_not_rotated(s: SparkSession, d: str) -> DataFrame:
    return layout.upright(_items(s, d)).groupBy("doc_id", "page_index").agg(F.count("*").alias("n"))


@_query
def q_page_bounds(s: SparkSession, d: str) -> DataFrame:
    return _items(s, d).groupBy("doc_id", "page_index").agg(*G.union_box())


@_query
def q_column_coverage(s: SparkSession, d: str) -> DataFrame:
    return layout.column_coverage(_items(s, d)).where("n > 0")


@_query
def q_coverage_window(s: SparkSession, d: str) -> DataFrame:
    return layout.coverage_window(layout.column_coverage(_items(s, d))).where("total > 0")


@_query
def q_gutters(s: SparkSession, d: str) -> DataFrame:
    return layout.gutters(layout.coverage_window(layout.column_coverage(_items(s, d)))).drop("n")


@_query
def q_three_columns(s: SparkSession, d: str) -> DataFrame:
    """Lines dealt over three columns of 290 px: up to two gutters a page, and each column's runs."""
    offset = F.col("x") - F.when(F.col("x") < 459, F.lit(75.0)).otherwise(F.lit(463.0))
    items = _items(s, d).withColumn("x", 30.0 + 290 * (F.col("line_ord") % 3) + offset * 0.75)
    found = layout.gutters(layout.coverage_window(layout.column_coverage(items)), most=2)
    runs = layout.assign_columns(items, found).groupBy("doc_id", "page_index", "column_index").agg(F.count("*").alias("runs"), F.min("x").alias("left"))
    return runs.join(found.withColumn("column_index", F.col("n") + 1).drop("n"), ["doc_id", "page_index", "column_index"], "left")


@_query
def q_assign_columns(s: SparkSession, d: str) -> DataFrame:
    items = _items(s, d)
    out = layout.assign_columns(items, layout.gutters(layout.coverage_window(layout.column_coverage(items))))
    return out.groupBy("doc_id", "page_index", "column_index").agg(F.count("*").alias("n"), F.max("x").alias("x_max"))


@_query
def q_lines(s: SparkSession, d: str) -> DataFrame:
    return layout.lines(_columned(s, d), spans=False).select("doc_id", "page_index", "column_index", "line_index", "text", "x", "y", "w", "h", "baseline_y", "font_size", "n_items", "n_gaps")


@_query
def q_paragraphs(s: SparkSession, d: str) -> DataFrame:
    return _blocks(s, d).select("doc_id", "page_index", "column_index", "block", "text", "x", "y", "w", "h", "font_size", "n_lines", "gap_count", "dominant_font", "read_order")


@_query
def q_body_font(s: SparkSession, d: str) -> DataFrame:
    return layout.body_font(_items(s, d))


@_query
def q_heading_fonts(s: SparkSession, d: str) -> DataFrame:
    items = _items(s, d)
    return layout.heading_fonts(items, layout.body_font(items))


@_query
def q_block_style(s: SparkSession, d: str) -> DataFrame:
    return _styled(s, d).select("doc_id", "page_index", "column_index", "block", "font_scale", "width_ratio", "gaps_per_line", "bold", "numeric", "heading_level", "figure_reason", "is_body_text")


@_query
def q_formula_features(s: SparkSession, d: str) -> DataFrame:
    c = _read(s, d, "conversations").select("conv_id", "turn", F.col("text").alias("t"))
    return c.select("conv_id", "turn", *[v.alias(k) for k, v in X.signals(F.col("t")).items()])


@_query
def q_formula_mark(s: SparkSession, d: str) -> DataFrame:
    # with lines that read like formulas, as prose has none
    return layout.absorb_fragments(_styled(s, d, analysis._items(s, d))).where("formula").select("doc_id", "page_index", "column_index", "block")


@_query
def q_reference_intervals(s: SparkSession, d: str) -> DataFrame:
    # every fifth document's second block stands in for the heading, so that sections open
    b = _styled(s, d).withColumn("text", F.when((F.col("doc_id") % 5 == 0) & (F.col("read_order") == 1), "References").otherwise(F.col("text")))
    b = b.withColumn("font_scale", F.when(F.col("text") == "References", 1.2).otherwise(F.col("font_scale")))
    return layout.mark_references(b).where("in_references").groupBy("doc_id").agg(F.count("*").alias("n"))


@_query
def q_front_matter(s: SparkSession, d: str) -> DataFrame:
    return layout.front_matter(_styled(s, d))


@_query
def q_table_rows(s: SparkSession, d: str) -> DataFrame:
    return layout.table_rows(_columned(s, d), 5.0)


@_query
def q_shared_boundaries(s: SparkSession, d: str) -> DataFrame:
    return layout.shared_boundaries(layout.row_gaps(_columned(s, d), 5.0), ["doc_id", "page_index", "column_index"])


@_query
def q_geometry_trust(s: SparkSession, d: str) -> DataFrame:
    # ink under every box whose number, added to the page's, is even; lone rules do not count as paths
    paths = _graphics(s, d).where("ord < 5").withColumn("ink", (F.col("ord") + F.col("page_index")) % 2 == 0)
    return layout.geometry_trust(_items(s, d), paths)


@_query
def q_self_check(s: SparkSession, d: str) -> DataFrame:
    items = _columned(s, d)
    lines = layout.lines(items, spans=False)
    return layout.self_check(items, lines, layout.paragraphs(lines), _bounds())


@_query
def q_continuation(s: SparkSession, d: str) -> DataFrame:
    return layout.continuations(_styled(s, d))


@_query
def q_overrides(s: SparkSession, d: str) -> DataFrame:
    # every fourth block is overridden, by one kind or another; the rest has no row
    b = settled(_styled(s, d))
    n = F.col("doc_id") + F.col("page_index") + F.col("block")
    kinds = F.element_at(F.array(*map(F.lit, ("body", "figure", "formula", "reference", "auto", "table"))), (F.floor(n / 4) % 6 + 1).cast("int"))
    own = b.where(n % 4 == 0).select("doc_id", X.anchor(F.col("page_index"), F.col("text")).alias("anchor"), kinds.alias("kind"))
    out = layout.apply_overrides(b, own)
    return out.select("doc_id", "page_index", "read_order", "anchor", "kind", "eff_body", "eff_translatable", "eff_formula", "eff_figure_reason", "eff_reason")


@_query
def q_bbox_pairs_overlap(s: SparkSession, d: str) -> DataFrame:
    return layout.overlapping_pairs(_graphics(s, d), 3.0)


@_query
def q_figure_clusters(s: SparkSession, d: str) -> DataFrame:
    # each frame a second time, 400 px to the right, as boxes 10 to 15
    g = _graphics(s, d)
    return layout.figure_clusters(g.unionByName(g.withColumns({"x": F.col("x") + 400, "ord": F.col("ord") + 10})))


@_query
def q_merge_overlapping(s: SparkSession, d: str) -> DataFrame:
    return regions.merge_overlapping(_graphics(s, d))


@_query
def q_drawing_boxes(s: SparkSession, d: str) -> DataFrame:
    # each document's lines as a program: a translation and a box per line
    lines = _read(s, d, "documents").select("doc_id", F.lit(0).alias("page_index"), F.posexplode(F.split("text", "\n")).alias("i", "l"))
    n = F.length("l")
    move = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), (n % 7).cast("double"), F.lit(2.0))
    rect = F.array(F.lit(0.0), F.lit(0.0), F.lit(4.0), (n % 5 + 1).cast("double"))
    ops = lines.select("doc_id", "page_index", "i", F.posexplode(F.array(F.struct(F.lit("transform").alias("fn"), move.alias("args")), F.struct(F.lit("path").alias("fn"), rect.alias("args")))).alias("k", "o"))
    return drawing.drawing_boxes(ops.select("doc_id", "page_index", (2 * F.col("i") + F.col("k")).alias("seq"), "o.fn", "o.args")).select("doc_id", "ord", "kind", "x", "y", "w", "h")


@_query
def q_fnv_cache_key(s: SparkSession, d: str) -> DataFrame:
    return _read(s, d, "documents").select("doc_id", X.cache_key("mock", "m", "zh", 1, F.col("text")).alias("key"))


@_query
def q_mask(s: SparkSession, d: str) -> DataFrame:
    # every third document loses its first marker, as a translation may
    m, p = X.masked(F.col("text"), r"\d+")
    m = F.when(F.col("doc_id") % 3 == 0, F.replace(m, F.lit("[[MATH_0]]"), F.lit(""))).otherwise(m)
    out = _read(s, d, "documents").select("doc_id", "text", m.alias("masked"), p.alias("pieces"))
    return out.select("doc_id", F.md5("masked").alias("masked_md5"), F.size("pieces").cast("long").alias("n_pieces"), (X.unmasked(F.col("masked"), F.col("pieces")) == F.col("text")).alias("restored"), X.missing_markers(F.col("masked"), F.col("pieces")).alias("missing"))


@_query
def q_merge_masked(s: SparkSession, d: str) -> DataFrame:
    m, p = X.masked(F.col("text"), r"\d+")
    c = _read(s, d, "conversations").select("conv_id", "turn", m.alias("m"), F.size(p).alias("n"))
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = c.withColumn("hm", F.lag("m").over(w)).withColumn("hn", F.lag("n").over(w)).where("hm is not null")
    return out.select("conv_id", "turn", X.merge_masked(F.col("hm"), F.col("hn"), F.col("m"), F.col("n")).alias("merged"))


@_query
def q_quality(s: SparkSession, d: str) -> DataFrame:
    docs = _read(s, d, "documents").select("doc_id", F.col("text").alias("source"))
    k = F.col("doc_id") % 4
    target = F.when(k == 0, "").when(k == 1, F.col("source")).when(k == 2, "短").otherwise(F.repeat(F.lit("长"), 900))
    return docs.select("doc_id", X.quality_warning(F.col("source"), target).alias("warning"))


@_query
def q_mock_translate(s: SparkSession, d: str) -> DataFrame:
    docs = _read(s, d, "documents").select("doc_id", F.col("text").alias("source"))
    out = docs.withColumn("target", enrich.mock_translation(F.col("source")))
    return out.select("doc_id", F.length("target").alias("n"), X.quality_warning(F.col("source"), F.col("target")).alias("warning"))


@_query
def q_cache_hits(s: SparkSession, d: str) -> DataFrame:
    docs = _read(s, d, "documents").select("doc_id", F.col("text").alias("source"))
    key = {"provider": "mock", "model": "m", "language": "zh", "prompt": 1}
    cache = docs.where("doc_id % 2 = 0").select(X.cache_key(text=F.col("source"), **key).alias("key")).distinct().withColumn("text", F.lit("x"))
    out = enrich.split_by_cache(docs, cache, **key)
    return out.select("doc_id", F.col("cached").isNotNull().alias("hit"))


@_query
def q_run_summary(s: SparkSession, d: str) -> DataFrame:
    state = F.element_at(F.array(*map(F.lit, ("done", "cached", "failed", "cancelled"))), (F.col("event_id") % 4 + 1).cast("int"))
    return enrich.run_summary(_read(s, d, "events").select(state.alias("state")))


@_query
def q_http_classify(s: SparkSession, d: str) -> DataFrame:
    status = F.element_at(F.array(*map(F.lit, (200, 401, 403, 429, 500, 503, 404))), (F.col("event_id") % 7 + 1).cast("int"))
    e = _read(s, d, "events").select(status.alias("status"), (F.col("event_id") % 3 + 1).alias("attempt"))
    kind = X.error_kind(F.col("status"))
    return e.where("status <> 200").groupBy(kind.alias("kind"), X.retryable(kind).alias("retryable"), "attempt").agg(F.count("*").alias("n"), F.sum(X.backoff_ms(F.col("attempt"))).alias("wait_ms"))


@_query
def q_lru_keep(s: SparkSession, d: str) -> DataFrame:
    e = _read(s, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("at"))
    return library.keep_recent(e, 100)


@_query
def q_library_filter(s: SparkSession, d: str) -> DataFrame:
    return library.filter_papers(_papers(s, d), "src3", " The").select("id", "title")


@_query
def q_scope_counts(s: SparkSession, d: str) -> DataFrame:
    return library.scope_counts(library.delete_collection(_papers(s, d), "src7"))


@_query
def q_tags_dedupe(s: SparkSession, d: str) -> DataFrame:
    return _papers(s, d).select("id", F.array_join(library.distinct_tags(F.col("tags")), "|").alias("tags"))


@_query
def q_dedup_papers(s: SparkSession, d: str) -> DataFrame:
    docs = _read(s, d, "documents").select("doc_id", "source", "n_chars")
    return library.latest(docs, ["source", "n_chars"], ["doc_id"])


@_query
def q_upsert_latest(s: SparkSession, d: str) -> DataFrame:
    e = _read(s, d, "events").select("user_id", "event_id", "event_type", "value")
    return library.latest(e, ["user_id"], ["event_id"])


@_query
def q_delete_rows(s: SparkSession, d: str) -> DataFrame:
    gone = _read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return library.without(_read(s, d, "customer").select("c_custkey", "c_nationkey"), gone, ["c_custkey"])


@_query
def q_stream_register(s: SparkSession, d: str) -> DataFrame:
    schema = _read(s, d, "events").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    return streams.run_available(streams.register(stream.select(F.col("user_id").cast("string").alias("id"), F.lit("x").alias("source"))))


@_query
def q_stream_page_state(s: SparkSession, d: str) -> DataFrame:
    schema = _read(s, d, "documents").schema
    stream = s.readStream.schema(schema).parquet(f"{d}/documents.parquet*")
    page = stream.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_index", "l"))
    n, none = F.length("l"), F.lit(None).cast("string")
    pages = page.select("doc_id", "page_index", (n % 5 == 0).alias("heads"), (n % 7 == 0).alias("closes"), n.cast("double").alias("width"), none.alias("tail"), none.alias("head"), F.lit(False).alias("head_plain"))
    return streams.run_available(streams.ordered_pages(pages)).select("doc_id", "page_index", "in_references", "width_so_far")


@_query
def q_stream_continuation(s: SparkSession, d: str) -> DataFrame:
    """The pages' ends as a stream of several shuffled files; its paragraphs that go on are those of q_continuation."""
    blocks = settled(_styled(s, d))
    every = blocks.groupBy("doc_id").agg(F.max("page_index").alias("last")).select("doc_id", F.explode(F.sequence(F.lit(0), "last")).alias("page_index"), F.lit(0.0).alias("width"))
    pages = every.join(layout.page_ends(blocks), ["doc_id", "page_index"], "left").withColumns({"heads": F.lit(False), "closes": F.lit(False), "head_plain": F.coalesce("head_plain", F.lit(False))})
    folder = f"{shared_folder(s)}/pages-{uuid.uuid4().hex}"
    pages.repartition(4, F.xxhash64("page_index", "doc_id")).write.parquet(folder)
    stream = s.readStream.schema(pages.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    return streams.going_on(streams.run_available(streams.ordered_pages(stream)))
