"""Page layout: columns, lines, paragraphs, styles and marks of positioned runs.

Everything is keyed by (doc_id, page_index), which one shuffle deals out; what follows reuses that partitioning.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions import geometry as G
from ..functions import text as X
from .assembly import PAGE, lines, paragraph_lines, paragraphs  # noqa: F401

#: What runs may overlap by, shares that body text, headings and figures are told by.
OVERLAP, SMALL, AMBIGUOUS, NARROW, TOUCHED = 2.0, 0.85, 1.05, 0.35, 0.6
BUCKET, SLIDE, LOW, SHORTEST = 2.0, 8, 0.3, 5


def upright(items: DataFrame) -> DataFrame:
    return items.where(~F.col("rotated"))


def column_coverage(items: DataFrame, width: float = 918.0) -> DataFrame:
    """Runs over each bucket of BUCKET px, zeros included: (page, bucket, n)."""
    last = int(width // BUCKET) - 1
    start = F.greatest(F.floor(F.col("x") / BUCKET), F.lit(0))
    stop = F.least(F.ceil((F.col("x") + F.col("w")) / BUCKET) - 1, F.lit(last))
    step = lambda bucket, d: F.struct(bucket.cast("long").alias("bucket"), F.lit(d).alias("d"))
    # counted as steps up and down at a run's ends, so a run makes two rows whatever its width
    ends = upright(items).where(stop >= start).select(*PAGE, F.explode(F.array(step(start, 1), step(stop + 1, -1))).alias("s"))
    every = F.transform(F.sequence(F.lit(0), F.lit(last)), lambda b: step(b, 0))
    page = ends.groupBy(*PAGE).agg(F.collect_list("s").alias("steps"))
    steps = page.select(*PAGE, F.inline(F.concat("steps", every))).groupBy(*PAGE, "bucket").agg(F.sum("d").alias("d")).where(F.col("bucket") <= last)
    running = Window.partitionBy(*PAGE).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(*PAGE, F.col("bucket").cast("int").alias("bucket"), F.sum("d").over(running).alias("n"))


def coverage_window(coverage: DataFrame) -> DataFrame:
    """Sums over SLIDE buckets from each on; the last SLIDE - 1 are dropped."""
    w = Window.partitionBy(*PAGE).orderBy("bucket")
    out = coverage.withColumn("total", F.sum("n").over(w.rowsBetween(0, SLIDE - 1))).withColumn("left", F.count("*").over(w.rowsBetween(0, SLIDE - 1)))
    return out.where(F.col("left") == SLIDE).select(*PAGE, "bucket", "total")


def gutters(slides: DataFrame, width: float = 918.0, most: int = 1) -> DataFrame:
    """The emptiest runs of low coverage per page, `most` of them, of SHORTEST buckets at least and centred within 15 to
    85 %: (page, n, split_x, least), n from 0 from left to right. Of equally empty runs the left one counts."""
    page = Window.partitionBy(*PAGE)
    low = slides.withColumn("peak", F.max("total").over(page)).withColumn("rank", F.row_number().over(page.orderBy("bucket")))
    low = low.where((F.col("peak") > 0) & (F.col("total") < LOW * F.col("peak"))).withColumn("run", F.col("rank") - F.row_number().over(page.orderBy("bucket")))
    runs = low.groupBy(*PAGE, "run").agg(F.min("bucket").alias("first"), F.max("bucket").alias("last"), F.min("total").alias("least"), F.count("*").alias("n"))
    split = (F.col("first") + F.col("last") + 1) / 2 * BUCKET
    runs = runs.where(F.col("n") >= SHORTEST).withColumn("split_x", split).where((F.col("split_x") > 0.15 * width) & (F.col("split_x") < 0.85 * width))
    best = runs.withColumn("k", F.row_number().over(page.orderBy("least", "first"))).where(F.col("k") <= max(1, most))
    return best.select(*PAGE, (F.row_number().over(page.orderBy("split_x")) - 1).alias("n"), "split_x", F.col("least").cast("long").alias("least"))


def page_splits(splits: DataFrame) -> DataFrame:
    """(page, splits): a page's gutters from left to right."""
    return splits.groupBy(*PAGE).agg(F.sort_array(F.collect_list("split_x")).alias("splits"))


def assign_columns(items: DataFrame, splits: DataFrame) -> DataFrame:
    """column_index of each run, by its centre: the number of the page's gutters up to there."""
    joined = upright(items).join(page_splits(splits), PAGE, "left")
    centre = F.col("x") + F.col("w") / 2
    return joined.withColumn("column_index", F.coalesce(F.size(F.filter("splits", lambda x: x <= centre)), F.lit(0))).drop("splits")


def body_font(items: DataFrame) -> DataFrame:
    """The quantised size with most characters per page; of equals, the one seen first."""
    sizes = upright(items).groupBy(*PAGE, G.half(F.col("font_size")).alias("body_font")).agg(F.sum(F.length("str")).alias("weight"), F.min(F.struct("line_ord", "word_ord")).alias("first"))
    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("weight"), "first"))
    return sizes.withColumn("k", k).where("k = 1").select(*PAGE, "body_font", "weight")


def heading_fonts(items: DataFrame, body: DataFrame) -> DataFrame:
    """Fonts whose median size is 1.15 times the body's or more."""
    fonts = upright(items).groupBy(*PAGE, "font_name").agg(F.percentile("font_size", F.lit(0.5)).alias("median"))
    return fonts.join(body, PAGE).where(F.col("median") >= 1.15 * F.col("body_font")).select(*PAGE, "font_name", "median")


def refined_body_font(blocks: DataFrame) -> DataFrame:
    """The second pass: the quantised size with most characters among body blocks, of equals the first in order; pages
    without body text have none."""
    own = blocks.where("is_body_text and length(text) > 0")
    sizes = own.groupBy(*PAGE, G.half(F.col("font_size")).alias("body_font")).agg(F.sum(F.length("text")).alias("weight"), F.min("read_order").alias("first"))
    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("weight"), "first"))
    return sizes.where("body_font > 0").withColumn("k", k).where("k = 1").select(*PAGE, "body_font", F.col("weight").cast("long").alias("weight"))


def rounded(c: Column, digits: int) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def heading_level(scale: Column, number: Column) -> Column:
    return F.when(number, 0).when(scale >= 1.3, 2).when(scale >= 1.06, 1).otherwise(0)


def with_column_range(blocks: DataFrame, bounds: Column) -> DataFrame:
    """Blocks with what those that cover their column alone span of it (left, right); null where none does.

    A window finds each covered column's range, another hands a page's few ranges to all its blocks: no join, so what
    blocks are made of is worked out once.
    """
    own = F.when(F.size("covered") == 1, F.get("covered", F.lit(0)))
    column, page = Window.partitionBy(*PAGE, "own"), Window.partitionBy(*PAGE)
    out = blocks.withColumn("covered", G.covered_columns(F.col("x"), F.col("w"), bounds)).withColumn("own", own)
    span = F.struct("own", F.min("x").over(column).alias("left"), F.max(F.col("x") + F.col("w")).over(column).alias("right"))
    out = out.withColumn("span", F.when(F.col("own").isNotNull(), span)).withColumn("spans_", F.collect_set("span").over(page))
    out = out.withColumn("span", F.get(F.filter("spans_", lambda r: r["own"] == F.col("column_index")), F.lit(0)))
    return out.withColumns({"left": F.col("span.left"), "right": F.col("span.right")}).drop("covered", "own", "span", "spans_")


def block_style(blocks: DataFrame, body: DataFrame, bounds: Column, headings: DataFrame | None = None, touched: DataFrame | None = None) -> DataFrame:
    """Scale, width ratio, gaps, bold, page numbers, heading level, body text and the reason against it.

    `bounds` are the page's column bounds (an array), `headings` its heading fonts, `touched` the share of each block's
    lines that graphics enclose (page, column_index, block, share): it counts for blocks whose size tells nothing.
    Comparisons take the values before they are rounded.
    """
    out = with_column_range(blocks, bounds).join(body.select(*PAGE, "body_font"), PAGE)
    width = F.when(F.col("left").isNotNull(), F.greatest(F.lit(1.0), F.col("right") - F.col("left"))).otherwise(F.col("w"))
    out = out.withColumn("scale", F.col("font_size") / F.col("body_font")).withColumn("ratio", F.col("w") / width)
    number = X.stripped(F.col("text")).rlike(X.PAGE_NUMBER)
    out = out.withColumn("numeric", number).withColumn("heading_level", heading_level(F.col("scale"), F.col("numeric")))
    if headings is not None:
        out = out.join(headings.select(*PAGE, F.col("font_name").alias("dominant_font"), F.lit(True).alias("is_bold")), [*PAGE, "dominant_font"], "left")
    wide = (F.col("heading_level") > 0) | (F.col("ratio") >= NARROW)
    inside = F.lit(False)
    if touched is not None:
        out = out.join(touched.select(*PAGE, "column_index", "block", F.col("share").alias("touched")), [*PAGE, "column_index", "block"], "left")
        inside = (F.col("scale") >= SMALL) & (F.col("scale") <= AMBIGUOUS) & wide & (F.coalesce("touched", F.lit(0.0)) >= TOUCHED)
    reason = F.when(F.col("scale") < SMALL, "font-size").when(inside, "graphics-region").when(~wide, "narrow")
    out = out.withColumn("figure_reason", reason).withColumn("is_body_text", F.col("figure_reason").isNull())
    bold = F.coalesce("is_bold", F.lit(False)) if headings is not None else F.lit(False)
    gaps = rounded(F.col("gap_count") / F.col("n_lines"), 2) if "gap_count" in blocks.columns else F.lit(0.0)
    return out.select(
        *[c for c in blocks.columns if c not in ("gap_count",)], rounded(F.col("scale"), 3).alias("font_scale"), rounded(F.col("ratio"), 2).alias("width_ratio"), gaps.alias("gaps_per_line"), bold.alias("bold"),
        "numeric", "heading_level", "figure_reason", "is_body_text", (~F.col("numeric")).alias("translatable"), F.when(F.col("numeric"), "numeric").alias("reason"),
    )


def refine_style(blocks: DataFrame, body: DataFrame) -> DataFrame:
    """Scale and heading level of body blocks anew, by the second pass's font; pages that have none stay as they are."""
    out = blocks.join(body.select(*PAGE, F.col("body_font").alias("again")), PAGE, "left")
    own = F.col("is_body_text") & F.col("again").isNotNull()
    out = out.withColumn("font_scale", F.when(own, rounded(F.col("font_size") / F.col("again"), 3)).otherwise(F.col("font_scale")))
    return out.withColumn("heading_level", F.when(own, heading_level(F.col("font_scale"), F.lit(False))).otherwise(F.col("heading_level"))).drop("again")


def _as_formula(blocks: DataFrame, hit: Column) -> DataFrame:
    out = blocks.withColumn("hit", hit).withColumn("formula", F.col("hit") | (F.col("formula") if "formula" in blocks.columns else F.lit(False)))
    return out.withColumn("translatable", F.col("translatable") & ~F.col("hit")).withColumn("reason", F.when(F.col("hit"), "formula").otherwise(F.col("reason"))).drop("hit")


def mark_formulas(blocks: DataFrame) -> DataFrame:
    """Translatable body blocks that are no headings and look like formulas; they are not translated."""
    s = X.signals(F.col("text"))
    hit = X.looks_like_formula(s["n_chars"], s["n_strong"], s["long_words"], s["numbered"], F.col("n_lines"))
    return _as_formula(blocks, F.col("is_body_text") & F.col("translatable") & (F.col("heading_level") == 0) & hit)


def absorb_fragments(blocks: DataFrame) -> DataFrame:
    """Short translatable body blocks, no headings, that overlap a formula of their column vertically by 2 px become formulas.

    A column's formulas are few, so each block looks through its column's in its own row: no join, one sort.
    """
    column = Window.partitionBy(*PAGE, "column_index")
    out = blocks.withColumn("all", F.collect_list(F.when(F.col("formula"), F.struct("y", "h"))).over(column))
    near = F.exists("all", lambda f: F.least(F.col("y") + F.col("h"), f["y"] + f["h"]) - F.greatest(F.col("y"), f["y"]) >= 2)
    short = (F.col("n_lines") <= 3) & (F.length("text") <= 40) & ~F.col("formula") & F.col("is_body_text") & F.col("translatable") & (F.col("heading_level") == 0)
    return _as_formula(out, short & near).drop("all")


def mark_references(blocks: DataFrame) -> DataFrame:
    """Whether a block lies in a reference section, in a document's reading order.

    A reference heading opens the section and stays outside it; while open, a heading that is not shaped like an
    entry closes it. A block that does one of both settles the state behind it; one that does both turns it round. So the
    state before a block is what the last settling block made it, turned as often as blocks have turned it since: running
    values over the document's blocks, of which no more than the running ones are ever held.
    """
    t = X.stripped(F.col("text"))
    opens = t.rlike(X.REFERENCE_HEADING) & ((F.col("font_scale") >= 1.05) | (F.col("heading_level") > 0))
    closes = (F.col("heading_level") > 0) & ~t.rlike(X.REFERENCE_ENTRY)
    order = Window.partitionBy("doc_id").orderBy("page_index", "read_order", "column_index", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = blocks.select(*PAGE, "column_index", "block", "read_order", opens.alias("opens"), closes.alias("closes"))
    rows = rows.withColumn("turns", F.sum((F.col("opens") & F.col("closes")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    settled_ = F.when(F.col("opens") != F.col("closes"), F.struct(F.col("opens").alias("on"), F.col("turns").alias("turns")))
    rows = rows.withColumns({"was": F.last(settled_, ignorenulls=True).over(before), "turned": F.coalesce(F.lag("turns").over(order), F.lit(0))})
    on, at = F.coalesce(F.col("was.on"), F.lit(False)), F.coalesce(F.col("was.turns"), F.lit(0))
    on = on != ((F.col("turned") - at) % 2 == 1)
    return rows.select(*PAGE, "column_index", "block", (on & ~F.col("closes")).alias("in_references"))


def front_matter(blocks: DataFrame, height: float = 1188.0) -> DataFrame:
    """First pages' blocks between the title and the abstract, or the first wide body block."""
    document = Window.partitionBy("doc_id")
    first = blocks.where("page_index = 0")  # only first pages have a title
    place = F.struct("font_scale", (-F.col("read_order")).alias("before"), "y")
    first = first.withColumn("title", F.max(F.when((F.col("y") <= 0.4 * height) & (F.col("font_scale") >= 1.3), place)).over(document))
    below = first.withColumns({"title_y": F.col("title.y"), "title_order": -F.col("title.before")}).where("y > title_y")
    body = (F.col("font_scale") < 1.15) & (F.col("width_ratio") >= 0.85) & (F.length("text") >= 80)
    limit = F.min(F.when(X.stripped(F.col("text")).rlike(X.ABSTRACT) | body, F.col("y"))).over(document)
    return below.withColumn("limit_y", limit).where("y < limit_y and read_order <> title_order").select("doc_id", "read_order", "y", "title_y", "limit_y")


def table_rows(items: DataFrame, least_gap: float = 12.0) -> DataFrame:
    """Lines with three runs and two wide gaps between runs: their gap centres."""
    w = Window.partitionBy(*PAGE, "column_index", "baseline_y").orderBy("x", "line_ord", "word_ord")
    end = F.lag(F.col("x") + F.col("w")).over(w)
    gaps = items.withColumn("end", end).groupBy(*PAGE, "column_index", "baseline_y").agg(F.count("*").alias("n_items"), F.sum(F.when(F.col("x") - F.col("end") >= least_gap, 1).otherwise(0)).alias("n_gaps"))
    return gaps.where("n_items >= 3 and n_gaps >= 2")


def row_gaps(items: DataFrame, least_gap: float = 12.0) -> DataFrame:
    """Centres of the wide gaps between neighbouring runs of a row."""
    w = Window.partitionBy(*PAGE, "column_index", "baseline_y").orderBy("x", "line_ord", "word_ord")
    gaps = items.withColumn("end", F.lag(F.col("x") + F.col("w")).over(w)).where(F.col("x") - F.col("end") >= least_gap)
    return gaps.select(*PAGE, "column_index", "baseline_y", ((F.col("end") + F.col("x")) / 2).alias("centre"))


def shared_boundaries(gaps: DataFrame, keys: list[str], tolerance: float = 16.0, ratio: float = 0.6) -> DataFrame:
    """Per group of rows: the longest chain of gap centres with steps up to the tolerance, and whether it carries a table.

    Chains count centres, so a row with two near centres counts twice.
    """
    w = Window.partitionBy(*keys).orderBy("centre", "baseline_y")
    cut = F.coalesce((F.col("centre") - F.lag("centre").over(w) > tolerance).cast("int"), F.lit(0))
    chain = F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0))
    best = gaps.withColumn("cut", cut).withColumn("chain", chain).groupBy(*keys, "chain").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("best"))
    rows = gaps.groupBy(*keys).agg(F.countDistinct("baseline_y").alias("n_rows"))
    needed = F.greatest(F.lit(2), F.ceil(F.col("n_rows") * ratio))
    return best.join(rows, keys).select(*keys, "n_rows", "best", (F.col("best") >= needed).alias("shared"))


def geometry_trust(pages: DataFrame, paths: DataFrame, least: float = 0.5) -> DataFrame:
    """Per page: the share of path boxes with ink under them (1 where there are none), and whether it is enough."""
    share = paths.groupBy(*PAGE).agg(F.avg(F.coalesce(F.col("ink"), F.lit(False)).cast("int")).alias("share"))
    out = pages.select(*PAGE).distinct().join(share, PAGE, "left").withColumn("share", F.coalesce("share", F.lit(1.0)))
    return out.select(*PAGE, "share", (F.col("share") >= least).alias("trusted"))


def self_check(items: DataFrame, lines_: DataFrame, blocks: DataFrame, bounds: Column) -> DataFrame:
    """Per page: counts, runs by column, blocks beyond their column, gaps between blocks, overlaps in lines, order."""
    w = Window.partitionBy(*PAGE, "column_index").orderBy("read_order")
    own, after = F.get(bounds, F.col("column_index")), F.get(bounds, F.col("column_index") + 1)
    over = (F.col("x") < own - 1) | (F.col("x") + F.col("w") > after + 1)
    several = F.size(G.covered_columns(F.col("x"), F.col("w"), bounds)) >= 2
    ratio = F.when(F.col("h") > 0, (F.lead("y").over(w) - F.col("y") - F.col("h")) / F.col("h")).when(F.lead("y").over(w).isNotNull(), 0.0)
    b = blocks.withColumns({"spans_": over & several, "beyond": over & ~several, "space": ratio, "before": F.lag("column_index").over(Window.partitionBy(*PAGE).orderBy("read_order"))})
    some = lambda c: F.sum(F.coalesce(c.cast("int"), F.lit(0)))
    b = b.groupBy(*PAGE).agg(
        F.count("*").alias("n_blocks"), some(F.col("spans_")).alias("spanning"), some(F.col("beyond")).alias("out_of_column"),
        F.coalesce(F.percentile("space", F.lit(0.5)), F.lit(0.0)).alias("gap"), some(F.col("space") < 1).alias("tight"), some(F.col("column_index") < F.col("before")).alias("back"),
    )
    overlaps = F.size(F.filter("gaps", lambda g: g["gap"] < -OVERLAP))
    l = lines_.groupBy(*PAGE).agg(F.count("*").alias("n_lines"), F.sum(overlaps).alias("overlaps"), F.percentile("h", F.lit(0.5)).alias("line_height"))
    counts = items.groupBy(*PAGE).agg(F.count("*").alias("n_items"), F.sum(F.when(F.col("column_index") == 0, 1).otherwise(0)).alias("n_left"), F.percentile("font_size", F.lit(0.5)).alias("size"))
    out = counts.join(l, PAGE).join(b, PAGE)
    return out.select(
        *PAGE, "n_items", "n_left", "n_lines", "n_blocks", "spanning", "out_of_column", F.col("overlaps").cast("long").alias("overlaps"), rounded(F.col("gap"), 2).alias("median_gap"),
        "tight", (F.col("back") == 0).alias("monotonic"), rounded(F.col("line_height"), 1).alias("line_height"), rounded(F.col("size"), 1).alias("size"),
    )


def page_ends(blocks: DataFrame) -> DataFrame:
    """(page, tail, head, head_plain): the last paragraph that the next page may go on with, and the first block that may
    go on from the page before, with whether it is a paragraph.

    Both are translatable body text, no headings and no formulas; the first one is the page's first translatable body
    block, whatever it is, and then has to pass.
    """
    body = blocks.where("is_body_text and translatable")
    plain = (F.col("heading_level") == 0) & ~F.col("formula")
    tail = F.max_by(F.when(plain, F.col("text")), F.when(plain, F.col("read_order")))
    head = F.min_by(F.struct("text", plain.alias("plain")), "read_order")
    return body.groupBy(*PAGE).agg(tail.alias("tail"), head.alias("head")).select(*PAGE, "tail", F.col("head.text").alias("head"), F.col("head.plain").alias("head_plain"))


def continuations(blocks: DataFrame) -> DataFrame:
    """Pages whose last paragraph runs on into the next page's first."""
    w = Window.partitionBy("doc_id").orderBy("page_index")
    out = page_ends(blocks).withColumn("before", F.lag("tail").over(w)).withColumn("page_before", F.lag("page_index").over(w))
    hit = (F.col("page_before") == F.col("page_index") - 1) & F.col("head_plain") & F.rtrim("before").rlike(X.OPEN_END) & F.ltrim("head").rlike(X.CONTINUES)
    return out.where(hit).select("doc_id", "page_index", F.length("before").cast("long").alias("tail_chars"), F.length("head").cast("long").alias("head_chars"))


def apply_overrides(blocks: DataFrame, overrides: DataFrame) -> DataFrame:
    """Effective marks (eff_*) beside the automatic ones, which stay, so applying twice changes nothing and taking an
    override back restores them.

    `overrides` are (doc_id, anchor, kind), of one anchor the greatest kind; `auto` and blocks without a row keep what is
    automatic. Columns that the blocks lack count as body text, translatable, no formula and no reason.
    """
    missing = {"is_body_text": F.lit(True), "translatable": F.lit(True), "formula": F.lit(False), "figure_reason": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")}
    own = blocks.withColumns({c: v for c, v in missing.items() if c not in blocks.columns})
    keyed = own.withColumn("anchor", X.anchor(F.col("page_index"), F.col("text")))
    wanted = overrides.where("kind <> 'auto'").groupBy("doc_id", "anchor").agg(F.max("kind").alias("kind"))
    out = keyed.join(wanted, ["doc_id", "anchor"], "left")
    kind = F.coalesce(F.col("kind"), F.lit("auto"))
    region = F.when(kind == "figure", "graphics-region").when(kind == "table", "table-region")
    return out.withColumns({
        "eff_body": F.when(kind == "body", True).when(region.isNotNull(), False).otherwise(F.col("is_body_text")),
        "eff_translatable": F.when(kind == "body", True).when(kind.isin("figure", "table", "formula", "reference"), False).otherwise(F.col("translatable")),
        "eff_formula": F.when(kind == "body", False).when(kind == "formula", True).otherwise(F.col("formula")),
        "eff_figure_reason": F.when(kind != "body", F.coalesce(region, "figure_reason")),
        "eff_reason": F.when(kind == "formula", "formula").when(kind == "reference", "references").when(kind != "body", F.col("reason")),
    })


def overlapping_pairs(boxes: DataFrame, pad: float = 0.0, band: float = 64.0) -> DataFrame:
    """Pairs of a page's boxes that overlap once grown by pad; a band of y is an equi key, so no nested loop is planned."""
    x, y, w, h = G.expanded(G.box(), pad)
    keyed = boxes.select(*PAGE, "ord", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"))
    banded = keyed.withColumn("band", F.explode(F.sequence(F.floor(F.col("y") / band), F.floor((F.col("y") + F.col("h")) / band))))
    a, b = banded.alias("a"), banded.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*PAGE, "band")]
    left, right = G.box("a."), G.box("b.")
    pairs = a.join(b, on).where((F.col("a.ord") < F.col("b.ord")) & G.overlaps(left, right))
    return pairs.select("a.doc_id", "a.page_index", F.col("a.ord").alias("a"), F.col("b.ord").alias("b"), G.shared_area(left, right).alias("area"), F.round(G.coverage(left, right), 6).alias("coverage")).distinct()


@F.pandas_udf(ArrayType(IntegerType()))
def _least_reached(ords: pd.Series, edges: pd.Series) -> pd.Series:
    """For each of a page's numbers the least that its edges lead to, by a forest whose roots are the least."""
    out = []
    for own, pairs in zip(ords, edges, strict=True):
        up = {n: n for n in own}

        def root(n: int, up: dict = up) -> int:
            while up[n] != n:
                up[n] = n = up[up[n]]
            return n

        for e in pairs if pairs is not None else ():
            a, b = root(e["a"]), root(e["b"])
            up[max(a, b)] = min(a, b)
        out.append([root(n) for n in own])
    return pd.Series(out)


def box_clusters(boxes: DataFrame, distance: float = 6.0) -> DataFrame:
    """(page, ord, cluster) of boxes that are connected by less than `distance`; a cluster is named by its least box.

    Pairs come from a banded join; a page's boxes and pairs are then one row, and time goes with their number.
    """
    pairs = overlapping_pairs(boxes, distance / 2).groupBy(*PAGE).agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    page = boxes.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.col("ord").cast("int"))).alias("ords")).join(pairs, PAGE, "left")
    edges = F.coalesce(F.col("pairs"), F.array().cast("array<struct<a:int,b:int>>")).cast("array<struct<a:int,b:int>>")
    labelled = page.withColumn("clusters", _least_reached("ords", edges))
    return labelled.select(*PAGE, F.explode_outer(F.arrays_zip("ords", "clusters")).alias("z")).select(*PAGE, F.col("z.ords").alias("ord"), F.col("z.clusters").alias("cluster"))


def figure_clusters(boxes: DataFrame, distance: float = 6.0, least: int = 4) -> DataFrame:
    """Clusters of `least` boxes or more, with their box and count."""
    named = box_clusters(boxes, distance)
    return boxes.join(named, [*PAGE, "ord"]).groupBy(*PAGE, "cluster").agg(*G.union_box(), F.count("*").alias("n")).where(F.col("n") >= least)
