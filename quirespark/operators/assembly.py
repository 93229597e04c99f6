"""Lines and blocks of a column: texts with their joins, styled spans, and the splits of reference lists and indents.

A page's runs are gathered once per column; what follows is worked in the row of a line or block, so that only lines and
blocks move on. Offsets are counted in characters of the assembled text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X

PAGE = ["doc_id", "page_index"]
COLUMN = [*PAGE, "column_index"]
SPANS = "array<struct<start:int,stop:int,bold:boolean,italic:boolean,script:string,math:boolean>>"
STYLE = ("bold", "italic", "script", "math")
#: Shares of sizes and gaps that lines, blocks and entries are told by.
SAME_LINE, SPACE_GAP, WIDE_GAP, MATH_SHARE = 0.5, 0.15, 0.3, 0.4
BREAK_GAP, LEAST_GAP, SIZE_BREAK = 1.6, 0.25, 0.2
INDENT, HANGING, FLUSH = 0.8, 0.5, 0.25


def middle(values: Column) -> Column:
    """Median of an array: of an even number of values the mean of the middle two; 0 for none."""

    def of(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2).otherwise(0.0)

    return _let(F.sort_array(values), of)


def _let(value: Column, body) -> Column:
    """Evaluates `value` once for a body that uses it several times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def joined_runs(spans: Column, add) -> Column:
    """A fold over spans that joins neighbours of one style that lie within a character of each other."""

    def step(out: Column, s: Column) -> Column:
        def grown(last: Column) -> Column:
            same = (F.size(out) > 0) & (s["start"] - last["stop"] <= 1)
            for c in STYLE:
                same &= last[c].eqNullSafe(s[c])
            longer = F.struct(last["start"].alias("start"), s["stop"].alias("stop"), *[s[c].alias(c) for c in STYLE])
            return F.when(same, F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), longer)).otherwise(F.array_append(out, s))

        return _let(F.get(out, F.size(out) - 1), grown)

    return F.aggregate(F.transform(spans, add), F.array().cast(SPANS), step)


def with_traits(items: DataFrame, fonts: DataFrame | None = None) -> DataFrame:
    """Runs with bold, italic and math_font, from a font table (font_name, bold, italic) or else from the fonts' names;
    a font that the table lacks is regular."""
    name = F.col("font_name") if "font_name" in items.columns else F.lit(None).cast("string")
    bold, italic, math = X.font_traits(name)
    if fonts is None:
        return items.withColumns({"bold": bold, "italic": italic, "math_font": math})
    known = fonts.select("font_name", F.col("bold").alias("b"), F.col("italic").alias("i")).dropDuplicates(["font_name"])
    out = items.join(known, "font_name", "left")
    no = F.lit(False)
    return out.withColumns({"bold": F.coalesce("b", no), "italic": F.coalesce("i", no), "math_font": math}).drop("b", "i")


def lines(items: DataFrame, spans: bool = True) -> DataFrame:
    """Lines of a column: runs in order of baseline whose baseline is within half the median size of the line's first.

    The comparison is with the line's first run, not the previous one, so it is a fold over the ordered runs. Each line
    has its text, spans, box, median size, the number of its runs, of its gaps of over 0.3 sizes, its fonts' characters
    in order, its runs' sizes and the centres of the gaps between its runs. Spans cost more than all else, so who does not
    read them leaves them out; blocks of such lines have none either.
    """
    if spans and "math_font" not in items.columns:
        items = with_traits(items)
    font = F.col("font_name") if "font_name" in items.columns else F.lit("")
    style = ("bold", "italic", "math_font") if spans else ()
    run = F.struct("baseline_y", "x", "line_ord", "word_ord", "str", "w", "h", "y", "font_size", *style, font.alias("font_name"))
    columns = items.groupBy(*COLUMN).agg(F.sort_array(F.collect_list(run)).alias("runs"))

    def begins(median: Column) -> Column:
        """Places where a line begins. Runs of the baseline before them never begin one, so the fold is over the others."""
        apart = lambda r, i: F.coalesce(r["baseline_y"] - F.get("runs", i - 1)["baseline_y"] != 0, F.lit(True))
        fresh = F.filter(F.transform("runs", lambda r, i: F.when(apart(r, i), F.struct(i.alias("i"), r["baseline_y"].alias("b")))), lambda f: f.isNotNull())
        return F.aggregate(
            fresh,
            F.struct(F.lit(None).cast("double").alias("first"), F.array().cast("array<int>").alias("at")),
            lambda s, f: F.when(s["first"].isNull() | (F.abs(f["b"] - s["first"]) > SAME_LINE * median), F.struct(f["b"].alias("first"), F.array_append(s["at"], f["i"]).alias("at"))).otherwise(s),
            lambda s: s["at"],
        )

    # what a lambda reads is made by _let: the optimizer writes a column that is read once into the lambda, to be made each time
    columns = columns.withColumn("at", _let(middle(F.transform("runs", lambda r: r["font_size"])), begins))
    cut = F.transform("at", lambda a, k: F.slice(F.col("runs"), a + 1, F.coalesce(F.get(F.col("at"), k + 1), F.size("runs")) - a))
    # no column is without lines; the outer form keeps the optimizer from working the fold out twice for a filter
    out = columns.select(*COLUMN, F.posexplode_outer(cut).alias("line_index", "runs"))
    ordered = F.sort_array(F.transform("runs", lambda r: F.struct(r["x"].alias("x"), r["line_ord"].alias("line_ord"), r["word_ord"].alias("word_ord"), r.alias("r"))))
    out = out.withColumn("runs", F.transform(ordered, lambda p: p["r"]))
    out = out.withColumn("font_size", middle(F.transform("runs", lambda r: r["font_size"])))

    def spaced(r: Column, i: Column) -> Column:
        p = F.get(F.col("runs"), i - 1)
        hyphen = p["str"].endswith("-") & r["str"].rlike("^[a-z]")
        wide = r["x"] - (p["x"] + p["w"]) > F.col("font_size") * SPACE_GAP
        bare = p["str"].endswith(" ") | r["str"].startswith(" ") | X.cjk_last(p["str"]) | X.cjk_first(r["str"])
        return (i > 0) & wide & ~hyphen & ~bare

    out = out.withColumn("pieces", F.transform("runs", lambda r, i: F.when(spaced(r, i), F.concat(F.lit(" "), r["str"])).otherwise(r["str"])))
    out = out.withColumn("raw", F.array_join("pieces", "")).withColumn("text", X.stripped(F.col("raw")))
    if spans:
        out = _with_spans(out)

    def gap(r: Column, i: Column) -> Column:
        p = F.get(F.col("runs"), i - 1)
        return F.when(i > 0, F.struct((r["x"] - p["x"] - p["w"]).alias("gap"), ((r["x"] + p["x"] + p["w"]) / 2).alias("centre")))

    gaps = F.filter(F.transform("runs", gap), lambda g: g.isNotNull())
    least, most = (lambda f: F.array_min(F.transform("runs", f))), (lambda f: F.array_max(F.transform("runs", f)))
    return out.withColumn("gaps", gaps).select(
        *COLUMN, "line_index", "text", *(["spans"] if spans else []), least(lambda r: r["x"]).alias("x"), least(lambda r: r["y"]).alias("y"),
        (most(lambda r: r["x"] + r["w"]) - least(lambda r: r["x"])).alias("w"), (most(lambda r: r["y"] + r["h"]) - least(lambda r: r["y"])).alias("h"),
        F.get("runs", F.lit(0))["baseline_y"].alias("baseline_y"), "font_size", F.size("runs").cast("long").alias("n_items"),
        F.size(F.filter("gaps", lambda g: g["gap"] > F.when(F.col("font_size") > 0, F.col("font_size")).otherwise(1.0) * WIDE_GAP)).cast("long").alias("n_gaps"),
        F.transform("runs", lambda r: F.struct(r["font_name"].alias("name"), F.length(r["str"]).alias("n"))).alias("fonts"), F.transform("runs", lambda r: r["font_size"]).alias("sizes"), "gaps",
    )


def _with_spans(out: DataFrame) -> DataFrame:
    """Lines with the styled spans of their runs, on the text without its outer white space."""
    out = out.withColumn("largest", F.array_max(F.transform("runs", lambda r: r["font_size"])))
    out = out.withColumn("main", F.get(F.filter("runs", lambda r: r["font_size"] >= F.col("largest") * 0.95), F.lit(0))["baseline_y"])

    piece = lambda i: F.get("pieces", i)

    def script(r: Column) -> Column:
        near = F.abs(r["baseline_y"] - F.col("main")) <= F.greatest(F.col("largest") * 0.06, F.lit(0.3))
        return F.when((r["font_size"] < F.col("largest") * 0.85) & ~near, F.when(r["baseline_y"] > F.col("main"), "sub").otherwise("sup"))

    def styled(r: Column, i: Column) -> Column:
        s = script(r)
        math = s.isNotNull() | r["math_font"] | (X.math_ratio(r["str"]) >= MATH_SHARE)
        return F.struct((F.length(piece(i)) - F.length(r["str"])).alias("space"), F.length(r["str"]).alias("n"), r["bold"].alias("bold"), r["italic"].alias("italic"), s.alias("script"), math.alias("math"))

    def place(s: Column, p: Column) -> Column:
        start, stop = s["k"] + p["space"], s["k"] + p["space"] + p["n"]
        return F.struct(stop.alias("k"), F.array_append(s["out"], F.struct(start.alias("start"), stop.alias("stop"), *[p[c].alias(c) for c in STYLE])).alias("out"))

    def moved(s: Column) -> Column:
        start, stop = F.greatest(s["start"] - F.col("lead"), F.lit(0)), F.least(s["stop"] - F.col("lead"), F.length("text"))
        return F.struct(start.alias("start"), stop.alias("stop"), *[s[c].alias(c) for c in STYLE])

    placed = F.aggregate(F.transform("runs", styled), F.struct(F.lit(0).alias("k"), F.array().cast(SPANS).alias("out")), place, lambda s: s["out"])
    out = out.withColumn("lead", F.length("raw") - F.length(F.regexp_replace("raw", rf"^{X.SPACE}+", "")))
    return out.withColumn("spans", F.filter(joined_runs(placed, moved), lambda s: s["stop"] > s["start"]))


def paragraph_lines(lines_: DataFrame) -> DataFrame:
    """Lines with the number of their block within the column.

    Large gaps and changes of size open a group. A group with three or more rising entry numbers is split at them; one
    of four lines or more where few lines stand flush and others hang behind them is split at the flush ones; any other
    of four lines or more where a line is indented from the edge that most lines share.
    """
    column, order = Window.partitionBy(*COLUMN), Window.partitionBy(*COLUMN).orderBy("line_index")
    out = lines_.withColumn("gap", F.col("y") - F.lag(F.col("y") + F.col("h")).over(order)).withColumn("was", F.lag("font_size").over(order))
    out = out.withColumn("usual", F.coalesce(F.percentile(F.when(F.col("gap") > 0, F.col("gap")), F.lit(0.5)).over(column), F.lit(0.0)))
    out = out.withColumn("height", F.coalesce(F.nullif(F.percentile("h", F.lit(0.5)).over(column), F.lit(0.0)), F.lit(1.0)))
    breaks = (F.col("gap") > F.greatest(BREAK_GAP * F.col("usual"), LEAST_GAP * F.col("height"))) | ((F.col("was") > 0) & (F.abs(F.col("font_size") - F.col("was")) > SIZE_BREAK * F.col("was")))
    out = out.withColumn("opens", F.coalesce(breaks, F.lit(False))).withColumn("g", F.sum(F.col("opens").cast("int")).over(order))

    group = Window.partitionBy(*COLUMN, "g")
    inside = group.orderBy("line_index")
    number = F.regexp_extract("text", X.ENTRY_NUMBER, 1)
    out = out.withColumn("number", F.when(number != "", number.cast("int")))
    highest = F.max("number").over(inside.rowsBetween(Window.unboundedPreceding, -1))
    out = out.withColumn("entry", F.col("number").isNotNull() & (F.col("number") > F.coalesce(highest, F.lit(-1))))
    out = out.withColumn("edge", F.floor(F.col("x") / 2 + 0.5) * 2)
    same = Window.partitionBy(*COLUMN, "g", "edge")
    out = out.withColumn("alike", F.struct(F.count("*").over(same).alias("n"), (-F.min("line_index").over(same)).alias("first"), "edge"))
    out = out.withColumn("size", F.coalesce(F.nullif(F.percentile("font_size", F.lit(0.5)).over(group), F.lit(0.0)), F.lit(1.0))).withColumn("left", F.min("x").over(group))
    flush, deep = F.col("x") <= F.col("left") + F.col("size") * FLUSH, F.col("x") > F.col("left") + F.col("size") * HANGING
    some = lambda c: F.sum(c.cast("int")).over(group)
    out = out.withColumns({"n": F.count("*").over(group), "n_entries": some(F.col("entry")), "n_flush": some(flush), "n_deep": some(deep), "shared": F.max("alike").over(group)["edge"]})
    hanging = (F.col("n_flush") >= 2) & (2 * F.col("n_flush") < F.col("n")) & (F.col("n_deep") >= 2)
    begins = F.when(F.col("n_entries") >= 3, F.col("entry")).when(F.col("n") < 4, F.lit(False)).when(hanging, flush).otherwise(F.col("x") > F.col("shared") + F.col("size") * INDENT)
    first = F.row_number().over(inside) == 1
    out = out.withColumn("cut", (F.col("opens") | (begins & ~first)).cast("int"))
    return out.withColumn("block", F.sum("cut").over(order)).select(*lines_.columns, "block")


def blocks_of(numbered: DataFrame) -> DataFrame:
    """Blocks of numbered lines: hyphens at line ends are undone before small letters, other lines are joined by a space
    unless one of them is Chinese, Japanese or Korean there; spans, where lines have them, move along."""
    styled = ["spans"] if "spans" in numbered.columns else []
    line = F.struct("line_index", "text", *styled, "fonts", "sizes")
    out = numbered.groupBy(*COLUMN, "block").agg(F.sort_array(F.collect_list(line)).alias("ls"), *G.union_box(), F.count("*").alias("n_lines"), F.sum("n_gaps").cast("long").alias("gap_count"))

    def part(l: Column, i: Column) -> Column:
        p, n = F.get(F.col("ls"), i - 1)["text"], F.get(F.col("ls"), i + 1)["text"]
        undone = (i > 0) & p.endswith("-") & l["text"].rlike("^[a-z]")
        follows = F.coalesce(l["text"].endswith("-") & n.rlike("^[a-z]"), F.lit(False))
        space = (i > 0) & ~undone & ~X.cjk_last(p) & ~X.cjk_first(l["text"])
        own = F.when(follows, F.substring(l["text"], F.lit(1), F.length(l["text"]) - 1)).otherwise(l["text"])
        return F.struct(F.when(space, 1).otherwise(0).alias("space"), own.alias("text"), *[l[c].alias(c) for c in styled])

    out = out.withColumn("parts", F.transform("ls", part))
    if styled:
        out = _with_moved_spans(out)
    text = F.array_join(F.transform("parts", lambda p: F.concat(F.repeat(F.lit(" "), p["space"]), p["text"])), "")
    sizes = F.flatten(F.transform("ls", lambda l: l["sizes"]))
    fonts = F.flatten(F.transform("ls", lambda l: l["fonts"]))
    return out.select(
        *COLUMN, F.col("block").cast("long").alias("block"), text.alias("text"), *styled, "x", "y", "w", "h", middle(sizes).alias("font_size"), "n_lines", "gap_count", dominant_font(fonts).alias("dominant_font"),
        (F.col("column_index") * 10000 + F.col("block")).cast("long").alias("read_order"),
    )


def _with_moved_spans(out: DataFrame) -> DataFrame:
    """Blocks with their lines' spans, each moved by where its line begins in the block's text."""
    base = lambda s, p: F.struct((s["k"] + p["space"] + F.length(p["text"])).alias("k"), F.array_append(s["out"], s["k"] + p["space"]).alias("out"))
    bases = F.aggregate("parts", F.struct(F.lit(0).alias("k"), F.array().cast("array<int>").alias("out")), base, lambda s: s["out"])

    def moved(p: Column, at: Column) -> Column:
        return F.transform(p["spans"], lambda s: F.struct((at + s["start"]).alias("start"), (at + F.least(s["stop"], F.length(p["text"]))).alias("stop"), *[s[c].alias(c) for c in STYLE]))

    shifted = _let(bases, lambda b: F.flatten(F.transform("parts", lambda p, i: moved(p, F.get(b, i)))))
    return out.withColumn("spans", F.filter(joined_runs(shifted, lambda s: s), lambda s: s["stop"] > s["start"]))


def dominant_font(fonts: Column) -> Column:
    """The font of most characters, of equals the one seen first."""

    def of(fs: Column) -> Column:
        names = F.array_distinct(F.transform(fs, lambda f: f["name"]))
        weight = lambda n: F.aggregate(F.filter(fs, lambda f: f["name"].eqNullSafe(n)), F.lit(0), lambda s, f: s + f["n"])
        return F.array_max(F.transform(names, lambda n, i: F.struct(weight(n).alias("n"), (-i).alias("i"), n.alias("name"))))["name"]

    return _let(fonts, of)


def paragraphs(lines_: DataFrame) -> DataFrame:
    """The blocks of a column's lines."""
    return blocks_of(paragraph_lines(lines_))


def rendered(text: Column, spans: Column) -> Column:
    """A text as HTML by its spans; what no span covers is plain. `&`, `<` and `>` of the text are escaped."""
    safe = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    plain = lambda a, b: safe(F.substring(text, a + 1, b - a))

    def chunk(s: Column) -> Column:
        out = plain(s["start"], s["stop"])
        out = F.when(s["italic"], F.concat(F.lit("<em>"), out, F.lit("</em>"))).otherwise(out)
        out = F.when(s["bold"], F.concat(F.lit("<strong>"), out, F.lit("</strong>"))).otherwise(out)
        return F.when(s["script"].isNotNull(), F.concat(F.lit("<"), s["script"], F.lit(">"), out, F.lit("</"), s["script"], F.lit(">"))).otherwise(out)

    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def add(s: Column, p: Column) -> Column:
        between = F.when(p["start"] > s["at"], plain(s["at"], p["start"])).otherwise("")
        return state(p["stop"], F.concat(s["out"], between, chunk(p)))

    def close(s: Column) -> Column:
        return F.concat(s["out"], F.when(s["at"] < F.length(text), plain(s["at"], F.length(text))).otherwise(""))

    return F.aggregate(spans, state(F.lit(0), F.lit("")), add, close)


def math_ranges(text: Column, spans: Column) -> Column:
    """Ranges of mathematical spans, clipped to the text, in order; those that overlap are one."""
    kind = "array<struct<start:int,stop:int>>"
    clipped = lambda s: F.struct(F.greatest(s["start"], F.lit(0)).alias("start"), F.least(s["stop"], F.length(text)).alias("stop"))
    own = F.filter(F.transform(F.filter(spans, lambda s: s["math"]), clipped), lambda r: r["stop"] > r["start"])

    def step(out: Column, r: Column) -> Column:
        def grown(last: Column) -> Column:
            longer = F.struct(last["start"].alias("start"), F.greatest(last["stop"], r["stop"]).alias("stop"))
            return F.when((F.size(out) > 0) & (r["start"] < last["stop"]), F.array_append(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), longer)).otherwise(F.array_append(out, r))

        return _let(F.get(out, F.size(out) - 1), grown)

    return F.aggregate(F.sort_array(own), F.array().cast(kind), step)


def masked_math(text: Column, spans: Column) -> Column:
    """struct(masked, pieces): the text with numbered markers for its mathematical ranges, and their texts."""
    ranges = math_ranges(text, spans)
    cut = lambda a, b: F.substring(text, a + 1, b - a)

    def of(r: Column) -> Column:
        pieces = F.transform(r, lambda p: cut(p["start"], p["stop"]))
        before = F.transform(r, lambda p, i: F.concat(cut(F.when(i > 0, F.get(r, i - 1)["stop"]).otherwise(0), p["start"]), F.lit("[[MATH_"), i.cast("string"), F.lit("]]")))
        rest = cut(F.coalesce(F.get(r, F.size(r) - 1)["stop"], F.lit(0)), F.length(text))
        return F.struct(F.concat(F.array_join(before, ""), rest).alias("masked"), pieces.alias("pieces"))

    return _let(ranges, of)
