"""Assembly, tables, figures and the flow on small pages with known answers, and catalogue queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from quirespark.functions import text as X
from quirespark.operators import assembly, crosspage, enrich, figures, flow, layout, pages, store, tables
from quirespark.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
RUNS = "doc_id long, page_index int, column_index int, line_ord int, word_ord int, str string, x double, y double, w double, h double, baseline_y double, font_size double, font_name string"
BOX = "doc_id long, page_index int, x double, y double, w double, h double"
CATALOGUE = ["q_add_papers", "q_set_progress", "q_create_collections", "q_override_state", "q_cache_newer_half", "q_base64", "q_run_geometry", "q_covered_columns", "q_translate_run", "q_mask_spans", "q_render_spans", "q_table_groups", "q_enclosed", "q_region_covers_block"]


@pytest.mark.parametrize("name", CATALOGUE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    value = lambda v: round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) else v
    rows = lambda xs, at: sorted(repr(tuple(value(x[at[c]]) for c in cols)) for x in xs)
    assert rows(got.collect(), {c: c for c in cols}) == rows(want.fetchall(), {c: want.columns.index(c) for c in cols}) != []


def line(y, words, x=75.0, column=0, size=10.0, gap=5.0, ord_=None):
    out = []
    for k, w in enumerate(words):
        text, font, own, drop = (w, "Regu", size, 0.0) if isinstance(w, str) else w
        out.append((1, 0, column, int(y) if ord_ is None else ord_, k, text, x, y + drop - own, len(text) * own / 2, own, y + drop, own, font))
        x += len(text) * own / 2 + gap
    return out


def test_hyphens_scripts_and_spaces(spark):
    runs = line(100.0, ["Learn-", "ing", ("x", "CMMI10", 10.0, 0.0), ("i", "CMMI7", 7.0, 2.0), "net-"]) + line(112.0, ["works", "中", "文"])
    lines = assembly.lines(spark.createDataFrame(runs, RUNS))
    assert [r.text for r in lines.orderBy("line_index").collect()] == ["Learn-ing x i net-", "works中文"]
    block = assembly.paragraphs(lines).first()
    assert block.text == "Learn-ing x i networks中文" and [(s.start, s.stop, s.script, s.math) for s in block.spans] == [(0, 9, None, False), (10, 11, None, True), (12, 13, "sub", True), (14, 24, None, False)]


def test_entry_and_indent_splits(spark):
    def blocks(rows):
        runs = [r for k, (x, text) in enumerate(rows) for r in line(100.0 + 12 * k, [text], x=x)]
        return [b.text for b in assembly.paragraphs(assembly.lines(spark.createDataFrame(runs, RUNS))).orderBy("block").collect()]

    assert blocks([(75.0, "[1]_a"), (75.0, "b"), (75.0, "[2]_c"), (75.0, "[1]_no"), (75.0, "[3]_d")]) == ["[1]_a b", "[2]_c [1]_no", "[3]_d"]
    assert blocks([(75.0, "A"), (90.0, "b"), (90.0, "c"), (75.0, "D"), (90.0, "e")]) == ["A b c", "D e"]
    assert blocks([(90.0, "A"), (75.0, "b"), (75.0, "c"), (90.0, "D"), (75.0, "e"), (75.0, "f")]) == ["A b c", "D e f"]
    assert blocks([(75.0, "[1]_a"), (90.0, "b"), (75.0, "[2]_c")]) == ["[1]_a b [2]_c"]


def test_tables_with_headers_and_halves(spark):
    runs = []
    for col, x in ((0, 75.0), (1, 463.0)):
        runs += line(80.0, ["Head", "of", "it"], x=x, column=col, gap=70.0) if col else line(80.0, ["Top1", "err"], x=x, column=col, gap=150.0)
        for k in range(4):
            runs += line(100.0 + 16 * k, ["a1", "b2", "c3"], x=x, column=col, gap=80.0)
    lines = assembly.lines(spark.createDataFrame(runs, RUNS)).withColumn("block", F.lit(0).cast("long"))
    blocks = lines.select(*assembly.COLUMN, "block").distinct().withColumns({"formula": F.lit(False), "reason": F.lit(None).cast("string"), "heading_level": F.lit(0)})
    body = spark.createDataFrame([(1, 0, 10.0)], "doc_id long, page_index int, body_font double")
    own = tables.candidates(lines, blocks, body)
    groups = tables.row_groups(own)
    assert sorted((r.column_index, r.n, r.best) for r in groups.collect()) == [(0, 4, 4), (1, 5, 5)]
    found = tables.table_regions(lines, blocks, body).collect()
    assert [(r.x, r.n_rows) for r in found] == [(73.0, 10)] and found[0].y < 80.0
    assert tables.in_step([1, 2, 3], [1.5, 2, 9]) and not tables.in_step([1, 2, 3, 4], [1, 9]) and not tables.in_step([1], [1])


def test_figures(spark):
    paths = [(1, 0, k, 100.0 + 15 * k, 100.0, 10.0, 10.0) for k in range(4)] + [(1, 0, 9, 500.0, 500.0, 5.0, 5.0)]
    p = spark.createDataFrame(paths, "doc_id long, page_index int, ord int, x double, y double, w double, h double")
    assert [(r.x, r.w, r.n) for r in figures.clusters(p).collect()] == [(100.0, 55.0, 4)]
    assert figures.figure_paths(p).count() == 4 and figures.figure_paths(p, crowded=4).count() == 5
    lines = spark.createDataFrame([(1, 0, 1, 112.0, 101.0, 2.0, 8.0), (1, 0, 2, 700.0, 100.0, 9.0, 9.0)], "doc_id long, page_index int, k int, x double, y double, w double, h double")
    assert {(r.k, r.enclosed) for r in figures.enclosed(lines, ["k"], p, 5.0).collect()} == {(1, True), (2, False)}
    assert figures.grown([[0, 0, 10, 10]], [(30, 0, 40, 10), (60, 0, 70, 10), (200, 0, 210, 10)]) == [[0, 0, 70, 10]]


def flow_of(spark, blocks, figs=(), paths=(), tabs=()):
    kind = BOX + ", column_index int, block long, read_order long, is_body_text boolean, formula boolean, font_size double"
    b = spark.createDataFrame([(1, 0, float(x), float(y), float(w), float(h), c, k, c * 10000 + k, body, form, 10.0) for k, (x, y, w, h, c, body, form) in enumerate(blocks)], kind)
    box = lambda rows: spark.createDataFrame([(1, 0, *map(float, r)) for r in rows], BOX)
    bounds = spark.createDataFrame([(1, 0, [0.0, 459.0, 918.0])], "doc_id long, page_index int, bounds array<double>")
    made = flow.page_flow(b, box(tabs), box(figs), box(paths), bounds)
    return [(r.column_index, r.kind, r.y, r.y + r.h, r.block) for r in made.orderBy("column_index", "seq").collect()], made, b


def test_flow(spark):
    got, *_ = flow_of(spark, [(75, 100, 300, 50, 0, True, False), (75, 300, 300, 50, 0, True, False), (500, 100, 300, 50, 1, True, False)], paths=[(100, 180, 50, 60)])
    assert got == [(0, "text", 100, 150, 0), (0, "slice", 150, 300, -1), (0, "text", 300, 350, 1), (1, "text", 100, 150, 2)]
    # a formula is a slice of its own, padded by 3.5, and takes in what overlaps it
    got, *_ = flow_of(spark, [(75, 100, 300, 50, 0, True, False), (100, 200, 200, 12, 0, True, True), (120, 205, 30, 12, 0, False, False)])
    assert got == [(0, "text", 100, 150, 0), (0, "slice", 196.5, 217, -1)]
    # a table over both columns stands in the first; blocks centred in it are its own
    got, made, b = flow_of(spark, [(75, 100, 300, 50, 0, True, False), (80, 210, 100, 10, 0, True, False), (500, 400, 300, 50, 1, True, False)], tabs=[(70, 200, 700, 100)])
    assert got == [(0, "text", 100, 150, 0), (0, "slice", 200, 300, -1), (1, "text", 400, 450, 2)]
    stats = flow.flow_stats(made, b, made.limit(0).select("doc_id", "page_index", "x", "y", "w", "h"), b.limit(0)).first()
    assert (stats.n_slices, stats.n_texts, stats.widest, stats.n_twice) == (1, 2, 700.0, 1)


def test_store(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"abc")
    (tmp_path / "b.txt").write_bytes(b"d")
    assert [bytes(r.content) for r in store.document_source(spark, "file", str(tmp_path), "*.pdf").collect()] == [b"abc"]
    spark.createDataFrame([("1", "x"), ("2", "y")], "id string, title string").write.parquet(str(tmp_path / "papers"))
    assert [r.title for r in store.document_source(spark, "library", str(tmp_path / "papers"), "2").collect()] == ["y"]
    assert 400 <= enrich.wait_ms("a", 1, None, 800) < 800 and enrich.wait_ms("a", 3, 250.0, 800) == 250.0
    assert [r.x for r in spark.createDataFrame([("QUJD",), ("QU JD\n",), ("QQ==",), ("Q=Q",), ("!",), ("",)], "s string").select(store.from_base64(F.col("s")).alias("x")).collect()] == [b"ABC", b"ABC", b"A", None, None, b""]
    ids = store.unregistered(spark.range(5), spark.createDataFrame([(1,), (1,)], "id long"))
    assert sorted(r.id for r in ids.collect()) == [0, 2, 3, 4]


def test_continuation_needs_plain_text(spark):
    kind = "doc_id long, page_index int, read_order long, text string, is_body_text boolean, translatable boolean, heading_level int, formula boolean"
    rows = [(1, 0, 0, "ends open", True, True, 0, False), (1, 0, 1, "Heading", True, True, 1, False), (1, 1, 0, "goes on", True, True, 0, False), (2, 0, 0, "ends open", True, True, 0, False), (2, 1, 0, "a heading", True, True, 1, False), (2, 1, 1, "goes on", True, True, 0, False)]
    assert [(r.doc_id, r.page_index) for r in layout.continuations(spark.createDataFrame(rows, kind)).collect()] == [(1, 1)]


BLOCKS = BOX + f", column_index int, block long, read_order long, text string, spans {assembly.SPANS}, is_body_text boolean, translatable boolean, heading_level int, formula boolean, font_size double, bold boolean, font_scale double, reason string"


def paged(page, k, text, spans=(), heading=0, y=None, body=True, translatable=True):
    marks = [(a, b, False, False, None, True) for a, b in spans]
    return (1, page, 75.0, 100.0 + 60 * k if y is None else y, 300.0, 50.0, 0, k, k, text, marks, body, translatable, heading, False, 10.0, False, 1.0, None)


def test_units_over_page_ends(spark):
    """Page 0 ends open with two formulas, page 1 goes on with one and ends open, page 2 goes on; page 4 has no page 3."""
    rows = [
        paged(0, 0, "Title", heading=1), paged(0, 1, "so a=b and c=d then", [(3, 6), (11, 14)]),
        paged(1, 0, "we get x=y, which", [(7, 10)]), paged(2, 0, "ends here."), paged(2, 1, "is open"), paged(4, 0, "goes on"),
        paged(5, 0, "A new start"),
    ]
    blocks = spark.createDataFrame(rows, BLOCKS)
    units = crosspage.continued_units(blocks)
    got = {r.page_index: r for r in units.collect()}
    assert got.keys() == {1, 2}
    one = got[1]
    assert (one.column_index, one.block, one.tail_column, one.tail_block) == (0, 0, 0, 1) and one.text == "so a=b and c=d then we get x=y, which"
    assert one.masked == "so [[MATH_1]] and [[MATH_2]] then we get [[MATH_0]], which" and one.pieces == ["x=y", "a=b", "c=d"]
    assert [one.text[s.start : s.stop] for s in one.spans] == ["a=b", "c=d", "x=y"]
    assert units.where("page_index = 1").select(X.unmasked(F.col("masked"), F.col("pieces")).alias("t")).first().t == one.text
    sources = {(r.page_index, r.block): (r.source, r.pieces) for r in crosspage.translation_sources(blocks, units).collect()}
    # the second page's paragraph is a head and the next one's tail: its unit gives way, as tails do
    assert sources == {
        (0, 0): ("Title", []), (2, 0): ("we get [[MATH_0]], which ends here.", ["x=y"]), (2, 1): ("is open", []), (4, 0): ("goes on", []), (5, 0): ("A new start", []),
    }
    bounds = blocks.select("doc_id", "page_index").distinct().withColumn("bounds", F.array(F.lit(0.0), F.lit(918.0)))
    none = blocks.select("doc_id", "page_index", "x", "y", "w", "h").limit(0)
    real = spark.createDataFrame([(1, 0, 0, 1, "old half"), (1, 4, 0, 0, "real")], "doc_id long, page_index int, column_index int, block long, target string")
    widths = spark.createDataFrame([(1, 0, 300.0), (1, 2, 310.0)], "doc_id long, page_index int, reading double")
    made = flow.text_nodes(flow.page_flow(blocks, none, none, none, bounds), blocks, real, None, units, widths, F.concat(F.lit("S:"), F.col("preview")))
    shown = {(r.page_index, r.block): (r.target, r.continues, r.is_tail, r.width) for r in made.where("kind = 'text'").collect()}
    assert shown == {
        (0, 0): ("S:Title", False, False, 300.0), (0, 1): (None, False, True, 300.0), (1, 0): (None, True, True, None), (2, 0): ("S:we get x=y, which ends here.", True, False, 310.0),
        (2, 1): ("S:is open", False, False, 310.0), (4, 0): ("real", False, False, None), (5, 0): ("S:A new start", False, False, None),
    }


def test_flow_with_figures(spark):
    """A figure over two columns stands in the first, as wide as the paths beside it; one that no text runs through is left
    to the gap that it lies in; what it has taken goes; a text between two slices of a figure cuts it."""
    text = lambda y, h=50, x=75, c=0: (x, y, 300, h, c, True, False)
    both = [text(100), text(400), text(120, x=500, c=1), text(420, x=500, c=1)]
    got, made, _ = flow_of(spark, both, figs=[(200, 200, 500, 100)], paths=[(150, 210, 600, 50)])
    assert got == [(0, "text", 100, 150, 0), (0, "slice", 200, 300, -1), (0, "text", 400, 450, 1), (1, "text", 120, 170, 2), (1, "slice", 170, 420, -1), (1, "text", 420, 470, 3)]
    assert [(r.column_index, r.x, r.w) for r in made.where("kind = 'slice'").orderBy("column_index").collect()] == [(0, 150.0, 600.0), (1, 459.0, 459.0)]
    # in one column without text through it: no obstacle, the paths in the gap make the slice
    got, *_ = flow_of(spark, [text(100), text(400)], figs=[(100, 200, 200, 100)], paths=[(100, 210, 200, 80)])
    assert got == [(0, "text", 100, 150, 0), (0, "slice", 150, 400, -1), (0, "text", 400, 450, 1)]
    # a label that is no body text, and that the figure covers by more than 30 %, is its own
    got, *_ = flow_of(spark, [text(100), (120, 220, 100, 10, 0, False, False), text(400)], figs=[(100, 200, 200, 100)], paths=[(100, 210, 200, 80)])
    assert got == [(0, "text", 100, 150, 0), (0, "slice", 150, 400, -1), (0, "text", 400, 450, 2)]
    # a text runs through the figure: it is an obstacle, stands where it is and shows the text within
    got, *_ = flow_of(spark, [text(100), (75, 200, 300, 60, 0, True, False), text(400)], figs=[(60, 190, 380, 100)], paths=[(60, 190, 380, 100)])
    assert got == [(0, "text", 100, 150, 0), (0, "slice", 190, 290, -1), (0, "text", 400, 450, 2)]


def test_flow_stats_with_figures(spark):
    """Two slices of a figure with a shown text between, one path that no slice shows and one that is shown in part."""
    node = "doc_id long, page_index int, column_index int, seq int, kind string, x double, y double, w double, h double, scale_to_text boolean, block int, block_column int, skipped int, dropped double, target string"
    n = lambda seq, kind, y, h, target=None: (1, 0, 0, seq, kind, 0.0, float(y), 100.0, float(h), False, 0 if kind == "text" else -1, 0, 2, 7.5, target)
    made = spark.createDataFrame([n(0, "slice", 0, 50), n(1, "text", 50, 20, "T"), n(2, "slice", 70, 50)], node)
    box = lambda *rows: spark.createDataFrame([(1, 0, *map(float, r)) for r in rows], BOX)
    blocks = box((0, 50, 100, 20), (0, 0, 100, 20)).withColumns({"is_body_text": F.lit(True), "formula": F.lit(False)})
    figs = box((0, 40, 100, 60))
    r = flow.flow_stats(made, blocks, figs, box((10, 10, 10, 10), (500, 500, 10, 10), (90, 10, 100, 10))).first()
    assert (r.n_slices, r.n_texts, r.n_skipped, r.dropped, r.covered, r.widest, r.body_share) == (2, 1, 2, 7.5, 100.0, 100.0, 1.0)
    # the second block lies in a slice, beside the figure, which takes the first; the figure is cut by the text shown
    assert (r.n_twice, r.twice_area, r.n_cut, r.n_unseen, r.n_part_seen) == (1, 2000.0, 1, 1, 1)
    unshown = made.withColumn("target", F.lit(None).cast("string"))
    assert flow.flow_stats(unshown, blocks, figs, figs).first().n_cut == 0


def two_pages(spark):
    """A first page of title, authors, abstract and text; a figure with a label; a table; references on the second page."""
    rows, body = [], ["word word word word word word word word word word word word."] * 12
    put = lambda page, y, words, x=75.0, size=10.0, gap=5.0: rows.extend((1, page, *r[3:]) for r in line(float(y), words, x=x, size=size, gap=gap))
    put(0, 80, ["The title of it"], size=20.0)
    put(0, 120, ["Ada and Bob"])
    put(0, 160, ["Abstract"])
    for k, t in enumerate(body):
        put(0, 190 + 12 * k, [t])
    put(0, 400, ["label"], x=120.0, size=5.0)
    for k in range(4):
        put(0, 500 + 16 * k, ["a1", "b2", "c3"], gap=80.0)
    put(0, 700, ["E=mc+x+y+z+w+v+u+t+s=0"])
    put(1, 80, ["References"], size=12.0)
    for k in range(3):
        put(1, 110 + 12 * k, [f"[{k + 1}] An entry of the list, with a long enough text in it."])
    items = spark.createDataFrame([(*r[:2], *r[2:], False) for r in rows], RUNS.replace("column_index int, ", "") + ", rotated boolean")
    paths = spark.createDataFrame([(1, 0, k, 100.0 + 30 * k, 380.0, 32.0, 60.0) for k in range(5)], "doc_id long, page_index int, ord int, x double, y double, w double, h double")
    bounds = items.select("doc_id", "page_index").distinct().withColumn("bounds", F.array(F.lit(0.0), F.lit(918.0)))
    return items, paths, bounds


def test_page_analysis(spark):
    items, paths, bounds = two_pages(spark)
    out = pages.analyze_pages(items, paths=paths, bounds=bounds)
    got = {b.text: b for b in out.blocks.collect()}
    told = lambda t: (lambda b: (b.is_body_text, b.translatable, b.formula, b.reason, b.figure_reason))(next(b for k, b in got.items() if k.startswith(t)))
    assert told("The title") == (True, True, False, None, None) and got["The title of it"].heading_level == 2
    assert told("Ada")[3] == "authors" and not told("Ada")[1] and told("word") == (True, True, False, None, None)
    assert told("label")[0] is False and told("a1")[4] == "table-region" and told("a1")[:2] == (False, False)
    assert told("E=mc")[2:4] == (True, "formula") and told("[1]")[1] is False and told("[1]")[3] == "references" and told("References")[3] is None
    assert [(t.n_rows) for t in out.tables.collect()] == [4]
    figure = [r for r in out.figures.collect() if r.y < 450]
    assert [(r.x, r.y, r.w, r.h) for r in figure] == [(100.0, 380.0, 152.0, 60.0)]
    # overrides come over what is automatic, slices that are empty go, paths without ink are not believed
    anchors = {b.text[:6]: f"{b.page_index}|{b.text[:40]}" for b in got.values()}
    wanted = spark.createDataFrame([(1, anchors["Ada an"], "body"), (1, anchors["Refere"], "figure"), (1, anchors["E=mc+x"], "auto")], "doc_id long, anchor string, kind string")
    seen = pages.document_flow(out, paths, overrides=wanted, has_content=F.col("y") < 450, stand_in=F.concat(F.lit("S:"), F.col("preview"))).collect()
    texts = {r.source[:6]: r for r in seen if r.kind == "text"}
    assert texts["Ada an"].target == "S:Ada and Bob" and texts["Ada an"].overridden == "body" and texts["Ada an"].translatable and "Refere" not in texts
    assert texts["The ti"].width == 300.0 and all(r.y < 450 for r in seen if r.kind == "slice") and any(r.kind == "slice" and r.y <= 380 < r.y + r.h for r in seen)
    blank = pages.analyze_pages(items, paths=paths.withColumn("ink", F.lit(False)), bounds=bounds)
    assert [r for r in blank.figures.collect() if r.y < 450] == []
    told_inside = pages.analyze_pages(items, bounds=bounds, inside=F.col("y").between(170, 300) & (F.col("page_index") == 0))
    assert next(b.figure_reason for b in told_inside.blocks.collect() if b.text.startswith("word")) == "graphics-region"
