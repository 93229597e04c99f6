import random

import duckdb
import pytest
from pyspark.sql import functions as F

from quirespark.functions import geometry as G
from quirespark.functions import text as X
from quirespark.operators import assembly, enrich, layout, library, pages, store
from quirespark.operators.regions import merged_boxes
from quirespark.plans.queries import ORACLE_SQL, QUERIES
from quirespark.sources import drawing

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["q_lines", "q_paragraphs", "q_gutters", "q_formula_features", "q_scope_counts", "q_upsert_latest", "q_continuation", "q_shared_boundaries", "q_geometry_trust"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "events"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    rows = lambda xs, at: sorted(repr(tuple(float(x[at[c]]) if isinstance(x[at[c]], int | float) and not isinstance(x[at[c]], bool) else x[at[c]] for c in cols)) for x in xs)
    assert rows(got.collect(), {c: c for c in cols}) == rows(want.fetchall(), {c: want.columns.index(c) for c in cols})


def test_shared_boundaries(spark):
    gaps = [(1, 0, float(r), c) for r in range(5) for c in (100.0 + r * 16, 400.0 + r * 17)] + [(2, 0, 1.0, 5.0), (3, 0, 1.0, 5.0), (3, 0, 1.0, 21.0)]
    got = layout.shared_boundaries(spark.createDataFrame(gaps, "doc_id long, page_index int, baseline_y double, centre double"), ["doc_id", "page_index"]).collect()
    assert {(r.doc_id, r.n_rows, r.best, r.shared) for r in got} == {(1, 5, 5, True), (2, 1, 1, False), (3, 1, 2, True)}


def test_geometry_trust(spark):
    pages = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "doc_id long, page_index int")
    paths = spark.createDataFrame([(1, 0, True), (1, 0, None), (2, 0, False)], "doc_id long, page_index int, ink boolean")
    got = {(r.doc_id, r.share, r.trusted) for r in layout.geometry_trust(pages, paths).collect()}
    assert got == {(1, 0.5, True), (2, 0.0, False), (3, 1.0, True)}


def test_hash(spark):
    got = spark.createDataFrame([("hello",), ("plain networks",), ("",)], "s string").select(X.fnv1a(F.col("s")).alias("h")).collect()
    assert [r.h for r in got] == ["a430d84680aabd0b", "33de935862b82122", "cbf29ce484222325"]


def fnv(text):
    h = 0xCBF29CE484222325
    units = text.encode("utf-16-be")
    for k in range(0, len(units), 2):
        h = (h ^ int.from_bytes(units[k : k + 2], "big")) * 0x100000001B3 % 2**64
    return f"{h:016x}"


def test_hash_of_long_texts(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices("ab é中\n😀\uffff", k=n)) for n in (1, 5, 300, 130_000)]
    got = spark.createDataFrame([(x,) for x in texts], "s string").select("s", X.fnv1a(F.col("s")).alias("h")).collect()
    assert [r.h for r in got] == [fnv(r.s) for r in got]
    assert spark.range(1).select(X.fnv1a(F.lit(None).cast("string")).alias("h")).first().h == fnv("")


@pytest.fixture(scope="module")
def alike(spark, tmp_path_factory):
    """Documents that begin alike and differ beyond 1,000 characters."""
    at, head = str(tmp_path_factory.mktemp("alike")), "the same words " * 80
    texts = [head + "one", head + "two", head + "one", head, head + "two!", "", None, " \n"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at, texts


def test_cache_hits_by_whole_text(spark, alike):
    at, texts = alike
    held = {fnv(x or "") for x in texts[::2]}
    got = {r.doc_id: r.hit for r in QUERIES["q_cache_hits"](spark, at).collect()}
    assert got == {k: fnv(x or "") in held for k, x in enumerate(texts)}
    assert [got[k] for k in (1, 3)] == [False, False]


def test_key_quality_and_translation_of_whole_texts(spark, alike):
    at, texts = alike
    keys = {r.doc_id: r.key for r in QUERIES["q_fnv_cache_key"](spark, at).collect()}
    assert keys == {k: "v1|mock|m|zh|p1|" + fnv(x or "") for k, x in enumerate(texts)}
    # 900 characters are within 2.5 times the whole text of document 3, not of its first 300 characters
    assert {r.doc_id: r.warning for r in QUERIES["q_quality"](spark, at).collect()}[3] is None
    # the first 200 characters would give half as many at most
    assert {r.doc_id: r.n for r in QUERIES["q_mock_translate"](spark, at).collect()}[3] > 150


def test_mock_translation(spark):
    def want(source):
        own = source.strip(" \t\n\r\x0b\x0c\xa0\u2003\u3000\ufeff")
        if not own:
            return ""
        size, start, out = max(18, (len(own.encode("utf-16-be")) // 2 + 1) // 2), int(fnv(own)[-8:], 16) % 12, ""
        for i in range(12):
            following = enrich.SENTENCES[(start + i) % 12]
            if out and len(out) + len(following) > size * 1.15:
                break
            out += following
            if len(out) >= size:
                break
        return out

    rng = random.Random(3)
    texts = ["", " \n\u3000\ufeff", "a", " a ", "\xa0\u2003x y\n", "😀" * 50, *("".join(rng.choices("abc é中😀", k=n)) for n in range(20, 900, 11))]
    got = spark.createDataFrame([(x,) for x in texts], "s string").select("s", enrich.mock_translation(F.col("s")).alias("t")).collect()
    assert [r.t for r in got] == [want(r.s) for r in got]
    assert len(enrich.SENTENCES) == 12 and want("a")[-1] == "。" and len({want(x) for x in texts}) > 40
    assert spark.range(1).select(enrich.mock_translation(F.lit(None).cast("string")).alias("t")).first().t is None


@pytest.mark.parametrize(("text", "lines", "want"), [("y = F(x, {Wi}) + x. (1)", 1, True), ("x = y + z − w", 1, True), ("a = b + c", 1, True), ("x = y z = w", 2, True), ("Eq. (1)", 1, False), ("F(x) = 0 holds for every x in the dataset", 1, False)])
def test_formula(spark, text, lines, want):
    s = X.signals(F.col("t"))
    row = spark.createDataFrame([(text,)], "t string").select(X.looks_like_formula(s["n_chars"], s["n_strong"], s["long_words"], s["numbered"], F.lit(lines)).alias("f")).first()
    assert row.f is want


def test_mask_round_trip_and_merge(spark):
    df = spark.createDataFrame([("a 1 b 22",), ("",), ("none",)], "t string")
    m, p = X.masked(F.col("t"), r"\d+")
    for r in df.select("t", m.alias("m"), p.alias("p")).select("t", X.unmasked(F.col("m"), F.col("p")).alias("u")).collect():
        assert r.t == r.u
    got = spark.range(1).select(X.merge_masked(F.lit("h [[MATH_0]]"), F.lit(1), F.lit("a [[MATH_0]] b [[MATH_1]] c"), F.lit(2)).alias("x")).first().x
    assert got == "h [[MATH_2]] a [[MATH_0]] b [[MATH_1]] c"
    got = spark.range(1).select(X.merge_masked(F.lit("[[MATH_0]] [[MATH_1]]"), F.lit(2), F.lit("[[MATH_0]]"), F.lit(1)).alias("x")).first().x
    assert got == "[[MATH_1]] [[MATH_2]] [[MATH_0]]"


def test_quality(spark):
    df = spark.createDataFrame([("a" * 200, "短"), ("a" * 200, "长" * 800), ("a" * 200, "中" * 120), ("ab", "中"), ("ab", " "), ("ab", "x")], "s string, t string")
    assert [r.w for r in df.select(X.quality_warning(F.col("s"), F.col("t")).alias("w")).collect()] == ["short", "long", None, None, "empty", "no-cjk"]


def test_drawing_stack(spark):
    rows = [(1, 0, 0, "transform", [1.0, 0.0, 0.0, 1.0, 100.0, 200.0]), (1, 0, 1, "save", None), (1, 0, 2, "transform", [2.0, 0.0, 0.0, 2.0, 0.0, 0.0]), (1, 0, 3, "path", [0.0, 0.0, 1.0, 1.0]), (1, 0, 4, "restore", None), (1, 0, 5, "path", [0.0, 0.0, 10.0, 20.0])]
    got = drawing.drawing_boxes(spark.createDataFrame(rows, "doc_id long, page_index int, seq int, fn string, args array<double>")).orderBy("ord").collect()
    assert [(r.x, r.y, r.w, r.h) for r in got] == [(100, 200, 2, 2), (100, 200, 10, 20)]


def test_boxes(spark):
    assert merged_boxes([(0, 0, 10, 10), (5, 5, 10, 10), (14, 14, 4, 4), (50, 50, 1, 1)]) == [(0, 0, 18, 18), (50, 50, 1, 1)]
    touch = spark.range(1).select(G.overlaps(tuple(map(F.lit, (0, 0, 10, 10))), tuple(map(F.lit, (10, 0, 5, 5)))).alias("o")).first().o
    assert touch is False


def test_line_anchor(spark):
    """Runs drift by less than the tolerance each, but lines are anchored at their first run; gaps of 5 are spaces."""
    rows = [(1, 0, 0, 0, k, str(k), 10.0 * k, 100.0 + 4 * k, 5.0, 10.0, 100.0 + 4 * k, 10.0) for k in range(4)]
    items = spark.createDataFrame(rows, "doc_id long, page_index int, column_index int, line_ord int, word_ord int, str string, x double, y double, w double, h double, baseline_y double, font_size double")
    got = layout.lines(items).orderBy("line_index").collect()
    assert [r.text for r in got] == ["0 1", "2 3"]


def test_tags_and_scopes(spark):
    df = spark.createDataFrame([("1", [" A", "a", "", "b"], [])], "id string, tags array<string>, collection_ids array<string>")
    assert df.select(library.distinct_tags(F.col("tags")).alias("t")).first().t == ["A", "b"]
    assert {r.scope: r.n for r in library.scope_counts(df).collect()} == {"all": 1, "uncategorised": 1}


def test_overrides_twice(spark):
    b = spark.createDataFrame([(1, 0, "Some  text", True, False)], "doc_id long, page_index int, text string, is_body_text boolean, formula boolean")
    o = spark.createDataFrame([(1, "0|Some text", "figure")], "doc_id long, anchor string, kind string")
    first = layout.apply_overrides(b, o)
    again = layout.apply_overrides(first.select(b.columns), o)
    assert first.select("eff_body").collect() == again.select("eff_body").collect() and first.first().eff_body is False


def test_three_columns_and_more_gutters_than_wanted(spark):
    """Columns at 0, 300 and 600, 200 wide: the gutters lie at 250 and 550; the right one is emptier, so one alone is it."""
    kind = "doc_id long, page_index int, rotated boolean, x double, w double"
    rows = [(1, 0, False, 300.0 * c, 200.0) for c in range(3) for _ in range(20)] + [(1, 0, False, 200.0, 100.0)] * 3 + [(2, 0, False, 0.0, 900.0)] * 5
    items = spark.createDataFrame(rows, kind)
    slides = layout.coverage_window(layout.column_coverage(items))
    found = {k: [(r.n, r.split_x) for r in layout.gutters(slides, most=k).orderBy("n").collect()] for k in (1, 2, 5)}
    assert [n for n, _ in found[2]] == [0, 1] and [abs(x - w) <= 10 for (_, x), w in zip(found[2], (250, 550), strict=True)] == [True, True]
    assert found[5] == found[2] and found[1] == [(0, found[2][1][1])]
    columns = layout.assign_columns(items, layout.gutters(slides, most=2)).groupBy("doc_id", "column_index").count()
    assert {(r.doc_id, r.column_index): r["count"] for r in columns.collect()} == {(1, 0): 20, (1, 1): 23, (1, 2): 20, (2, 0): 5}
    bounds = {r.doc_id: r.bounds for r in pages.column_bounds(items, 918.0, 2).collect()}
    assert len(bounds[1]) == 4 and bounds[2] == [0.0, 918.0]


def test_overrides_by_kind(spark):
    """Every kind, no row, `auto`, and an override taken back."""
    kind = "doc_id long, page_index int, text string, is_body_text boolean, translatable boolean, formula boolean, figure_reason string, reason string"
    kinds = ["body", "figure", "table", "formula", "reference", "auto", None]
    rows = [(1, 0, f"{k} {n}", n % 2 == 0, n == 0, n == 1, "narrow" if n else None, "numeric" if n else None) for k in kinds for n in range(2)]
    blocks = spark.createDataFrame(rows, kind)
    wanted = [(1, f"0|{k} {n}", k) for k in kinds[:-1] for n in range(2)]
    out = layout.apply_overrides(blocks, spark.createDataFrame([*wanted, *wanted[:2]], "doc_id long, anchor string, kind string"))
    got = {r.text: (r.eff_body, r.eff_translatable, r.eff_formula, r.eff_figure_reason, r.eff_reason) for r in out.collect()}
    plain = ((True, True, False, None, None), (False, False, True, "narrow", "numeric"))
    want = {
        "body": ((True, True, False, None, None),) * 2, "figure": ((False, False, False, "graphics-region", None), (False, False, True, "graphics-region", "numeric")),
        "table": ((False, False, False, "table-region", None), (False, False, True, "table-region", "numeric")),
        "formula": ((True, False, True, None, "formula"), (False, False, True, "narrow", "formula")), "reference": ((True, False, False, None, "references"), (False, False, True, "narrow", "references")),
        "auto": plain, None: plain,
    }
    assert got == {f"{k} {n}": want[k][n] for k in kinds for n in range(2)} and out.count() == len(rows)
    back = layout.apply_overrides(out.select(*blocks.columns), spark.createDataFrame([], "doc_id long, anchor string, kind string"))
    assert [r.eff_translatable for r in back.orderBy("text").collect()] == [r.translatable for r in blocks.orderBy("text").collect()]


def test_rendering_escapes(spark):
    one = "struct(0 as start, 3 as stop, true as bold, false as italic, cast(null as string) as script, false as math)"
    df = spark.sql(f"select 'a<b & c>' as t, array({one}) as s")
    assert df.select(assembly.rendered(F.col("t"), F.col("s")).alias("h")).first().h == "<strong>a&lt;b</strong> &amp; c&gt;"


def test_own_columns_never_meet_the_rows(spark):
    papers = spark.createDataFrame([("1", ["a"], 7, "x", True), ("2", ["b"], 8, "y", True)], "id string, tags array<string>, k long, clean string, wanted boolean")
    assert [(r.id, r.k) for r in library.latest(papers, ["id"], ["k"]).orderBy("id").collect()] == [("1", 7), ("2", 8)]
    tags = store.set_tags(papers, spark.createDataFrame([("1", ["c"], 1), ("1", ["d", "D "], 2)], "id string, new_tags array<string>, seq long")).orderBy("id").collect()
    assert [(r.id, r.tags, r.k, r.clean, r.changed) for r in tags] == [("1", ["d"], 7, "x", True), ("2", ["b"], 8, "y", False)]
    filled = papers.withColumn("filled", F.lit(3))
    assert store.migrated(filled.limit(0), filled).count() == 2 and store.migrated(filled.limit(1), filled).count() == 1
    entries = spark.createDataFrame([(f"k{k}", k // 2, "p", 1) for k in range(9)], "key string, at long, place string, part int")
    assert sorted(r.key for r in store.newer_half(entries, 4).collect()) == ["k4", "k5", "k6", "k7", "k8"]
    same = store.registered_with(spark.createDataFrame([("a", "t"), ("b", "t"), ("c", None)], "id string, text string"), spark.createDataFrame([("a", "t"), ("a", "t"), ("b", "u")], "id string, text string"))
    assert sorted((r.id, r.registered) for r in same.collect()) == [("a", True), ("b", False), ("c", False)]


def test_reference_sections_against_a_plain_walk(spark):
    rng = random.Random(3)
    kinds = [("References", 1.2, 0), ("References", 1.0, 1), ("Bibliography", 1.1, 2), ("5 Results", 1.3, 2), ("[3] Entry", 1.1, 1), ("plain text", 1.0, 0), ("References", 1.0, 0)]
    rows = [(doc, k // 7, k % 7 % 2, k % 7, k % 7, *rng.choice(kinds)) for doc in range(30) for k in range(rng.randint(1, 40))]
    df = spark.createDataFrame(rows, "doc_id long, page_index int, column_index int, block int, read_order int, text string, font_scale double, heading_level int")
    want, on, doc = {}, False, None
    for r in sorted(rows, key=lambda r: (r[0], r[1], r[4], r[2], r[3])):
        on, doc = (on if r[0] == doc else False), r[0]
        opens = r[5] in ("References", "Bibliography") and (r[6] >= 1.05 or r[7] > 0)
        closes = r[7] > 0 and not r[5].startswith("[3]")
        want[r[:4]] = on and not closes
        on = not closes if on else opens
    got = {(r.doc_id, r.page_index, r.column_index, r.block): r.in_references for r in layout.mark_references(df).collect()}
    assert got == want and any(want.values())
