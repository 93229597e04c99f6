"""Findings of round 4 at the layout and its streams: steps whose work grew with a square, or was done several times."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from quirespark.functions import text as X
from quirespark.operators import assembly, figures, layout, regions
from quirespark.sources import adapter, drawing
from quirespark.streaming import pages as streams

RUN = "doc_id long, page_index int, column_index int, line_ord int, word_ord int, str string, x double, y double, w double, h double, baseline_y double, font_size double"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_long_lines(spark):
    """q_lines, q_paragraphs, q_line_spans: each run worked out its column's median and its line's blanks anew."""
    n = 10_000
    runs = spark.range(n).select(F.lit(1).alias("doc_id"), *[F.lit(0).alias(c) for c in ("page_index", "column_index", "line_ord")], F.col("id").cast("int").alias("word_ord"), F.lit("ab").alias("str"),
                                 (F.col("id") * 10.0).alias("x"), F.lit(90.0).alias("y"), F.when(F.col("id") % 2 == 0, 10.0).otherwise(5.0).alias("w"), F.lit(10.0).alias("h"), F.lit(100.0).alias("baseline_y"), F.lit(10.0).alias("font_size"))
    began = time.time()
    line = assembly.lines(runs, spans=False).select("text", "n_items").collect()
    assert [(r.text, r.n_items) for r in line] == [("abab " * (n // 2 - 1) + "abab", n)]
    assert time.time() - began < 60


def test_lines_begin_at_the_first_run(spark):
    rows = [(1, 0, 0, k, 0, "a", 10.0 * k, 0.0, 5.0, 10.0, b, 10.0) for k, b in enumerate((100.0, 100.0, 103.0, 105.0, 106.0, 110.0, 111.5, None, None))]
    got = assembly.lines(spark.createDataFrame(rows[:7], RUN), spans=False).orderBy("line_index").collect()
    assert [r.n_items for r in got] == [4, 2, 1]
    assert sum(r.n_items for r in assembly.lines(spark.createDataFrame(rows, RUN), spans=False).collect()) == 9


def test_runs_of_odd_texts(spark):
    docs = [(1, "Title é\n\n   \n one  two\nx"), (2, None), (3, ""), (4, "w" * 500 + " z")]
    got = adapter.items(spark.createDataFrame(docs, "doc_id long, text string")).orderBy("doc_id", "line_ord", "word_ord").collect()
    assert [(r.doc_id, r.line_ord, r.word_ord, r.str[:5], r.x, r.w, r.baseline_y) for r in got] == [
        (1, 0, 0, "Title", 75.0, 40.0, 90.0), (1, 0, 1, "é", 123.0, 8.0, 90.0), (1, 3, 0, "one", 75.0, 15.0, 122.0), (1, 3, 1, "two", 95.0, 15.0, 122.0), (1, 4, 0, "x", 75.0, 5.0, 154.0),
        (4, 0, 0, "wwwww", 75.0, 4000.0, 90.0), (4, 0, 1, "z", 75.0 + 4008 - 16 * 240, 8.0, 90.0 + 16 * 16)]


def test_stripped_and_shares(spark):
    texts = ["", " ", "a", " a", "a　", "﻿a b ", "a \n", "a \u0085", "a  ", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    plain = F.regexp_replace("t", rf"^{X.SPACE}+|{X.SPACE}+$", "")
    assert df.where(~X.stripped(F.col("t")).eqNullSafe(plain)).count() == 0
    one = spark.createDataFrame([("a∑",), ("ab",), ("",)], "t string").select(X.math_ratio(F.col("t")).alias("r"), X.cjk_last(F.concat("t", F.lit("中"))).alias("c"), X.cjk_first(F.col("t")).alias("f"))
    assert [(r.r, r.c, r.f) for r in one.collect()] == [(0.5, True, False), (0.0, True, False), (0.0, True, False)]


def test_pages_are_rows_for_python(spark):
    """q_merge_overlapping, q_drawing_boxes, q_figure_regions: a group for Python for each page."""
    boxes = spark.createDataFrame([(1, 0, 0.0, 0.0, 4.0, 4.0), (1, 0, 3.0, 3.0, 4.0, 4.0), (1, 0, 20.0, 0.0, 1.0, 1.0), (2, 5, 1.0, 1.0, 1.0, 1.0)], "doc_id long, page_index int, x double, y double, w double, h double")
    merged = regions.merge_overlapping(boxes)
    assert sorted(map(tuple, merged.collect())) == [(1, 0, 0, 0.0, 0.0, 7.0, 7.0), (1, 0, 1, 20.0, 0.0, 1.0, 1.0), (2, 5, 0, 1.0, 1.0, 1.0, 1.0)]
    ops = spark.createDataFrame([(1, 0, 2, "path", [0.0, 0.0, 1.0, 1.0]), (1, 0, 1, "transform", [2.0, 0.0, 0.0, 2.0, 5.0, 0.0]), (2, 0, 1, "save", None)], "doc_id long, page_index int, seq int, fn string, args array<double>")
    drawn = drawing.drawing_boxes(ops)
    assert [tuple(r) for r in drawn.collect()] == [(1, 0, 0, "path", 5.0, 0.0, 2.0, 2.0)]
    runs = spark.createDataFrame([(1, 0, 0, 0, 10.0, 8.0, 5.0, 5.0, 5.0), (1, 0, 0, 1, 500.0, 500.0, 5.0, 5.0, 5.0), (3, 0, 0, 0, 1.0, 1.0, 5.0, 5.0, 5.0)], "doc_id long, page_index int, line_ord int, word_ord int, x double, y double, w double, h double, font_size double")
    body = spark.createDataFrame([(1, 0, 10.0), (2, 5, 10.0), (3, 0, 10.0)], "doc_id long, page_index int, body_font double")
    found = figures.figure_regions([boxes], runs, body, 918.0, 1188.0)
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0, 0.0, 0.0, 15.0, 13.0), (1, 0, 1, 20.0, 0.0, 1.0, 1.0), (2, 5, 0, 1.0, 1.0, 1.0, 1.0)]
    assert not any("FlatMapGroups" in plan(df) for df in (merged, drawn, found))


def test_blocks_are_read_once(spark):
    """q_front_matter and all styled queries: blocks were joined with themselves, which worked their lines out again."""
    rows = [(1, 0, 0, 0, "A title", 0.0, 10.0, 400.0, 20.0, 20.0, 1, 0), (1, 0, 0, 1, "An author", 0.0, 50.0, 100.0, 10.0, 10.0, 1, 1), (1, 0, 0, 2, "Abstract", 0.0, 80.0, 400.0, 10.0, 10.0, 1, 2), (1, 0, 1, 0, "Across", 300.0, 90.0, 300.0, 10.0, 10.0, 1, 10000), (2, 0, 0, 0, "text", 0.0, 10.0, 10.0, 10.0, 10.0, 1, 0)]
    blocks = spark.createDataFrame(rows, "doc_id long, page_index int, column_index int, block long, text string, x double, y double, w double, h double, font_size double, n_lines long, read_order long")
    ranges = layout.with_column_range(blocks, F.array(F.lit(0.0), F.lit(459.0), F.lit(918.0)))
    assert sorted((r.doc_id, r.read_order, r.left, r.right) for r in ranges.collect()) == [(1, 0, 0.0, 400.0), (1, 1, 0.0, 400.0), (1, 2, 0.0, 400.0), (1, 10000, None, None), (2, 0, 0.0, 10.0)]
    styled = blocks.withColumns({"font_scale": F.col("font_size") / 10, "width_ratio": F.lit(0.5)})
    front = layout.front_matter(styled)
    assert [tuple(r) for r in front.collect()] == [(1, 1, 50.0, 10.0, 80.0)]
    assert "Join" not in plan(front) + plan(ranges)


class Map(dict):
    """A map state that counts what is asked of it."""

    asked = 0

    def containsKey(self, k):
        self.asked += 1
        return k in self

    def exists(self):
        return bool(self)

    def getValue(self, k):
        return self[k]

    def removeKey(self, k):
        del self[k]

    def updateValue(self, k, v):
        self.asked += 1
        self[k] = v


class Value:
    def __init__(self):
        self.now = None

    def get(self):
        return self.now

    def update(self, v):
        self.now = v


def test_pages_in_turn_pass_the_store_by(monkeypatch):
    """q_stream_page_state, q_stream_continuation: each page was asked of the store five times."""
    from pyspark.sql import Row

    monkeypatch.setattr(streams, "EARLY", 3)
    page = lambda k, **x: Row(**({"page_index": k, "heads": k == 2, "closes": False, "width": float(k), "tail": f"t{k}", "head": None, "head_plain": None} | x))
    order = streams.PageOrder(None)
    order.waiting, order.left = Map(), Value()
    rows = lambda *ks: [r.page_index for r in order.handleInputRows((1,), iter([page(k) for k in ks]), None)]
    assert rows(0, 2, 1, 1, 3) == [0, 1, 2, 3] and order.waiting.asked == 0 and order.left.now == (4, True, 3.0, "t3")
    assert rows(9, 8, 7, 6, 5, 3) == [] and sorted(k for k, in order.waiting) == [5, 6, 7, 8, 9]
    assert rows(4, 10, 6) == [4, 5, 6, 7, 8, 9, 10] and not order.waiting
