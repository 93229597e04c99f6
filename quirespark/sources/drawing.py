"""Drawing programs: ordered operators with a matrix stack, read as path and bitmap boxes."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType, StructField, StructType

BOXES = ArrayType(StructType([StructField("kind", StringType()), *(StructField(c, DoubleType()) for c in "xywh")]))
ARROW_BOXES = pa.list_(pa.struct([("kind", pa.string()), *((c, pa.float64()) for c in "xywh")]))


def _times(m: tuple, n: tuple) -> tuple:
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u)


def _page(ops: list[dict]) -> list[dict]:
    now, stack, out = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], []
    for op in ops:
        fn, args = op["fn"], [] if op["args"] is None else [float(a) for a in op["args"]]
        if fn in ("save", "formBegin"):
            stack.append(now)
            now = _times(tuple(args), now) if len(args) == 6 else now
        elif fn in ("restore", "formEnd"):
            now = stack.pop() if stack else now
        elif fn == "transform" and len(args) == 6:
            now = _times(tuple(args), now)
        elif fn in ("path", "image"):
            x0, y0, x1, y1 = args if len(args) == 4 else (0.0, 0.0, 1.0, 1.0)
            xs = [now[0] * x + now[2] * y + now[4] for x in (x0, x1) for y in (y0, y1)]
            ys = [now[1] * x + now[3] * y + now[5] for x in (x0, x1) for y in (y0, y1)]
            out.append({"kind": fn, "x": min(xs), "y": min(ys), "w": max(xs) - min(xs), "h": max(ys) - min(ys)})
    return out


@F.arrow_udf(BOXES)
def _drawn(programs: pa.Array) -> pa.Array:
    return pa.array([_page(p) for p in programs.to_pylist()], ARROW_BOXES)


def drawing_boxes(ops: DataFrame) -> DataFrame:
    """Boxes of (doc_id, page_index, seq, fn, args): a page's program is small and must be read in order. It is a row, so
    Python takes many pages at a time."""
    program = F.transform(F.sort_array(F.collect_list(F.struct("seq", "fn", "args"))), lambda o: F.struct(o["fn"].alias("fn"), o["args"].alias("args")))
    pages = ops.groupBy("doc_id", "page_index").agg(program.alias("program"))
    return pages.select("doc_id", "page_index", F.posexplode_outer(_drawn("program")).alias("ord", "b")).where("b is not null").select("doc_id", "page_index", "ord", "b.*")
