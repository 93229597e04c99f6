"""Quality rules: an isolation forest on rule statistics.

Every document gets word, symbol and repetition counts. Random axis-parallel splits of the statistics' box are
fitted to ordinary documents; a document that few splits suffice to isolate is anomalous. The score above which
a document is rejected is calibrated on all labelled rows.

The splits are drawn over the whole box of shares, not the range of a node's rows, so a document beside all those that
the forest was fitted to falls into empty nodes and its path ends early.

Edge cases: null or empty text has no words, fails the base rules and is not kept; rows repeat as they are and get one
verdict; a null doc_id stays null and is never learnt from; an id labelled both 0 and 1 counts as not labelled; without
labels the forest is fitted to all documents and the cut is a fixed quantile; an empty table gives no rows; texts of any
length are measured whole, by one task; columns other than doc_id, text and quality never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, steps, stored, words

#: The contract's symbols and white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

BASE = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
#: Statistics that the forest splits, all from 0 to 1.
STATS = ("symbols", "dup_lines", "repeats", "upper", "digits", "marks", "word_length", "distinct", "line_length")
STATS_SCHEMA = BASE + ", base_failed boolean, " + ", ".join(f"s_{s} float" for s in STATS)

TREES, SAMPLE, DEPTH = 128, 256, 14
#: Bound of the sample of rows that the forest is fitted to (TREES samples of SAMPLE rows each).
FIT_ROWS = TREES * SAMPLE
BINS = 2000
MIX = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(tokens: list[bytes]) -> int:
    """Words in five-word windows that are found twice or more."""
    n = len(tokens)
    if n < 6:
        return 0
    h = np.fromiter(map(hash, tokens), np.int64, n).view(np.uint64)
    w = h[: n - 4].copy()
    for k in range(1, 5):
        w = w * MIX + h[k : n - 4 + k]
    order = np.argsort(w)
    ranked = w[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 4, bool)
    twice[1:] |= same
    twice[:-1] |= same
    starts = order[twice]
    edge = np.zeros(n + 1, np.int32)
    edge[starts] += 1
    edge[starts + 5] -= 1
    return int((np.cumsum(edge) > 0).sum())


def statistics(text: str) -> tuple:
    """Base counts of a text, whether the base rules fail, and the forest's statistics."""
    tokens = words(text)
    n, chars = len(tokens), len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeats = repeated_words(tokens)
    raw = text.encode()
    codes = np.frombuffer(raw, np.uint8)
    kinds = np.bincount(codes, minlength=128) if len(codes) else np.zeros(128, int)
    letters = max(1, int(kinds[65:91].sum() + kinds[97:123].sum()))
    share = lambda a, b: min(1.0, a / b) if b else 0.0
    stats = (
        share(symbols, chars),
        share(dup, len(lines)),
        share(repeats, n),
        share(int(kinds[65:91].sum()), letters),
        share(int(kinds[48:58].sum()), chars),
        share(sum(int(kinds[ord(c)]) for c in "!?;:.,"), chars),
        share(chars, n * 20),
        1 - share(len(set(tokens)), n) if n else 0.0,
        share(n, 400 * max(1, len(lines))),
    )
    failed = n < 10 or 100 * repeats > 20 * n
    return (n, chars, symbols, dup, repeats, failed, *stats)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64()] * 6 + [pa.bool_()] + [pa.float32()] * len(STATS)
    names = [x.split()[0] for x in STATS_SCHEMA.split(", ")]
    for ids, texts in steps(batches):
        columns = [ids, *zip(*map(statistics, texts), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def rule_statistics(docs: DataFrame) -> DataFrame:
    """Base counts and statistics of every document."""
    return ids_and_texts(docs).mapInArrow(_measure, STATS_SCHEMA)


class Forest:
    """Isolation trees in arrays; a node without rows, or with one, ends a path."""

    def __init__(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size = min(SAMPLE, max(2, len(rows)))
        size = 2 ** (DEPTH + 1)
        self.feature = np.full((TREES, size), -1, np.int8)
        self.cut = np.zeros((TREES, size), np.float32)
        self.extra = np.zeros((TREES, size), np.float32)
        for t in range(TREES):
            picked = rows[rng.choice(len(rows), self.size, replace=len(rows) < self.size)] if len(rows) else rows
            self._grow(t, 1, 0, picked, low.copy(), high.copy(), rng)

    @staticmethod
    def expected(n: np.ndarray | float) -> np.ndarray:
        """Mean path length of an unsuccessful search among n rows."""
        n = np.maximum(np.asarray(n, float), 1)
        return np.where(n > 1, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, 0.0)

    def _grow(self, t: int, node: int, depth: int, rows: np.ndarray, low, high, rng) -> None:
        open_ = np.flatnonzero(high > low)
        if depth >= DEPTH or len(rows) <= 1 or not len(open_):
            self.extra[t, node] = self.expected(len(rows))
            return
        f = int(rng.choice(open_))
        cut = rng.uniform(low[f], high[f])
        self.feature[t, node], self.cut[t, node] = f, cut
        left = rows[:, f] <= cut
        for child, own, side in ((2 * node, left, high), (2 * node + 1, ~left, low)):
            kept, side[f] = side[f], cut
            self._grow(t, child, depth + 1, rows[own], low, high, rng)
            side[f] = kept

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / its expectation): near 1 for anomalies."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(TREES):
            node, depth = np.ones(len(x), np.int64), np.zeros(len(x))
            while True:
                f = self.feature[t, node]
                live = f >= 0
                if not live.any():
                    break
                right = x[rows, np.maximum(f, 0)] > self.cut[t, node]
                node = np.where(live, 2 * node + right, node)
                depth += live
            total += depth + self.extra[t, node]
        return 2 ** (-(total / TREES) / max(1e-9, float(self.expected(self.size))))


def agreed(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) of the ids that are labelled one way."""
    found = labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    return found.where("quality = most").select("doc_id", "quality")


def fit_forest(stats: DataFrame, labels: DataFrame | None = None, fit_rows: int = FIT_ROWS) -> Forest:
    """A forest on at most fit_rows documents, those labelled as good where there are any.

    The rows are those of smallest hash, so a retry picks the same. Statistics are shares, so the box is 0 to 1.
    """
    columns = [f"s_{s}" for s in STATS]
    ordinary = stats
    if labels is not None:
        good = agreed(labels).where("quality = 1").select("doc_id")
        ordinary = stats.join(good, "doc_id", "left_semi")
    pick = lambda df: df.orderBy(F.xxhash64("doc_id"), *columns).limit(fit_rows).select(columns).toPandas()
    rows = pick(ordinary)
    if not len(rows):
        rows = pick(stats)
    x = rows.to_numpy(np.float32)
    return Forest(x, np.zeros(len(STATS)), np.ones(len(STATS)))


def score(stats: DataFrame, forest: Forest) -> DataFrame:
    """The statistics with an `anomaly` column."""
    sent = stats.sparkSession.sparkContext.broadcast(forest)  # a fixed number of nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(f"s_{s}").to_numpy(zero_copy_only=False) for s in STATS])
            yield batch.append_column("anomaly", pa.array(sent.value.scores(x), pa.float64()))

    return stats.mapInArrow(run, STATS_SCHEMA + ", anomaly double")


def threshold(scored: DataFrame, labels: DataFrame | None, cost_of_good: float = 40.0) -> float:
    """The cut that loses least over all labelled rows: a rejected good row costs cost_of_good kept bad ones.

    Only a histogram of BINS bins leaves the executors.
    """
    binned = F.floor(F.col("anomaly") * BINS).cast("int").alias("bin")
    good, bad = np.zeros(BINS + 1), np.zeros(BINS + 1)
    if labels is not None:
        for r in scored.where("not base_failed").join(agreed(labels), "doc_id").groupBy(binned, "quality").count().collect():
            (good if r["quality"] == 1 else bad)[r["bin"]] += r["count"]
    if not good.sum() or not bad.sum():
        every = np.zeros(BINS + 1)
        for r in scored.where("not base_failed").groupBy(binned).count().collect():
            every[r["bin"]] += r["count"]
        return float(np.searchsorted(np.cumsum(every), 0.995 * every.sum()) + 1) / BINS
    lost = lambda k: cost_of_good * good[k:].sum() / good.sum() + bad[:k].sum() / bad.sum()
    costs = np.array([lost(k) for k in range(BINS + 2)])
    best = np.flatnonzero(costs <= costs.min() + 1e-12)
    return float(best[len(best) // 2]) / BINS


def quality_rules(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, anomaly and kept of every document."""
    stats = stored(rule_statistics(docs), "rule-statistics")
    scored = stored(score(stats, fit_forest(stats, labels)), "rule-scores")
    cut = threshold(scored, labels)
    kept = ~F.col("base_failed") & (F.floor(F.col("anomaly") * BINS) < cut * BINS)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "anomaly")


def keep_rows(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows, with all their columns, that quality_rules() keeps.

    The forest and its cut come from all rows' statistics; each row is then judged where it lies, so texts never move.
    """
    stats = stored(rule_statistics(docs), "rule-statistics")
    forest = fit_forest(stats, labels)
    cut = threshold(stored(score(stats, forest), "rule-scores"), labels)
    sent, at = docs.sparkSession.sparkContext.broadcast(forest), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(x.as_py() or "") for x in batch.column(at)]
            failed = np.array([r[5] for r in rows], bool)
            x = np.array([r[6:] for r in rows], np.float32).reshape(len(rows), len(STATS))
            ordinary = np.floor(sent.value.scores(x) * BINS) < cut * BINS
            yield batch.filter(pa.array(~failed & ordinary))

    return docs.mapInArrow(run, docs.schema)
