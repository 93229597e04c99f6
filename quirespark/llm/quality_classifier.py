"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Words are cut into runs of letters, digits and marks, hashed to BUCKETS rows. Each row has a sparse random index
vector; a row's word vector is the sum of the index vectors of its neighbours over all documents, scaled by the log
of its count. Executors add up partial tables, so the driver receives BUCKETS x DIM sums whatever the corpus. A
document is the mean of its words' vectors with a few shares of the word kinds. A network with one hidden layer is
trained in numpy on a bounded sample of labelled rows, its temperature is fitted on a part kept aside.

Edge cases: null and empty text pool to zeros and get the score of that; a null doc_id is never learnt from; an id
labelled both 0 and 1 is not learnt from, and of an id's several texts the one of smallest features is; where fewer than
two different labels are left, the score is the share of label 1, or 0.5; repeated rows stay; an empty table gives no
rows; texts of any length are pooled whole, by one task; columns other than doc_id, text and quality never matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import LETTER, NUMBER, SPACE, WHOLE, kinds
from .common import ids_and_texts, steps, stored
from .wordhash import mix, powers

BUCKETS, DIM, NONZERO, WINDOW = 1 << 14, 48, 4, 2
#: Most labelled rows that the network learns from: those of smallest hash.
FIT_ROWS = 20_000
CUT = 0.3
BREAK = 0xD800
SHARES = 12


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimensions and signs of each bucket's index vector."""
    rng = np.random.default_rng(11)
    return rng.integers(0, DIM, (BUCKETS, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (BUCKETS, NONZERO))


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the texts' runs of one kind, where each text's begin, and the texts' shares of word kinds."""
    codes = np.frombuffer(chr(BREAK).join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds(codes)
    edge = np.flatnonzero(np.concatenate(([True], kind[1:] != kind[:-1], [True])))
    starts, ends = edge[:-1], edge[1:]
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    keep = (kind[starts] != SPACE) & (kind[starts] != WHOLE)
    starts, ends = starts[keep], ends[keep]
    hashes = mix((total[ends] - total[starts]) * down[starts])
    stops = np.flatnonzero(codes == BREAK)
    bounds = np.searchsorted(starts, np.concatenate(([0], stops + 1)))
    of = np.repeat(np.arange(len(texts)), np.diff(bounds))
    own, upper = kind[starts], (codes >= 65) & (codes <= 90)
    uppers = np.concatenate(([0], np.cumsum(upper)))
    spread = uppers[ends] - uppers[starts]
    size = ends - starts
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (of[1:] == of[:-1])
    again[2:] |= (hashes[2:] == hashes[:-2]) & (of[2:] == of[:-2])
    order = np.lexsort((hashes, of))
    seen = np.zeros(len(starts), bool)
    seen[order[1:]] = (hashes[order][1:] == hashes[order][:-1]) & (of[order][1:] == of[order][:-1])
    mark = (own != LETTER) & (own != NUMBER)
    one = codes[starts]
    last = lambda c: mark & (one == ord(c))
    flags = [mark, own == NUMBER, (own == LETTER) & (spread == size) & (size > 1), again, seen & (own == LETTER), mark & (size > 1), last("|"), last("."), last(","), last("!")]
    n = np.maximum(1, np.diff(bounds))
    shares = [np.bincount(of, f, len(texts)) / n for f in flags]
    shares += [np.log1p(np.diff(bounds)) / 10, np.bincount(of, size, len(texts)) / n / 10]
    return (hashes >> np.uint64(50)).astype(np.int64), bounds, np.column_stack(shares)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of one task: (bucket, count, sums) rows."""
    spots, signs = index_vectors()
    table, count = np.zeros(BUCKETS * DIM), np.zeros(BUCKETS)
    for _, texts in steps(batches):
        word, bounds, _ = tokens(texts)
        of = np.repeat(np.arange(len(texts)), np.diff(bounds))
        count += np.bincount(word, minlength=BUCKETS)
        # co-occurrences of buckets first: numpy then adds each pair's index vector once
        for shift in range(1, WINDOW + 1):
            same = of[shift:] == of[:-shift]
            a, b = word[shift:][same], word[:-shift][same]
            for x, y in ((a, b), (b, a)):
                for k in range(NONZERO):
                    table += np.bincount(x * DIM + spots[y, k], signs[y, k], BUCKETS * DIM)
    if count.any():
        rows = np.flatnonzero(count)
        sums = pa.FixedSizeListArray.from_arrays(pa.array(table.reshape(BUCKETS, DIM)[rows].ravel()), DIM).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(count[rows]), sums], ["bucket", "n", "sums"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds partial tables up; what one task gathers is one table."""
    table, count = np.zeros((BUCKETS, DIM)), np.zeros(BUCKETS)
    for batch in batches:
        rows = batch.column(0).to_numpy()
        np.add.at(count, rows, batch.column(1).to_numpy())
        np.add.at(table, rows, batch.column(2).flatten().to_numpy().reshape(-1, DIM))
    rows = np.flatnonzero(count)
    if len(rows):
        sums = pa.FixedSizeListArray.from_arrays(pa.array(table[rows].ravel()), DIM).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(count[rows]), sums], ["bucket", "n", "sums"])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM unit vectors over all documents. Partial tables meet by bucket range, then at the driver (6 MB)."""
    schema = "bucket int, n double, sums array<double>"
    partial = ids_and_texts(docs).mapInArrow(_neighbours, schema)
    met = partial.repartition(min(16, max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))), "bucket").mapInArrow(_fold, schema)
    vectors = np.zeros((BUCKETS, DIM), np.float32)
    for r in met.select("bucket", "n", F.col("sums").cast("array<float>").alias("sums")).toLocalIterator():
        v = np.array(r["sums"], np.float32)
        vectors[r["bucket"]] = v / max(1e-9, float(np.linalg.norm(v))) / np.log(2.7 + r["n"])
    return vectors


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """doc_id and features (array of float): the mean word vector and the shares."""
    sent = docs.sparkSession.sparkContext.broadcast(vectors)  # BUCKETS x DIM floats, 3 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for ids, texts in steps(batches):
            word, bounds, shares = tokens(texts)
            of = np.repeat(np.arange(len(texts)), np.diff(bounds))
            n = np.maximum(1, np.diff(bounds))
            x = np.column_stack([*(np.bincount(of, table[word, d], len(texts)) / n for d in range(DIM)), shares]).astype(np.float32)
            features = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), features], ["doc_id", "features"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, features array<float>")


class Network:
    """Two layers, trained with Adam; the temperature is fitted on rows kept aside."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(DIM + SHARES), np.ones(DIM + SHARES))
        self.prior = float(y.mean()) if len(y) else 0.5
        self.weights, self.temperature = None, 1.0
        if len(np.unique(y)) < 2:
            return
        x = self._scaled(x)
        order = rng.permutation(len(x))
        aside, own = order[: len(x) // 5], order[len(x) // 5 :]
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(epochs):
            rng.shuffle(own)
            for k in range(0, len(own), 256):
                a, b = x[own[k : k + 256]], y[own[k : k + 256]]
                h = np.tanh(a @ w[0] + w[1])
                d = (1 / (1 + np.exp(-(h @ w[2] + w[3]))) - b) / len(b)
                e = np.outer(d, w[2]) * (1 - h * h)
                t += 1
                for j, g in enumerate((a.T @ e + 1e-4 * w[0], e.sum(0), h.T @ d + 1e-4 * w[2], d.sum(keepdims=True))):
                    m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                    w[j] = w[j] - 0.004 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        self.weights = w
        logits, truth = self._logits(x[aside]), y[aside]
        loss = lambda c: float(np.mean(np.logaddexp(0, logits / c) - truth * logits / c))
        self.temperature = min(np.geomspace(0.25, 8, 61).tolist(), key=loss) if len(aside) else 1.0

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def _logits(self, x: np.ndarray) -> np.ndarray:
        w = self.weights
        return np.tanh(x @ w[0] + w[1]) @ w[2] + w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-self._logits(self._scaled(x)) / self.temperature))


def held_out(doc_id: int | None) -> bool:
    """Rows that are never learnt from: crc32 of the id as text leaves 0 by 5."""
    return doc_id is not None and crc32(str(doc_id).encode()) % 5 == 0


def fit(features: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Network:
    """The network, from at most fit_rows labelled rows that are not held out."""
    learnt = (F.crc32(F.col("doc_id").cast("string")) % 5 != 0) & F.col("quality").isin(0, 1)
    rows = labels.where(learnt).select("doc_id", "quality").distinct()
    # the labels of smallest hash are picked before the join, so what moves is bounded
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(fit_rows)
    found = features.join(rows, "doc_id").groupBy("doc_id").agg(F.min("features").alias("features"), F.avg("quality").alias("quality")).where("quality in (0, 1)").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    x = np.array(found["features"].tolist(), np.float32).reshape(-1, DIM + SHARES)
    return Network(x, found["quality"].to_numpy(float))


def quality_scores(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    features = stored(pooled(docs, word_vectors(docs)), "pooled")
    sent = docs.sparkSession.sparkContext.broadcast(fit(features, labels))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, DIM + SHARES)
            score = sent.value.scores(x)
            out = [batch.column(0), pa.array([held_out(i) for i in batch.column(0).to_pylist()]), pa.array(score, pa.float64()), pa.array((score >= cut).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "score", "predicted"])

    return features.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
