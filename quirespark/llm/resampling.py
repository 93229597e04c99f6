r"""Target-distribution importance resampling over hashed n-gram buckets.

Documents become rows of a sparse document-by-bucket count matrix, stored as CSR blocks. Column sums of the documents'
and the target's matrix are the two distributions; the logarithm of their ratio is a bucket's gain; the matrix times the
gains gives each document's weight. Gumbel noise that the id gives turns the largest scores into a draw by weight.

What the driver holds are two vectors of BUCKETS sums and the gains, whatever the tables' sizes.

Edge cases: null and empty texts have no features, weight 0 and are never drawn; a null doc_id hashes as an empty string,
its rows rank behind others of their score; repeated rows count each time and get a rank each; ties go to the smaller
doc_id; an empty target makes every bucket's gain depend on the documents alone; an empty table gives no rows; other
columns never matter; texts of any length are counted whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_and_texts, steps, stored

#: Buckets of features, the shortest document to draw (words), and the share drawn in percent.
BUCKETS, MIN_WORDS, PERCENT = 10_000, 20, 25
#: A-Z as a-z; bytes of letters, digits and of any character beyond ASCII stay, all others become blanks.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
CSR = "ids array<bigint>, words array<bigint>, starts array<bigint>, buckets array<int>, counts array<bigint>"
#: Scores are cut into ranges of so many, for the sums over all higher scores.
SPAN = 256


def buckets_of(text: str) -> tuple[int, np.ndarray]:
    """Words, and the buckets of their runs of one and two."""
    own = text.encode().translate(WORD_BYTES).split()
    one = list(map(crc32, own))
    two = [crc32(w, crc32(b" ", c)) for c, w in zip(one, own[1:], strict=False)]  # crc32 goes on from a run's first word
    return len(own), np.array(one + two, np.int64) % BUCKETS


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.list_(pa.int64())] * 3 + [pa.list_(pa.int32()), pa.list_(pa.int64())]
    for ids, texts in steps(batches):
        words, rows = zip(*map(buckets_of, texts), strict=True)
        cells, counts = np.unique(np.concatenate([np.int64(k) * BUCKETS + b for k, b in enumerate(rows)]), return_counts=True)
        starts = np.searchsorted(cells, np.arange(len(ids) + 1) * BUCKETS)
        block = (ids, words, starts, (cells % BUCKETS).astype(np.int32), counts.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(block, kinds, strict=True)], ["ids", "words", "starts", "buckets", "counts"])


def count_matrix(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The sparse count matrix of (key, text) as stored CSR blocks of about a million characters each.

    Row k of a block is the document ids[k] with words[k] words; its cells are starts[k] to starts[k + 1] of buckets and
    counts.
    """
    return stored(ids_and_texts(docs, key).mapInArrow(_blocks, CSR), "csr")


def _array(batch: pa.RecordBatch, name: str, row: int) -> np.ndarray:
    return batch.column(name)[row].values.to_numpy(zero_copy_only=False)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            own = np.bincount(_array(batch, "buckets", k), _array(batch, "counts", k), BUCKETS)  # of one block, so exact
            total += own.astype(np.int64)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])


def column_sums(matrix: DataFrame) -> np.ndarray:
    """Features in each bucket; tasks add up their blocks first, so BUCKETS rows leave each and reach the driver."""
    out = np.zeros(BUCKETS, np.int64)
    for r in matrix.mapInArrow(_sums, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the ratio of smoothed shares."""
    s_all, t_all = int(source.sum()), int(target.sum())
    s_all, t_all = float(s_all + BUCKETS), float(t_all + BUCKETS)
    ratios = (float(t + 1) * s_all / (float(s + 1) * t_all) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def matrix_times(matrix: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): each row's product with the gains over its features, floored; 0 without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                starts, counts = _array(batch, "starts", k), _array(batch, "counts", k)
                summed = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[starts])  # noqa: B023, E731
                n = summed(counts)
                weight = summed(counts * gains[_array(batch, "buckets", k)]) // np.maximum(n, 1)
                ids = batch.column("ids")[k].values
                yield pa.RecordBatch.from_arrays([ids, pa.array(_array(batch, "words", k)), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(key: Column, seed: int = 7) -> Column:
    """Noise in thousandths that a key gives: floor(-1000 ln(-ln u)), u from the first 32 bits of a digest."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln(u)))


def drawn(scored: DataFrame, percent: int = PERCENT) -> DataFrame:
    """`rank` of the eligible rows of highest score, floor(percent * their number / 100) of them, ties by doc_id.

    A rank is the number of eligible rows of higher scores, plus the place within its score. Scores are thousandths of
    logarithms of 64-bit counts and 32-bit noise, so there are under 250,000 of them, in under 1,000 ranges of SPAN: the
    sums over higher scores run over these, not over rows.
    """
    per_score = scored.where("eligible").groupBy("score").agg(F.count("*").alias("of_score")).withColumn("span", F.floor(F.col("score") / SPAN))
    spans = per_score.groupBy("span").agg(F.sum("of_score").alias("of_span"))
    higher = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    all_spans = Window.orderBy(F.desc("span"))
    spans = spans.select("span", F.coalesce(F.sum("of_span").over(higher(all_spans)), F.lit(0)).alias("above_span"), F.sum("of_span").over(Window.partitionBy()).alias("of_all"))
    within = F.coalesce(F.sum("of_score").over(higher(Window.partitionBy("span").orderBy(F.desc("score")))), F.lit(0))
    above = per_score.withColumn("within", within).join(F.broadcast(spans), "span")
    above = above.select("score", (F.col("above_span") + F.col("within")).alias("above"), F.floor(F.col("of_all") * percent / F.lit(100)).alias("wanted"))
    placed = F.row_number().over(Window.partitionBy("score", "eligible").orderBy(F.asc_nulls_last("doc_id"), "n_features"))
    ranks = scored.join(F.broadcast(above), "score", "left").withColumn("place", F.col("above") + placed)
    return ranks.withColumn("rank", F.when(F.col("eligible") & (F.col("place") <= F.col("wanted")), F.col("place")).cast("long"))


def resampled(docs: DataFrame, target: DataFrame, target_key: str = "item_id") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null for those not drawn."""
    matrix = count_matrix(docs)
    gains = bucket_gains(column_sums(matrix), column_sums(count_matrix(target, target_key)))
    weighed = matrix_times(matrix, gains)
    scored = weighed.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"))).alias("score"), (F.col("n_words") >= MIN_WORDS).alias("eligible"))
    return drawn(stored(scored, "scored")).select("doc_id", "n_features", "weight", "score", "rank")
