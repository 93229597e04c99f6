"""Benchmark decontamination: a BM25 inverted index of test items that every training passage queries.

Spark counts the items' words: document frequencies, item lengths and their mean are one table over all items. Each
item's impacts are divided by its score for its own text, so one threshold serves short and long items. Items are dealt
over shards; a shard's index has a posting list per word, in order of item, with the list's largest impact and that of
each block of BLOCK items. A passage's distinct words are its query. It is searched by block-max WAND: blocks in which
the maxima of the words' lists stay under the threshold are skipped; in the others cursors stand on the lists, the
pivot is the first item at which the maxima of the cursors up to it reach the threshold, and the cursors move on to it
and score it. Many passages are searched in lockstep. All items at or above the threshold are retrieved. A retrieved
item is a leak if enough five-word shingles of its question (all lines but the last) and of its answer (the last of
several lines) stand in the passage.

Passages are two neighbouring segments as long as the longest item, so each item lies whole in some passage.
Shards hold about ITEMS items; a pass over the documents takes as many shards as PASS_BYTES hold. Impacts and passages
come from all items, so the results do not depend on how items are dealt over shards.

Edge cases: null or empty documents have no passages, items without words match nothing, an empty table of either kind
gives no leak; repeated items and rows each give their rows; null ids stay null; texts of any length are searched whole,
held by one task; other columns never matter.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_codec import LETTER, NUMBER, kinds
from .common import bounded_batches, ids_and_texts, steps, stored, whole_groups
from .wordhash import mix, powers

K1, B = 1.2, 0.75
#: Share of an item's own score that retrieves it, and of its shingles that make it a leak.
THRESHOLD, OVERLAP, SHINGLE = 0.5, 0.8, 5
#: Items of a shard about, and of a block, and bytes of shards that one pass over the documents takes.
ITEMS, BLOCK, PASS_BYTES = 8192, 8, 64 << 20
#: Cursors of passages, and passages times blocks, that are searched at once, and what float sums may lack.
CURSORS, BOUNDS, SLACK = 1 << 16, 1 << 22, 1e-4
BREAK = 0xD800


def plain_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased runs of letters and digits, and where each text's begin (one more than texts)."""
    codes = np.frombuffer(chr(BREAK).join([*(t.lower() for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds(codes)
    inside = np.zeros(len(codes) + 1, np.int8)
    inside[:-1] = (kind == LETTER) | (kind == NUMBER)
    edge = np.diff(inside, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
    bounds = np.searchsorted(starts, np.concatenate(([0], np.flatnonzero(codes == BREAK) + 1)))
    return mix((total[ends] - total[starts]) * down[starts]), bounds


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Distinct hashes of k words in a row; of all words if there are fewer."""
    if not len(words):
        return words
    k = min(k, len(words))
    out = words[: len(words) - k + 1].copy()
    for j in range(1, k):
        out = mix(out) + words[j : len(words) - k + 1 + j]
    return np.unique(out)


class Index:
    """A shard: posting lists of normalised BM25 impacts with their maxima by list and by block."""

    def __init__(self, items: list[tuple[int | None, str]], terms: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int, mean: float, longest: int):
        """`terms` has each item's distinct words, in order, their counts and their document frequencies."""
        self.longest = longest
        self.vocabulary, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *(w for w, _, _ in terms)]), return_counts=True)
        # items with a common most frequent word, so mostly of one language, are neighbours, which tightens the maxima
        top = [int(w[np.argmax(count[np.searchsorted(self.vocabulary, w)])]) for w, _, _ in terms]
        order = sorted(range(len(items)), key=lambda i: (top[i], len(terms[i][0])))
        self.ids = [items[i][0] for i in order]
        found = []
        for i, (w, tf, df) in enumerate(terms[j] for j in order):
            size = tf.sum()
            x = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))
            found.append((np.searchsorted(self.vocabulary, w), np.full(len(w), i), x / x.sum()))
        term, item, impact = (np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        at = np.lexsort((item, term))
        term, item, self.impact = term[at], item[at].astype(np.int64), impact[at].astype(np.float32)
        #: Postings are numbers term * width + item in order, so a cursor moves by binary search.
        self.width = len(items) + 1
        self.key = term * self.width + item
        self.begin = np.searchsorted(term, np.arange(len(self.vocabulary) + 1))
        self.list_max = np.maximum.reduceat(self.impact, self.begin[:-1]).astype(np.float64) if len(item) else np.zeros(0)
        # blocks of BLOCK items, the same for all lists; a list has those in which it has postings
        part = item // BLOCK
        spot = np.flatnonzero(np.concatenate(([True], (part[1:] != part[:-1]) | (term[1:] != term[:-1])))) if len(item) else np.zeros(0, np.int64)
        self.block = part[spot]
        self.block_max = np.maximum.reduceat(self.impact, spot).astype(np.float64) if len(item) else np.zeros(0)
        self.block_begin = np.searchsorted(spot, self.begin)
        self.n_blocks = int(part.max(initial=-1)) + 1
        self.parts = []
        for i in order:
            lines = [x for x in items[i][1].split("\n") if x.strip()]
            question, answer = ("\n".join(lines[:-1]), lines[-1]) if len(lines) > 1 else (items[i][1], "")
            made = plain_words([question, answer])
            q, a = (made[0][x:y] for x, y in zip(made[1][:-1], made[1][1:], strict=True))
            self.parts.append([(min(SHINGLE, len(p)), shingles(p, SHINGLE)) for p in (q, a) if len(p)])

    def search(self, query: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, item, score) of all items at or above the threshold; rows are the queries' terms, sorted by query."""
        low = threshold - SLACK
        # shallow: the blocks of each query in which its lists' block maxima reach the threshold
        many = self.block_begin[term + 1] - self.block_begin[term]
        entry = np.arange(many.sum()) + np.repeat(self.block_begin[term] - np.cumsum(many) + many, many)
        pair = np.repeat(query, many) * self.n_blocks + self.block[entry]
        bound = np.bincount(pair, self.block_max[entry])
        live = np.flatnonzero(bound[pair] >= low) if len(pair) else pair
        names, pair = np.unique(pair[live], return_inverse=True)
        term, most = np.repeat(term, many)[live], self.block_max[entry[live]]
        order = np.lexsort((term, pair))
        pair, term, most = pair[order], term[order], most[order]
        owner, at = names // max(1, self.n_blocks), names % max(1, self.n_blocks) * BLOCK
        end = at + BLOCK
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        # deep: cursors on the lists of such a block, all queries in lockstep
        while len(pair):
            cursor = np.searchsorted(self.key, term * self.width + at[pair])
            on = cursor < self.begin[term + 1]
            on[on] = self.key[cursor[on]] < (term * self.width + end[pair])[on]
            pair, term, most, cursor = pair[on], term[on], most[on], cursor[on]
            if not len(pair):
                break
            item = self.key[cursor] - term * self.width
            order = np.lexsort((item, pair))
            p = pair[order]
            first = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
            total = np.cumsum(most[order])
            total -= np.repeat(total[first] - most[order][first], np.diff(np.append(first, len(p))))
            # pivots: where the maxima of the cursors up to there first reach the threshold; blocks without one are done
            reached = np.flatnonzero(total >= low)
            pivot = reached[np.concatenate(([True], p[reached][1:] != p[reached][:-1]))] if len(reached) else reached
            goal = np.full(len(names), -1)
            goal[p[pivot]] = item[order][pivot]
            # the cursors move to the pivot, and what stands on it is its score
            place = np.searchsorted(self.key, term * self.width + goal[pair])
            hit = (goal[pair] >= 0) & (place < len(self.key))
            hit[hit] = self.key[place[hit]] == (term * self.width + goal[pair])[hit]
            score = np.bincount(pair[hit], self.impact[place[hit]], len(names))
            found = np.flatnonzero((goal >= 0) & (score >= low))
            out.append((owner[found], goal[found], score[found]))
            at = goal + 1
            on = goal[pair] >= 0
            pair, term, most = pair[on], term[on], most[on]
        return tuple(np.concatenate(c) for c in zip(*out, strict=True))

    def leaks(self, texts: list[str], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float]]:
        """(text, item, score, overlap) of every leak, the best passage of each pair."""
        if not self.ids:
            return []
        hashes, bounds = plain_words(texts)
        length = self.longest
        sizes = np.diff(bounds)
        parts = -(-sizes // length)
        first = np.cumsum(parts) - parts
        of = np.repeat(np.arange(len(texts)), sizes)
        segment = first[of] + (np.arange(len(hashes)) - bounds[of]) // length
        term = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        known = self.vocabulary[term] == hashes
        pairs = np.unique(segment[known] * len(self.vocabulary) + term[known])
        where, term = pairs // len(self.vocabulary), pairs % len(self.vocabulary)
        n = int(parts.sum())
        of_segment = np.repeat(np.arange(len(texts)), parts)
        follows = np.append(of_segment[1:] == of_segment[:-1], False) if n else np.zeros(0, bool)
        # a passage that its words' maxima do not lift to the threshold has no pivot
        bound = np.bincount(where, self.list_max[term], n)
        passages = np.flatnonzero(bound + np.where(follows, np.append(bound[1:], 0), 0) >= threshold - SLACK) if n else np.zeros(0, np.int64)
        edges = np.searchsorted(where, np.arange(n + 2))
        best: dict[tuple[int, int], tuple[float, float]] = {}
        to = passages + 1 + (follows[passages] if n else 0)
        work, k = np.cumsum(edges[to] - edges[passages]), 0
        while k < len(passages):
            stop = max(k + 1, int(np.searchsorted(work, (work[k - 1] if k else 0) + CURSORS, "right")))
            stop = min(stop, k + max(1, BOUNDS // max(1, self.n_blocks)))
            own, many = passages[k:stop], (edges[to] - edges[passages])[k:stop]
            spot = np.arange(many.sum()) + np.repeat(edges[own] - np.cumsum(many) + many, many)
            asked = np.unique(np.repeat(np.arange(len(own)), many) * len(self.vocabulary) + term[spot])
            for q, i, score in zip(*(x.tolist() for x in self.search(asked // len(self.vocabulary), asked % len(self.vocabulary), threshold)), strict=True):
                p = int(own[q])
                t = int(of_segment[p])
                start = bounds[t] + (p - first[t]) * length
                share = self.overlap(i, hashes[start : min(bounds[t + 1], start + int(to[k + q] - p) * length)])
                if share >= overlap:
                    best[t, i] = max(best.get((t, i), (0.0, 0.0)), (share, score))
            k = stop
        return [(t, i, score, share) for (t, i), (share, score) in best.items()]

    def overlap(self, item: int, words: np.ndarray) -> float:
        """The smaller share, of the question's and the answer's shingles, that the words hold."""
        shares = []
        for k, own in self.parts[item]:
            held = shingles(words, k) if len(words) >= k else words[:0]
            shares.append(float(np.isin(own, held, assume_unique=True).mean()))
        return min(shares, default=0.0)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, term, tf, n) of the distinct words of items, n the item's number of words."""
    for ids, texts in steps(batches):
        hashes, bounds = plain_words(texts)
        for i, a, b in zip(ids, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            w, tf = np.unique(hashes[a:b], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(w), pa.int64()), pa.array(w.view(np.int64)), pa.array(tf), pa.array([b - a] * len(w), pa.int64())], ["uid", "term", "tf", "n"])


def _built(n: int, mean: float, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """An index of each shard; rows are sorted by shard, id, text and uid."""
        for batch in whole_groups(batches, "shard"):
            for shard in np.unique(batch.column("shard").to_numpy()).tolist():
                rows = batch.filter(pa.compute.equal(batch.column("shard"), shard)).to_pylist()
                terms = []
                for r in rows:
                    w = np.array([x["term"] for x in r["terms"]], np.int64).view(np.uint64)
                    order = np.argsort(w)
                    terms.append((w[order], *(np.array([x[c] for x in r["terms"]], np.float64)[order] for c in ("tf", "df"))))
                blob = pickle.dumps(Index([(r["id"], r["text"]) for r in rows], terms, n, mean, longest))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([blob], pa.binary())], ["shard", "blob"])

    return run


def build_index(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """The stored shards (shard, blob) of the index; only the three totals of all items reach the driver."""
    base = ids_and_texts(items, key, text).select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    base = stored(base.withColumn("uid", F.monotonically_increasing_id()), "items")
    terms = stored(base.select("uid", "text").mapInArrow(_terms, "uid long, term long, tf long, n long"), "item-terms")
    totals = terms.groupBy("uid").agg(F.first("n").alias("n")).agg(F.count("*").alias("n"), F.avg("n").alias("mean"), F.max("n").alias("longest")).first()
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    lists = terms.join(df, "term").groupBy("uid").agg(F.collect_list(F.struct("term", "tf", "df")).alias("terms"))
    shard = F.pmod(F.xxhash64("uid"), F.lit(max(1, -(-totals["n"] // ITEMS)))).cast("int").alias("shard")
    rows = base.join(lists, "uid").select(shard, "id", "text", "uid", "terms")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "id", "text", "uid")
    return stored(rows.mapInArrow(_built(totals["n"], totals["mean"] or 1.0, totals["longest"] or 1), "shard int, blob binary"), "index")


def passes(index: DataFrame) -> Iterator[list[bytes]]:
    """Shards for one pass over the documents each, of PASS_BYTES or one shard; the driver holds no more than that."""
    held: list[bytes] = []
    for row in index.select("blob").toLocalIterator():
        if held and sum(map(len, held)) + len(row["blob"]) > PASS_BYTES:
            yield held
            held = []
        held.append(bytes(row["blob"]))
    if held:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score (share of the item's own) and overlap of every leak."""
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, score double, overlap double"
    source = ids_and_texts(docs)
    out = None
    for blobs in passes(build_index(items)):
        sent = spark.sparkContext.broadcast(blobs)  # PASS_BYTES at most

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shards = [*map(pickle.loads, sent.value)]
            for ids, texts in steps(batches):
                rows = [(ids[t], own.ids[i], round(score, 6), round(share, 6)) for own in shards for t, i, score, share in own.leaks(texts, threshold, overlap)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)], ["doc_id", "item_id", "score", "overlap"])

        found = source.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows, with all their columns, of documents without a leak. Rows are judged where they lie: nothing moves."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for blobs in passes(build_index(items)):
        sent = docs.sparkSession.sparkContext.broadcast(blobs)  # PASS_BYTES at most

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            shards = [*map(pickle.loads, sent.value)]
            for batch in batches:
                clean, k = np.ones(batch.num_rows, bool), 0
                for ids, texts in steps([pa.RecordBatch.from_arrays([pa.array(range(batch.num_rows)), batch.column(at)], ["k", "text"])]):
                    for own in shards:
                        for t, *_ in own.leaks(texts, threshold, overlap):
                            clean[k + t] = False
                    k += len(ids)
                yield batch.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
