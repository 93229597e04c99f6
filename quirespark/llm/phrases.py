r"""Phrase collocation mining: n-grams that stick together, per language, ranked.

Texts are exploded into rows of (language, n-gram, count), hash-aggregated by language and n-gram; candidates are joined
with the counts of their first parts and rests, scored in Decimal, anti-joined with one-word extensions that occur half
as often, and ranked by windows.

Rows go by level: orders 0 (all words of a language, under the empty phrase), 1 and 2 first, then one more at a time. An
n-gram of a higher order makes a row only if both n-grams of one word less inside it may be frequent, which a bit of a
hash table of SIEVE bits says; an n-gram never occurs more often than a part of it, so the sieve never loses one that
counts, and one that it lets through wrongly falls to its own count. The table's size is fixed, so it may be broadcast;
with very many frequent n-grams it lets more rows through, with the same result. Only frequent n-grams are ever stored.

A candidate inside any longer candidate that occurs half as often is also inside one that is a word longer, so
one-word extensions suffice.

Bounds: exact while 1,000,000 * a * a stays under 10 ** 38, a under 10 ** 16.

Edge cases: null and empty texts have no words; a null language is `und`; a doc_id is not needed, so null ids and repeated
rows count like others; texts are cut into chunks at piece breaks, a piece of any length is read whole; ties of score and
count go by the phrase's bytes; an empty table gives no rows; other columns never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, stored
from .wordhash import LOWER, mix, span_hashes

#: Characters that end a piece, blanks between words, what a language is called that is not known.
BREAKS, BLANKS, UNKNOWN = b".,;:!?\n\x0b\x0c\r", b" \t", "und"
KIND = np.zeros(256, np.uint8)
KIND[list(BLANKS)] = 1
KIND[list(BREAKS)] = 2
#: Bytes of text that one step holds, rows of a batch that leaves it, bits of the sieve (8 MB).
STEP_BYTES, OUT_ROWS, SIEVE = 1_500_000, 50_000, 1 << 26
GRAMS = "lang string, phrase string, n long"
#: Parts that a language's candidates are dealt over before the last of them are ranked together.
PARTS = 64


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Languages and texts of each step; longer texts are cut behind a piece break."""
    langs, texts, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            raw = (text.as_py() or "").encode()
            while raw:
                part = raw
                if len(raw) > STEP_BYTES:
                    ends = np.flatnonzero(KIND[np.frombuffer(raw, np.uint8)] == 2)
                    after = np.searchsorted(ends, STEP_BYTES)
                    part = raw[: ends[after] + 1] if after < len(ends) else raw
                raw = raw[len(part) :]
                if texts and size + len(part) > STEP_BYTES:
                    yield langs, texts
                    langs, texts, size = [], [], 0
                langs.append(lang)
                texts.append(part)
                size += len(part)
    if texts:
        yield langs, texts


class Words:
    """All words of some texts, in order: their codes, hashes, languages and pieces."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        data = LOWER[np.frombuffer(b"\n".join([*texts, b""]), np.uint8)]
        kind = KIND[data]
        edge = np.diff((kind == 0).astype(np.int8), prepend=np.int8(0))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        bare = data[kind == 0]
        begins = np.concatenate([[0], np.cumsum(ends - starts)])
        flat = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(begins.astype(np.int64)), pa.py_buffer(bare))
        coded = flat.dictionary_encode()
        self.codes, self.table = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.piece = np.cumsum(kind == 2)[starts]
        own = pa.array(langs).dictionary_encode()
        self.langs = own.dictionary
        bounds = np.cumsum([len(t) + 1 for t in texts])
        self.lang = own.indices.to_numpy().astype(np.int64)[np.searchsorted(bounds, starts, "right")]
        names = [x.encode() for x in self.langs.to_pylist()]
        at = np.cumsum([0, *map(len, names)])
        of_lang = span_hashes(np.frombuffer(b"".join(names), np.uint8), at[:-1], at[1:])
        self.hashes, self.salt = span_hashes(bare, begins[:-1], begins[1:]), of_lang[self.lang]

    def whole(self, order: int) -> np.ndarray:
        """Places at which an n-gram of the order lies within a piece."""
        last = len(self.codes) - order + 1
        return np.flatnonzero(self.piece[:last] == self.piece[order - 1 :]) if last > 0 else np.array([], np.int64)

    def bits(self, order: int) -> np.ndarray:
        """The bit of the sieve for the n-gram that begins at each place."""
        h = self.salt[: max(0, len(self.codes) - order + 1)]
        for k in range(order):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + self.hashes[k : k + len(h)])
        return (h % np.uint64(SIEVE)).astype(np.int64)

    def counted(self, order: int, sieve: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        """(lang, phrase, n) of each n-gram of an order; with a sieve only where both parts of one word less pass it."""
        if order == 0:
            found, n = np.unique(self.lang, return_counts=True)
            yield _batch(self.langs.take(pa.array(found)), pa.array([""] * len(found)), n)
            return
        at = self.whole(order)
        if sieve is not None:
            bit = self.bits(order - 1)
            passed = sieve[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
            at = at[(passed[at] & passed[at + 1]) == 1]
        key = self.lang[at]
        for k in range(order):
            key = np.unique(key * len(self.table) + self.codes[at + k], return_inverse=True)[1]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        at = at[first]
        for k in range(0, len(at), OUT_ROWS):
            some = at[k : k + OUT_ROWS]
            words = [self.table.take(pa.array(self.codes[some + j])) for j in range(order)]
            phrase = pc.binary_join_element_wise(*words, pa.scalar(" ", pa.large_string())) if order > 1 else words[0]
            yield _batch(self.langs.take(pa.array(self.lang[some])), phrase.cast(pa.string()), n[k : k + OUT_ROWS])


def _batch(lang: pa.Array, phrase: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(n, pa.int64())], ["lang", "phrase", "n"])


def _frequent(docs: DataFrame, orders: list[int], least: int, sieve: np.ndarray | None) -> DataFrame:
    """The stored n-grams of some orders that occur `least` times or more."""
    shared = None if sieve is None else docs.sparkSession.sparkContext.broadcast(sieve)  # SIEVE bits, whatever the tables

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if shared is None else shared.value
        for langs, texts in _chunks(batches):
            words = Words(langs, texts)
            for order in orders:
                yield from words.counted(order, own)

    rows = docs.mapInArrow(explode, GRAMS).groupBy("lang", "phrase").agg(F.sum("n").alias("n"))
    out = stored(rows.where(F.col("n") >= least), "grams")
    if shared is not None:
        shared.destroy()
    return out


def _sieve(grams: DataFrame, order: int) -> np.ndarray:
    """A bit for each of the n-grams, as bytes: at most SIEVE / 64 rows of 64 bits reach the driver."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = Words(batch.column("lang").to_pylist(), [p.encode() for p in batch.column("phrase").to_pylist()])
                bit = words.bits(order)[words.whole(order)]
                yield pa.RecordBatch.from_arrays([pa.array(bit >> 6), pa.array(np.left_shift(np.uint64(1), (bit & 63).astype(np.uint64)).view(np.int64))], ["place", "mask"])

    out = np.zeros(SIEVE >> 6, np.uint64)
    rows = grams.select("lang", "phrase").mapInArrow(marks, "place long, mask long").groupBy("place").agg(F.bit_or("mask").alias("mask")).toArrow()
    out[rows.column("place").to_numpy()] = rows.column("mask").to_numpy().view(np.uint64)
    return out.view(np.uint8)


def phrase_counts(docs: DataFrame, max_n: int, least: int) -> DataFrame:
    """(lang, phrase, n) of every n-gram of 0 to max_n words that occurs `least` times or more in its language."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    out = last = _frequent(rows, list(range(min(2, max_n) + 1)), least, None)
    for order in range(3, max_n + 1):
        last = _frequent(rows, [order], least, _sieve(last.where(_words(F.col("phrase")) == order - 1), order - 1))
        out = out.unionByName(last)
    return out


def _words(phrase: Column) -> Column:
    """Words of a phrase; none of the empty one."""
    return F.when(phrase == "", 0).otherwise(F.size(F.split(phrase, " ")))


def _part(words: Column, start: Column | int, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def scored_phrases(counts: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of each candidate, by its lowest-scoring cut, ties to the shortest first part."""
    words = F.split("phrase", " ")
    candidates = counts.where((_words(F.col("phrase")) >= 2) & (F.col("n") >= least)).select("lang", "phrase", F.col("n").alias("a"), words.alias("words"))
    cuts = candidates.select("lang", "phrase", "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.col("words"), 1, F.col("k")).alias("first"), _part(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(name)), ["lang", part])
    # integral division of decimals, whose products may pass 64 bits; a score is 1,000,000 at most
    score = F.expr("1000000BD * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def without_extended(candidates: DataFrame, percent: int) -> DataFrame:
    """Candidates (lang, phrase, a, ...) but those inside one that is a word longer and occurs `percent` as often."""
    words = F.split("phrase", " ")
    longer = candidates.select("lang", F.col("a").alias("longer"), words.alias("words")).where(F.size("words") > 2)
    shorter = F.size("words") - 1
    inner = longer.select("lang", "longer", F.explode(F.array(_part(F.col("words"), 1, shorter), _part(F.col("words"), 2, shorter))).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    lost = candidates.join(most, ["lang", "phrase"]).where(F.col("longer") * 100 >= F.col("a") * percent).select("lang", "phrase")
    return candidates.join(lost, ["lang", "phrase"], "left_anti")


def ranked(candidates: DataFrame, top: int) -> DataFrame:
    """`rank` of each language's first `top` candidates. Parts of a language are ranked first and hand on `top` each, so
    the last window of a language gets PARTS * top rows at most."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    place = lambda *key: F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")
    dealt = candidates.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)))
    first = dealt.withColumn("rank", place("lang", "part")).where(F.col("rank") <= top)
    return first.withColumn("rank", place("lang")).where(F.col("rank") <= top).drop("part")


def mined_phrases(docs: DataFrame, max_n: int = 3, least: int = 10, percent: int = 50, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first phrases of 2 to max_n words."""
    counts = phrase_counts(docs, max_n, least)
    kept = without_extended(scored_phrases(counts, least), percent)
    n = counts.where("phrase = ''").select("lang", "n")
    return ranked(kept, top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
