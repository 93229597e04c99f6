r"""BPE encoding and decoding by forced boundaries.

A pair of bytes that occurs inside no token of the vocabulary is never merged across, so it marks a certain cut. A
batch of texts becomes one array of bytes, cut at all such pairs and at the pretokens of the vocabulary's pattern.
The fragments are encoded independently and their ids concatenated: an automaton compiled from the merges, started
anew at every cut, tells after each byte which token would end the fragment there, and the tokens are then taken
from every fragment's end back to its start. Decoding joins the bytes of the ids.

Edge cases: null and empty text encode to no ids and decode to ""; special strings in a text become their id, the
library's default; a null doc_id stays null; texts of any length and without white space are encoded whole, by one task;
repeated rows stay; an empty table gives no rows; other columns never matter.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, Words
from .bpe import merges, public_path
from .common import ids_and_texts, steps

VOCABULARY = "byte_bpe_50k.json"
#: Pairs of tokens whose fit is remembered, and characters read at once; both bound what a worker holds.
FITS, CHARS = 1 << 17, 500_000
#: The pretoken pattern of byte-level vocabularies of this kind, which pretoken_starts() follows,
#: 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+, and its contractions without quotes.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Lone surrogates cannot occur in UTF-8 input: one marks the ends of texts, those from SPECIAL on special tokens.
BREAK, SPECIAL = 0xD800, 0xD801
SPACE, LETTER, NUMBER, OTHER, WHOLE, UNKNOWN = range(6)
KINDS = np.full(0x110000, UNKNOWN, np.uint8)
KINDS[0xD800:0xE000] = WHOLE


def kinds(codes: np.ndarray) -> np.ndarray:
    """Kind of each code point; the table is filled as code points are met."""
    out = KINDS[codes]
    if (out == UNKNOWN).any():
        for c in np.unique(codes[out == UNKNOWN]).tolist():
            x = chr(c)
            KINDS[c] = SPACE if regex.match(r"\p{White_Space}", x) else LETTER if regex.match(r"\p{L}", x) else NUMBER if regex.match(r"\p{N}", x) else OTHER
        out = KINDS[codes]
    return out


def pretoken_starts(codes: np.ndarray) -> np.ndarray:
    """Whether a pretoken starts at each code point of texts that BREAK ends."""
    kind = kinds(codes)
    start = np.empty(len(codes), bool)
    start[:1] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == WHOLE
    # white space before other characters gives up its last one: a space joins them, another stands alone
    after = np.flatnonzero(start[1:] & (kind[:-1] == SPACE) & (kind[1:] < WHOLE)) + 1
    start[after - 1] = True
    start[after[codes[after - 1] == 32]] = False
    # contractions, where a pretoken starts at the quote
    for q in np.flatnonzero((codes == 39) & start).tolist():
        tail = "".join(map(chr, codes[q + 1 : q + 3].tolist()))
        own = next((c for c in CONTRACTIONS if tail.startswith(c)), None)
        if own:
            start[q + 1 : q + 1 + len(own)] = False
            start[q + 1 + len(own)] = True
    return start


class Strings:
    """Byte strings by number, joined for many numbers at once."""

    def __init__(self, strings: dict[int, bytes]):
        self.length = np.zeros(max(strings) + 1, np.int64)
        self.length[[*strings]] = [*map(len, strings.values())]
        self.begin = np.cumsum(self.length) - self.length
        self.all = np.frombuffer(b"".join(strings.get(n, b"") for n in range(len(self.length))), np.uint8)

    def join(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The strings of ids in a row, and where each ends."""
        lengths = self.length[ids]
        ends = np.cumsum(lengths)
        return self.all[np.arange(lengths.sum()) + np.repeat(self.begin[ids] - ends + lengths, lengths)].tobytes(), ends


class Encoder(Automaton):
    """Reads bytes, 256 more at a fragment's first; outputs the token that would end the fragment after each byte.

    A state is written as bytes, two numbers for each tail: its own and the token's before it. A worker holds some
    100,000 states, which take a fifth of what tuples of them would.
    """

    def __init__(self, path: str):
        self.words = Words(merges(path), FITS)
        self.tails = sorted(self.words.open)
        self.number = {tail: n for n, tail in enumerate(self.tails)}
        self.initial = self.packed(self.words.start())
        self.reset()

    def packed(self, state: tuple) -> bytes:
        # only differences of the counts matter, and the encoder needs none: equal tails then share a state
        return array("i", [x for tail, before, _ in state for x in (self.number[tail], before)]).tobytes()

    def transition(self, state: bytes, symbol: int) -> tuple[bytes, int]:
        if symbol >= 256:
            begun = self.words.start()
        else:
            flat = array("i", state)
            begun = tuple((self.tails[t], before, 0) for t, before in zip(flat[::2], flat[1::2], strict=True))
        after, _, token = self.words.step(begun, symbol & 255)
        return self.packed(after), token


class Codec:
    """Encodes and decodes texts with one vocabulary."""

    def __init__(self, path: str):
        self.model = model = merges(path)
        self.encoder = Encoder(path)
        inside = np.zeros((256, 256), bool)
        for token in model.bytes.values():
            if len(token) > 1:
                codes = np.frombuffer(token, np.uint8)
                inside[codes[:-1], codes[1:]] = True
        self.forced = ~inside
        size = max([*model.bytes, *model.special.values()]) + 1
        numbers = [*model.bytes, *model.special.values()]
        self.bytes = Strings(model.bytes | {n: s.encode() for s, n in model.special.items()})
        self.decimal = Strings({n: b"%d," % n for n in numbers})

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin and the last one's end."""
        joined = chr(BREAK).join([*texts, ""])
        for k, special in enumerate(self.model.special):
            joined = joined.replace(special, chr(SPECIAL + k))
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        marked = (codes >= BREAK) & (codes < 0xE000)
        width = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        width[marked] = codes[marked] != BREAK  # a special token counts as one byte, an end as none
        ends = np.cumsum(width)
        raw = re.sub("[\ud801-\udfff]", " ", joined.replace(chr(BREAK), "")).encode()
        data = np.frombuffer(raw, np.uint8)
        fresh = np.zeros(len(data) + 1, bool)
        fresh[(ends - width)[pretoken_starts(codes)]] = True
        fresh[[0, -1]] = True
        if len(data):
            fresh[1:-1] |= self.forced[data[:-1], data[1:]]
        ends_with = self.encoder.read(data.astype(np.int32) + 256 * fresh[:-1])
        # every fragment's tokens from its last back to its first, all fragments side by side
        edges = np.flatnonzero(fresh)
        first, last = edges[:-1], edges[1:] - 1
        token_at = np.full(len(data), -1, np.int32)
        while len(last):
            token = ends_with[last]
            begin = last - self.bytes.length[token] + 1
            token_at[begin] = token
            on = begin > first
            first, last = first[on], begin[on] - 1
        for k, number in enumerate(self.model.special.values()):
            token_at[ends[codes == SPECIAL + k] - 1] = number
        used = token_at >= 0
        bounds = np.concatenate(([0], ends[codes == BREAK]))
        return token_at[used], np.concatenate(([0], np.cumsum(used)))[bounds]

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text."""
        return self.encode_batch([text])[0].tolist()

    def pieces(self, strings: Strings, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """The joined strings of each text's ids."""
        joined, ends = strings.join(ids)
        at = np.concatenate(([0], ends))[bounds].tolist()
        return [joined[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def written(self, ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
        """Decimal ids joined by commas, of each text."""
        return [x[:-1] for x in self.pieces(self.decimal, ids, bounds)]

    def decode_batch(self, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
        """The text of each text's ids; bytes that are no UTF-8 become U+FFFD."""
        return [x.decode("utf-8", "replace") for x in self.pieces(self.bytes, ids, bounds)]

    def decode(self, ids: list[int]) -> str:
        return self.decode_batch(np.array(ids, np.int64), np.array([0, len(ids)]))[0]


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array of int) of every document."""
    path = path or public_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for ids, texts in steps(batches, CHARS):
            out, bounds = own.encode_batch(texts)
            out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(out, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), out], ["doc_id", "ids"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of (doc_id, ids); null ids give an empty text."""
    path = path or public_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    columns = (F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids"))
    return encoded.select(*columns).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encodes and decodes every document: doc_id, n_tokens and digests of the ids and of the decoded text.

    Both directions run in one pass, so neither ids nor texts are shuffled or written.
    """
    path = path or public_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        digest = lambda x: hashlib.sha256(x).hexdigest()
        for keys, texts in steps(batches, CHARS):
            ids, bounds = own.encode_batch(texts)
            decoded = [x.encode() for x in own.decode_batch(ids, bounds)]
            columns = [keys, np.diff(bounds), [*map(digest, own.written(ids, bounds))], [*map(digest, decoded)]]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
