r"""Token counts: a finite-state transducer compiled from a word-end BPE vocabulary.

The transducer reads code points. Its states hold what the merges of the word so far still depend on: for each
start from which a token may still grow, the token that ends there and the tokens counted since. Every transition
is annotated with the tokens that it adds (or takes back, when a longer token replaces shorter ones). States and
transitions are compiled when first met. A text is cut into chunks which numpy reads in lockstep; each chunk has a state
map, from the states that the chunk before may leave to the state it leaves itself and the tokens added, and the maps
are composed by a parallel prefix scan.

Texts are prepared as the file's normalizer does (NFC, white space, lower case); special strings in a text are one
token each, the library's default.

Edge cases: null and empty text have 0 tokens; a null doc_id stays null; repeated rows stay; an empty table gives no
rows; text of any length is read whole, by one task; other columns never matter.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .automaton import Automaton, Words
from .bpe import merges, public_path
from .common import ids_and_texts, steps

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Lone surrogates cannot occur in UTF-8 input, so they mark special tokens and the ends of texts.
SPECIAL, BREAK = "\ud800", "\ud801"
#: The vocabulary's contractions.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Kinds of code points.
SPACE, LETTER, NUMBER, OTHER, WHOLE = range(5)


class Transducer(Automaton):
    """Counts tokens; outputs are what a transition adds to the count."""

    initial = ("start",)

    def __init__(self, path: str):
        self.model = merges(path)
        self.words = Words(self.model)
        self.symbol_of = np.full(0x110000, -1, np.int32)
        self.symbols: list[tuple[int, bytes, str]] = []
        self.contraction = {c: self._count(c) for c in CONTRACTIONS}
        self.reset()

    def _count(self, text: str) -> int:
        raw = text.encode()
        return len(self.model.merge([*map(self.model.first.__getitem__, raw[:-1]), self.model.last[raw[-1]]]))

    def symbol(self, code: int) -> int:
        """Number of a code point, with its kind and bytes."""
        c = chr(code)
        if c in (SPECIAL, BREAK):
            entry = (WHOLE, b"", c)
        else:
            kind = SPACE if regex.match(r"\p{White_Space}", c) else LETTER if regex.match(r"\p{L}", c) else NUMBER if regex.match(r"\p{N}", c) else OTHER
            entry = (kind, c.encode("utf-8", "surrogatepass"), c)
        self.symbol_of[code] = len(self.symbols)
        self.symbols.append(entry)
        return len(self.symbols) - 1

    # A state is ("start",), or (kind, quote, close, word): the run's kind, what of a contraction has been read,
    # the tokens that the run's end adds, and the merges so far.

    def _close(self, state: tuple) -> int:
        """Tokens added when the open run ends."""
        return 0 if state[0] == "start" else state[2]

    def _read(self, word: tuple, raw: bytes) -> tuple[int, tuple, int]:
        total = 0
        for byte in raw:
            before = word
            word, added, _ = self.words.step(word, byte)
            total += added
        return self.words.last(before, raw[-1]) - added, word, total

    def _open(self, kind: int, raw: bytes, quote: str) -> tuple[tuple, int]:
        close, word, total = self._read(self.words.start(), raw)
        return (kind, quote, close, word), total

    def transition(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        kind, raw, c = self.symbols[symbol]
        if kind in (SPACE, WHOLE):
            return ("start",), self._close(state) + (c == SPECIAL)
        if kind == NUMBER:
            alone, total = self._open(kind, raw, "")
            return ("start",), self._close(state) + total + self._close(alone)
        quote = state[1] if state[0] != "start" else ""
        if quote and quote + c in self.contraction:
            # "'" was counted as a run of its own, and a first letter as an open word: both give way
            counted = self._apostrophe() if len(quote) == 1 else self._apostrophe() + self._open(LETTER, quote[1:].encode(), "")[1]
            counted = counted if len(quote) > 1 else self._open(OTHER, b"'", "")[1]
            return ("start",), self.contraction[quote + c] - counted
        if state[0] == kind and not (kind == LETTER and quote == "'"):
            close, word, total = self._read(state[3], raw)
            return (kind, "", close, word), total
        begun, total = self._open(kind, raw, "'" if c == "'" else "")
        if kind == LETTER and quote == "'" and any(x.startswith("'" + c) for x in CONTRACTIONS):
            begun = (kind, "'" + c, *begun[2:])
        return begun, self._close(state) + total

    def _apostrophe(self) -> int:
        return self._count("'")

    def count(self, texts: list[str]) -> list[int]:
        """Tokens of each text."""
        joined = BREAK.join([*map(self.prepare, texts), ""])
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.symbol_of[codes]
        if (symbols < 0).any():
            for c in np.unique(codes[symbols < 0]).tolist():
                self.symbol(c)
            symbols = self.symbol_of[codes]
        adds = self.read(symbols)
        ends = np.flatnonzero(symbols == self.symbol_of[ord(BREAK)])
        return np.diff(np.cumsum(adds, dtype=np.int64)[ends], prepend=0).tolist()

    def prepare(self, text: str) -> str:
        """The normalizer's text, with special strings as one mark each. Special strings split before all else."""
        if "<|" in text:
            for s in self.model.special:
                text = text.replace(s, SPECIAL)
        if not text.isascii():
            # NFC of a text is NFC of its parts here: the mark neither composes nor reorders
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()


@cache
def transducer(path: str) -> Transducer:
    return Transducer(path)


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every document."""
    path = path or public_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(path)
        for ids, texts in steps(batches):
            tokens = machine.count(texts)
            columns = [ids, [len(t.encode()) for t in texts], tokens, [n > limit for n in tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [pa.int64()] * 3 + [pa.bool_()], strict=True)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return ids_and_texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
