"""Byte pair merges, shared by the token counter and the codec; merge ranks come from a tokenizer file."""

from __future__ import annotations

import heapq
import json
from functools import cache
from pathlib import Path


def public_path(name: str) -> str:
    """Where the installed public tokenizer files have `name`."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def byte_alphabet() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: printable Latin-1 stands for itself, the rest for U+0100 up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merges:
    """Vocabulary and merge ranks of a byte-level BPE file. `end` is its word-end suffix, "" if it has none."""

    def __init__(self, path: str):
        spec = json.loads(Path(path).read_text(encoding="utf-8"))
        model, alphabet = spec["model"], byte_alphabet()
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.vocab: dict[str, int] = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.pairs = {}
        for rank, (a, b) in enumerate(pairs):
            self.pairs.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.bytes: dict[int, bytes] = {}
        self.ends: set[int] = set()
        for text, number in self.vocab.items():
            if self.end and text.endswith(self.end) and len(text) > len(self.end):
                text = text[: -len(self.end)]
                self.ends.add(number)
            self.bytes[number] = bytes(alphabet[c] for c in text)
        single = {(b, n in self.ends): n for n, b in self.bytes.items() if len(b) == 1}
        self.first = [single[bytes([b]), False] for b in range(256)]
        self.last = [single.get((bytes([b]), True)) for b in range(256)]

    def symbols(self, number: int) -> list[int]:
        """A token's single-byte symbols."""
        out = [self.first[b] for b in self.bytes[number]]
        if number in self.ends:
            out[-1] = self.last[self.bytes[number][-1]]
        return out

    def trace(self, ids: list[int]) -> tuple[list[int], tuple[int, int] | None]:
        """As merge, for short inputs, with the last pair that was merged."""
        ids, pairs, last = list(ids), self.pairs, None
        while len(ids) > 1:
            best, at = None, -1
            for k in range(len(ids) - 1):
                p = pairs.get((ids[k], ids[k + 1]))
                if p is not None and (best is None or p[0] < best[0]):
                    best, at = p, k
            if best is None:
                break
            last = ids[at], ids[at + 1]
            ids[at : at + 2] = [best[1]]
        return ids, last

    def merge(self, ids: list[int]) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left; a heap keeps long inputs at n log n."""
        n, pairs = len(ids), self.pairs
        if n < 2:
            return ids
        if n <= 24:
            return self.trace(ids)[0]
        ids, after, before = list(ids), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(pairs[p][0], k, *p) for k, p in enumerate(zip(ids, ids[1:])) if p in pairs]  # noqa: B905
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = after[k]
            if ids[k] != a or j >= n or ids[j] != b:
                continue
            ids[k], ids[j] = pairs[a, b][1], -1
            after[k] = m = after[j]
            if m < n:
                before[m] = k
                if (p := (ids[k], ids[m])) in pairs:
                    heapq.heappush(heap, (pairs[p][0], k, *p))
            if (i := before[k]) >= 0 and (p := (ids[i], ids[k])) in pairs:
                heapq.heappush(heap, (pairs[p][0], i, *p))
        return [x for x in ids if x >= 0]


@cache
def merges(path: str) -> Merges:
    return Merges(path)
