r"""Words of many texts as 64-bit hashes, made by numpy over all bytes of a batch at once."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240101)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_BACK = pow(_BASE, -1, 2**64)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, as bytes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2 ** 64."""
    if len(_powers.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", _BACK)):
            out = np.full(max(n, 1 << 20), base, np.uint64)
            out[0] = 1
            _powers[name] = np.cumprod(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end) of data, by differences of one running polynomial."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def hashed_words(texts: list[str], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    r"""Words [^\x20\x09-\x0D]+ of texts: hashes, the text each text's words begin at (bounds, one more than texts), the
    words' start and end bytes in the joined texts, and where each text begins there (a line break ends each)."""
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    if lower:
        data = LOWER[data]
    begins = np.cumsum([0, *(len(r) + 1 for r in raw)])
    word = np.zeros(len(data) + 1, np.int8)
    word[:-1] = ~SPACE[data]
    edge = np.diff(word, prepend=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.searchsorted(starts, begins)
    return span_hashes(data, starts, ends), bounds, starts, ends, begins
