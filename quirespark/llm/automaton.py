"""Merges of byte pairs as a finite automaton, compiled when first met; chunks are read by numpy in lockstep and their
state maps composed by a parallel prefix scan."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .bpe import Merges

#: Chunks of the input that are read side by side.
LANES = 8192
#: Transitions kept before the compiled automaton is dropped and compiled anew; bounds a worker's memory.
MAX_TRANSITIONS = 1 << 19
#: Pairs of tokens whose fit is remembered.
FITS = 1 << 18
START = 0


class Words:
    """Incremental merges of one word: states are tuples of (tail, token before the tail, tokens since), canonical.

    A tail is a suffix of the word that some token starts with and goes beyond, or may end a word with.
    """

    def __init__(self, model: Merges, fits: int = FITS):
        self.model = model
        self.inner: dict[bytes, int] = {}
        self.final: dict[bytes, int] = {}
        self.single = [bytes([b]) for b in range(256)]
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank = [-1] * (max(model.bytes) + 1)
        for number, text in model.bytes.items():
            ids, last = model.trace(model.symbols(number))
            if ids == [number]:
                (self.final if number in model.ends else self.inner)[text] = number
                if last:
                    self.parts[number], self.rank[number] = last, model.pairs[last][0]
        self.open = {t[:k] for d in (self.inner, self.final) for t in d for k in range(len(t))} | set(self.final)
        self.fits = lru_cache(fits)(self._fits)

    def _fits(self, a: int, b: int) -> bool:
        """Whether merging the symbols of both tokens gives just the two.

        Undoes the later merge of either side until a pair across the cut is found that would have come first.
        """
        if a < 0:
            return True
        rank, limit = self.rank, float("inf")
        while True:
            p = self.model.pairs.get((a, b))
            if p is not None and p[0] < limit:
                return False
            if rank[a] > rank[b]:
                limit, a = rank[a], self.parts[a][1]
            elif rank[b] >= 0:
                limit, b = rank[b] + 1, self.parts[b][0]
            else:
                return True

    def start(self) -> tuple:
        return ((b"", -1, 0),)

    def last(self, state: tuple, byte: int) -> int:
        """Tokens added when `byte` is the word's last one."""
        raw = self.single[byte]
        for tail, before, since in state:
            t = self.final.get(tail + raw)
            if t is not None and self.fits(before, t):
                return 1 - since
        raise AssertionError("no token fits")

    def step(self, state: tuple, byte: int) -> tuple[tuple, int, int]:
        """The state after one more byte, the tokens added, and the token that then ends the word.

        Just one token that is a suffix fits what stands before it.
        """
        raw, token, added, grown = self.single[byte], -1, 0, []
        for tail, before, since in state:
            x = tail + raw
            if token < 0 and (t := self.inner.get(x)) is not None and self.fits(before, t):
                token, added = t, 1 - since
            if x in self.open:
                grown.append((x, before, since))
        return (*((x, before, since + added) for x, before, since in grown), (b"", token, 0)), added, token


class Automaton:
    """A lazily compiled automaton: states are interned, transitions live in an open-addressing table that numpy reads.

    A subclass gives the initial state and transition(state, symbol) -> (state, output).
    """

    initial: tuple = ()

    def reset(self) -> None:
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.used, self.size = 0, 1 << 16
        self._table()
        self.intern(self.initial)

    def _table(self) -> None:
        self.keys = np.full(self.size, -1, np.int64)
        self.next = np.zeros(self.size, np.int32)
        self.outs = np.zeros(self.size, np.int32)
        self.shift = np.uint64(64 - self.size.bit_length() + 1)

    def intern(self, state: tuple) -> int:
        n = self.ids.setdefault(state, len(self.states))
        if n == len(self.states):
            self.states.append(state)
        return n

    def transition(self, state: tuple, symbol: int) -> tuple[tuple, int]:
        raise NotImplementedError

    def _add(self, keys: np.ndarray) -> None:
        """Compiles the transitions of keys (state << 21 | symbol) that the table lacks."""
        to, adds = np.empty(len(keys), np.int32), np.empty(len(keys), np.int32)
        for k, key in enumerate(keys.tolist()):
            state, adds[k] = self.transition(self.states[key >> 21], key & 0x1FFFFF)
            to[k] = self.intern(state)
        self.used += len(keys)
        if 2 * self.used > self.size:
            kept = self.keys >= 0
            old = self.keys[kept], self.next[kept], self.outs[kept]
            while 2 * self.used > self.size:
                self.size *= 2
            self._table()
            self._put(*old)
        self._put(keys, to, adds)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _put(self, keys: np.ndarray, to: np.ndarray, adds: np.ndarray) -> None:
        slots, left = self._slots(keys), np.arange(len(keys))
        while len(left):
            at = slots[left]
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.next[at[won]], self.outs[at[won]] = to[left[won]], adds[left[won]]
            left = left[~won]
            slots[left] = (slots[left] + 1) % self.size

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next state and output of each lane."""
        keys = (states.astype(np.int64) << 21) | symbols
        while True:
            slots = self._slots(keys)
            found = self.keys[slots]
            off = np.flatnonzero(found != keys)
            missing = []
            while len(off):
                gap = found[off] < 0
                if gap.any():
                    missing.append(keys[off[gap]])
                off = off[~gap]
                slots[off] = (slots[off] + 1) % self.size
                found[off] = self.keys[slots[off]]
                off = off[found[off] != keys[off]]
            if not missing:
                return self.next[slots], self.outs[slots]
            self._add(np.unique(np.concatenate(missing)))

    def read(self, symbols: np.ndarray, lanes: int = LANES) -> np.ndarray:
        """The output at each position, by state maps of chunks and a parallel prefix scan over their compositions.

        A chunk's map takes each state that the chunk before may leave to the state that the chunk leaves. All chunks
        are read side by side, first from START; from another state a chunk is read up to where both runs meet.
        """
        n = len(symbols)
        if not n:
            return np.zeros(0, np.int32)
        if self.used > MAX_TRANSITIONS:
            self.reset()
        lanes = max(1, min(lanes, n // 64))
        length = -(-n // lanes)
        padded = np.full(lanes * length, symbols[0] if n else 0, np.int32)
        padded[:n] = symbols
        grid = np.ascontiguousarray(padded.reshape(lanes, length).T)
        after = np.empty((length, lanes), np.int32)
        adds = np.empty((length, lanes), np.int32)
        state = np.zeros(lanes, np.int32)
        for k in range(length):
            state, adds[k] = self.step(state, grid[k])
            after[k] = state
        # rows of the maps: chunk << 32 | state, and the state left; outputs that differ from those read from START
        keys, left, heads = [np.arange(lanes) << 32], [after[-1].astype(np.int64)], []
        chunk, state = np.arange(1, lanes), after[-1, :-1]
        while True:
            fresh = np.setdiff1d(chunk << 32 | state, np.concatenate(keys))
            if not len(fresh):
                break
            keys.append(fresh)
            chunk, state = fresh >> 32, (fresh & 0xFFFFFFFF).astype(np.int32)
            leaves, live = after[-1, chunk].astype(np.int64), np.arange(len(fresh))
            for k in range(length):
                state, out = self.step(state, grid[k, chunk[live]])
                heads.append((fresh[live], k, out))
                on = state != after[k, chunk[live]]
                live, state = live[on], state[on]
                if not len(live):
                    break
            leaves[live] = state
            left.append(leaves)
            on = chunk + 1 < lanes
            chunk, state = chunk[on] + 1, leaves[on]
        order = np.argsort(np.concatenate(keys))
        keys, jump = np.concatenate(keys)[order], np.concatenate(left)[order]
        # the scan: maps of 1, 2, 4, ... chunks give the states that twice as many chunks are entered in
        entry, span = np.zeros(1, np.int64), 1
        while len(entry) < lanes:
            more = np.arange(min(span, lanes - span))
            entry = np.concatenate((entry, jump[np.searchsorted(keys, more << 32 | entry[: len(more)])]))
            ends = (keys >> 32) + span
            at = np.searchsorted(keys, np.minimum(ends, lanes - 1) << 32 | jump)
            inside = (ends < lanes) & (at < len(keys))
            inside[inside] = keys[at[inside]] == ((ends << 32) | jump)[inside]
            jump = np.where(inside, jump[np.minimum(at, len(keys) - 1)], jump)
            span *= 2
        due = np.arange(lanes) << 32 | entry
        for own, k, out in heads:
            used = due[own >> 32] == own
            adds[k, own[used] >> 32] = out[used]
        return adds.T.ravel()[:n]
