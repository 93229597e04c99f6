"""Round 3's findings on the corpus operators: what workers hold, and work that grew with the number of buckets."""

from __future__ import annotations

import random
import sys

import numpy as np
import pyarrow as pa
import pytest

from quirespark.llm import bpe, bpe_codec, suffix_dedup, wordhash


def held(x, seen):
    if id(x) in seen:
        return 0
    seen.add(id(x))
    return sys.getsizeof(x) + sum(held(y, seen) for y in (x if isinstance(x, tuple) else ()))


def test_states_are_small():
    """pipeline: a worker's states of the encoder, which were 400 bytes each."""
    pytest.importorskip("public_tokenizers")
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randrange(2, 14))) for _ in range(4000))
    encoder = bpe_codec.Codec(bpe.public_path(bpe_codec.VOCABULARY))
    encoder.encode(text)
    states, seen = encoder.encoder.states, set()
    assert len(states) > 1000
    assert sum(held(x, seen) for x in states) < 120 * len(states)


def chunk_of(docs):
    table = pa.table({"doc_id": pa.array([k for k, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string())})
    return next(iter(suffix_dedup._pack(["doc_id", "text"], 1 << 40)(iter(table.combine_chunks().to_batches())))).column(1)[0].as_py()


def test_powers_of_slices_only(monkeypatch):
    """pipeline, op3_suffix_dedup: workers kept 16 bytes for each byte of the longest chunk or bucket."""
    monkeypatch.setattr(wordhash, "_powers", {})
    rng = random.Random(2)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    text = " ".join(rng.choices(words, k=200_000))
    c = suffix_dedup.Chunk(chunk_of([(1, text), (2, text[5000:])]))
    order, first, least, bounds = c.runs(np.arange(len(c.starts)), 8)
    assert len(c.data) > 2_000_000 and first.sum() < len(order)
    assert len(wordhash._powers["up"]) <= 1 << 20


def test_names_tell_every_byte(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    rng = random.Random(3)
    base = bytes(rng.randrange(256) for _ in range(76))
    strings = [base[:n] for n in range(50, 77)] + [base[:at] + bytes([base[at] ^ 1]) + base[at + 1 : n] for n in (50, 57, 76) for at in range(n)]
    strings += strings[::3]
    data, sizes = np.frombuffer(b"".join(strings), np.uint8), np.array([*map(len, strings)])
    names = suffix_dedup.run_names(data, np.cumsum(sizes) - sizes, sizes, np.zeros(len(sizes), np.uint64)).tolist()
    assert len(set(names)) == len(set(strings)) == len(set(zip(names, strings, strict=True)))


def test_dedup_over_slices(spark):
    """Repeats across the borders of slices, beside documents of less than a window, against all strings of 50 bytes."""
    rng = random.Random(4)
    own = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    shared = own(3000)
    docs = [(3, own(64_000) + shared + own(70_000)), (1, own(130_000) + shared[700:]), (2, "x" * 200), (4, shared[:49]), (5, ""), (6, shared[:60]), (7, "x" * 66_000 + shared)]
    first, want = {}, {}
    for k, t in sorted(docs):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first.setdefault(b[j : j + 50], k) < k:
                gone[j : j + 50] = True
        want[k] = int(gone.sum())
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == want and want[7] > 66_000


def test_buckets():
    anchors = np.array([7, 3, 3, 10, 12], np.uint64)
    order, bounds = suffix_dedup.by_bucket(anchors, 5)
    assert {b: anchors[order[i:j]].tolist() for b, (i, j) in bounds.items()} == {0: [10], 2: [7, 12], 3: [3, 3]}
    assert suffix_dedup.by_bucket(anchors[:0], 5)[1] == {}
