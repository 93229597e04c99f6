"""The index and its search against a plain BM25 over all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from quirespark.llm import decontaminate


def bm25(items, queries, threshold):
    """{(query, item): share of the item's own score} at or above the threshold, by the formula alone."""
    bags = [Counter(t.split()) for t in items]
    full = [b for b in bags if b]
    n, mean = len(full), sum(sum(b.values()) for b in full) / max(1, len(full))
    df = Counter(w for b in full for w in b)
    out = {}
    for i, b in enumerate(bags):
        gain = {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean)) for w, tf in b.items()}
        for q, text in enumerate(queries):
            share = sum(gain[w] for w in set(text.split()) if w in gain) / sum(gain.values()) if b else 0.0
            if b and share >= threshold:
                out[q, i] = share
    return out


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("block", [1, 3, 16])
def test_search_equals_bm25(monkeypatch, seed, block):
    monkeypatch.setattr(decontaminate, "BLOCK", block)
    rng = random.Random(seed)
    words = [f"w{j}" for j in range(40)]
    items = [" ".join(rng.choices(words[: rng.choice((6, 15, 40))], k=rng.randint(1, 25))) for _ in range(60)]
    queries = [" ".join(rng.sample(words, k=rng.randint(0, 30))) for _ in range(80)] + items[:10]
    hashes, bounds = decontaminate.plain_words(items)
    bags = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    names, df = np.unique(np.concatenate([w for w, _ in bags]), return_counts=True)
    terms = [(w, tf.astype(float), df[np.searchsorted(names, w)].astype(float)) for w, tf in bags]
    index = decontaminate.Index([*enumerate(items)], terms, len(items), float(np.diff(bounds).mean()), 30)
    asked, at = decontaminate.plain_words(queries)
    rows = [(q, t) for q, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)) for t in sorted({int(np.searchsorted(index.vocabulary, w)) for w in asked[a:b] if w in index.vocabulary})]
    q, t = (np.array([r[k] for r in rows]) for k in (0, 1))
    got = {(a, index.ids[b]): s for a, b, s in zip(*(x.tolist() for x in index.search(q, t, 0.5)), strict=True)}
    want = bm25(items, queries, 0.5)
    assert {k for k, s in want.items() if s > 0.5001} <= set(got) <= {k for k, s in bm25(items, queries, 0.4998).items()}
    assert len(want) > 20 and all(abs(got[k] - want[k]) < 1e-5 for k in want if k in got)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven", "x"), (1, "one two three four five six seven", "x"), (None, "One, two three four five six seven", "y"), (3, None, None), (4, "", None)], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(7, "one two three four five six seven"), (7, "one two three four five six seven"), (None, "one two three four five six seven"), (8, None)], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.find_leaks(docs, items).collect())
    assert got == {(1, 7): 4, (1, None): 2, (None, 7): 2, (None, None): 1}
    assert decontaminate.find_leaks(docs, items.limit(0)).count() == 0 == decontaminate.find_leaks(docs.limit(0), items).count()
    kept = decontaminate.without_leaks(docs, items)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {3, 4}
    assert decontaminate.without_leaks(docs, items.limit(0)).count() == 5
