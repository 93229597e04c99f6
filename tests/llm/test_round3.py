"""Chat examples, collocations and resampling against brute force, with nulls, empties, ties, repeats and other columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark.llm import chat_format, phrases, resampling

MARKS = ["<|start|>", "<|message|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<|im_start|>", "<\\|end|>", "<\\\\|end|>", "[\\INST]", "<", "|end|>", "<|", "\\", "é𝒙", "\n", " ", "ok", ""]


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(11)
    text = lambda: "".join(rng.choices(MARKS, k=rng.randint(0, 9)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "assistant", None, "<|end|>"]), rng.choice([text(), text(), None])) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(90, 0, "assistant", "only"), (91, 0, "user", "only"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (92, 1, "assistant", "x"), (92, 1, "assistant", "x"), (92, None, "user", "first"), (92, 1, "assistant", "a")]
    rows += [(93, t, ("user", "assistant")[t % 2], f"turn {t} " * 50) for t in range(120)]
    rng.shuffle(rows)
    return rows


def test_chat_read_back(spark, turns):
    df = spark.createDataFrame([(*r, 1, [0]) for r in turns], "conv_id long, turn long, role string, text string, place int, said array<int>")
    examples = chat_format.chat_examples(df)
    got = {r.conv_id: r for r in chat_format.digests(chat_format.read_back(examples)).collect()}
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((t is not None, t or 0, role or "", text or ""))
    assert got.keys() == by.keys()
    rows = defaultdict(list)
    for e in examples.collect():
        rows[e.conv_id].append(e)
    for c, said in by.items():
        said.sort()
        trained = "".join(x[3] for x in said if x[2] == "assistant")
        own = sorted(rows[c], key=lambda e: e.place)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (c, len(said), sha("".join(f"{x[2]}\n{x[3]}\n" for x in said)), len(trained), sha(trained), sum(len(e.text) for e in own))
        assert tuple(got[c]) == want
        # an example for each assistant turn, with all before it as context, and one more where the last turn is another's
        places = [k for k, x in enumerate(said) if x[2] == "assistant" or k == len(said) - 1]
        assert [e.place for e in own] == places and all(b.text.startswith(a.text) for a, b in zip(own, own[1:], strict=False))
        assert all(e.text.count(chat_format.START) == e.text.count(chat_format.END) == e.place + 1 for e in own)
        assert all(e.text[e.loss_start :].endswith(chat_format.END) and (e.loss_chars == 0 or e.text[e.loss_start + e.loss_chars :] == chat_format.END) for e in own)
    assert chat_format.chat_examples(df.limit(0)).count() == 0
    plan = chat_format.digests(chat_format.read_back(examples))._jdf.queryExecution().toString()
    assert "Python" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange") == 1


def test_escapes_are_reversible(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choices(MARKS, k=rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escaped(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat_format.unescaped(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not re.search(r"[<\[](\|\w{1,40}\|>|/?s>|/?INST\])", r.e)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(6)
    words = ["new", "york", "city", "a", "b", "of", "ö", "中", "x\x85y", "Ünd", "AND", "the", "x z"]
    rows = []
    for k in range(160):
        parts = [rng.choice(["new york city", "New York", "of the", " ".join(rng.choices(words, k=rng.randint(1, 6)))]) + rng.choice([".", ",", " ", "\n", "\t", "  ", "\x0b", "!?"]) for _ in range(rng.randint(0, 12))]
        rows.append((k, "".join(parts), rng.choice(["en", "de", None, "und"])))
    rows += [(3, rows[3][1], "en"), (None, "new york city " * 30, "en"), (200, None, "en"), (201, "", None), (202, " \t.,", "xx"), (203, "a " * 3000, "fr"), (204, "Q" * 50_000, "fr")]
    return rows


def collocations(rows, max_n, least, percent, top):
    n, f = Counter(), defaultdict(Counter)
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", lower(text or "")):
            ws = [w for w in re.split(r"[ \t]+", piece) if w]
            n[lang] += len(ws)
            for size in range(1, max_n + 1):
                for i in range(len(ws) - size + 1):
                    f[lang][tuple(ws[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in candidates.items():
            if any(len(q) > len(p) and 100 * b >= percent * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in candidates.items()):
                continue
            score, k = min((1_000_000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("max_n", "least", "percent", "top"), [(3, 10, 50, 2000), (2, 3, 50, 7), (4, 2, 30, 40), (5, 3, 80, 2000)])
def test_phrases(spark, docs, monkeypatch, max_n, least, percent, top):
    df = spark.createDataFrame([(*r, "k", 1, 2) for r in docs], "doc_id long, text string, lang string, phrase string, n long, a long")
    got = phrases.mined_phrases(df, max_n, least, percent, top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == collocations(docs, max_n, least, percent, top)


def test_phrases_edges(spark, docs, monkeypatch):
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    assert phrases.mined_phrases(df.limit(0)).count() == 0 and phrases.mined_phrases(df.where("lang = 'xx'")).count() == 0
    # steps cut texts at piece breaks, a sieve of one bit lets all through: neither changes a count
    batches = df.select("lang", "text").toArrow().to_batches()
    whole = Counter()
    for langs, texts in phrases._chunks(iter(batches)):
        for b in phrases.Words([x or "und" for x in langs], texts).counted(3, None):
            whole.update({(x, y): z for x, y, z in zip(*(c.to_pylist() for c in b.columns), strict=True)})
    monkeypatch.setattr(phrases, "STEP_BYTES", 40)
    small, steps = Counter(), 0
    for langs, texts in phrases._chunks(iter(batches)):
        steps += 1
        for b in phrases.Words([x or "und" for x in langs], texts).counted(3, np.full(phrases.SIEVE >> 3, 255, np.uint8)):
            for x, y, z in zip(*(c.to_pylist() for c in b.columns), strict=True):
                small[x, y] += z
    assert steps > 100 and small == whole


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    counts = spark.createDataFrame([("en", "", 10 * big), ("en", "p", big + 7), ("en", "q", big + 11), ("en", "p q", big)], "lang string, phrase string, n long")
    assert phrases.scored_phrases(counts, 10).first().score == 1_000_000 * big * big // ((big + 7) * (big + 11))


def resampled(rows, target):
    def features(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
        return len(ws), [crc32(x.encode()) % 10_000 for x in [*ws, *map(" ".join, zip(ws, ws[1:], strict=False))]]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(features(text)[1])
    for _, text in target:
        t.update(features(text)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))
    out = []
    for ident, text in rows:
        n, own = features(text)
        weight = sum(map(gain, own)) // len(own) if own else 0
        h = int(hashlib.sha256(f"7:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        out.append([ident, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= 20])
    some = sorted((x for x in out if x[5]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, x[1]))
    for rank, x in enumerate(some[: 25 * len(some) // 100], 1):
        x[4] = rank
    return Counter(tuple(x[:5]) for x in out)


@pytest.mark.parametrize("size", [0, 5, 400])
def test_resampling(spark, size):
    rng = random.Random(size)
    words = ["alpha", "BETA", "g4mma", "ÄÖ", "中文", "x_y", "d-e", "it's", "\x00", "z"]
    rows = [(k, rng.choice([" ", ".", " "]).join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(size)]
    rows += [(7, rows[0][1]), (None, "word " * 25), (None, "word " * 25), (900, None), (901, ""), (902, "long " * 40_000)] if size else []
    target = [(1, "alpha beta alpha"), (2, None), (3, "中文 d e")] if size != 5 else []
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, score long, span long")
    got = resampling.resampled(docs, spark.createDataFrame(target, "item_id long, text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, got.collect())) == resampled(rows, target)
