"""Every corpus operator against brute force, on small tables with nulls, empties, repeats and extra columns."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quirespark.llm import bpe, bpe_codec, column_bwt, components, decontaminate, html_text, jaccard_join, quality_classifier, quality_rules, suffix_dedup, token_counts, url_filter, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocabulary = ["".join(rng.choices("abcdefghé ", k=rng.randint(2, 8))).strip() or "x" for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 150))) for _ in range(60)]
    texts += [texts[0], texts[1] + " tail", "pre " + texts[2], texts[3].replace(" ", "\n", 3), texts[4][:200] + texts[5][:200], "", None, " \n\t", "a", "a b", "A B", "zz " * 300, "x" * 5000, "中文字符" * 200, "it's <|endoftext|> I'll ''s don't", "\x85 \xa0x  y"]
    out = [(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)]
    return [*out, out[7], (None, texts[8], None, None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def test_quality_rules(spark, docs, rows):
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)], "doc_id long, quality int, toxic int")
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.quality_rules(docs, labels).collect())
    want = Counter()
    for k, t, *_ in rows:
        t = t or ""
        w = t.encode().split()
        seen = Counter(tuple(w[j : j + 5]) for j in range(len(w) - 4))
        repeat = len({j + i for j in range(len(w) - 4) if seen[tuple(w[j : j + 5])] > 1 for i in range(5)})
        lines = [x for x in t.split("\n") if x.encode().split()]
        want[k, len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeat, len(w) < 10 or 100 * repeat > 20 * len(w)] += 1
    assert got == want
    assert quality_rules.quality_rules(docs.limit(0)).count() == 0


def test_token_counts(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.public_path(token_counts.VOCABULARY))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs).collect())
    assert got == Counter((k, len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for k, x, *_ in rows)


def test_transducer_on_random_text():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.public_path(token_counts.VOCABULARY)
    t, own, rng = tokenizers.Tokenizer.from_file(path), token_counts.transducer(path), random.Random(9)
    pieces = [*"abcdeinorst'  \n.,!09ÄéΣςİ中½²“ ", "'s", "'re", "'ll", "<|endoftext|>", "ing", "😀", "́"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(0, 50))) for _ in range(800)]
    assert own.count(texts) == [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]


def test_codec(docs, rows):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.public_path(bpe_codec.VOCABULARY))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = Counter(tuple(r) for r in bpe_codec.round_trip(docs).collect())
    want = Counter()
    for k, x, *_ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[k, len(ids), sha(",".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False))] += 1
    assert got == want
    assert Counter(r.text for r in bpe_codec.decode(bpe_codec.encode(docs)).collect()) == Counter(x or "" for _, x, *_ in rows)


def test_suffix_dedup(docs, rows):
    first = {}
    key = lambda k: float("inf") if k is None else k
    for k, t, *_ in sorted(rows, key=lambda r: key(r[0])):
        b = (t or "").encode()
        for j in range(len(b) - 49):
            first.setdefault(b[j : j + 50], key(k))
    want = Counter()
    for k, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < key(k):
                gone[j : j + 50] = b"\1" * 50
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[k, len(b), sum(gone), sum(g and (not j or not gone[j - 1]) for j, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.suffix_dedup(docs, carry=("lang", "source"))
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got.collect()) == want
    assert suffix_dedup.suffix_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("held", [10, 10**9])
def test_column_transform(held):
    import os

    import numpy as np

    rng = random.Random(held)
    for _ in range(30):
        strings = [bytes(rng.choices(b"abc", k=rng.randint(0, 20))) for _ in range(rng.randint(1, 20))]
        sizes = np.array([*map(len, strings)], np.int64)
        data = np.frombuffer(b"".join(strings) + b"a", np.uint8)
        s, n, common = column_bwt.sorted_suffixes(data, np.cumsum(sizes) - sizes, sizes, 8, held)
        made = [strings[a][len(strings[a]) - b :] for a, b in zip(s.tolist(), n.tolist(), strict=True)]
        assert made == sorted(made) and len(made) == sizes.sum() + len(strings)
        assert all(common[k] == min(8, len(os.path.commonprefix([made[k - 1], made[k]]))) for k in range(1, len(made)))


@pytest.mark.parametrize(("k", "percent"), [(3, 90), (5, 80)])
def test_jaccard(docs, rows, k, percent):
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t, *_ in rows:
        w = (t or "").encode().translate(lower).split()
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = [*range(len(rows))]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = label[a], label[b]
                label = [y if v == x else v for v in label]
    want = Counter()
    for j, (i, *_) in enumerate(rows):
        ids = [rows[m][0] for m in range(len(rows)) if label[m] == label[j] and rows[m][0] is not None]
        want[i, len(sets[j]), min(ids, default=None)] += 1
    assert Counter(tuple(r) for r in jaccard_join.jaccard_components(docs, k, percent).collect()) == want


@pytest.mark.parametrize(("block", "tile"), [(8192, 1 << 15), (50, 20), (9, 7)])
def test_jaccard_large_group(spark, monkeypatch, block, tile):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "SIFTED", tile)
    rng = random.Random(1)
    base = [f"w{j}" for j in range(200)]
    out = []
    for i in range(120):
        w = [*base]
        for _ in range(2):
            w[rng.randrange(200)] = f"e{i}"
        out.append((i, " ".join(w)))
    got = jaccard_join.jaccard_components(spark.createDataFrame(out, "doc_id long, text string"), 3, 90).collect()
    sets = [{tuple(t.split()[j : j + 3]) for j in range(198)} for _, t in out]
    label = [*range(120)]
    for a in range(120):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]) and label[a] != label[b]:
                x, y = max(label[a], label[b]), min(label[a], label[b])
                label = [y if v == x else v for v in label]
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(label))


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(50, 51), (51, 51), (51, 50)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 50: 50, 51: 50}


def test_leaks(spark, docs):
    items = [(0, "alpha beta gamma delta epsilon zeta eta theta\niota kappa lambda mu"), (1, "one two three four five six seven eight nine ten"), (2, None), (3, "")]
    extra = spark.createDataFrame([(900, "zz " * 50 + "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu. " + "yy " * 50), (901, "one two three four five"), (902, "one two three four five six seven eight nine ten")], "doc_id long, text string")
    found = decontaminate.find_leaks(docs.select("doc_id", "text").union(extra), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(900, 0), (902, 1)}
    assert decontaminate.without_leaks(extra, spark.createDataFrame(items, "item_id long, text string")).count() == 1


def test_leaks_do_not_depend_on_the_size_of_an_index(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{j}" for j in range(60)]
    items = [(j, " ".join(rng.choices(vocabulary[: 10 + 5 * (j % 11)], k=rng.randint(6, 40)))) for j in range(25)] + [(None, "w1 w2 w3"), (40, ""), (3, "w4 w5 w6 w7")]
    texts = []
    for _, t in items:
        for cut in (0, 1, 2):
            texts.append(" ".join([*rng.choices(vocabulary, k=30), *t.split()[cut:], *rng.choices(vocabulary, k=50)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter(tuple(r) for r in decontaminate.find_leaks(docs, bench).collect())
    assert len({r[2] for r in want}) > 10
    for n in (10, 3):
        monkeypatch.setattr(decontaminate, "ITEMS", n)
        assert Counter(tuple(r) for r in decontaminate.find_leaks(docs, bench.repartition(5)).collect()) == want


def test_html():
    page = "<body><nav><a href=/>Home</a></nav><div class=ad>Buy this, now.</div><article><h1>Title</h1><p><b>One &amp; two,<br>three.<p>Es.</p><div class=comments><p>Nice, really nice.</p></div></article><footer>&copy; x</footer></body>"
    assert html_text.extract(page) == "Title\nOne & two, three.\nEs."
    assert html_text.extract("") == "" and html_text.extract("<script>var a='<p>x</p>'</script>") == ""


def test_html_short_article_beside_long_boilerplate():
    footer = "<footer>" + ("<p>" + ("x" * 19 + ".") * 20 + "</p>") * 3 + "</footer>"
    nav = "<nav><a>Prev</a><a>Next</a></nav>"
    for holder in ("article", "div"):
        assert html_text.extract(f"<{holder}><h1>Title</h1><p>Short text.</p></{holder}>{nav}{footer}") == "Title\nShort text."
    assert html_text.extract(nav + footer) == ""


def test_html_votes_choose_among_all_elements():
    text = lambda k, n=6: "".join(f"<p>Text {k} {j}, in words of its own, and then some more.</p>" for j in range(n))
    lines = lambda k, n=6: [f"Text {k} {j}, in words of its own, and then some more." for j in range(n)]
    # a teaser in an article does not take the place of the text in a div
    assert html_text.extract(f"<body><div id=x><h1>Title</h1>{text(1, 12)}</div><article>{text(2, 1)}</article></body>").split("\n") == ["Title", *lines(1, 12)]
    # several content elements, within a main and without one, of like and of unlike sizes
    for tag in ("main", "div"):
        for n in (6, 60):
            page = f"<body><nav><a>Home</a></nav><{tag}><h1>Title</h1><article>{text(1, n)}</article><article>{text(2)}</article></{tag}></body>"
            assert html_text.extract(page).split("\n") == ["Title", *lines(1, n), *lines(2)]
    # a part of an article with nearly all votes leaves the rest of it in place
    assert html_text.extract(f"<body><article><h1>Title</h1><section>{text(1, 12)}</section><p>End.</p></article><div>Junk</div></body>").split("\n") == ["Title", *lines(1, 12), "End."]


def test_classifier(spark, rows):
    texts = [(k, ("Good words, plainly said. " if k % 2 else "bad*** words### && ") * (k % 7 + 1)) for k in range(300)]
    docs = spark.createDataFrame([*texts, (None, None), (301, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(300)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_classifier.quality_scores(docs, labels).collect()}
    assert len(got) == 302 and all(0 <= r.score <= 1 for r in got.values())
    held = [r for k, r in got.items() if k is not None and k < 300 and r.held_out]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)


def test_warc(spark):
    pages = spark.createDataFrame([(3, "http://a\n/", "same"), (1, "http://b/", "same"), (2, None, None), (4, "u", ""), (5, "v", "own" * 999), (5, "v", "own" * 999)], "page_id long, url string, html string")
    archives = warc.write_archives(pages)
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_archives(archives).collect())
    nulls = spark.createDataFrame([(None, "a", "x"), (7, "b", "x"), (None, "c", "y"), (None, "d", "y")], "page_id long, url string, html string")
    assert {(r.page_id, r.url, r.record_type, r.refers_to) for r in warc.read_archives(warc.write_archives(nulls)).collect()} == {(None, "a", "revisit", 7), (7, "b", "response", None), (None, "c", "response", None), (None, "d", "response", None)}
    assert warc.read_archives(warc.write_archives(nulls.limit(0))).count() == 0
    assert got == [(1, 4, "response", None), (2, 0, "response", None), (3, 4, "revisit", 1), (4, 0, "revisit", 2), (5, 2997, "response", None), (5, 2997, "response", None)]
    content = warc.pack([warc.record(1, "u", b"abc", None)])
    assert [r for _, r in warc.unpack(content)][0].endswith(b"abc\r\n\r\n")
    with pytest.raises(ValueError):
        list(warc.unpack(content[:-3]))
    with pytest.raises(ValueError):
        warc.parse(warc.record(1, "u", b"abc", None).replace(b"abc", b"abd"))


def test_urls(spark):
    urls = ["http://X.example.org/es/1?q", "https://a.com/de/", "https://b.com/de/", "https://b.com/fr/2", "https://a.com/en/3", "nothing", None, "ftp://net/#x", "https://notexample.org/es/", "http://example.org/en/12"]
    pages = spark.createDataFrame([*enumerate(urls), (0, urls[0])], "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages).collect()}
    assert got[0] == ("x.example.org", "/es/1", "example.org/es/", "block") and got[3] == ("b.com", "/fr/2", "com/fr/", "allow")
    assert got[4] == ("a.com", "/en/3", None, "block") and got[5] == ("", "", None, "allow") == got[6]
    assert got[8][2:] == ("org/", "allow") and got[9][2:] == ("example.org/en/1", "block")
    keys = spark.createDataFrame([(f"k{j}", j % 7 == 0) for j in range(3000)], "key string, listed boolean")
    cascade = url_filter.fit_cascade(keys)
    assert len(cascade.levels) > 1 and keys.where(cascade.holds(F.col("key")) != F.col("listed")).count() == 0
    several = url_filter.fit_cascade(keys, 50)
    assert several.shards == 9 and several.mark(keys, "key", "got").where(F.col("got") != F.col("listed")).count() == 0
    again = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, per_shard=1).collect()}
    assert again == {(k, *v) for k, v in got.items()}
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
