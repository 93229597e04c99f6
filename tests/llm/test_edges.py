"""Empty tables, nulls, repeats and clashing column names for every operator, and the pipeline's stages one by one."""

import random
from collections import Counter

import pytest

import corpus_pipeline
from quirespark.llm import bpe, bpe_codec, decontaminate, html_text, jaccard_join, quality_classifier, quality_rules, suffix_dedup, token_counts, url_filter, warc

#: Names that operators use inside.
CLASH = "key string, n long, kept_id long, n_tokens long, row long, component string, shard int, blob binary, listed boolean, digest binary, block int, tile long"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(rng):
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(200)]
    return [" ".join(rng.choices(words, k=rng.randint(15, 60))) for _ in range(25)]


@pytest.fixture(scope="module")
def rows():
    t = texts(random.Random(8))
    long = " ".join(t) * 40
    return [*enumerate(t), (3, t[3]), (3, t[4]), (50, t[0]), (51, None), (52, ""), (None, t[1]), (None, None), (60, long), (61, long)]


@pytest.fixture(scope="module")
def plain(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


@pytest.fixture(scope="module")
def clashing(spark, rows):
    extra = ("k", 7, 7, 7, 7, "c", 7, b"x", True, b"y", 7, 7)
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {CLASH}")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([*((k, k % 2) for k in range(25)), (2, 1), (None, 1), (51, None)], "doc_id long, quality int")


OPERATORS = {
    "rules": lambda d, l: quality_rules.quality_rules(d, l),
    "tokens": lambda d, l: token_counts.token_counts(d),
    "dedup": lambda d, l: suffix_dedup.suffix_dedup(d).drop("spans"),
    "codec": lambda d, l: bpe_codec.round_trip(d),
    "classifier": lambda d, l: quality_classifier.quality_scores(d, l),
    "jaccard": lambda d, l: jaccard_join.jaccard_components(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_other_columns_never_matter_and_empty_tables_give_none(plain, clashing, labels, name):
    run = OPERATORS[name]
    assert Counter(map(tuple, run(plain, labels).collect())) == Counter(map(tuple, run(clashing, labels).collect()))
    assert run(plain.limit(0), labels).count() == 0


def test_pages_with_clashing_columns(spark):
    base = [(1, "http://a.com/de/", "<p>a.</p>"), (1, "http://a.com/de/", "<p>a.</p>"), (None, None, None)]
    extra = ("k", 7, 7, 7, 7, "c", 7, b"x", True, b"y", 7, 7)
    one = spark.createDataFrame(base, "page_id long, url string, html string")
    two = spark.createDataFrame([(*r, *extra) for r in base], f"page_id long, url string, html string, {CLASH}")
    for run in (html_text.extract_pages, lambda p: warc.read_archives(warc.write_archives(p)), url_filter.filter_urls):
        assert Counter(map(repr, map(tuple, run(one).collect()))) == Counter(map(repr, map(tuple, run(two).collect())))
        assert run(one.limit(0)).count() == 0


def test_quality_verdicts(spark):
    rng = random.Random(2)
    good = [" ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 8))) for _ in range(rng.randint(30, 200))) + "." for _ in range(150)]
    bad = [" ".join("### " + "".join(rng.choices("ab$%|", k=5)) for _ in range(60)) for _ in range(50)]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k < 150)) for k in range(200)] + [(199, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert sum(got[k].kept for k in range(150)) >= 147 and sum(got[k].kept for k in range(150, 200)) <= 2
    kept = quality_rules.keep_rows(docs, labels)
    assert {r.doc_id for r in kept.collect()} == {k for k, r in got.items() if r.kept}
    assert {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, labels).collect()} == {k: r.kept for k, r in got.items()}
    assert quality_rules.quality_rules(docs).where("kept").count() > 150


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_one_of_each(spark, clashing, rows):
    got = jaccard_join.one_of_each(clashing)
    assert got.columns == clashing.columns
    sets = [shingles(t) for _, t in rows]
    label = [*range(len(rows))]
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                label = [label[b] if v == label[a] else v for v in label]
    want = Counter()
    for x in set(label):
        group = [k for k in range(len(rows)) if label[k] == x]
        if not sets[group[0]]:
            want.update(rows[k] for k in group)
            continue
        want[min((rows[k] for k in group), key=lambda r: (r[0] is None, r[0] or 0))[0]] += 1
    assert Counter(r.doc_id if shingles(r.text) else (r.doc_id, r.text) for r in got.collect()) == want
    # rows that differ in another column alone are one group; of wholly equal ones one stays
    twice = spark.createDataFrame([(1, "a b c d e f", "x"), (1, "a b c d e f", "y"), (1, "a b c d e f", "x"), (2, "q", "z"), (2, "q", "z")], "doc_id long, text string, other string")
    assert Counter(r.doc_id for r in jaccard_join.one_of_each(twice).collect()) == {1: 1, 2: 1}


def test_frequent_shingles_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", 10)
    monkeypatch.setattr(jaccard_join, "SAMPLE_PART", 1)
    rng = random.Random(3)
    base = [f"w{j}" for j in range(60)]
    docs = []
    for i in range(90):
        w = list(base) if i % 3 else [*base[:45], *(f"o{j}" for j in range(15))]
        w[rng.randrange(60)] = f"e{i}"
        docs.append((i, " ".join(w)))
    sets = [shingles(t) for _, t in docs]
    label = [*range(90)]
    for a in range(90):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and label[a] != label[b]:
                x, y = max(label[a], label[b]), min(label[a], label[b])
                label = [y if v == x else v for v in label]
    got = jaccard_join.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r.doc_id: r.component_id for r in got.collect()} == dict(enumerate(label))


def test_runs_of_one_hash_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffix_dedup, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    data = np.frombuffer(b"abcabdabcxyzabd", np.uint8)
    names = suffix_dedup.run_names(data, np.arange(0, 15, 3), np.full(5, 3), np.zeros(5, np.uint64))
    assert names[0] == names[2] and names[1] == names[4] and len(set(names.tolist())) == 3


def test_pipeline(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    rng = random.Random(4)
    base = texts(rng)
    shared = " ".join(f"shared{j}" for j in range(60))
    leak = "what is the name of the river that runs through the old town of this land\nit is the long river"
    own = lambda k: " ".join(f"u{k}x{j}" for j in range(40))
    docs = [(k, t + " " + own(k)) for k, t in enumerate(base)]
    docs += [(100, docs[0][1]), (101, docs[1][1] + " more"), (102, own(102) + " " + shared), (103, own(103) + " " + shared), (104, own(104) + " " + leak.replace("\n", " ") + " " + own(105)), (105, None), (106, "short")]
    at = str(tmp_path)
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in docs], COLUMNS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    now = spark.read.parquet(f"{at}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, at)
        assert now.columns == list(corpus_pipeline.COLUMNS), name
        seen.append({r.doc_id: r.text for r in now.collect()})
    rules, near, cut, clean = seen
    assert {105, 106}.isdisjoint(rules) and {0, 100, 102, 104} <= set(rules)
    assert set(near) == set(rules) - {100, 101}
    assert cut[102] == near[102] and shared not in cut[103] and cut[103].startswith(own(103)[:-10]) and set(cut) == set(near)
    assert set(clean) == set(cut) - {104}
    t = tokenizers.Tokenizer.from_file(bpe.public_path(bpe_codec.VOCABULARY))
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, at).collect()}
    assert set(out) == set(clean) and all(list(out[k].ids) == t.encode(clean[k], add_special_tokens=False).ids and out[k].n_tokens == len(out[k].ids) for k in out)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, now.limit(0), at).count() == 0
