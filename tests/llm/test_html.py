"""Extraction against pages whose main text is known."""

import random
from html.parser import HTMLParser

import pytest

from quirespark.llm import html_text
from quirespark.llm.html_text import extract, extract_pages

LONG = "A sentence of the article, long enough to count. And a second one, with more words in it."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<main><section class='legal'><h1>T</h1><p>{LONG}</p></section></main>", f"T\n{LONG}"),
        (f"<form><nav><a>Home</a></nav><div><h1>T</h1><p>{LONG}</p></div><footer>x</footer></form>", f"T\n{LONG}"),
        (f"<article><p>{LONG}</p><div class='side-by-side'><p>{LONG}</p></div></article>", f"{LONG}\n{LONG}"),
        ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>1</mn></math> be, as it is.</p></article>", "Let x=1 be, as it is."),
        (f'<article><p title=5">{LONG}</p></article>', LONG),
        (f"<article><p title='a>b' data-x = \"c>d\">{LONG}</p></article>", LONG),
        ("<article><p>a &am<b>p;</b> b, &lt;c&gt;</p></article>", "a &amp; b, <c>".replace("&amp;", "&amp;")),
        (f"<article><h1>T</h1><p>{LONG}</p><div class=comments><p>{LONG}</p><p>{LONG}</p></div><form><label>Mail</label><input></form></article>", f"T\n{LONG}"),
        (f"<body><div class=widget><nav>Menu</nav><article><p>{LONG}</p></article></div></body>", LONG),
        (f"<article><p>{LONG}</p></article><aside><article><p>A teaser, short.</p></article></aside>", LONG),
        ("<nav><a>One</a></nav><footer>Two, three.</footer>", ""),
        ("plain text, no tags", "plain text, no tags"),
        (f"<article><p>{LONG}</p><p hidden>gone</p><svg><text>gone</text></svg><p>tail</p><b", f"{LONG}\ntail"),
        ("<p>a < b and c", "a < b and c"),
    ],
)
def test_pages(page, want):
    assert extract(page) == want


def test_deep_nesting():
    for n in (1_500, 30_000):
        assert extract("<nav>x</nav><article>" + "<div>" * n + LONG + "</div>" * n + "</article>") == LONG


def test_generated_pages():
    rng = random.Random(5)
    words = lambda n: " ".join("".join(rng.choices("abcdeinorst", k=rng.randint(2, 9))) for _ in range(n))
    for _ in range(300):
        title, body = words(rng.randint(2, 12)), [words(rng.randint(3, 90)) + "." for _ in range(rng.randint(1, 12))]
        junk = [f"<nav><ul>{''.join(f'<li><a href=/>{words(1)}</a></li>' for _ in range(6))}</ul></nav>", f"<div class='{rng.choice(('ad', 'ad-slot', 'cookie-banner', 'sidebar', 'site-nav'))}'><p>{words(20)}, {words(9)}.</p></div>", f"<aside>{words(30)}.</aside>"]
        after = [f"<section id=comments><p>{words(40)}, {words(5)}.</p></section>", f"<footer>&copy; {words(12)}.</footer>"]
        paragraphs = "".join(f"<p>{b}</p>" if rng.random() < 0.5 else f"<p>{b}" for b in body)
        page = "<html><head><title>x</title></head><body>" + "".join(rng.sample(junk, rng.randint(0, 3))) + f"<article><h1>{title}</h1>{paragraphs}</article>" + "".join(rng.sample(after, rng.randint(0, 2))) + "</body></html>"
        assert extract(page).split("\n") == [title, *body]


def test_rows(spark):
    rows = [(1, "u", "<p>a, b.</p>", "x"), (1, "u", "<p>a, b.</p>", "x"), (None, None, None, None), (2, "", "", "y"), (3, "v", "<article>" + f"<p>{LONG}</p>" * 20_000 + "</article>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(((r.page_id or 0, r.url, r.n_chars) for r in extract_pages(pages).collect()), key=repr)
    assert got == sorted([(1, "u", 5), (1, "u", 5), (0, None, 0), (2, "", 0), (3, "v", 20_000 * (len(LONG) + 1) - 1)], key=repr)
    assert extract_pages(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "part",
    [
        f"<section id='related-work'><h2>Related work</h2><p>{LONG}</p></section>", f"<h2 id='social-impact'>Related work</h2><p>{LONG}</p>", f"<h2 id=comments>Related work</h2><p>{LONG}</p>",
        f"<h2>Related work</h2><p class='comment-on-law'>{LONG}</p>", f"<section class='share-price'><h2>Related work</h2><p>{LONG}</p></section>",
        f"<section id='banner-wars'><h2>Related work</h2><p>{LONG}</p></section>", f"<dialog open><h2>Related work</h2><p>{LONG}</p></dialog>",
        f"<h2>Related work</h2><p>{LONG[:45]}<a href=/x>{LONG[45:60]}</a>{LONG[60:]}</p>", f"<ul><li>Related work<li>{LONG}</ul>",
    ],
)
def test_names_that_say_nothing_lose_no_text(part):
    assert extract(f"<article><h1>T</h1><p>{LONG}</p>{part}<p>{LONG}</p></article>") == f"T\n{LONG}\nRelated work\n{LONG}\n{LONG}"


@pytest.mark.parametrize(
    "part",
    [
        "<ul>" + "".join(f"<li><a href=/{k}>Other story {k}</a></li>" for k in range(8)) + "</ul>", "<div>" + "".join(f"<div><a href=/{k}>Other story, {k}.</a></div>" for k in range(8)) + "</div>",
        f"<div class='comment-list'><p>{LONG}</p><p>{LONG}</p></div>", f"<section id=comments><p>{LONG}</p></section>", f"<div class='wide ad-300x250'><p>{LONG}</p></div>", f"<dialog><p>{LONG}</p></dialog>",
        f"<div class='related-posts'><p>{LONG}</p></div>", f"<aside><p>{LONG}</p></aside>", f"<div role=navigation><p>{LONG}</p></div>", f"<div class='cookie-notice'><p>{LONG}</p></div>",
    ],
)
def test_lists_of_links_and_telling_names_go(part):
    body = "\n".join([LONG] * 6)
    paragraphs = "".join(f"<p>{x}</p>" for x in body.split("\n"))
    assert extract(f"<article><h1>T</h1>{paragraphs}{part}</article>") == f"T\n{body}"


class Table(HTMLParser):
    """The sums of each path, by another reader: nodes, characters, marks, linked characters."""

    def __init__(self, page):
        super().__init__()
        self.open, self.sums = [], {}
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.open.append((tag, *(dict(attrs).get("class") or "").split()))

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        if data.strip():
            own = self.sums.setdefault(tuple(self.open), [0, 0, 0, 0])
            linked = any(t[0] == "a" for t in self.open)
            for k, x in enumerate((1, len(data.strip()), sum(c in ".,;:!?" for c in data), len(data.strip()) * linked)):
                own[k] += x


def test_path_sums_and_pages_without_telling_names():
    """Nameless boxes: a list of links, the text, a line below; the sums of paths are those of a plain reader."""
    rng = random.Random(9)
    words = lambda n: " ".join("".join(rng.choices("abcdeinorst", k=rng.randint(2, 9))) for _ in range(n))
    for _ in range(150):
        title, body = words(rng.randint(2, 9)), [words(rng.randint(25, 90)) + ", " + words(9) + "." for _ in range(rng.randint(3, 12))]
        links = "".join(f"<li><a href=\"/\">{words(rng.randint(1, 3))}</a></li>" for _ in range(rng.randint(4, 9)))
        teasers = "".join(f"<li><a href=\"/\">{words(rng.randint(2, 6))}</a></li>" for _ in range(rng.randint(3, 8)))
        text = f"<h1>{title}</h1>" + "".join(f"<p class=\"c{k % 2}\">{b}</p>" for k, b in enumerate(body))
        page = f"<body><div><ul>{links}</ul></div><div>{text}<div><ol>{teasers}</ol></div></div><div>{words(4)}</div></body>"
        want = Table(page).sums
        every, nodes = html_text.read_nodes(page)
        got = {}
        for e, data, _ in nodes:
            path, at = [], e
            while at.up:
                path, at = [at, *path], at.up
            own = got.setdefault(e.path, [0, 0, 0, 0, len(path)])
            for k, x in enumerate((1, len(data.strip()), len(html_text.PUNCTUATION.findall(data)), len(data.strip()) * e.linked)):
                own[k] += x
        assert sorted(map(tuple, got.values())) == sorted((*v, len(k)) for k, v in want.items())
        assert extract(page).split("\n") == [title, *body]
