r"""HTML extraction by tag-path ratios.

The nodes of a page are its texts, with their root-to-leaf tag paths (tags with class and id names). For each path the
text length, the punctuation and the length inside links are summed; length per node and punctuation per node, less the
share in links, give two ratios. Both are smoothed over the page's sequence of nodes, fused as a geometric mean, weighed
by the path's names and compared with a threshold from the page itself. Paths above it are content: they vote, with
their text, for the smallest element with most of the votes; texts in article and main elements count twice. If that
element lies in an article or main, the content is the smallest element around all of those that have votes. Inside it a
text is left out only if its path is under the threshold, and then only for links or for names that speak against it:
headings and short paragraphs stay whatever their ratio.

Names only weigh: of class names the whole ones, of ids those of containers that are one plain word, so ids made from
headings say nothing. Plain ones (nav, footer, sidebar, comments, ads and the like, alone or with general words such as
list or box) and doubtful ones (side, notice, legal, form) divide the ratio, and neighbours do not lift it, so that a path
falls under the threshold unless much text outweighs them. None counts on an element that holds all of the page's texts,
or its only article or main: there a name tells nothing apart. Elements that HTML has for it (nav, footer, aside, menu,
a page's header) are left out. So is a list of links: three or more blocks of one path whose text is nearly all linked have
a ratio near 0; a link within a paragraph's text is not such a block.

Edge cases: null and empty html, and pages without content, give ""; unclosed and stray tags are repaired as browsers
do for paragraphs and list items; a page of bare text is kept as it is; repeated rows stay; an empty table gives none;
elements may lie in each other to any depth, and pages of any length are read whole; other columns never matter.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Comments, declarations, tags with their attributes (values may be unquoted and then hold quotes), texts; a tag that the
#: page ends in is dropped.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[\s/]+|[^\s/>=]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)?)?|=)*+)>|[^<]+|<(?=/?[a-zA-Z])[^<>]*\Z|<""", re.S)
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
OPEN = re.compile(r"(?:^|\s)open(?=\s|$|=)", re.I)
PARTS, NUMBER = re.compile(r"[-_]+"), re.compile(r"\d*x?\d*$")
HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|$|=)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
PUNCTUATION = re.compile(r"""[.,;:!?。，；：！？、…»«"”“]""")
#: Fixed values of HTML: elements by how they are read.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noembed", "noframes", "svg", "object", "canvas", "audio", "video", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "img", "wbr", "br", "input", "math", "mi", "mn", "mo", "mrow", "msup", "msub", "mfrac", "msqrt", "mtext"}
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "select"}
#: Elements that are left out, names that speak against a path plainly or doubtfully, general words that may stand beside
#: such a name, and by how much they divide the ratio.
DROPPED = {"nav", "footer", "aside", "menu", "head"}
LABELS = set(
    "ad ads advert adverts advertisement advertisements advertorial sponsor sponsored promo promos promotion promotions banner nav navbar navigation menu breadcrumb breadcrumbs "
    "footer sidebar aside widget widgets cookie cookies consent gdpr popup modal overlay newsletter subscribe signup login comment comments disqus replies respond share sharing "
    "social related recommend recommended recommendations masthead topbar toolbar pagination pager complementary contentinfo".split()
)
DOUBTS = set("side rail notice alert search copyright legal disclaimer skip".split())
GENERAL = set(
    "site page main top bottom left right upper lower inner outer box area list section wrapper wrap container block slot unit bar group item items link links button buttons icon icons "
    "form header head title content body post posts article articles entry story stories news thread media global primary secondary".split()
)
DOUBTFUL = {"form", "fieldset"}
DOUBT, PLAIN = 0.3, 0.01
#: Elements whose ids may speak; blocks of one path that a list of links has at least, and the linked share of its text.
CONTAINERS = {"div", "section", "ul", "ol", "dl", "table", "form", "fieldset", "header"}
LINKED_BLOCKS, LINKED_SHARE = 3, 0.8
#: Content elements, and how much more the texts in them count as votes.
CONTENT, WEIGHT = {"article", "main"}, 2


class Element:
    __slots__ = ("tag", "up", "depth", "path", "weight", "hidden", "linked", "content", "within", "size", "votes", "holds", "inside", "pure")

    def __init__(self, tag: str, up: Element | None, path: int = 0, weight: float = 1.0, hidden: bool = False):
        self.tag, self.up, self.path, self.depth = tag, up, path, up.depth + 1 if up else 0
        #: What the element and its names say; `pure` is whether that counts wherever the element stands.
        self.weight, self.pure = weight, tag in DROPPED
        self.hidden = hidden or bool(up and up.hidden)
        self.linked = tag == "a" or bool(up and up.linked)
        self.content = tag in CONTENT
        self.within = self.content or bool(up and up.within)
        self.size = self.votes = self.holds = 0
        self.inside = False


def told(name: str, words: set[str]) -> bool:
    """Whether a whole name has one of the words, beside numbers, general words and other telling ones at most."""
    parts = [NUMBER.sub("", x) for x in PARTS.split(name)]
    return any(x in words for x in parts) and all(not x or x in LABELS or x in DOUBTS or x in GENERAL for x in parts)


def spoken(tag: str, classes: list[str], ident: str, role: str, within: bool) -> float:
    """What an element and its names say of it: 0 leaves it out, less than 1 divides its ratio."""
    if tag in DROPPED or (tag == "header" and not within):
        return 0.0
    if tag in ("html", "body"):
        return 1.0
    names = [*classes, *role.split(), *([ident] if tag in CONTAINERS and not PARTS.search(ident) else [])]
    if any(told(x, LABELS) for x in names):
        return PLAIN
    return DOUBT if tag in DOUBTFUL or any(told(x, DOUBTS) for x in names) else 1.0


def read_nodes(page: str) -> tuple[list[Element], list[tuple[Element, str, int]]]:
    """The page's elements, parents first, and its texts in order: their element, their text and the number of their block."""
    root = at = Element("", None)
    every, block, nodes, paths = [root], 0, [], {}
    pos, size = 0, len(page)
    while pos < size:
        m = TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] != "<" or m[0] == "<":
                nodes.append((at, entities.unescape(m[0]), block))
            continue
        tag = tag.lower()
        if m[1]:
            hit = at
            while hit is not root and hit.tag != tag:
                hit = hit.up
            if hit is not root:
                at = hit.up
            if tag not in INLINE:
                block += 1
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/") or tag not in ("svg", "object", "canvas"):
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, pos)
                pos = end.end() if end else size
            continue
        if tag not in INLINE:
            block += 1
            hit = at
            closes = SAME.get(tag, {"p"} if tag not in VOID else set())
            while hit is not root and hit.tag not in closes and hit.tag not in SCOPES and (hit.tag in INLINE or tag in SAME):
                hit = hit.up
            if hit is not root and hit.tag in closes:
                at = hit.up
        if tag == "br":
            nodes.append((at, " ", block))
        if tag in VOID:
            continue
        names = {kind.lower(): (b or c or d or "").lower() for kind, b, c, d in reversed(NAMES.findall(m[3]))}  # the first of a kind counts
        classes = names.get("class", "").split()
        path = paths.setdefault((at.path, tag, *classes), len(paths) + 1)
        hidden = bool(HIDDEN.search(m[3])) or (tag == "dialog" and not OPEN.search(m[3]))
        at = Element(tag, at, path, spoken(tag, classes, names.get("id", ""), names.get("role", ""), at.within), hidden)
        every.append(at)
    return every, nodes


def smooth(values: list[float]) -> list[float]:
    """Gaussian means over two neighbours to either side."""
    weights = (0.06, 0.24, 0.4, 0.24, 0.06)
    padded = [0.0, 0.0, *values, 0.0, 0.0]
    return [sum(w * padded[k + j] for j, w in enumerate(weights)) for k in range(len(values))]


def deepest(elements: list[Element], fits) -> Element:
    """Of elements that lie in each other, the innermost."""
    return max((e for e in elements if fits(e)), key=lambda e: e.depth)


def weigh(every: list[Element], nodes: list[tuple[Element, str, int]]) -> list[float]:
    """How far each element and its names, with those it lies in, speak for it, by the element's place."""
    for e, text, _ in nodes:
        e.size += len(text.strip())
    for e in reversed(every):
        if e.up:
            e.up.size += e.size
    total = every[0].size
    for tag in CONTENT:
        own = [e for e in every if e.tag == tag]
        if len(own) == 1:
            e = own[0].up
            while e:
                e.holds = 1
                e = e.up
    place = {id(e): k for k, e in enumerate(every)}
    out: list[float] = []
    for e in every:
        own = 1.0
        if not (e.holds or (e.size == total and not e.pure)):
            own = e.weight
        out.append(own * (out[place[id(e.up)]] if e.up else 1.0))
        e.holds = 0
    return out


def block_of(e: Element) -> Element:
    """The element whose block a text of e is in."""
    while e.tag in INLINE and e.up:
        e = e.up
    return e


def link_lists(nodes: list[tuple[Element, str, int]]) -> set[int]:
    """Paths of blocks that are lists of links: LINKED_BLOCKS blocks or more, nearly all of their text linked."""
    sums: dict[int, list] = {}
    for e, text, block in nodes:
        size = len(text.strip())
        if size:
            own = sums.setdefault(block_of(e).path, [0, 0, set()])
            own[0] += size
            own[1] += size * e.linked
            own[2].add(block)
    return {p for p, (size, linked, own) in sums.items() if linked >= LINKED_SHARE * size and len(own) >= LINKED_BLOCKS}


def extract(page: str) -> str:
    """The main text of a page, a line per block."""
    every, nodes = read_nodes(page)
    nodes = [x for x in nodes if not x[0].hidden]
    names = {id(e): w for e, w in zip(every, weigh(every, nodes), strict=True)}
    paths: dict[int, list[float]] = {}
    texts = []
    for e, text, _ in nodes:
        size = len(text.strip())
        if size and names[id(e)]:
            own = paths.setdefault(e.path, [0.0, 0.0, 0.0, 0.0])
            own[0] += 1
            own[1] += size
            own[2] += len(PUNCTUATION.findall(text))
            own[3] += size * e.linked
            texts.append((e, size))
    if not texts:
        return ""
    free = lambda p: 1 - paths[p][3] / paths[p][1]
    fuse = lambda a, b: math.sqrt(a * (b + 0.1))
    lone = {p: (own[1] / own[0] * free(p), own[2] / own[0] * free(p)) for p, own in paths.items()}
    smoothed = zip(*(smooth([lone[e.path][k] for e, _ in texts]) for k in (0, 1)), strict=True)
    best: dict[int, float] = {}
    for (e, _), (a, b) in zip(texts, smoothed, strict=True):
        # neighbours lift no path that a name speaks against
        own = fuse(a, b) if names[id(e)] == 1 else min(fuse(a, b), fuse(*lone[e.path])) * names[id(e)]
        best[e.path] = max(best.get(e.path, 0.0), own)
    # paths that names speak against plainly are no measure of the page
    plain = {e.path for e, _ in texts if names[id(e)] <= PLAIN}
    usual = [x for p, x in best.items() if p not in plain] or list(best.values())
    mean = sum(usual) / len(usual)
    cut = 0.5 * min(mean, math.sqrt(sum((x - mean) ** 2 for x in usual) / len(usual)) or mean)
    for e, size in texts:
        if best[e.path] >= cut:  # the cut is half the mean at most, so the best path passes
            e.votes += size * (WEIGHT if e.within else 1)
    for e in reversed(every):
        if e.up:
            e.up.votes += e.votes
            # the outermost content elements with votes, counted in all that hold them
            e.up.holds += e.holds + (1 if e.content and not e.up.within and e.votes else 0)
    total = every[0].votes
    # elements with so large a share of the votes lie within each other; the root is one of them
    chosen = deepest(every, lambda e: e.votes >= 0.8 * total and e.tag not in INLINE and e.tag != "p")
    if chosen.within:
        # names only widen what the votes chose: to all content elements with votes
        n = every[0].holds
        chosen = deepest(every, lambda e: e.holds == n or (n == 1 and e.content and e.votes and not e.up.within))
    for e in every:
        e.inside = e is chosen or bool(e.up and e.up.inside)
    listed = link_lists(nodes)
    blocks: dict[int, list[str]] = {}
    for e, text, block in nodes:
        above = best.get(e.path, 0.0) >= cut
        if e.inside and names[id(e)] and (above or names[id(e)] >= names[id(chosen)]) and block_of(e).path not in listed:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""

    bounded_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [extract(x.as_py() or "") for x in part.column(2)]
                sizes = pa.array(map(len, texts), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    columns = (F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.select(*columns).mapInArrow(run, "page_id long, url string, text string, n_chars long")
