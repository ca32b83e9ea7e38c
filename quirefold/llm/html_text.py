"""Main text of web pages by tag-path ratios.

A page is a sequence of text nodes, each below a root-to-leaf tag path (names with their first class or id; inline
elements left out). For every path the text length and the punctuation of its nodes are summed; dividing by the number of
nodes gives a text ratio and a punctuation ratio. Both are smoothed over neighbouring nodes of the page and fused by
multiplication, together with the share of text outside links and with a prior: paths through article or main count
PRIOR_MAIN times, paths through a container named like boilerplate PRIOR_NAMED times, on every page alike. Paths whose
fused score reaches a share of the page's best hold content.

Content paths then choose where the article is: going down from the root, the container that holds most of what they
score, as long as one does; not below an article or main, nor below a heading of its own. What stands inside it belongs to
the article, short paragraphs and headings included, but for inner containers that are named like boilerplate and score
little. Menus, footers, forms and what is hidden are left out by what they are.

Null or empty html: empty text. Malformed markup: unclosed elements end where HTML says. Very long pages: whole, in time
linear in their length, whatever their markup. Repeated rows and ties of page_id: a row each. Ties of scores: the earlier
container. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas textarea xmp noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("br option optgroup html head body caption td th tr tbody thead tfoot summary legend".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
#: Elements that an element of the same list ends implicitly, up to the given container.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist"})}
DROPPED = frozenset("head title nav footer aside form button select option input menu dialog fieldset legend datalist".split()) | RAW
MAIN = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2"))
CONTAINERS = frozenset("html body div section article main center td".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
# Words in class and id that name what isn't the article.
BOILERPLATE = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advert[a-z]*|adsense|adslot|ad-?(?:box|unit|banner|container|wrapper)|banner|sponsor(?:ed)?|promo(?:tion)?s?|nav(?:bar|igation)?|menus?|breadcrumbs?|side-?bar|header|site-?head|masthead|footer|foot|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|newsletter|subscri(?:be|ption)|signup|sign-?in|login|register|comments?|comment-?(?:list|section|form|body|area)|disqus|repl(?:y|ies)|respond|discussion|related|recommend(?:ed|ations?)?|share|sharing|social|follow|pagination|pager|toolbar|widget|tags?|search|form|copyright|legal|skip-?link|teaser|paywall|disclaimer)(?![a-z])"
)
#: Content paths score at least this share of the page's highest path.
THRESHOLD = 0.12
PRIOR_MAIN, PRIOR_NAMED = 20.0, 0.02
#: What a path loses whose text is all links.
LINKED = 0.95
#: A container is gone into if it holds this share of what its parent's content scores.
MOST = 0.6


@dataclass
class Node:
    """A piece of text, its path's number, its container's number, its block's."""

    text: str
    path: int
    box: int
    block: int
    linked: bool


@dataclass
class Box:
    """A container: the one around it, whether article or main is around it or it is one, whether its name is boilerplate's."""

    parent: int
    main: bool
    named: bool
    heading: bool = False


@dataclass
class Page:
    nodes: list[Node]
    boxes: list[Box]
    paths: list[tuple[int, str]]  # the path above and the last element
    priors: list[float]

    def path(self, k: int) -> str:
        names: list[str] = []
        while k:
            k, name = self.paths[k]
            names.append(name)
        return "/".join(reversed(names))


@dataclass
class Open:
    name: str
    dropped: bool
    path: int
    box: int
    linked: bool


def _attributes(raw: str) -> tuple[str, bool, bool]:
    """First class or id, whether it or another of them names boilerplate, whether the element isn't content by role or style."""
    label, named, hidden = "", False, False
    for m in ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key in ("class", "id"):
            label = label or (value.split() or [""])[0]
            named = named or bool(BOILERPLATE.search(value.replace("_", "-")))
        hidden = hidden or key == "hidden" or (key == "role" and value.strip() in ROLES) or (key == "aria-hidden" and value == "true") or (key == "style" and bool(INVISIBLE.search(value)))
    return label, named, hidden


class Tags:
    """Tags of a page in order: start, end, name (with / for an end tag), attributes. Comments have an empty name."""

    def __init__(self, html: str):
        self.html, self.quoted = html, True

    def end_of(self, at: int) -> int:
        """Of the tag whose attributes begin at `at`, the place of its >; quotes hold it back while they still pair up."""
        start = at
        while self.quoted and (m := STOP.search(self.html, at)):
            if m[0] == ">":
                return m.start()
            close = self.html.find(m[0], m.end())
            if close < 0:
                break
            at = close + 1
        self.quoted = False  # a quote that never closes, or a tag that doesn't end: quotes mean nothing from here on
        return self.html.find(">", start)

    def after(self, at: int) -> tuple[int, int, str, str] | None:
        while (start := self.html.find("<", at)) >= 0:
            if m := NAME.match(self.html, start + 1):
                end = self.end_of(m.end())
                if end < 0:
                    return None
                return start, end + 1, m[0].lower(), self.html[m.end() : end]
            for opening, closing in (("<!--", "-->"), ("<![CDATA[", "]]>"), ("<!", ">"), ("<?", ">")):
                if self.html.startswith(opening, start):
                    end = self.html.find(closing, start + len(opening))
                    return start, len(self.html) if end < 0 else end + len(closing), "", ""
            at = start + 1
        return None


class Parser:
    """Reads a page once; every step costs what it opens or closes."""

    def __init__(self):
        self.page = Page([], [Box(-1, False, False)], [(0, "")], [1.0])
        self.known: dict[tuple[int, str], int] = {}
        self.stack: list[Open] = []
        self.places: dict[str, list[int]] = {}  # of open elements by name
        self.blocks: list[int] = []  # places of open blocks
        self.block = 0

    def pop_to(self, depth: int) -> None:
        while len(self.stack) > depth:
            self.places[self.stack.pop().name].pop()
        while self.blocks and self.blocks[-1] >= depth:
            self.blocks.pop()

    def nearest(self, names: set[str] | frozenset[str] | tuple[str, ...]) -> int:
        return max((p[-1] for n in names if (p := self.places.get(n))), default=-1)

    def text(self, raw: str) -> None:
        top = self.stack[-1] if self.stack else Open("", False, 0, 0, False)
        if raw and not top.dropped:
            self.page.nodes.append(Node(unescape(raw) if "&" in raw else raw, top.path, top.box, self.block, top.linked))

    def close(self, name: str) -> None:
        at = self.nearest((name,))
        # an inline end tag doesn't end the blocks around it
        if at >= 0 and not (name in INLINE and self.blocks and self.blocks[-1] > at):
            self.pop_to(at)

    def make_room(self, name: str) -> None:
        """Ends what an element of this name ends implicitly."""
        if name in CLOSES_P and self.blocks and self.stack[self.blocks[-1]].name == "p":
            self.pop_to(self.blocks[-1])
        if name in ENDS:
            ended, bound = ENDS[name]
            while (at := self.nearest(ended)) > self.nearest(bound):
                self.pop_to(at)
                if name != "tr":
                    break
        if name == "body":
            self.pop_to(1 if self.stack and self.stack[0].name == "html" else 0)

    def open(self, name: str, raw: str) -> None:
        label, named, hidden = _attributes(raw) if raw.strip() else ("", False, False)
        above = self.stack[-1] if self.stack else Open("", False, 0, 0, False)
        page, around = self.page, self.page.boxes[above.box]
        main = name in MAIN
        # a header inside the article holds its title; one above it is the site's
        dropped = above.dropped or hidden or name in DROPPED or (name == "header" and not around.main)
        named = named and name not in ("html", "body") and not (around.main and (name in BLOCK and name not in CONTAINERS and name not in ("ul", "ol", "dl", "table")))
        if main:
            named = bool(BOILERPLATE.fullmatch(label))
        path, box = above.path, above.box
        if name not in INLINE or named:
            key = (above.path, f"{name}.{label}" if label else name)
            if key not in self.known:
                self.known[key] = len(page.paths)
                page.paths.append(key)
                prior = page.priors[above.path]
                prior *= PRIOR_MAIN if main and not around.main else 1.0
                page.priors.append(prior * PRIOR_NAMED if named and not around.named else prior)
            path = self.known[key]
        if name in CONTAINERS or named:
            box = len(page.boxes)
            page.boxes.append(Box(above.box, around.main or main, around.named or named))
        elif name in HEADINGS and not dropped:
            around.heading = True
        self.places.setdefault(name, []).append(len(self.stack))
        if name in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append(Open(name, dropped, path, box, above.linked or name == "a"))

    def read(self, html: str) -> Page:
        tags, at = Tags(html), 0
        while found := tags.after(at):
            start, end, name, raw = found
            self.text(html[at:start])
            at = end
            if not name:
                continue
            if name.lstrip("/") in BLOCK:
                self.block += 1
            if name[0] == "/":
                self.close(name[1:])
            elif name in RAW:
                close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
                at = close.end() if close else len(html)
            elif name not in VOID:
                self.make_room(name)
                if not (raw.endswith("/") and name not in BLOCK and name not in INLINE):
                    self.open(name, raw)
        self.text(html[at:])
        return self.page


def parse(html: str) -> Page:
    return Parser().read(html)


def _smoothed(order: list[int], ratio: dict[int, float]) -> dict[int, float]:
    """Each path's ratio, averaged over its nodes with what stands before and after them."""
    total, count = dict.fromkeys(ratio, 0.0), dict.fromkeys(ratio, 0)
    for before, path, after in zip([order[0], *order], order, [*order[1:], order[-1]], strict=False):
        total[path] += (ratio[before] + 2 * ratio[path] + ratio[after]) / 4
        count[path] += 1
    return {p: total[p] / count[p] for p in ratio}


def path_scores(page: Page) -> dict[int, float]:
    """The fused score of each path that holds text."""
    sums: dict[int, list[int]] = {}
    order: list[int] = []
    for node in page.nodes:
        if text := node.text.strip():
            order.append(node.path)
            total = sums.setdefault(node.path, [0, 0, 0, 0])
            for k, more in enumerate((len(text), len(PUNCTUATION.findall(text)), 1, len(text) * node.linked)):
                total[k] += more
    if not order:
        return {}
    texts = _smoothed(order, {p: length / n for p, (length, _, n, _) in sums.items()})
    marks = _smoothed(order, {p: m / n for p, (_, m, n, _) in sums.items()})
    return {p: texts[p] * (0.5 + marks[p]) * (1 - LINKED * linked / length) * page.priors[p] for p, (length, _, _, linked) in sums.items()}


def content_nodes(page: Page) -> list[Node]:
    scores = path_scores(page)
    limit = THRESHOLD * max(scores.values(), default=0.0)
    if not limit:
        return []
    boxes = page.boxes
    held = [0.0] * len(boxes)
    for n in page.nodes:
        if n.text.strip() and scores[n.path] >= limit:
            held[n.box] += scores[n.path]
    inner: list[list[int]] = [[] for _ in boxes]
    for k in range(len(boxes) - 1, 0, -1):  # a container is numbered after the one around it
        held[boxes[k].parent] += held[k]
        inner[boxes[k].parent].append(k)
    at = 0
    while inner[at] and not (boxes[at].main or (boxes[at].heading and boxes[at].parent > 0)):
        most = max(reversed(inner[at]), key=held.__getitem__)
        if held[most] < MOST * held[at]:
            break
        at = most
    inside = [False] * len(boxes)
    inside[at] = True
    for k in range(at + 1, len(boxes)):
        inside[k] = inside[boxes[k].parent] and not (boxes[k].named and not boxes[at].named and held[k] < held[at] / 2) and (boxes[at].main or held[k] > 0)
    return [n for n in page.nodes if inside[n.box]]


def main_text(html: str | None) -> str:
    parts: list[str] = []
    last = None
    for n in content_nodes(parse(html or "")):
        if last is not None and n.block != last:
            parts.append(" ")
        parts.append(n.text)
        last = n.block
    return " ".join("".join(parts).split())


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(scan, "page_id long, url string, text string, n_chars long")


def path_table(pages: DataFrame) -> DataFrame:
    """page_id, path, length, score, content (whether text of this path is taken): the figures behind the choice."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for page_id, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page = parse(html or "")
                chosen = {n.path for n in content_nodes(page) if n.text.strip()}
                sizes: dict[int, int] = {}
                for n in page.nodes:
                    sizes[n.path] = sizes.get(n.path, 0) + len(n.text.strip())
                scores = path_scores(page)
                rows += [(page_id, page.path(p), size, scores[p], p in chosen) for p, size in sizes.items() if size]
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "path", "length", "score", "content"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("html").cast("string").alias("html")).mapInArrow(scan, "page_id long, path string, length long, score double, content boolean")
