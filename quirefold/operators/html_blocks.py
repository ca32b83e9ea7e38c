"""HTML pages as typed blocks, and removal of what must not be rendered."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.css import clean_css, is_safe_image, rewritten, unreferenced
from ..functions.lambdas import bound
from ..functions.slices import map_slices
from ..functions.text import clean_html_text

# Elements that are dropped with their content, and those blocked by the sanitizer.
STRIPPED = ("head", "style", "script", "noscript", "iframe", "object", "embed")
BLOCKED = ("script", "iframe", "object", "embed", "applet", "form", "input", "button", "textarea", "select", "meta", "link", "base", "frame", "frameset", "audio", "video", "source", "track", "portal")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


def page_title(html: Column) -> Column:
    """The title element's text, cleaned; null without one."""
    found = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    return F.when(found != "", clean_html_text(found))


def without_stripped(html: Column) -> Column:
    out = html
    for name in STRIPPED:
        out = F.regexp_replace(out, rf"(?is)<{name}\b[^>]*>.*?</{name}>", "")
    return F.regexp_replace(out, r"(?i)<!DOCTYPE[^>]*>", "")


def element_count(html: Column, names: tuple[str, ...] = BLOCKED) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<(?:{'|'.join(names)})[\s/>]"))


# Fixed values of the sanitizer: elements that go with their content, elements that go as tags, attributes that go, and
# attributes that may hold an image or a place in the page.
UNSAFE_CONTENT = ("script", "noscript", "iframe", "object", "frameset", "portal", "audio", "video")
UNSAFE_TAGS = (*UNSAFE_CONTENT, "embed", "link", "meta", "base", "frame", "source", "track")
UNSAFE_ATTRIBUTES = ("srcdoc", "formaction", "action", "poster", "ping", "dynsrc", "lowsrc", "srcset", "data")
IMAGE_ATTRIBUTES = ("src", "background")
PLACE_ATTRIBUTES = ("href", "xlink:href")
UNTITLED = "Documento"

_NAME, _VALUE = r"""[^\s"'<>/=]+""", r"""(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)"""
#: An attribute of a tag: its name, and its value in quotes or not.
ATTRIBUTE = rf"[\s/]+({_NAME})(?:\s*=\s*({_VALUE}))?"
#: Comments, end tags (what never ends goes on to the end) and well-formed start tags; loops are possessive, so time is
#: linear. A "<" that begins none of them is text.
MARKUP = rf"(?s)<!--.*?(?:-->|\z)|</[A-Za-z][^>]*(?:>|\z)|<[A-Za-z][^\s/>]*+(?:[\s/]++{_NAME}+(?:\s*+=\s*+{_VALUE.replace('?:', '?>', 1)})?+)*+[\s/]*+>"


def _clean_attribute(name: Column, raw: Column) -> Column:
    """The attribute as it is written again; null if it goes."""

    def kept(value: Column) -> Column:
        return (
            F.when(F.startswith(name, F.lit("on")) | name.isin(*UNSAFE_ATTRIBUTES), F.lit(None).cast("string"))
            .when(name == "style", bound(clean_css(value), lambda css: F.when(css.rlike(r"\S"), css)))
            .when(name.isin(*IMAGE_ATTRIBUTES), F.when(is_safe_image(value), value))
            .when(name.isin(*PLACE_ATTRIBUTES), F.when(value.rlike(r"(?U)^\s*#"), value))
            .otherwise(value)
        )

    value = bound(unreferenced(F.when(raw.rlike("^[\"']"), F.substring(raw, 2, F.length(raw) - 2)).otherwise(raw)), kept)
    return F.concat(F.lit(" "), name, F.lit('="'), F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit('"'))


def _attributes(inside: Column) -> Column:
    found = lambda group: F.regexp_extract_all(inside, F.lit(ATTRIBUTE), F.lit(group))
    kept = F.array_compact(F.zip_with(F.transform(found(1), F.lower), found(2), _clean_attribute))
    return F.when(inside.rlike(r"[^\s/]"), F.array_join(kept, "")).otherwise("")


def _clean_tag(tag: Column) -> Column:
    """A start tag with what may stay of its attributes, an end tag by its name; nothing for comments and unsafe elements.

    Comments go because readers disagree where they end, unsafe names once more because removal can join what stood apart.
    """

    def written(name: Column) -> Column:
        inside = F.substring(tag, F.length(name) + 2, F.length(tag) - F.length(name) - 2)
        start = F.concat(F.lit("<"), name, bound(inside, _attributes), F.lit(">"))
        whole = F.when(F.startswith(tag, F.lit("</")), F.concat(F.lit("</"), name, F.lit(">"))).otherwise(start)
        return F.when((name == "") | name.isin(*UNSAFE_TAGS, "style", "title"), "").otherwise(whole)

    return bound(F.lower(F.regexp_extract(tag, r"^</?([A-Za-z][^\s/>]*)", 1)), written)


def clean_markup(html: Column) -> Column:
    """Each start tag with its safe attributes; a "<" outside markup that could begin a tag becomes a reference."""
    return rewritten(html, MARKUP, 0, _clean_tag, lambda text: F.regexp_replace(text, "<(?=[A-Za-z/!?])", "&lt;"))


def without_elements(html: Column, content: tuple[str, ...] = UNSAFE_CONTENT, tags: tuple[str, ...] = UNSAFE_TAGS) -> Column:
    out = F.regexp_replace(html, rf"(?is)<({'|'.join(content)})\b[^>]*(?:>.*?(?:</\1\s*>|\z)|\z)", "")
    return F.regexp_replace(out, rf"(?i)</?(?:{'|'.join(tags)})\b[^>]*(?:>|\z)", "")


def style_sheets(html: Column) -> Column:
    """The cleaned contents of all style elements, one after the other."""
    sheets = F.transform(F.regexp_extract_all(html, F.lit(r"(?is)<style\b[^>]*>(.*?)(?:</style\s*>|\z)"), F.lit(1)), clean_css)
    return F.array_join(F.filter(sheets, lambda s: s.rlike(r"\S")), "\n")


def _body(safe: Column) -> Column:
    """The body's clean markup; a page without a body element is a body."""

    def inner(out: Column) -> Column:
        body = F.regexp_extract(out, r"(?is)<body\b[^>]*>(.*?)(?:</body\s*>|\z)", 1)
        bare = F.regexp_replace(out, r"(?i)</?(?:html|head|body)\b[^>]*>|<!DOCTYPE[^>]*>", "")
        return clean_markup(F.when(out.rlike(r"(?i)<body\b[^>]*>"), body).otherwise(bare))

    return bound(F.regexp_replace(safe, r"(?is)<(style|title)\b[^>]*>.*?(?:</\1\s*>|\z)", ""), inner)


def sanitized(html: Column) -> Column:
    """The body's markup without unsafe elements, attributes and addresses, and without forms."""
    return _body(without_elements(html, (*UNSAFE_CONTENT, "applet", "form", "textarea", "select", "button"), (*UNSAFE_TAGS, *BLOCKED)))


def sanitized_document(html: Column) -> Column:
    """A struct of title, style_css, body_html and the body's own style, class, dir and lang."""

    def fields(safe: Column) -> Column:
        own = lambda body, name: clean_html_text(F.regexp_extract(body, rf' {name}="([^"]*)"', 1)).alias(f"body_{name}")
        body = _clean_tag(F.regexp_extract(safe, r"(?is)<body\b[^>]*>", 0))
        return bound(
            body,
            lambda b: F.struct(
                F.coalesce(F.nullif(page_title(html), F.lit("")), F.lit(UNTITLED)).alias("title"),
                style_sheets(safe).alias("style_css"),
                _body(safe).alias("body_html"),
                *(own(b, name) for name in ("style", "class", "dir", "lang")),
            ),
        )

    return bound(without_elements(html), fields)


class _Blocks(HTMLParser):
    """Headings, paragraphs, list items, tables, quotes, preformatted text and rules, in order."""

    LEAVES = {*HEADINGS, "p", "blockquote", "pre", "li"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[tuple[str, int, str, bool]] = []
        self.skip = 0
        self.kind: str | None = None
        self.text: list[str] = []
        self.lists: list[list] = []
        self.row: list[str] | None = None
        self.heads = False
        self.loose: list[str] = []

    def close_block(self) -> None:
        text = "".join(self.text)
        text = text.strip("\n") if self.kind == "pre" else " ".join(text.split())
        if self.kind and text:
            level = int(self.kind[1]) if self.kind in HEADINGS else len(self.lists) if self.kind == "li" else 0
            if self.kind == "li" and self.lists:
                ordered, number = self.lists[-1]
                text = f"{number}. {text}" if ordered else f"• {text}"
            name = {"p": "paragraph", "blockquote": "quote", "pre": "preformatted", "li": "item"}.get(self.kind, "heading")
            self.out.append((name, level, text, False))
        self.kind, self.text = None, []

    def handle_starttag(self, tag: str, attributes) -> None:
        if tag in STRIPPED:
            self.skip += tag != "embed"
        elif self.skip:
            return
        elif tag in ("ul", "ol"):
            self.close_block()
            self.lists.append([tag == "ol", 0])
        elif tag == "tr":
            self.close_block()
            self.row, self.heads = [], False
        elif tag in ("td", "th"):
            self.heads |= tag == "th"
            if self.row is not None:
                self.row.append("")
        elif tag == "hr":
            self.close_block()
            self.out.append(("rule", 0, "", False))
        elif tag == "br":
            self.text.append("\n" if self.kind == "pre" else " ")
        elif tag in self.LEAVES and self.row is None:
            self.close_block()
            if tag == "li" and self.lists:
                self.lists[-1][1] += 1
            self.kind = tag

    def handle_endtag(self, tag: str) -> None:
        if tag in STRIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag == self.kind:
            self.close_block()
        elif tag in ("ul", "ol") and self.lists:
            self.close_block()
            self.lists.pop()
        elif tag == "tr" and self.row is not None:
            cells = [" ".join(c.split()) for c in self.row]
            if any(cells):
                self.out.append(("row", 0, "\t".join(cells), self.heads))
            self.row = None

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        if self.row is not None:
            if self.row:
                self.row[-1] += data
        elif self.kind:
            self.text.append(data)
        else:
            self.loose.append(data)


def html_blocks(html: str | None) -> list[tuple[str, int, str, bool]]:
    """kind, level, text, header row; plain text becomes one paragraph where no block is found."""
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    loose = " ".join("".join(parser.loose).split())
    return parser.out or ([("paragraph", 0, loose, False)] if loose else [])


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, seq, kind, level, text, header."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, k, *b) for p, html in zip(frame["page_id"], frame["html"], strict=True) for k, b in enumerate(html_blocks(html))]
            yield pd.DataFrame(rows, columns=["page_id", "seq", "kind", "level", "text", "header"])

    return map_slices(pages.select(F.col("page_id").cast("long").alias("page_id"), "html"), scan, "page_id long, seq int, kind string, level int, text string, header boolean")
