"""DOCX files with the standard library: safe opening, text, structure."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame

from ..functions.slices import map_slices

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
MAX_FILES, MAX_BYTES, MAX_RATIO = 2000, 64 << 20, 100


def document_xml(content: bytes, member: str = "word/document.xml") -> ElementTree.Element:
    """The parsed part; refuses bombs, odd paths and documents that declare a DOCTYPE or entities."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        infos = archive.infolist()
        total = sum(i.file_size for i in infos)
        if len(infos) > MAX_FILES or total > MAX_BYTES or total > MAX_RATIO * max(1, len(content)):
            raise ValueError("archive too large")
        if any(i.filename.startswith("/") or ".." in i.filename.split("/") for i in infos):
            raise ValueError("unsafe path")
        raw = archive.read(member)
    if re.search(rb"<!(?:DOCTYPE|ENTITY)", raw, re.I):
        raise ValueError("DOCTYPE or ENTITY")
    return ElementTree.fromstring(raw)


def _run_text(node: ElementTree.Element) -> str:
    out = []
    for x in node.iter():
        if x.tag == W + "t":
            out.append(x.text or "")
        elif x.tag == W + "tab":
            out.append("\t")
        elif x.tag in (W + "br", W + "cr"):
            out.append("\n")
    return "".join(out)


def _table(node: ElementTree.Element) -> list[list[str]]:
    return [["\n".join(_run_text(p) for p in cell.iter(W + "p")) for cell in row.findall(W + "tc")] for row in node.findall(W + "tr")]


def docx_text(content: bytes) -> str:
    """Paragraphs by line; cells of a row separated by tabs."""
    lines: list[str] = []
    body = document_xml(content).find(W + "body")
    for node in body if body is not None else ():
        if node.tag == W + "p":
            lines.append(_run_text(node))
        elif node.tag == W + "tbl":
            lines += ["\t".join(row) for row in _table(node)]
    return "\n".join(lines)


def docx_structure(content: bytes) -> tuple[list[tuple[str, str]], list[list[list[str]]]]:
    """Paragraphs with their style, and tables."""
    body = document_xml(content).find(W + "body")
    paragraphs = []
    for p in body.findall(W + "p") if body is not None else ():
        style = p.find(f"{W}pPr/{W}pStyle")
        paragraphs.append((_run_text(p), style.get(W + "val") if style is not None else "Normal"))
    return paragraphs, [_table(t) for t in (body.findall(W + "tbl") if body is not None else ())]


def read_docx(files: DataFrame) -> DataFrame:
    """path, text, paragraphs, tables, error from path and content."""
    schema = "path string, text string, paragraphs array<struct<text: string, style: string>>, tables array<array<array<string>>>, error string"

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                try:
                    paragraphs, tables = docx_structure(bytes(content))
                    rows.append((path, docx_text(bytes(content)), [{"text": t, "style": s} for t, s in paragraphs], tables, None))
                except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as problem:
                    rows.append((path, None, None, None, str(problem)))
            yield pd.DataFrame(rows, columns=["path", "text", "paragraphs", "tables", "error"])

    return map_slices(files.select("path", "content"), scan, schema)


def table_shape_error(rows: list[list[str]]) -> str | None:
    """A table to be written must have rows of one width."""
    return None if rows and len({len(r) for r in rows}) == 1 else "ragged or empty table"


# The parts that a document must have, and what of a text XML can't hold.
DOCX_PARTS = {
    "[Content_Types].xml": '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
    "_rels/.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
}
STYLES = ("Normal", "Title", "Heading1", "Heading2", "Heading3", "ListBullet", "ListNumber", "Quote")
UNPRINTABLE = re.compile("[^\t\n\r\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")


def packed(parts: dict[str, str]) -> bytes:
    """XML parts as a package whose bytes depend on nothing but them."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, xml in parts.items():
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + xml, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _paragraph(text: str, style: str | None = None) -> str:
    """Line feeds become breaks and tabs tab marks, so reading gives the text back."""
    marks = {"\n": "<w:br/>", "\t": "<w:tab/>"}
    pieces = (marks.get(x) or f'<w:t xml:space="preserve">{escape(x)}</w:t>' for x in re.split("([\n\t])", UNPRINTABLE.sub("", text.replace("\r\n", "\n").replace("\r", "\n"))) if x)
    look = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style and style != "Normal" else ""
    return f"<w:p>{look}<w:r>{''.join(pieces)}</w:r></w:p>"


def docx_bytes(paragraphs: list[tuple[str, str | None]], tables: list[list[list[str]]]) -> bytes:
    """A document of paragraphs (text, style), then tables."""
    for rows in tables:
        if problem := table_shape_error(rows):
            raise ValueError(problem)
    if odd := {s for _, s in paragraphs if s} - set(STYLES):
        raise ValueError(f"unknown style {min(odd)}")
    body = "".join(_paragraph(t or "", s) for t, s in paragraphs)
    for rows in tables:
        body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{_paragraph(c or '')}</w:tc>" for c in row) + "</w:tr>" for row in rows) + "</w:tbl>"
    return packed(DOCX_PARTS | {"word/document.xml": f'<w:document xmlns:w="{W[1:-1]}"><w:body>{body}</w:body></w:document>'})


def write_docx(docs: DataFrame) -> DataFrame:
    """doc_id, content, error from doc_id, paragraphs (text, style) and tables (rows of cells)."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, paragraphs, tables in zip(frame["doc_id"], frame["paragraphs"], frame["tables"], strict=True):
                try:
                    given = [] if paragraphs is None else [(p["text"], p["style"]) for p in paragraphs]
                    rows.append((doc_id, docx_bytes(given, [] if tables is None else [[list(r) for r in t] for t in tables]), None))
                except ValueError as problem:
                    rows.append((doc_id, None, str(problem)))
            yield pd.DataFrame(rows, columns=["doc_id", "content", "error"])

    return map_slices(docs.select("doc_id", "paragraphs", "tables"), scan, "doc_id long, content binary, error string")
