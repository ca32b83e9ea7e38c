"""XLSX workbooks: a sheet for each page, typed cells, with the standard library."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame

from .docx import UNPRINTABLE, packed

# Name spaces, and number formats by style: integer, decimal, currency, percentage, date.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
FORMATS = {2: "0", 3: "0.00##########", 4: '"R$" #,##0.00', 5: "0.00%", 6: "dd/mm/yyyy"}
#: What a sheet holds, at most.
MAX_ROWS, MAX_COLUMNS, MAX_CELL = 1_048_576, 16_384, 32_767


def _letters(column: int) -> str:
    out = ""
    while column >= 0:
        column, digit = divmod(column, 26)
        out, column = chr(65 + digit) + out, column - 1
    return out


def _cell(row: int, column: int, text: str, value: float | None, style: float | None) -> str:
    place = f"{_letters(column)}{row}"
    if value is not None and value == value:
        return f'<c r="{place}" s="{int(style or 0)}"><v>{value!r}</v></c>'
    return f'<c r="{place}" t="inlineStr"><is><t xml:space="preserve">{escape(UNPRINTABLE.sub("", text or ""))}</t></is></c>'


def _styles() -> str:
    formats = "".join(f'<numFmt numFmtId="{160 + k}" formatCode={quoteattr(code)}/>' for k, code in FORMATS.items())
    looks = "".join(f'<xf numFmtId="{160 + k if k in FORMATS else 0}" fontId="0" fillId="0" borderId="0" applyNumberFormat="{int(k in FORMATS)}"/>' for k in range(max(FORMATS) + 1))
    plain = '<fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>'
    return f'<styleSheet xmlns="{MAIN}"><numFmts count="{len(FORMATS)}">{formats}</numFmts>{plain}<cellXfs count="{max(FORMATS) + 1}">{looks}</cellXfs></styleSheet>'


def workbook_bytes(sheets: dict[str, list[list[tuple[str, float | None, float | None]]]]) -> bytes:
    """sheets: rows of cells (text, value, style) by name; a cell with a value is a number."""
    kinds = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
    base = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    kinds += f'<Override PartName="/xl/workbook.xml" ContentType="{base}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{base}.styles+xml"/>'
    listed = links = ""
    parts: dict[str, str] = {}
    for k, (name, rows) in enumerate(sheets.items(), 1):
        if len(rows) > MAX_ROWS or any(len(r) > MAX_COLUMNS or any(len(c[0] or "") > MAX_CELL for c in r) for r in rows):
            raise ValueError("more than a sheet holds")
        kinds += f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{base}.worksheet+xml"/>'
        listed += f'<sheet name={quoteattr(name[:31])} sheetId="{k}" r:id="rId{k}"/>'
        links += f'<Relationship Id="rId{k}" Type="{OFFICE}/worksheet" Target="worksheets/sheet{k}.xml"/>'
        lines = "".join(f'<row r="{n}">' + "".join(_cell(n, c, *cell) for c, cell in enumerate(row)) + "</row>" for n, row in enumerate(rows, 1))
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{MAIN}"><sheetData>{lines}</sheetData></worksheet>'
    links += f'<Relationship Id="rId0" Type="{OFFICE}/styles" Target="styles.xml"/>'
    head = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types">{kinds}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">{links}</Relationships>',
        "xl/styles.xml": _styles(),
    }
    return packed(head | parts)


def write_workbooks(cells: DataFrame) -> DataFrame:
    """doc_id, content, error from typed cells (doc_id, page, row, column, text, value, style); a group is one document's tables."""

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["page", "row", "column"])
        sheets = {}
        for page, part in frame.groupby("page"):
            numbers = lambda series: [None if pd.isna(x) else float(x) for x in series]
            sheets[f"Page {page}"] = [list(zip(row["text"], numbers(row["value"]), numbers(row["style"]), strict=True)) for _, row in part.groupby("row")]
        try:
            return pd.DataFrame([(frame["doc_id"].iloc[0], workbook_bytes(sheets), None)], columns=["doc_id", "content", "error"])
        except ValueError as problem:
            return pd.DataFrame([(frame["doc_id"].iloc[0], None, str(problem))], columns=["doc_id", "content", "error"])

    return cells.select("doc_id", "page", "row", "column", "text", "value", "style").groupBy("doc_id").applyInPandas(build, "doc_id long, content binary, error string")


def read_workbooks(books: DataFrame) -> DataFrame:
    """doc_id, sheet (from 1), row (from 1), cell, number, text of what write_workbooks made."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, content in zip(frame["doc_id"], frame["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if n.startswith("xl/worksheets/")]
                    for k in range(1, len(names) + 1):
                        for c in ElementTree.fromstring(archive.read(f"xl/worksheets/sheet{k}.xml")).iter(f"{{{MAIN}}}c"):
                            place = c.get("r")
                            number, text = c.find(f"{{{MAIN}}}v"), c.find(f"{{{MAIN}}}is/{{{MAIN}}}t")
                            out.append((doc_id, k, int(place.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ")), place, float(number.text) if number is not None else None, (text.text or "") if text is not None else None))
            yield pd.DataFrame(out, columns=["doc_id", "sheet", "row", "cell", "number", "text"])

    return books.select("doc_id", "content").mapInPandas(scan, "doc_id long, sheet int, row int, cell string, number double, text string")
