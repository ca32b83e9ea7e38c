"""DOCX and XLSX files: what is written is read again, and what can't be written is an error of its row."""

import io
import zipfile
from xml.etree import ElementTree

from quirefold.sources.docx import docx_bytes, docx_structure, docx_text, write_docx
from quirefold.sources.workbooks import _letters, workbook_bytes


def test_docx_comes_back():
    content = docx_bytes([("A <title> & more", "Title"), ("two\nlines\tand a tab  ", None), ("", None), ("bell\x07", None)], [[["a", "b"], ["c\nd", ""]]])
    assert docx_structure(content) == ([("A <title> & more", "Title"), ("two\nlines\tand a tab  ", "Normal"), ("", "Normal"), ("bell", "Normal")], [[["a", "b"], ["c\nd", ""]]])
    assert docx_text(content).startswith("A <title> & more\ntwo\nlines")
    assert docx_bytes([("x", None)], []) == docx_bytes([("x", None)], [])


def test_docx_errors_stay_in_their_row(spark):
    schema = "doc_id long, paragraphs array<struct<text: string, style: string>>, tables array<array<array<string>>>"
    rows = [(1, [("x", None)], None), (2, None, [[["a"], ["b", "c"]]]), (3, [("x", "Fancy")], []), (4, [(None, "Quote")], [])]
    got = {r["doc_id"]: r for r in write_docx(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["error"] is None and got[4]["error"] is None
    assert got[2]["content"] is None and "ragged" in got[2]["error"] and "Fancy" in got[3]["error"]


def test_workbook_parts():
    content = workbook_bytes({"One & two": [[("R$ 1,5", 1.5, 4.0), ("<b>", None, None)]], "Empty": []})
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        parts = {n: ElementTree.fromstring(archive.read(n)) for n in archive.namelist()}
    names = [x.get("name") for x in parts["xl/workbook.xml"].iter() if x.tag.endswith("}sheet")]
    assert names == ["One & two", "Empty"] and len([n for n in parts if "worksheets" in n]) == 2
    cells = [x for x in parts["xl/worksheets/sheet1.xml"].iter() if x.tag.endswith("}c")]
    assert [(c.get("r"), c.get("s"), "".join(c.itertext())) for c in cells] == [("A1", "4", "1.5"), ("B1", None, "<b>")]
    assert [_letters(k) for k in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
