import pandas as pd

from quirefold.functions.slices import ROWS, map_slices
from quirefold.operators import extraction, html_blocks, review, segments
from quirefold.sources import docx


def test_python_holds_few_rows_at_a_time(spark):
    def sizes(frames):
        for f in frames:
            yield pd.DataFrame([(len(f), [{"a": "x"}], None)], columns=["n", "parts", "error"])

    got = map_slices(spark.range(0, 1000, 1, 1), sizes, "n long, parts array<struct<a: string>>, error string").collect()
    assert max(r.n for r in got) == ROWS and sum(r.n for r in got) == 1000 and got[0].parts[0].a == "x" and got[0].error is None


def reads_slices(frame):
    plan = frame._jdf.queryExecution().toString()
    return "MapInArrow" in plan and "MapInPandas" not in plan


def test_files_are_read_and_written_by_slices(spark):
    docs = spark.sql("SELECT 1L AS doc_id, array(named_struct('text', 'a', 'style', 'Normal')) AS paragraphs, array(array(array('b'))) AS tables")
    written = docx.write_docx(docs)
    read = docx.read_docx(written.selectExpr("'p' AS path", "content"))
    assert reads_slices(written) and reads_slices(read)
    assert [r.text for r in read.collect()] == ["a\nb"]


def test_pages_are_read_by_slices(spark):
    blocks = html_blocks.page_blocks(spark.sql("SELECT 1L AS page_id, '<p>x</p>' AS html"))
    assert reads_slices(blocks) and [r.text for r in blocks.collect()] == ["x"]


def test_texts_are_read_by_slices(spark):
    docs = spark.createDataFrame([(1, "# A\n| a |\n|---|\n| 1 |")], "doc_id long, text string")
    assert all(map(reads_slices, (extraction.extract_sections(docs), extraction.extract_tables(docs), review.review(docs), segments.translation_segments(docs))))
