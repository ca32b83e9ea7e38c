"""Flowing text from positioned fragments."""

from quirefold.operators import rebuild

SCHEMA = "doc_id long, page int, x double, y double, width double, font_size double, font_name string, str string, page_width double"


def frag(x, y, text, size=10.0, width=None, font="Regular", page=1):
    return (1, page, float(x), float(y), float(len(text) * 5 if width is None else width), size, font, text, 600.0)


def blocks(spark, rows):
    return rebuild.rebuilt_blocks(spark.createDataFrame(rows, SCHEMA)).orderBy("page", "seq").collect()


def test_headings_lists_and_paragraphs(spark):
    rows = [frag(20, 20, "Big title", 20.0), frag(20, 60, "First line of"), frag(20, 74, "one paragraph,"), frag(95, 74, "here"), frag(20, 110, "Another one.")]
    rows += [frag(20, 130, "• bullet"), frag(20, 144, "1. one"), frag(20, 158, "2) two"), frag(20, 172, "plain"), frag(20, 186, "3. three"), frag(20, 210, "Small head", 11.5, font="X-Bold"), frag(20, 240, " ")]
    got = [(b.kind, b.level, b.list, b.text) for b in blocks(spark, rows)]
    assert got == [
        ("heading", 1, None, "Big title"), ("paragraph", None, None, "First line of one paragraph, here"), ("paragraph", None, None, "Another one."), ("bullet", None, None, "bullet"),
        ("numbered", None, 1, "one"), ("numbered", None, 1, "two"), ("paragraph", None, None, "plain"), ("numbered", None, 2, "three"), ("heading", 3, None, "Small head"),
    ]


def test_runs_follow_styles_and_marks(spark):
    rows = [frag(20, 20, "one"), frag(40, 21, "two", font="Arial-BoldItalic"), frag(60, 20, "three", font="Heavy Oblique"), frag(90, 20, ", four"), frag(125, 20, "five ", font="Black"), frag(155, 20, "six", font="Black")]
    (b,) = blocks(spark, rows)
    assert [(r.text, r.bold, r.italic) for r in b.runs] == [("one", False, False), (" two three", True, True), (", four", False, False), (" five six", True, False)]
    assert b.text == "one two three, four five six"


def test_tables_of_aligned_cells(spark):
    rows = [frag(x, 20 + 15 * r, t) for r, ts in enumerate((("Name", "City", "Age"), ("Ana", "Rio", "30"), ("Bob", "", "41"))) for x, t in zip((20, 120, 220), ts) if t]
    rows += [frag(20, 200, "left"), frag(150, 200, "right"), frag(20, 300, "after")]
    got = [(b.kind, b.text, b.rows) for b in blocks(spark, rows)]
    assert got == [("table", None, [["Name", "City", "Age"], ["Ana", "Rio", "30"], ["Bob", "", "41"]]), ("paragraph", "left right", None), ("paragraph", "after", None)]


def test_columns_are_read_one_after_the_other(spark):
    words = lambda side, r: f"{side}{r} has some words in it"
    rows = [frag(50, 10, "A title that goes over the middle of the page for sure", width=500)]
    rows += [frag(x, 40 + 14 * r, words(side, r), width=220) for r in range(4) for side, x in (("L", 40), ("R", 330))]
    got = [(b.kind, b.text) for b in blocks(spark, rows)]
    assert got[0] == ("paragraph", "A title that goes over the middle of the page for sure")
    assert [t for _, t in got[1:]] == [" ".join(words(s, r) for r in range(4)) for s in "LR"]
    # a gutter beside the middle
    rows = [frag(x, 40 + 14 * r, words(side, r), width=w) for r in range(4) for side, x, w in (("L", 40, 270), ("R", 340, 220))]
    assert [b.text for b in blocks(spark, rows)] == [" ".join(words(s, r) for r in range(4)) for s in "LR"]


def test_no_python_in_the_plan_and_empty_table(spark):
    df = rebuild.rebuilt_blocks(spark.createDataFrame([], SCHEMA))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.collect() == []


def test_lines_of_many_narrow_fragments_do_not_cross_the_page(spark):
    """A line's right edge is its fragments', however many there are."""
    rows = [frag(20 + 8 * k, 20 + 14 * r, "w", width=6) for r in range(3) for k in range(30)]
    assert [(b.kind, len(b.text.split())) for b in blocks(spark, rows)] == [("paragraph", 90)]


def test_the_gutter_is_found_once_in_a_band(spark):
    """In a filter it would be found anew for every fragment."""
    plan = rebuild.rebuilt_blocks(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert "0.65" in plan and not [line for line in plan.splitlines() if "Filter" in line and "0.65" in line]


def test_lines_of_a_page_are_made_once(spark):
    """One flow, dealt out once by document: no join of lines with lines, no second dealing."""
    groups = rebuild.reading_groups(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().optimizedPlan().toString()
    assert groups.count("posexplode(") == 1 and "Join" not in groups
