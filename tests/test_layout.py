"""Lines, cells, tables, reading order and Markdown of positioned text."""

import random

import pytest
from pyspark.sql import functions as F

from quirefold.operators import layout

SCHEMA = "doc_id long, page int, x double, y double, width double, height double, font_size double, bold boolean, str string, page_width double"


def item(x, y, text, size=10.0, width=40.0, bold=False, page=1):
    return (1, page, float(x), float(y), float(width), size, size, bold, text, 600.0)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def tables(spark, rows, separators=None):
    return [r.cells for r in layout.page_tables(frame(spark, rows), separators).orderBy("page", "row").collect()]


def markdown(spark, rows, mode="auto"):
    return [r.markdown for r in layout.pages_to_markdown(frame(spark, rows), mode).orderBy("page").collect()]


def test_tables_by_gaps_and_separators(spark):
    items = [item(c * 150, r * 20, f"{r}{c}") for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    assert tables(spark, items) == [["00", "01", "02"], ["10", "", "12"], ["20", "21", "22"]]
    assert tables(spark, items, [100.0, 250.0]) == [["00", "01", "02"], ["10", "", "12"], ["20", "21", "22"]]
    assert tables(spark, [item(0, 0, "a", width=10), item(12, 0, "b", width=10)]) == [["a b"]]
    assert tables(spark, []) == []
    cut = layout.page_tables(frame(spark, items), [160.0]).collect()
    assert [(r.row, r.cells, r.error) for r in cut] == [(0, [], "a separator cuts text")]


def test_cells_without_boundaries_take_the_nearest_column(spark):
    """A line of text across all gaps leaves no boundary; rows follow the first of the widest ones."""
    rows = [item(0, 0, "a", width=30), item(60, 0, "b", width=30), item(120, 0, "c", width=30), item(0, 20, "long", width=200), item(62, 40, "x", width=20), item(10, 60, "y", width=20), item(118, 60, "z", width=20)]
    assert tables(spark, rows) == [["a", "b", "c"], ["long", "", ""], ["", "x", ""], ["y", "", "z"]]


def test_reading_order_of_two_columns(spark):
    items = [item(x, 20 * r, f"{side}{r}", width=150) for r in range(4) for side, x in (("L", 20), ("R", 320))]
    parts = lambda rows, mode="auto": [(r.part, r.text) for r in layout.reading_order(frame(spark, rows), mode).orderBy("part", "line").collect()]
    assert parts(items) == [(1, "L0"), (1, "L1"), (1, "L2"), (1, "L3"), (2, "R0"), (2, "R1"), (2, "R2"), (2, "R3")]
    assert parts(items, "rows") == [(1, f"L{r} R{r}") for r in range(4)]
    title, short = item(100, -20, "Title", width=400), items[:4]
    assert parts([title, *items])[:2] == [(1, "Title"), (2, "L0")] and parts([title, *items])[-1] == (3, "R3")
    assert parts(short) == [(1, "L0 R0"), (1, "L1 R1")] and parts(short, "columns") == [(1, "L0"), (1, "L1"), (2, "R0"), (2, "R1")]
    across = item(250, 41, "x", width=100)
    assert [t for _, t in parts([*items, across], "columns")] == ["L0 R0", "L1 R1", "L2 xR2", "L3 R3"]


def test_markdown(spark):
    assert markdown(spark, [item(0, 0, "Title", 20.0), item(0, 40, "body one."), item(0, 60, "body two.")]) == ["# Title\n\nbody one.\n\nbody two."]
    assert markdown(spark, [item(100 * c, 20 * r, f"{r}{c}") for r in range(2) for c in range(2)]) == ["| 00 | 01 |\n| --- | --- |\n| 10 | 11 |"]
    rows = [item(0, 0, "- one"), item(0, 20, "• two*"), item(0, 40, "3. three"), item(0, 60, "a < b."), item(0, 80, "Bold", bold=True), item(0, 100, "---")]
    assert markdown(spark, rows) == ["- one\n\n- two\\*\n\n3. three\n\na &lt; b.\n\n### Bold\n\n\\-\\-\\-"]
    # the second table is too far below the first; a run of one line is no table; cells of dashes are escaped
    rows = [item(100 * c, y, t) for y, ts in ((0, "ab"), (20, ("-", "d")), (90, "ef"), (200, "gh"), (220, "ij")) for c, t in enumerate(ts)]
    assert markdown(spark, rows) == ["| a | b |\n| --- | --- |\n| \\- | d |\n\ne f\n\n| g | h |\n| --- | --- |\n| i | j |"]


def test_base_size_is_the_documents(spark):
    rows = [item(0, 0, "Big.", 20.0), item(0, 30, "Head", 20.0)] + [item(0, 20 * k, "x.", page=2) for k in range(3)]
    assert markdown(spark, rows)[0] == "Big.\n\n# Head"


def test_paragraphs(spark):
    rows = [item(0, 0, "one"), item(50, 0, "more"), item(0, 14, "two"), item(0, 40, "three"), item(30, 54, "indented"), item(30, 68, "big", 14.0)]
    got = layout.page_paragraphs(frame(spark, rows)).orderBy("seq").collect()
    assert [(r.seq, r.lines, r.text) for r in got] == [(0, 2, "one more two"), (1, 1, "three"), (2, 1, "indented"), (3, 1, "big")]


@pytest.mark.parametrize("seed", range(3))
def test_lines_and_cells_match_a_plain_reading(spark, seed):
    """Steps below the tolerance that add up beyond it, ties, and gaps at the limits."""
    r = random.Random(seed)
    rows = []
    for page in range(1, 9):
        y = 0.0
        for k in range(60):
            y += r.choice([0, 0, 0.5, 1, 2, 3, 3.5, 9])
            rows.append(item(r.choice([0, 10, 24, 34, 58, 64, 90, 150]), y, f"t{k}", r.choice([8.0, 10.0, 12.0]), r.choice([10, 20, 30]), page=page))
    wanted = []
    for page in range(1, 9):
        lines = []
        for i in sorted((x for x in rows if x[1] == page), key=lambda x: (x[3], x[2], x[8])):
            if lines and i[3] - lines[-1][0][3] <= min(3.5, i[6] * 0.3):
                lines[-1].append(i)
            else:
                lines.append([i])
        for n, line in enumerate(lines, 1):
            cells, reach = [], None
            for i in sorted(line, key=lambda x: (x[2], x[3], x[8])):
                if reach is not None and i[2] - reach <= 24:
                    cells[-1] += (" " if i[2] - reach > i[6] * 0.12 else "") + i[8]
                    reach = max(reach, i[2] + i[4])
                else:
                    cells.append(i[8])
                    reach = i[2] + i[4]
            wanted.append((page, n, cells))
    found = layout.text_lines(layout.as_items(frame(spark, rows)), layout.PAGE)
    assert sorted((x.page, x.line, [c.text for c in x.cells]) for x in found.collect()) == sorted(wanted)


def test_plans_stay_in_the_jvm(spark):
    one = frame(spark, [item(0, 0, "a")])
    for df in (layout.page_tables(one), layout.page_tables(one, [5.0]), layout.pages_to_markdown(one), layout.page_paragraphs(one)):
        assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_boundaries_of_columns(spark):
    spans = lambda *xs: F.array(*(F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("right")) for a, b in xs))
    lines = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(spans((0, 40), (60, 90), (100, 120)), spans((0, 50), (57.9, 92)), spans((300, 310)))).alias("spans"))
    assert [r.bounds for r in layout.column_boundaries(lines).collect()] == [[96.0]]


def test_equal_edges_are_one_row_of_the_sweep(spark):
    spans = spark.range(0, 3000, 1, 3).selectExpr("1L AS doc_id", "1 AS page", "CAST(100 * (id % 3) AS DOUBLE) AS x", "CAST(100 * (id % 3) + 60 AS DOUBLE) AS right")
    swept = layout.gap_sweep(spans)
    assert sorted(r.boundary for r in swept.collect()) == [80.0, 180.0]
    plan = swept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window") < plan.index("Aggregate") < plan.index("Generate")


def test_lines_of_a_page_are_made_once(spark):
    """Whole lines, bands and their sides come from one flow; a join would make the lines again on each side."""
    plan = layout.reading_order(frame(spark, [item(0, 0, "a")]))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1 and "Join" not in plan


def test_lines_within_a_column_are_as_by_the_window(spark):
    r = random.Random(5)
    rows, y = [], 0.0
    for k in range(120):
        y += r.choice([0, 0.5, 2, 3, 3.5, 9])
        rows += [item(x, y + r.choice([0, 1]), f"{side}{k}", r.choice([8.0, 10.0, 12.0]), width=200) for side, x in (("L", 20), ("R", 320))]
    halves = layout.reading_order(frame(spark, rows), "columns").orderBy("part", "line").collect()
    for part, side in ((1, "L"), (2, "R")):
        alone = layout.text_lines(layout.as_items(frame(spark, [x for x in rows if x[8][0] == side])), layout.PAGE).orderBy("line").collect()
        assert [(h.line, h.y, h.text) for h in halves if h.part == part] == [(a.line, a.y, a.text) for a in alone]
