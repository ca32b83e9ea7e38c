"""Flowing text from positioned fragments: runs of one style, lines, cells, columns, tables, lists, headings, paragraphs.

Input: doc_id, page, x, y, width, font_size, font_name, str, page_width. Each level groups the one below: fragments near a
line's first one, neighbours of one style, neighbours without a wide gap, lines between those that cross the page,
lines with several cells, plain lines close to the one before. Comparisons with the previous row are windows, the rest are
folds over a line's or a table's array; all of it built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lambdas import bound, grouped, without_last
from .layout import PAGE, base_sizes, by_x, lines_within, placed_lines

FRAGMENT = "struct<y: double, x: double, str: string, width: double, size: double, bold: boolean, italic: boolean>"
RUN = "struct<text: string, bold: boolean, italic: boolean, size: double>"
# Parts of font names, and what begins an item of a list.
BOLD, ITALIC = r"(?i)bold|black|heavy", r"(?i)italic|oblique"
BULLET, NUMBER = r"^([•◦▪▫●○■□►▸]|[-*])\s+(?=.)", r"^(\d+[.)])\s+(?=.)"


def _right(f: Column, letter: float = 0.45) -> Column:
    """A fragment's right edge; a letter takes a share of the font at least."""
    return f["x"] + F.greatest(f["width"], F.length(f["str"]) * f["size"] * letter)


def fragments(frame: DataFrame) -> DataFrame:
    """Page keys, page_width and item; blank fragments are left out."""
    number = lambda c: F.col(c).cast("double")
    style = lambda p: F.coalesce(F.col("font_name").rlike(p), F.lit(False))
    item = F.struct(number("y").alias("y"), number("x").alias("x"), F.col("str").alias("str"), number("width").alias("width"), number("font_size").alias("size"), style(BOLD).alias("bold"), style(ITALIC).alias("italic"))
    return frame.filter(F.col("str").rlike(r"\S")).select(*PAGE, number("page_width").alias("page_width"), item.alias("item"))


def styled_runs(items: Column) -> Column:
    """Fragments from left to right as runs of one style; a blank goes between words, but not before a comma or full stop."""

    def step(runs: Column, f: Column) -> Column:
        last = F.try_element_at(runs, F.lit(-1))
        any_yet = F.size(runs) > 0
        open_end = any_yet & ~F.endswith(last["text"], F.lit(" ")) & ~F.substring(f["str"], 1, 1).isin(" ", ",", ".")
        text = F.concat(F.when(open_end, " ").otherwise(""), f["str"])
        same = any_yet & (last["bold"] == f["bold"]) & (last["italic"] == f["italic"])
        run = lambda t, like: F.struct(t.alias("text"), like["bold"].alias("bold"), like["italic"].alias("italic"), like["size"].alias("size"))
        return F.when(same, F.concat(without_last(runs), F.array(run(F.concat(last["text"], text), last)))).otherwise(F.concat(runs, F.array(run(text, f))))

    return F.aggregate(items, F.array().cast(f"array<{RUN}>"), step)


def _text(runs: Column) -> Column:
    return F.trim(F.array_join(F.transform(runs, lambda r: r["text"]), ""))


def _cells(items: Column) -> Column:
    """x, right and text of each cell: neighbours less than a font and a quarter (14 points at least) apart."""
    begin = lambda f: F.struct(f["x"].alias("x"), _right(f).alias("right"), F.array(f).alias("items"))
    add = lambda c, f: F.struct(c["x"].alias("x"), F.greatest(c["right"], _right(f)).alias("right"), F.concat(c["items"], F.array(f)).alias("items"))
    near = lambda c, f: f["x"] - c["right"] <= F.greatest(F.lit(14.0), f["size"] * 1.25)
    kind = f"array<struct<x: double, right: double, items: array<{FRAGMENT}>>>"
    return F.transform(grouped(items, F.array().cast(kind), near, add, begin), lambda c: F.struct(c["x"].alias("x"), c["right"].alias("right"), _text(styled_runs(c["items"])).alias("text")))


TOLERANCE = lambda f: F.least(F.lit(4.0), F.greatest(F.lit(2.5), f["size"] * 0.35))
LINE = ["line", "top", "left", "right", "size", "bold", "runs", "cells", "text"]


def _line(number: Column, items: Column) -> Column:
    """struct of LINE's columns from a line's fragments, from left to right."""

    def line(items: Column, runs: Column, cells: Column) -> Column:
        each = lambda f: F.transform(items, f)
        left, right, size = F.array_min(each(lambda f: f["x"])), F.array_max(each(lambda f: _right(f))), F.array_max(each(lambda f: f["size"]))
        bold = F.forall(runs, lambda r: r["bold"] | ~r["text"].rlike(r"\S"))
        text = F.trim(F.array_join(F.transform(cells, lambda c: c["text"]), " "))
        return F.struct(number.cast("int").alias("line"), F.get(items, F.lit(0))["y"].alias("top"), left.alias("left"), right.alias("right"), size.alias("size"), bold.alias("bold"), runs.alias("runs"), cells.alias("cells"), text.alias("text"))

    return bound(items, lambda i: bound(styled_runs(i), lambda r: bound(_cells(i), lambda c: line(i, r, c))))


def gutter(items: Column, width: Column) -> Column:
    """Where a band may be cut: the middle if nothing crosses it, else the middle of the widest free gap near it; null if there is none.

    The gap lies between 0.35 and 0.65 of the page, is 16 points wide or more, and nothing crosses its middle.
    """
    spans = F.array_sort(F.transform(items, lambda f: F.struct(f["x"].alias("l"), _right(f).alias("r"))))
    crossed = lambda at, slack: F.exists(spans, lambda s: (s["l"] < at - slack) & (s["r"] > at + slack))
    start = F.struct(F.lit(0.0).alias("reach"), F.lit(0.0).alias("wide"), F.lit(None).cast("double").alias("at"))

    def step(state: Column, s: Column) -> Column:
        a, b = F.greatest(state["reach"], width * 0.35), F.least(s["l"], width * 0.65)
        better = (s["l"] > state["reach"]) & (b - a > state["wide"])
        return F.struct(F.greatest(state["reach"], s["r"]).alias("reach"), F.when(better, b - a).otherwise(state["wide"]).alias("wide"), F.when(better, (a + b) / 2).otherwise(state["at"]).alias("at"))

    gap = bound(F.aggregate(spans, start, step), lambda g: F.when((g["wide"] >= 16) & ~crossed(g["at"], 2), g["at"]))
    return F.when(crossed(width / 2, 4), gap).otherwise(width / 2)


def reading_groups(frame: DataFrame) -> DataFrame:
    """doc_id, page, part, band_top (null but for columns), line and the line's columns.

    A part is a line that crosses the page's middle in one cell, a band of lines between these, or a column of such a band:
    two sides of three lines or more, wide, beside each other, with words enough or unlike numbers of lines.
    """
    keys, middle, width = [*PAGE, "page_width"], F.col("page_width") / 2, F.col("page_width")
    lines = placed_lines(fragments(frame), keys, TOLERANCE, FRAGMENT)
    lines = lines.select(*keys, "items", _line(F.col("line"), F.col("items")).alias("x"))
    across = (F.size("x.cells") == 1) & (F.col("x.left") < middle - 8) & (F.col("x.right") > middle + 8)
    order = Window.partitionBy(*PAGE).orderBy("x.line")
    passed = F.sum(F.when(across, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("band", passed * 2 - F.when(across, 1).otherwise(0))
    # a band is one row, read by one expression: no line is made twice, and the gutter isn't found anew for each fragment
    bands = lines.groupBy(*keys, "band").agg(F.collect_list("x").alias("lines"), F.flatten(F.collect_list("items")).alias("items"))
    left, right = lambda cut: F.filter("items", lambda f: _right(f, 0.4) <= cut + 4), lambda cut: F.filter("items", lambda f: f["x"] >= cut - 4)
    clean = lambda s: (F.size(s[0]) > 0) & (F.size(s[1]) > 0) & (F.size(s[0]) + F.size(s[1]) == F.size("items"))
    words = lambda text: F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    made = lambda items: F.transform(lines_within(F.array_sort(items), TOLERANCE, FRAGMENT), lambda i, k: _line(k + 1, by_x(i)))
    wide = lambda lines: F.array_sort(F.transform(lines, lambda x: x["right"] - x["left"]))
    broad = lambda lines: (F.size(lines) >= 3) & (F.get(wide(lines), F.floor(F.size(lines) / 2).cast("int")) >= width * 0.22)
    full = lambda lines: F.aggregate(lines, F.lit(0), lambda n, x: n + words(x["text"])) / F.size(lines)
    first, last = lambda lines: F.get(lines, F.lit(0))["top"], lambda lines: F.try_element_at(lines, F.lit(-1))["top"]
    beside = lambda h: F.greatest(first(h[0]), first(h[1])) <= F.least(last(h[0]), last(h[1]))
    told = lambda h: (F.greatest(full(h[0]), full(h[1])) >= 3.5) | (F.abs(F.size(h[0]) - F.size(h[1])) >= 2)
    split = lambda h: broad(h[0]) & broad(h[1]) & beside(h) & told(h)
    tagged = lambda lines, s, top: F.transform(lines, lambda x: F.struct(F.lit(s).alias("side"), top.alias("band_top"), x.alias("x")))
    whole = tagged(F.col("lines"), 0, F.lit(None).cast("double"))
    halved = lambda h: F.when(split(h), bound(F.least(first(h[0]), first(h[1])), lambda top: F.concat(tagged(h[0], 0, top), tagged(h[1], 1, top)))).otherwise(whole)
    sided = lambda s: F.when(clean(s), bound(F.array(made(s[0]), made(s[1])), halved)).otherwise(whole)
    cut_at = lambda cut: F.when(cut.isNotNull(), bound(F.array(left(cut), right(cut)), sided)).otherwise(whole)
    read = F.when((F.col("band") % 2 == 0) & (F.size("lines") >= 3), bound(gutter(F.col("items"), width), cut_at)).otherwise(whole)
    every = bands.select(*PAGE, "band", F.explode(read).alias("s"))
    part = F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("band", "s.side"))
    return every.select(*PAGE, part.alias("part"), "s.band_top", *(f"s.x.{c}" for c in LINE))


def aligned_table(rows: Column) -> Column:
    """Lines of cells as rows of a table; null unless two columns are met by two lines each. Columns are runs of cells that overlap from above."""
    cell = lambda c: F.struct(c["x"].alias("l"), F.greatest(c["right"], c["x"] + 8).alias("r"))
    spans = F.array_sort(F.transform(F.flatten(rows), cell))
    bands = grouped(spans, F.array().cast("array<struct<l: double, r: double>>"), lambda b, s: s["l"] <= b["r"] + 4, lambda b, s: F.struct(b["l"].alias("l"), F.greatest(b["r"], s["r"]).alias("r")), lambda s: s)

    def table(columns: Column) -> Column:
        column = lambda c: F.array_position(F.transform(columns, lambda b: (c["x"] <= b["r"] + 4) & (F.greatest(c["right"], c["x"] + 8) >= b["l"] - 4)), True)
        placed = lambda row: F.transform(row, lambda c: F.struct(column(c).alias("k"), c["text"].alias("t")))
        numbers = F.sequence(F.lit(1), F.size(columns))

        def judged(lines: Column) -> Column:
            hit = lambda k: F.size(F.filter(lines, lambda row: F.exists(row, lambda c: c["k"] == k)))
            text = lambda row, k: F.trim(F.array_join(F.transform(F.filter(row, lambda c: c["k"] == k), lambda c: c["t"]), " "))
            fine = F.size(F.filter(numbers, lambda k: hit(k) >= 2)) >= 2
            return F.when(fine, F.transform(lines, lambda row: F.transform(numbers, lambda k: text(row, k))))

        return F.when(F.size(columns).between(2, 15), bound(F.transform(rows, placed), judged))

    return F.when((F.size(rows) >= 2) & (F.size(spans) >= 4), bound(bands, table))


def rebuilt_blocks(frame: DataFrame) -> DataFrame:
    """doc_id, page, seq, kind, level, list, text, runs, rows: what a page says, in reading order.

    kind: heading (level 1 to 3), bullet, numbered (list: which numbered list of the document), paragraph, table (rows).
    """
    # lists are numbered through a document, so its pages share a task; no later step deals them out again
    lines = reading_groups(frame.repartition("doc_id")).join(base_sizes(frame.filter(F.col("str").rlike(r"\S"))).hint("shuffle_hash"), "doc_id")
    group = Window.partitionBy(*PAGE, "part").orderBy("line")
    row = F.size("cells") >= 2
    follows = row & F.lag(row).over(group) & (F.abs(F.col("top") - F.lag("top").over(group)) <= F.greatest(F.col("size"), F.lag("size").over(group)) * 3.5)
    lines = lines.withColumn("run", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(group.rowsBetween(Window.unboundedPreceding, 0)))
    runs = lines.groupBy(*PAGE, "part", "run", "band_top").agg(F.array_sort(F.collect_list(F.struct("line", "top", "size", "bold", "runs", "cells", "text", "base"))).alias("lines"))
    several = F.size(F.get("lines", F.lit(0))["cells"]) >= 2
    runs = runs.withColumn("rows", F.when(several, aligned_table(F.transform("lines", lambda x: x["cells"]))))
    # a table is one element, every other line is one
    first = lambda x: F.slice(x, 1, 1)
    elements = runs.withColumn("x", F.explode(F.when(F.col("rows").isNotNull(), first(F.col("lines"))).otherwise(F.col("lines"))))
    last_top = F.when(F.col("rows").isNotNull(), F.try_element_at("lines", F.lit(-1))["top"]).otherwise(F.col("x.top"))
    elements = elements.select(*PAGE, "part", "band_top", "rows", last_top.alias("last_top"), "x.*").filter(F.col("rows").isNotNull() | (F.col("text") != ""))
    size, base, text = F.col("size"), F.col("base"), F.col("text")
    level = F.when((size >= base * 1.55) & (F.length(text) <= 140), 1).when((size >= base * 1.25) & (F.length(text) <= 140), 2).when((size >= base * 1.12) & F.col("bold") & (F.length(text) <= 100) & ~text.rlike(r"[.!?]$"), 3)
    kind = F.when(F.col("rows").isNotNull(), "table").when(text.rlike(BULLET), "bullet").when(text.rlike(NUMBER), "numbered").when(level.isNotNull(), "heading").otherwise("paragraph")
    elements = elements.withColumn("kind", kind).withColumn("level", F.when(F.col("kind") == "heading", level))
    before = F.lag("kind").over(group)
    joins = (F.col("kind") == "paragraph") & (before == "paragraph") & (F.abs(F.col("top") - F.lag("last_top").over(group)) <= size * 1.85)
    begins_list = (F.col("kind") == "numbered") & (F.coalesce(before, F.lit("")) != "numbered")
    elements = elements.withColumns({"joins": F.coalesce(joins, F.lit(False)), "begins": begins_list})
    elements = elements.withColumn("block", F.sum(F.when(F.col("joins"), 0).otherwise(1)).over(group.rowsBetween(Window.unboundedPreceding, 0)))
    every = Window.partitionBy("doc_id").orderBy("page", "part", "line").rowsBetween(Window.unboundedPreceding, 0)
    elements = elements.withColumn("list", F.when(F.col("kind") == "numbered", F.sum(F.when(F.col("begins"), 1).otherwise(0)).over(every)))
    stripped = F.when(F.col("kind") == "bullet", F.regexp_replace(text, BULLET, "")).when(F.col("kind") == "numbered", F.regexp_replace(text, NUMBER, "")).when(F.col("kind") != "table", text)
    parts = F.array_sort(F.collect_list(F.struct("line", stripped.alias("text"), "runs")))
    blocks = elements.groupBy(*PAGE, "part", "block").agg(F.min("kind").alias("kind"), F.min("level").alias("level"), F.min("list").alias("list"), F.first("rows").alias("rows"), F.min("band_top").alias("band_top"), F.min_by("top", "line").alias("top"), parts.alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    styled = F.flatten(F.transform("parts", lambda p: p["runs"]))
    place = Window.partitionBy(*PAGE).orderBy(F.coalesce("band_top", "top"), "part", "top", "block")
    table = F.col("kind") == "table"
    return blocks.select(*PAGE, F.row_number().over(place).alias("seq"), "kind", "level", F.col("list").cast("int").alias("list"), F.when(~table, joined).alias("text"), F.when(~table, styled).alias("runs"), "rows")
