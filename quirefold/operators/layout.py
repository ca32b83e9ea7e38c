"""Positioned text as gaps and islands: lines, cells, columns, tables, bands in reading order, Markdown, paragraphs.

Input frames have doc_id, page, x, y, width, height, font_size, bold, str; pages_to_markdown also page_width. Items of a page
are read by y, x and text, so equal positions have one order everywhere.

A comparison with the previous row is a window: lag, and a running sum of breaks. Where the reference point is the first
item of the open group instead, a window still cuts wherever even the previous row is too far away, and only what is left,
a few items, goes through a fold over an array. No step leaves the JVM, and none holds more than a page.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lambdas import bound, grouped
from ..functions.text import escape_markdown

PAGE = ["doc_id", "page"]
ITEM = "struct<y: double, x: double, str: string, width: double, size: double, bold: boolean>"
CELL = "struct<x: double, right: double, text: string, size: double, col: int>"


def _right(item: Column) -> Column:
    return item["x"] + item["width"]


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _last(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))


def as_items(frame: DataFrame, *more: str) -> DataFrame:
    """Page keys, further columns, and item."""
    number = lambda c: F.col(c).cast("double")
    item = F.struct(number("y").alias("y"), number("x").alias("x"), F.col("str").cast("string").alias("str"), number("width").alias("width"), number("font_size").alias("size"), F.col("bold").cast("boolean").alias("bold"))
    return frame.select(*PAGE, *more, item.alias("item"))


def placed_lines(items: DataFrame, keys: list[str], tolerance: Callable[[Column], Column], kind: str = ITEM) -> DataFrame:
    """keys, line (from 1), y and items (from left to right): a line ends where an item is further than its tolerance from the line's first item.

    An item that is too far from the item before it is too far from the line's first one; so a window cuts there, and a
    run in between is one line unless some item of it is too far from its first.
    """
    order = Window.partitionBy(*keys).orderBy("item")
    far = F.col("item.y") - F.lag("item.y").over(order) > tolerance(F.col("item"))
    runs = items.withColumn("run", F.sum(F.when(far, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = runs.groupBy(*keys, "run").agg(F.array_sort(F.collect_list("item")).alias("items"))
    rows = runs.select(*keys, "run", F.posexplode(_lines_of_run(F.col("items"), tolerance, kind)).alias("part", "items"))
    numbered = rows.withColumn("line", F.row_number().over(Window.partitionBy(*keys).orderBy("run", "part")))
    return numbered.select(*keys, "line", _first(F.col("items"))["y"].alias("y"), by_x(F.col("items")).alias("items"))


def by_x(items: Column) -> Column:
    return F.transform(F.array_sort(F.transform(items, lambda i: F.struct(i["x"].alias("at"), i.alias("item")))), lambda i: i["item"])


def _lines_of_run(run: Column, tolerance: Callable[[Column], Column], kind: str) -> Column:
    near = lambda first, item: item["y"] - first["y"] <= tolerance(item)
    one = F.forall(run, lambda i: near(_first(run), i))
    several = grouped(run, F.array().cast(f"array<array<{kind}>>"), lambda line, i: near(_first(line), i), lambda line, i: F.concat(line, F.array(i)), lambda i: F.array(i))
    return F.when(one, F.array(run)).otherwise(several)


def lines_within(items: Column, tolerance: Callable[[Column], Column], kind: str = ITEM) -> Column:
    """The lines of a sorted array of items, each from top to bottom: cut into runs first, as placed_lines does by a window."""

    def cut(items: Column) -> Column:
        far = lambda k: F.get(items, k)["y"] - F.get(items, k - 1)["y"] > tolerance(F.get(items, k))
        starts = F.filter(F.sequence(F.lit(0), F.size(items) - 1), lambda k: (k == 0) | far(k))
        run = lambda starts, s, n: F.slice(items, s + 1, F.coalesce(F.get(starts, n + 1), F.size(items)) - s)
        return bound(starts, lambda at: F.flatten(F.transform(at, lambda s, n: bound(run(at, s, n), lambda r: _lines_of_run(r, tolerance, kind)))))

    return bound(items, lambda i: F.when(F.size(i) > 0, cut(i)).otherwise(F.array().cast(f"array<array<{kind}>>")))


def _cell(x: Column, right: Column, text: Column, size: Column, col: Column | int = 0) -> Column:
    return F.struct(x.alias("x"), right.alias("right"), text.alias("text"), size.alias("size"), (F.lit(col) if isinstance(col, int) else col).cast("int").alias("col")).cast(CELL)


def as_cells(items: Column, col: Callable[[Column], Column] = lambda i: F.lit(0)) -> Column:
    return F.transform(items, lambda i: _cell(i["x"], _right(i), i["str"], i["size"], col(i)))


def merged_cells(cells: Column, joins: Callable[[Column, Column, Column], Column], blank: float) -> Column:
    """Neighbouring cells as one where joins(last, cell, gap) says so; a blank between where the gap exceeds its share of the font."""
    gap = lambda last, c: c["x"] - last["right"]

    def merge(last: Column, c: Column) -> Column:
        text = F.concat(last["text"], F.when(gap(last, c) > c["size"] * blank, " ").otherwise(""), c["text"])
        return _cell(last["x"], F.greatest(last["right"], c["right"]), text, F.greatest(last["size"], c["size"]), last["col"])

    return grouped(cells, F.array().cast(f"array<{CELL}>"), lambda last, c: joins(last, c, gap(last, c)), merge, lambda c: c)


# tables


def gap_sweep(spans: DataFrame, least: float = 8.0) -> DataFrame:
    """doc_id, page, boundary: the sweep over span edges as a window, for spans of lines with several spans. least: above 0.

    Equal edges of a page are one row with their number: no gap lies between them, and pages have few places.
    """
    edges = spans.select(*PAGE, F.explode(F.array(F.struct(F.col("x").alias("at"), F.lit(1).alias("delta")), F.struct(F.col("right").alias("at"), F.lit(-1).alias("delta")))).alias("e")).select(*PAGE, "e.*")
    edges = edges.groupBy(*PAGE, "at", "delta").agg(F.count("*").alias("n"))
    order = Window.partitionBy(*PAGE).orderBy("at", "delta")
    open_before = F.coalesce(F.sum(F.col("delta") * F.col("n")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    swept = edges.select(*PAGE, "at", F.lag("at").over(order).alias("before"), open_before.alias("active"))
    return swept.filter((F.col("active") == 0) & (F.col("at") - F.col("before") >= least)).select(*PAGE, ((F.col("before") + F.col("at")) / 2).alias("boundary"))


def column_boundaries(lines: DataFrame) -> DataFrame:
    """doc_id, page, bounds: middles of gaps that no span of a line with several spans covers, with spans on both sides, 4 points apart at least. lines: spans."""
    several = lines.filter(F.size("spans") >= 2).select(*PAGE, F.explode("spans").alias("s")).select(*PAGE, "s.x", "s.right")
    found = gap_sweep(several).groupBy(*PAGE).agg(F.array_sort(F.collect_list("boundary")).alias("found"))
    edges = lines.groupBy(*PAGE).agg(F.min(F.array_min(F.transform("spans", lambda s: s["right"]))).alias("left"), F.max(F.array_max(F.transform("spans", lambda s: s["x"]))).alias("right"))
    inside = F.filter(F.coalesce("found", F.array().cast("array<double>")), lambda b: (F.col("left") <= b + 1) & (F.col("right") >= b - 1))
    apart = F.aggregate(inside, F.array().cast("array<double>"), lambda held, b: F.when((F.size(held) > 0) & (b - _last(held) < 4), held).otherwise(F.concat(held, F.array(b))))
    return edges.join(found, PAGE, "left").select(*PAGE, apart.alias("bounds"))


def _row_by_column(cells: Column, columns: Column) -> Column:
    """The text of the first cell in each of `columns` columns."""
    return F.transform(F.sequence(F.lit(0), columns - 1), lambda k: F.coalesce(_first(F.transform(F.filter(cells, lambda c: c["col"] == k), lambda c: c["text"])), F.lit("")))


def _nearest_columns(cells: Column, model: Column) -> Column:
    """cells with col: each takes the nearest column of the model row, by either edge, to the right of the one before it."""

    def place(done: Column, cell: Column) -> Column:
        at = F.when(F.size(done) > 0, _last(done)["col"] + 1).otherwise(0)
        last = F.size(model) - F.size(cells) + F.size(done)
        distance = lambda m: F.least(F.abs(cell["x"] - m["x"]), F.abs(cell["right"] - m["right"]))
        choices = F.transform(F.sequence(at, F.greatest(at, last)), lambda k: F.struct(distance(F.get(model, k)).alias("d"), k.alias("k")))
        return F.concat(done, F.array(_cell(cell["x"], cell["right"], cell["text"], cell["size"], F.array_min(choices)["k"])))

    return F.aggregate(cells, F.array().cast(f"array<{CELL}>"), place)


def page_tables(items: DataFrame, separators: list[float] | None = None) -> DataFrame:
    """doc_id, page, row, cells, error. separators: x positions that fix the columns; one row with an error where they cut text."""
    lines = placed_lines(as_items(items), PAGE, lambda _: F.lit(4.0))
    page = Window.partitionBy(*PAGE)
    if separators:
        edges = F.array(*(F.lit(float(s)) for s in separators))
        column = lambda i: F.size(F.filter(edges, lambda s: i["x"] >= s))
        is_cut = lambda i: bound(column(i), lambda k: (k < len(separators)) & (_right(i) > F.get(edges, k) + 0.01))
        cells = merged_cells(as_cells(F.col("items"), column), lambda last, c, gap: last["col"] == c["col"], 0.15)
        rows = lines.withColumn("cut", F.max(F.exists("items", is_cut)).over(page)).withColumn("cells", _row_by_column(cells, F.lit(len(separators) + 1)))
        rows = rows.filter(~F.col("cut") | (F.col("line") == 1))
        return rows.select(*PAGE, (F.col("line") - 1).alias("row"), F.when(F.col("cut"), F.array().cast("array<string>")).otherwise(F.col("cells")).alias("cells"), F.when(F.col("cut"), "a separator cuts text").alias("error"))
    close = lambda last, c, gap: gap <= F.greatest(F.greatest(last["size"], c["size"]) * 0.55, F.lit(4.0))
    spans = lines.select(*PAGE, "line", merged_cells(as_cells(F.col("items")), close, 0.15).alias("spans"))
    bounds = F.col("bounds")
    between = lambda last, c: F.exists(bounds, lambda b: (last["right"] <= b + 1) & (c["x"] >= b - 1))
    cells = merged_cells(F.col("spans"), lambda last, c, gap: (gap <= 18) & ~between(last, c), 0.15)
    bucket = lambda c: F.size(F.filter(bounds, lambda b: c["x"] >= b - 1))
    rows = spans.join(column_boundaries(spans), PAGE).withColumn("cells", cells)
    rows = rows.withColumn("cells", F.transform("cells", lambda c: _cell(c["x"], c["right"], c["text"], c["size"], bucket(c))))
    places = F.transform("cells", lambda c: c["col"])
    rising = F.min(places == F.array_sort(F.array_distinct(places))).over(page)
    widest = F.max(F.struct(F.size("cells").alias("n"), (-F.col("line")).alias("first"), F.col("cells").alias("cells"))).over(page)["cells"]
    rows = rows.withColumns({"rising": rising, "model": widest})
    by_bounds, by_model = _row_by_column(F.col("cells"), F.size(bounds) + 1), _row_by_column(_nearest_columns(F.col("cells"), F.col("model")), F.size("model"))
    out = F.when((F.size(bounds) > 0) & F.col("rising"), by_bounds).otherwise(by_model)
    return rows.select(*PAGE, (F.col("line") - 1).alias("row"), out.alias("cells"), F.lit(None).cast("string").alias("error"))


# reading order and Markdown


TOLERANCE = lambda i: F.least(F.lit(3.5), i["size"] * 0.3)


def _line(number: Column, y: Column, items: Column) -> Column:
    """struct of line, y, items and what follows from them: cells (24 points apart), top (of the leftmost item), size, bold, wide, text."""

    def line(items: Column, cells: Column) -> Column:
        left = _first(items)
        size, bold = F.array_max(F.transform(items, lambda i: i["size"])), F.exists(items, lambda i: i["bold"])
        wide = F.array_max(F.transform(items, _right)) - left["x"]
        text = F.array_join(F.transform(cells, lambda c: F.trim(c["text"])), " ")
        return F.struct(number.cast("int").alias("line"), y.alias("y"), items.alias("items"), cells.alias("cells"), left["y"].alias("top"), size.alias("size"), bold.alias("bold"), wide.alias("wide"), text.alias("text"))

    cells = lambda items: merged_cells(as_cells(items), lambda last, c, gap: gap <= 24, 0.12)
    return bound(items, lambda i: bound(cells(i), lambda c: line(i, c)))


LINE = ["line", "y", "items", "cells", "top", "size", "bold", "wide", "text"]


def text_lines(items: DataFrame, keys: list[str]) -> DataFrame:
    lines = placed_lines(items, keys, TOLERANCE)
    return lines.select(*keys, _line(F.col("line"), F.col("y"), F.col("items")).alias("x")).select(*keys, *(f"x.{c}" for c in LINE))


def _upper_median(values: Column) -> Column:
    """The element after half of the sorted ones."""
    return F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int"))


def reading_order(items: DataFrame, mode: str = "auto") -> DataFrame:
    """doc_id, page, part, line and the line's columns: lines in reading order; a part is a band, one of its columns, or a line across the page.

    Bands lie between lines that cross the page's middle with one cell. A band is read column by column if nothing in it
    crosses the middle and, in auto mode, both sides have three lines or more, are wide, and lie beside each other.
    items: page_width too. mode: auto, columns or rows.
    """
    # one partitioning serves all steps of a page, and a band is one row: no line is made twice
    placed = as_items(items, "page_width").repartition(*PAGE)
    keys, middle = [*PAGE, "page_width"], F.col("page_width") / 2
    crosses = lambda i: (i["x"] < middle) & (_right(i) > middle)
    lines = text_lines(placed, keys)
    if mode == "rows":
        return lines.select(*PAGE, F.lit(1).alias("part"), *LINE)
    order = Window.partitionBy(*PAGE).orderBy("line")
    across = (F.size("cells") == 1) & F.exists("items", crosses)
    # lines across are parts of odd number, bands between them of even number
    passed = F.sum(F.when(across, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("band", passed * 2 - F.when(across, 1).otherwise(0))
    bands = lines.groupBy(*keys, "band").agg(F.collect_list(F.struct(*LINE)).alias("lines"))
    side = lambda i: F.when(_right(i) <= middle, 0).when(i["x"] >= middle, 1).otherwise(2)
    inside = lambda items, s: F.filter(items, lambda i: side(i) == s)
    enough, least = F.lit(1 if mode == "columns" else 3), F.col("page_width") * 0.22
    # no line of a side is wider than the side
    extent = lambda items: F.array_max(F.transform(items, _right)) - F.array_min(F.transform(items, lambda i: i["x"]))
    hopeful = lambda items: (F.size(items) >= enough) & (F.lit(True) if mode == "columns" else extent(items) >= least)
    made = lambda items: F.transform(lines_within(F.array_sort(items), TOLERANCE), lambda i, k: _line(k + 1, _first(i)["y"], by_x(i)))
    broad = lambda lines: (F.size(lines) >= 3) & (_upper_median(F.transform(lines, lambda x: x["wide"])) >= least)
    beside = lambda a, b: F.greatest(_first(a)["top"], _first(b)["top"]) <= F.least(_last(a)["top"], _last(b)["top"])
    split = lambda h: F.lit(True) if mode == "columns" else broad(h[0]) & broad(h[1]) & beside(h[0], h[1])
    tagged = lambda lines, s: F.transform(lines, lambda x: F.struct(F.lit(s).alias("side"), x.alias("x")))
    whole = tagged(F.col("lines"), 0)
    halved = lambda h: F.when(split(h), F.concat(tagged(h[0], 0), tagged(h[1], 1))).otherwise(whole)
    sides = lambda p: F.when(hopeful(p[0]) & hopeful(p[1]), bound(F.array(made(p[0]), made(p[1])), halved)).otherwise(whole)
    crossed = lambda items: F.exists(items, lambda i: side(i) == 2)
    read = lambda items: F.when(crossed(items), whole).otherwise(bound(F.array(inside(items, 0), inside(items, 1)), sides))
    items_of = F.flatten(F.transform("lines", lambda x: x["items"]))
    every = bands.select(*PAGE, "band", F.explode(F.when(F.col("band") % 2 == 0, bound(items_of, read)).otherwise(whole)).alias("s")).select(*PAGE, F.struct("band", "s.side").alias("part"), *(f"s.x.{c}" for c in LINE))
    return every.withColumn("part", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("part")))


# What begins a line that is written as it stands, and bullets that become dashes.
MARKER = r"^(#{1,6}\s|[-*+]\s|\d+\.\s|>\s|[•◦▪►]\s*)"
BULLET = r"^[•◦▪►]"


def heading_level(text: Column, font_size: Column, bold: Column, base_size: Column) -> Column:
    """1 to 3 by the font's ratio or weight; null for body text."""
    ratio = font_size / base_size
    short = (F.length(text) <= 100) & ~text.rlike(r"[.!?]$")
    return F.when(short, F.when(ratio >= 1.6, 1).when(ratio >= 1.3, 2).when((ratio >= 1.15) | bold, 3))


def plain_line(text: Column, size: Column, bold: Column, base: Column) -> Column:
    """A line outside tables as Markdown."""
    marker = F.regexp_extract(text, MARKER, 1)
    marked = F.concat(F.when(marker.rlike(BULLET), "- ").otherwise(marker), escape_markdown(F.substring(text, F.length(marker) + 1, F.length(text))))
    level = heading_level(text, size, bold, base)
    return F.when(marker != "", marked).when(level.isNotNull(), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), escape_markdown(text))).otherwise(escape_markdown(text))


def _pipe_table(rows: Column) -> Column:
    """A run of lines with several cells as a pipe table; null if its columns don't line up. rows: an array of arrays of cells."""
    anchor = "struct<x: double, n: int>"

    def met(anchors: Column, c: Column) -> Column:
        at = F.array_position(F.transform(anchors, lambda a: F.abs(a["x"] - c["x"]) <= 12), True)
        more = F.transform(anchors, lambda a, k: F.struct(a["x"].alias("x"), (a["n"] + F.when(k == at - 1, 1).otherwise(0)).cast("int").alias("n")))
        return F.when(at > 0, more).otherwise(F.concat(anchors, F.array(F.struct(c["x"].alias("x"), F.lit(1).alias("n")))))

    def text(c: Column) -> Column:
        return bound(escape_markdown(F.trim(c["text"])), lambda t: F.when(t.rlike(r"^[-:\s]+$"), F.regexp_replace(t, "([-:])", r"\\$1")).otherwise(t))

    def table(anchors: Column) -> Column:
        # each cell's anchor and text once; anchors are more than 12 apart
        anchor_of = lambda c: F.array_position(F.transform(anchors, lambda a: F.abs(a["x"] - c["x"]) <= 12), True)
        placed = lambda row: F.transform(row, lambda c: F.struct(anchor_of(c).alias("k"), text(c).alias("t")))
        line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        at = lambda row: F.transform(anchors, lambda _, k: F.coalesce(_last(F.filter(row, lambda c: c["k"] == k + 1))["t"], F.lit("")))
        lines = F.transform(rows, lambda row: line(bound(placed(row), at)))
        rule = F.array(line(F.transform(anchors, lambda _: F.lit("---"))))
        joined = bound(lines, lambda made: F.array_join(F.concat(F.slice(made, 1, 1), rule, F.slice(made, F.lit(2), F.size(made))), "\n"))
        return F.when((F.size(rows) >= 2) & F.size(anchors).between(2, 12) & (F.size(F.filter(anchors, lambda a: a["n"] >= 2)) >= 2), joined)

    return bound(F.array_sort(F.aggregate(F.flatten(rows), F.array().cast(f"array<{anchor}>"), met)), table)


def base_sizes(items: DataFrame) -> DataFrame:
    """doc_id, base: the upper median of a document's font sizes, by counts of distinct sizes."""
    counts = items.groupBy("doc_id", F.col("font_size").cast("double").alias("size")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy("size")
    upto, total = F.sum("n").over(order), F.sum("n").over(Window.partitionBy("doc_id"))
    placed = counts.select("doc_id", "size", upto.alias("upto"), total.alias("total"))
    return placed.filter(F.col("upto") > F.floor(F.col("total") / 2)).groupBy("doc_id").agg(F.min("size").alias("base"))


def pages_to_markdown(items: DataFrame, mode: str = "auto") -> DataFrame:
    """doc_id, page, markdown: headings by the document's font sizes, runs of lines with several cells as tables."""
    lines = reading_order(items, mode).join(base_sizes(items), "doc_id")
    order = Window.partitionBy(*PAGE, "part").orderBy("line")
    row = F.size("cells") >= 2
    follows = row & F.lag(row).over(order) & (F.col("top") - F.lag("top").over(order) <= F.col("base") * 4)
    runs = lines.withColumn("run", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    line = F.struct("line", "cells", "text", "size", "bold")
    blocks = runs.groupBy(*PAGE, "part", "run", "base").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    table = _pipe_table(F.transform("lines", lambda x: x["cells"]))
    plain = F.array_join(F.transform("lines", lambda x: plain_line(x["text"], x["size"], x["bold"], F.col("base"))), "\n\n")
    text = F.coalesce(F.when(F.size(_first(F.col("lines"))["cells"]) >= 2, table), plain)
    ordered = F.array_sort(F.collect_list(F.struct("part", "run", text.alias("text"))))
    return blocks.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda b: b["text"]), "\n\n").alias("markdown"))


def page_paragraphs(items: DataFrame) -> DataFrame:
    """doc_id, page, seq, lines, font_size, bold, text: lines of like size and left edge, at most 1.6 line heights apart."""
    lines = text_lines(as_items(items), PAGE).withColumn("left", _first(F.col("items"))["x"])
    order = Window.partitionBy(*PAGE).orderBy("line")
    before = lambda c: F.lag(c).over(order)
    gap = F.col("top") - before("top")
    follows = (F.abs(before("size") - F.col("size")) <= 0.5) & (F.abs(before("left") - F.col("left")) <= 6) & (gap > 0) & (gap <= F.col("size") * 1.6)
    runs = lines.withColumn("seq", F.sum(F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]), " ")
    return runs.groupBy(*PAGE, "seq").agg(F.count("*").cast("int").alias("lines"), F.max("size").alias("font_size"), F.min("bold").alias("bold"), text.alias("text")).withColumn("seq", F.col("seq").cast("int"))
