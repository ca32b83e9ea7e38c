"""Pages: sheets, regions, comparison and alignment, sensitive text, labels, budgets; layout.py has lines, tables and reading order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import overlap_pairs


def sheet_summary(rows: DataFrame) -> DataFrame:
    """doc_id, total_rows, total_columns (the widest row)."""
    return rows.groupBy("doc_id").agg(F.count("*").alias("total_rows"), F.max(F.size("cells")).cast("long").alias("total_columns"))


def region_filter(items: DataFrame, left: float, top: float, width: float, height: float) -> DataFrame:
    """Items inside the region (page shares; columns page_width and page_height), with cut true where it cuts one."""
    l, r = F.col("page_width") * left, F.col("page_width") * (left + width)
    t, b = F.col("page_height") * top, F.col("page_height") * (top + height)
    item_top = F.col("y") - F.when(F.col("height") > 0, F.col("height")).otherwise(F.col("font_size"))
    right = F.col("x") + F.col("width")
    inside = ~((right <= l) | (F.col("x") >= r) | (F.col("y") <= t) | (item_top >= b))
    cut = (F.col("x") < l - 0.01) | (right > r + 0.01) | (item_top < t - 0.01) | (F.col("y") > b + 0.01)
    return items.filter(inside).withColumn("cut", cut)


def word_similarity(left: Column, right: Column) -> Column:
    """Jaccard of distinct words; 0 for two texts without words."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{M}\p{N}]+"), F.lit(0)))
    a, b = words(left), words(right)
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def page_similarity(left: Column, right: Column, visual: Column) -> Column:
    texts = (left != "") & (right != "")
    return F.when(texts & (left == right), 0.95 + 0.05 * visual).when(texts, 0.85 * word_similarity(left, right) + 0.15 * visual).otherwise(visual)


GAP = 0.6
MAX_ALIGNED = 40


def align(scores: list[list[float]]) -> list[tuple[int | None, int | None]]:
    """Global alignment of two page sequences from their similarities; ties prefer a match, then a removal."""
    n, m = len(scores), len(scores[0]) if scores else 0
    cost = [[GAP * (i + j) for j in range(m + 1)] for i in range(n + 1)]
    move = [["r" if j == 0 else "a" for j in range(m + 1)] for i in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            options = [(cost[i - 1][j - 1] + 1 - scores[i - 1][j - 1], 0, "m"), (cost[i - 1][j] + GAP, 1, "r"), (cost[i][j - 1] + GAP, 2, "a")]
            cost[i][j], _, move[i][j] = min(options)
    out: list[tuple[int | None, int | None]] = []
    i, j = n, m
    while i or j:
        step = "r" if not j else "a" if not i else move[i][j]
        i, j = i - (step != "a"), j - (step != "r")
        out.append((i if step != "a" else None, j if step != "r" else None))
    return out[::-1]


def aligned_pages(scores: DataFrame) -> DataFrame:
    """scores: pair_id, left_page, right_page, similarity for all page pairs of a document pair (at most 40 x 40).

    Spark gathers a pair's similarities into one row; a call takes a batch of pairs.
    """

    def path(left: np.ndarray, right: np.ndarray, similarity: np.ndarray) -> list[tuple[int | None, int | None]]:
        lefts, rights = np.unique(left).tolist(), np.unique(right).tolist()
        if not len(left) == len(lefts) * len(rights) == len(set(zip(left.tolist(), right.tolist()))):
            raise ValueError("a page pair is missing or given twice")
        places = np.lexsort((right, left))
        steps = align(similarity[places].reshape(len(lefts), len(rights)).tolist())
        return [(lefts[a] if a is not None else None, rights[b] if b is not None else None) for a, b in steps]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [path(*x) for x in zip(f["left"], f["right"], f["similarity"])]
            sizes = [len(x) for x in found]
            flat = pd.DataFrame([x for steps in found for x in steps], columns=["left_page", "right_page"]).astype("Int32")
            flat.insert(0, "pair_id", f["pair_id"].repeat(sizes).to_numpy())
            flat.insert(1, "seq", [k for n in sizes for k in range(n)])
            yield flat

    bounded = scores.filter((F.col("left_page") <= MAX_ALIGNED) & (F.col("right_page") <= MAX_ALIGNED))
    cell = F.struct("left_page", "right_page", F.coalesce(F.col("similarity").cast("double"), F.lit(float("nan"))).alias("similarity"))
    gathered = bounded.groupBy("pair_id").agg(F.collect_list(cell).alias("c"))
    gathered = gathered.select("pair_id", F.col("c.left_page").alias("left"), F.col("c.right_page").alias("right"), F.col("c.similarity").alias("similarity"))
    return gathered.mapInPandas(run, "pair_id long, seq int, left_page int, right_page int")


def page_status(pages: DataFrame) -> DataFrame:
    """Adds status from left_page, right_page, left_text, right_text, changed_pixels, geometry_changed."""
    text = ~F.coalesce("left_text", F.lit("")).eqNullSafe(F.coalesce("right_text", F.lit("")))
    seen = (F.coalesce("changed_pixels", F.lit(0)) > 0) | F.coalesce("geometry_changed", F.lit(False))
    status = F.when(F.col("left_page").isNull(), F.lit("added")).when(F.col("right_page").isNull(), F.lit("removed")).when(text | seen, F.lit("modified")).otherwise(F.lit("unchanged"))
    return pages.withColumn("text_changed", text).withColumn("status", status)


def regions(cells: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (x, y, width, height, in cells) of 4-connected groups, in reading order of their first cell."""
    left, out = set(cells), []
    for start in sorted(cells, key=lambda c: (c[1], c[0])):
        if start not in left:
            continue
        left.discard(start)
        queue = [start]
        for x, y in queue:
            for n in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)):
                if n in left:
                    left.discard(n)
                    queue.append(n)
        xs, ys = [c[0] for c in queue], [c[1] for c in queue]
        out.append((min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1))
    return out


def changed_regions(pixels: DataFrame, width: int, height: int, grid: int = 24) -> DataFrame:
    """pixels: page_id, x, y of changed pixels. Boxes as shares of the page; at most grid x grid cells a page."""
    cell = max(1, -(-max(width, height) // grid))
    marked = pixels.select("page_id", F.floor(F.col("x") / cell).cast("int").alias("cx"), F.floor(F.col("y") / cell).cast("int").alias("cy")).distinct()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        boxes = regions(set(zip(frame["cx"].tolist(), frame["cy"].tolist(), strict=True)))
        rows = [(frame["page_id"].iloc[0], k, x * cell / width, y * cell / height, (min(width, (x + w) * cell) - x * cell) / width, (min(height, (y + h) * cell) - y * cell) / height) for k, (x, y, w, h) in enumerate(boxes)]
        return pd.DataFrame(rows, columns=["page_id", "seq", "x", "y", "width", "height"])

    return marked.groupBy("page_id").applyInPandas(run, "page_id long, seq int, x double, y double, width double, height double")


# Presets of the sensitive-text search.
PRESETS = {
    "cpf": r"(?<!\d)\d{3}\.?\d{3}\.?\d{3}-?\d{2}(?!\d)",
    "cnpj": r"(?<!\d)\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2}(?!\d)",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"(?:\+?55\s?)?(?:\(?\d{2}\)?\s?)(?:9?\d{4}[-.\s]?\d{4})(?!\d)",
}


def literal_pattern(query: str, case_sensitive: bool = False) -> str:
    return ("" if case_sensitive else "(?iu)") + "".join("\\" + c if c in r"\.*+?^${}()|[]" else c for c in query)


def sensitive_matches(pages: DataFrame, pattern: str) -> DataFrame:
    """doc_id, page, seq, start, stop, value: non-empty matches in code points."""
    between, found = F.split("text", pattern, -1), F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, stop: int>>").alias("spans"))
    steps = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, f: F.struct(F.length(b).alias("gap"), F.length(f).alias("size")))
    spans = F.aggregate(steps, start, lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.concat(s["spans"], F.array(F.struct((s["at"] + x["gap"]).alias("start"), (s["at"] + x["gap"] + x["size"]).alias("stop")))).alias("spans")), lambda s: s["spans"])
    rows = pages.filter(F.col("text").rlike(pattern)).select("doc_id", "page", F.posexplode(F.arrays_zip(spans.alias("span"), found.alias("value"))).alias("seq", "m"))
    return rows.select("doc_id", "page", "seq", "m.span.start", "m.span.stop", "m.value").filter(F.col("value") != "")


def match_rectangles(matches: DataFrame, slices: DataFrame) -> DataFrame:
    """matches joined with text slices (doc_id, page, first, last, x, y, width, height, font_size) on overlap; the boxes
    of one match on one visual line (0.6 of the font) are merged, in percent of the page with two decimals."""
    spans = slices.withColumnsRenamed({"first": "start", "last": "stop"})
    pairs = overlap_pairs(matches, spans, ["doc_id", "page"], "start", "stop")
    others = [c for c in slices.columns if c not in ("doc_id", "page", "first", "last")]
    joined = pairs.select("l.*", F.col("r.start").alias("first"), F.col("r.stop").alias("last"), *(F.col(f"r.{c}").alias(c) for c in others))
    share = F.lit(1.0) * (F.col("width") / (F.col("last") - F.col("first")))
    left = F.col("x") + share * F.greatest(F.lit(0), F.col("start") - F.col("first"))
    right = F.col("x") + share * F.least(F.col("last") - F.col("first"), F.col("stop") - F.col("first"))
    boxes = joined.select("doc_id", "page", "seq", left.alias("left"), right.alias("right"), (F.col("y") - F.col("font_size")).alias("top"), F.col("y").alias("bottom"), "font_size", "page_width", "page_height")
    order = Window.partitionBy("doc_id", "page", "seq").orderBy("bottom", "left")
    fresh = F.coalesce(F.col("bottom") - F.lag("bottom").over(order) > 0.6 * F.col("font_size"), F.lit(True)).cast("int")
    lines = boxes.withColumn("line", F.sum(fresh).over(order))
    merged = lines.groupBy("doc_id", "page", "seq", "line").agg(F.min("left").alias("l"), F.max("right").alias("r"), F.min("top").alias("t"), F.max("bottom").alias("b"), F.first("page_width").alias("pw"), F.first("page_height").alias("ph"))
    percent = lambda v, whole: F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), v / whole * 100)), 2)
    return merged.select("doc_id", "page", "seq", "line", percent(F.col("l"), F.col("pw")).alias("x"), percent(F.col("t"), F.col("ph")).alias("y"), percent(F.col("r") - F.col("l"), F.col("pw")).alias("width"), percent(F.col("b") - F.col("t"), F.col("ph")).alias("height"))


def page_labels(pages: DataFrame, style: str = "page_of", first: int = 1) -> DataFrame:
    """doc_id, page, label in one of five styles; pages before the first labelled one get none, but count."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))
    total = F.count("*").over(Window.partitionBy("doc_id")).cast("string")
    x = n.cast("string")
    styles = {"page_of": F.concat(F.lit("Página "), x, F.lit(" de "), total), "slash": F.concat(x, F.lit(" / "), total), "number": x, "sheet_of": F.concat(F.lit("Fls. "), x, F.lit(" de "), total), "sheet": F.concat(F.lit("Fls. "), x)}
    return pages.select("doc_id", "page", F.when(n >= first, styles[style]).alias("label")).filter(F.col("label").isNotNull())


def savings_range(signed: Column, total_bytes: Column, images: Column, image_bytes: Column, object_streams: Column) -> Column:
    """struct(low, high): percent that recompression may save."""
    half_up = lambda v: F.floor(v + 0.5)
    share = image_bytes / total_bytes
    low = F.greatest(F.lit(5), half_up(share * 25))
    high = F.least(F.lit(85), F.greatest(low + 10, half_up(share * 65 + F.when(object_streams, 0).otherwise(8))))
    none, plain = signed | (total_bytes == 0), images == 0
    return F.struct(F.when(none | plain, 0).otherwise(low).cast("int").alias("low"), F.when(none, 0).when(plain, F.when(object_streams | (total_bytes < 4096), 6).otherwise(10)).otherwise(high).cast("int").alias("high"))


def running_budget(pages: DataFrame, limit: int) -> DataFrame:
    """Pages of a document until its character budget is used up; the one that crosses it is cut."""
    before = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = pages.withColumn("before", before).filter(F.col("before") < limit)
    return rows.select("doc_id", "page", F.substring("text", F.lit(1), (limit - F.col("before")).cast("int")).alias("text"), (F.col("before") + F.length("text") > limit).alias("cut"))


def page_text(items: DataFrame) -> DataFrame:
    """doc_id, page, text: items in stream order (seq), a new line where y moves more than 5 points."""
    order = Window.partitionBy("doc_id", "page").orderBy("seq")
    gap = F.abs(F.col("y") - F.lag("y").over(order))
    joiner = F.when(gap.isNull(), F.lit("")).when(gap > 5, F.lit("\n")).otherwise(F.lit(" "))
    parts = items.withColumn("part", F.concat(joiner, F.col("str")))
    return parts.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "part"))), lambda x: x["part"]), "").alias("text"))
