"""Localised numbers, spreadsheet cells, geometry of images and boxes, and integer prices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three accepted number shapes and the limit on significant digits.
PLAIN = r"^-?(?:0|[1-9]\d*)(?:\.\d+)?$"
COMMA_DECIMAL = r"^-?(?:0|[1-9]\d{0,2}(?:\.\d{3})+|[1-9]\d*),\d+$"
POINT_DECIMAL = r"^-?(?:0|[1-9]\d{0,2}(?:,\d{3})+)\.\d+$"
MAX_DIGITS = 15
#: Spreadsheet styles: integer, decimal, currency, percentage, date.
INTEGER, DECIMAL, CURRENCY, PERCENT, DATE = 2, 3, 4, 5, 6


def _trim(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def _significant(number: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_replace(number, r"[-.]", ""), "^0+", ""))


def localized_text(value: Column) -> Column:
    """The number in plain notation, or null: leading zeros and over 15 significant digits stay text."""
    t = _trim(value)
    plain = (
        F.when(t.rlike(r"^-?0\d"), None)
        .when(t.rlike(PLAIN), t)
        .when(t.rlike(COMMA_DECIMAL), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(t.rlike(POINT_DECIMAL), F.replace(t, F.lit(","), F.lit("")))
    )
    return F.when(_significant(plain) <= MAX_DIGITS, plain)


def localized_number(value: Column) -> Column:
    return localized_text(value).cast("double")


def typed_cell(raw: Column) -> Column:
    """struct(kind, value, style): currency, percentage, date (serial day) or number; else a string."""
    t = _trim(raw)
    money = r"(?i)^(-?\s*)R\$\s*(-?)(.+)$"
    before, after, amount = (F.regexp_extract(t, money, k) for k in (1, 2, 3))
    amount_value = localized_number(amount)
    negative = F.contains(before, F.lit("-")) | F.contains(after, F.lit("-"))
    both = F.contains(before, F.lit("-")) & F.contains(after, F.lit("-"))
    share = localized_number(F.regexp_extract(t, r"^(.+?)\s*%$", 1))
    day = F.try_to_date(F.when(t.rlike(r"^\d{2}/\d{2}/\d{4}$"), t), "dd/MM/yyyy")
    year = F.year(day)
    plain = localized_text(t)
    kinds = [
        (t.rlike(money) & ~both & amount_value.isNotNull(), F.when(negative, -F.abs(amount_value)).otherwise(amount_value), CURRENCY),
        (t.rlike(r"^(.+?)\s*%$") & share.isNotNull(), share / 100, PERCENT),
        (day.isNotNull() & year.between(1900, 2100), F.datediff(day, F.lit("1899-12-30").cast("date")).cast("double"), DATE),
        (plain.isNotNull(), plain.cast("double"), None),
    ]
    value = style = None
    for test, number, kind in kinds:
        look = F.when(F.contains(plain, F.lit(".")), DECIMAL).otherwise(INTEGER) if kind is None else F.lit(kind)
        value = F.when(test, number) if value is None else value.when(test, number)
        style = F.when(test, look) if style is None else style.when(test, look)
    return F.struct(F.when(value.isNull(), F.lit("string")).otherwise(F.lit("number")).alias("kind"), value.alias("value"), style.alias("style"))


def csv_cell(raw: Column, delimiter: str = ",") -> Column:
    """Quotes where needed; what a spreadsheet would run as a formula gets an apostrophe first."""
    numeric = _trim(raw).rlike(PLAIN) & (_significant(_trim(raw)) <= MAX_DIGITS)
    safe = F.when(raw.rlike(r"(?U)^[\s\uFEFF]*[=+@-]") & ~numeric, F.concat(F.lit("'"), raw)).otherwise(raw)
    quote = F.contains(safe, F.lit(delimiter)) | safe.rlike('["\n\r]')
    return F.when(quote, F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def resize_percentage(width: Column, height: Column, percentage: Column) -> Column:
    size = lambda n: F.greatest(F.lit(1), half_up(n * percentage / 100)).cast("long")
    return F.struct(size(width).alias("width"), size(height).alias("height"))


def resize_to_fit(width: Column, height: Column, want_width: Column, want_height: Column, keep_ratio: bool = True, enlarge: bool = True) -> Column:
    """Pixel size inside the wanted box; either side of the box may be null."""
    w, h = width.cast("double"), height.cast("double")
    ratio = w / h
    both = want_width.isNotNull() & want_height.isNotNull()
    if keep_ratio:
        tall = want_width / want_height > ratio
        tw = F.when(both & tall, half_up(want_height * ratio)).when(both, want_width)
        th = F.when(both & tall, want_height).when(both, half_up(want_width / ratio))
    else:
        tw, th = F.when(both, want_width), F.when(both, want_height)
    tw = tw.when(want_width.isNotNull(), want_width).when(want_height.isNotNull(), half_up(want_height * w / h)).otherwise(width)
    th = th.when(want_width.isNotNull(), half_up(want_width * h / w)).when(want_height.isNotNull(), want_height).otherwise(height)
    if not enlarge:
        tw, th = F.least(tw, width), F.least(th, height)
    return F.struct(F.greatest(F.lit(1), half_up(tw)).cast("long").alias("width"), F.greatest(F.lit(1), half_up(th)).cast("long").alias("height"))


def crop_fits(x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column) -> Column:
    x, y, width, height = (half_up(c) for c in (x, y, width, height))
    inside = (x >= 0) & (y >= 0) & (width >= 1) & (height >= 1) & (x + width <= image_width) & (y + height <= image_height)
    return F.coalesce(inside, F.lit(False))


def saved_percent(before: Column, after: Column) -> Column:
    return F.when(before != 0, half_up((before - after) / before * 1000) / 10).otherwise(F.lit(0.0))


#: How far outside the page a vertex may lie.
BOX_TOLERANCE = 0.01


def polygon_box(vertices: Column) -> Column:
    """struct(x, y, width, height) rounded to 6 places; null where fewer than 3 vertices, off the page, or no area."""
    low, high = -BOX_TOLERANCE, 1 + BOX_TOLERANCE
    within = F.forall(vertices, lambda v: F.coalesce(v["x"].between(low, high) & v["y"].between(low, high), F.lit(False)))
    held = lambda f: F.transform(vertices, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), v[f])))
    x0, x1, y0, y1 = F.array_min(held("x")), F.array_max(held("x")), F.array_min(held("y")), F.array_max(held("y"))
    good = (F.size(vertices) >= 3) & within & (x1 > x0) & (y1 > y0)
    return F.when(good, F.struct(F.round(x0, 6).alias("x"), F.round(y0, 6).alias("y"), F.round(x1 - x0, 6).alias("width"), F.round(y1 - y0, 6).alias("height")))


def region_valid(page: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    finite = F.lit(True)
    for c in (x, y, width, height):
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))
    return F.coalesce((page >= 1) & finite & (x >= 0) & (y >= 0) & (width > 0) & (height > 0) & (x + width <= 1) & (y + height <= 1), F.lit(False))


def text_range_valid(start: Column, end: Column) -> Column:
    return F.coalesce((start >= 0) & (start < end), F.lit(False))


@dataclass(frozen=True)
class PriceBook:
    """Integer rates in nano-dollars and the limits that one job is priced by."""

    cpu: int
    memory: int
    ocr_page: int
    character: int
    egress_gib: int
    storage_gib_second: int
    overhead_micros: int
    startup: int
    inspection: int
    download_timeout: int
    upload_timeout: int
    ocr_timeout: int
    translation_timeout: int
    office_timeout: int
    max_downloads: int
    max_download_bytes: int
    input_bytes: int
    output_bytes: int
    result_seconds: int
    cleanup_seconds: int


GIB = 1 << 30


def price_micros(ocr_pages: Column, characters: Column, office_files: Column, book: PriceBook) -> Column:
    """Micro-dollars in exact integers; every division rounds up."""
    whole = lambda n: F.lit(str(n)).cast("decimal(38,0)")
    fixed = book.startup + book.inspection + book.upload_timeout + book.download_timeout * book.max_downloads
    rate = 2 * book.cpu + 4 * book.memory
    compute = F.when(ocr_pages > 0, whole((fixed + book.ocr_timeout) * rate)).when(characters > 0, whole((fixed + book.translation_timeout) * rate)).otherwise(whole((fixed + book.office_timeout) * rate))
    egress = -(-book.max_download_bytes * book.egress_gib // GIB)
    storage = -(-(book.input_bytes + book.output_bytes) * (book.result_seconds + book.cleanup_seconds) * book.storage_gib_second // GIB)
    api = ocr_pages.cast("decimal(18,0)") * book.ocr_page + characters.cast("decimal(18,0)") * book.character
    nanos = (compute + api + whole(egress + storage)).cast("decimal(38,0)")
    return (F.expr("bigint(0)") + F.call_function("div", nanos + 999, F.lit(1000).cast("decimal(38,0)")) + book.overhead_micros).cast("long")
