"""Style sheets and addresses that are safe to render, as columns of built-in functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lambdas import bound

REPLACEMENT = "\ufffd"

# What is cut out of a style sheet, in this order, and what takes its place.
COMMENT = r"(?s)/\*.*?(?:\*/|\z)"
ESCAPE = r"\\([0-9a-fA-F]{1,6}[\t\n\f\r ]?|[^\n\f\r])"
REMOVED = (
    (r"(?i)@import\b[^;]*(?:;|\z)", ""),
    (r"(?i)expression\s*\([^)]*\)", "none"),
    (r"(?i)-moz-binding\s*:[^;]*(?:;|\z)", ""),
    (r"(?i)behavior\s*:[^;]*(?:;|\z)", ""),
)
ADDRESS = r"(?is)url\s*\((.*?)\)"
IMAGE_SET = r"(?i)(?:-webkit-)?image-set\s*\([^)]*\)"
# Images that may stand in a page, and what must not occur in a vector image.
DATA_IMAGE = r"(?i)^data:image/(?:png|jpe?g|gif|webp|bmp|avif|ico|tiff|svg\+xml)(?:;[a-z0-9.+-]+=[^;,]+)*(?:;base64)?,"
ACTIVE = r"(?i)<script\b|javascript:|on[a-z]+\s*="
# References inside attributes, as pages use them to hide an address.
NAMED = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "colon": ":", "Tab": "\t", "NewLine": "\n"}
REFERENCE = rf"&(#[xX][0-9A-Fa-f]{{1,8}};?|#[0-9]{{1,9}};?|(?:{'|'.join(NAMED)});)"


def rewritten(text: Column, pattern: str, group: int, change: Callable[[Column], Column], between: Callable[[Column], Column] = lambda c: c) -> Column:
    """text with each match replaced by change(the match's group), and what lies between matches by between(it)."""
    def joined(t: Column) -> Column:
        hits = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), change)
        return F.array_join(F.zip_with(F.split(t, pattern, -1), hits, lambda gap, hit: F.concat(between(gap), F.coalesce(hit, F.lit("")))), "")

    return bound(text, joined)


def code_point(digits: Column) -> Column:
    """The character of a hexadecimal number of up to eight digits; U+FFFD for zero, surrogates and numbers beyond Unicode."""
    number = F.conv(digits, 16, 10).cast("long")
    odd = (number == 0) | (number > 0x10FFFF) | number.between(0xD800, 0xDFFF)
    return F.when(odd, REPLACEMENT).otherwise(F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32"))


def css_unescaped(css: Column) -> Column:
    """Backslash escapes decoded: up to six hexadecimal digits and one blank, or any other character as it is."""

    def one(escape: Column) -> Column:
        digits = F.regexp_extract(escape, r"^([0-9a-fA-F]{1,6})[\t\n\f\r ]?$", 1)
        return F.when(digits == "", escape).otherwise(code_point(digits))

    return bound(css, lambda c: F.when(F.contains(c, F.lit("\\")), rewritten(c, ESCAPE, 1, one)).otherwise(c))


def unreferenced(value: Column) -> Column:
    """Character references of an attribute decoded."""
    named = F.create_map(*(F.lit(x) for pair in NAMED.items() for x in pair))

    def one(name: Column) -> Column:
        bare = F.rtrim(name, F.lit(";"))
        digits = F.when(F.lower(F.substring(bare, 2, 1)) == "x", F.substring(bare, 3, 8)).otherwise(F.conv(F.substring(bare, 2, 9), 10, 16))
        return F.when(F.startswith(bare, F.lit("#")), code_point(digits)).otherwise(F.element_at(named, bare))

    return bound(value, lambda v: F.when(F.contains(v, F.lit("&")), rewritten(v, REFERENCE, 1, one)).otherwise(v))


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def vector_image_source(address: Column) -> Column:
    """What a data address holds, base64 or percent-encoded; as it stands where it is neither."""

    def unpacked(payload: Column) -> Column:
        packed = F.regexp_replace(payload, r"[\t\n\f\r ]", "")
        bare = F.rtrim(packed, F.lit("="))
        whole = packed.rlike(r"^[A-Za-z0-9+/]*={0,2}\z") & (F.length(bare) % 4 != 1) & ((bare == packed) | (F.length(packed) % 4 == 0))
        padded = F.rpad(bare, F.ceil(F.length(bare) / 4).cast("int") * 4, F.lit("="))
        return F.when(whole, F.decode(F.unbase64(padded), "ISO-8859-1")).otherwise(payload)

    def unescaped(payload: Column) -> Column:
        plain = F.try_url_decode(F.replace(payload, F.lit("+"), F.lit("%2B")))
        not_utf8 = lambda p: F.contains(p, F.lit(REPLACEMENT)) & ~F.contains(payload, F.lit(REPLACEMENT)) & ~payload.rlike("(?i)%EF%BF%BD")
        return bound(plain, lambda p: F.when(p.isNull() | not_utf8(p), payload).otherwise(p))

    in_base64 = F.contains(F.lower(F.substring_index(address, ",", 1)), F.lit(";base64"))
    decoded = bound(F.regexp_replace(address, r"(?s)^[^,]*,", ""), lambda p: F.when(in_base64, unpacked(p)).otherwise(unescaped(p)))
    return F.when(F.contains(address, F.lit(",")), decoded).otherwise("")


def is_safe_image(address: Column) -> Column:
    """A data address of an image; a vector image only without scripts, handlers and script addresses."""

    def judged(trimmed: Column) -> Column:
        bare = F.regexp_replace(trimmed, r"[\x00-\x20\x7F]", "")
        vector = bare.rlike(r"(?i)^data:image/svg\+xml")
        return F.when(~bare.rlike(DATA_IMAGE), False).when(vector, ~vector_image_source(trimmed).rlike(ACTIVE)).otherwise(True)

    return bound(_trimmed(address), judged)


def css_address(inner: Column) -> Column:
    """What stands for url(inner): a quoted safe image, or none."""
    bare = _trimmed(F.regexp_replace(_trimmed(inner), r"""(?s)^(['"])(.*)\1\z""", "$2"))
    quoted = lambda b: F.concat(F.lit('url("'), F.replace(b, F.lit('"'), F.lit('\\"')), F.lit('")'))
    return bound(bare, lambda b: F.when(is_safe_image(b), quoted(b)).otherwise("none"))


def clean_css(css: Column) -> Column:
    """A style sheet, or the declarations of an attribute, without comments, escapes, imports, bindings and foreign addresses."""
    out = css_unescaped(F.regexp_replace(F.replace(css, F.lit("\x00"), F.lit("")), COMMENT, ""))
    out = F.regexp_replace(out, COMMENT, "")  # those that escapes hid
    for pattern, instead in REMOVED:
        out = F.regexp_replace(out, pattern, instead)
    out = bound(out, lambda c: F.when(c.rlike(ADDRESS), rewritten(c, ADDRESS, 1, css_address)).otherwise(c))
    return F.regexp_replace(out, IMAGE_SET, "none")
