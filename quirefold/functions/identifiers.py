"""Check digits, numerals and keys, as Column expressions without UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Check-digit weights of the two Brazilian registries.
CPF_WEIGHTS = ((10, 9, 8, 7, 6, 5, 4, 3, 2), (11, 10, 9, 8, 7, 6, 5, 4, 3, 2))
CNPJ_WEIGHTS = ((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))
ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\D", "")


def _weighted(digits: Column, weights: tuple[int, ...]) -> Column:
    terms = [F.substring(digits, i + 1, 1).cast("int") * w for i, w in enumerate(weights)]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def _shaped(digits: Column, length: int) -> Column:
    """Exactly `length` ASCII digits that aren't all the same."""
    return F.coalesce(digits.rlike(rf"^[0-9]{{{length}}}$") & ~digits.rlike(rf"^([0-9])\1{{{length - 1}}}$"), F.lit(False))


def cpf_valid(digits: Column) -> Column:
    checks = [(_weighted(digits, w) * 10 % 11) % 10 == F.substring(digits, len(w) + 1, 1).cast("int") for w in CPF_WEIGHTS]
    return F.when(_shaped(digits, 11), checks[0] & checks[1]).otherwise(F.lit(False))


def cnpj_valid(digits: Column) -> Column:
    def check(w: tuple[int, ...]) -> Column:
        rest = _weighted(digits, w) % 11
        return F.when(rest < 2, 0).otherwise(11 - rest) == F.substring(digits, len(w) + 1, 1).cast("int")

    return F.when(_shaped(digits, 14), check(CNPJ_WEIGHTS[0]) & check(CNPJ_WEIGHTS[1])).otherwise(F.lit(False))


def roman_value(numeral: Column) -> Column:
    """A symbol counts against the total where a larger one stands to its right."""
    symbols = F.reverse(F.regexp_extract_all(F.upper(numeral), F.lit("(?s)(.)")))
    table = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("most"))

    def step(state: Column, symbol: Column) -> Column:
        value = F.coalesce(F.element_at(table, symbol), F.lit(0))
        less = value < state["most"]
        return F.struct(F.when(less, state["total"] - value).otherwise(state["total"] + value).alias("total"), F.when(less, state["most"]).otherwise(value).alias("most"))

    return F.aggregate(symbols, start, step, lambda s: s["total"])


def column_letter(index: Column) -> Column:
    """Spreadsheet letters of a 0-based column number below 18,278 (three letters)."""
    letter = lambda n: F.char(n.cast("int") + 65)
    n = index.cast("long")
    two, three = F.floor(n / 26) - 1, F.floor((F.floor(n / 26) - 1) / 26) - 1
    return F.concat(F.when(three >= 0, letter(three % 26)).otherwise(F.lit("")), F.when(two >= 0, letter(two % 26)).otherwise(F.lit("")), F.when(n >= 0, letter(n % 26)).otherwise(F.lit("")))


def idempotency_id(member: Column, key: Column) -> Column:
    return F.sha2(F.concat_ws("/", member, key), 256)


def request_fingerprint(digest: Column, ocr_pages: Column, characters: Column, office_files: Column, maximum: Column) -> Column:
    """SHA-256 of the JSON array of digest, units and limit, keys in the wire order."""
    units = F.concat(F.lit('{"ocrPages":'), ocr_pages.cast("string"), F.lit(',"characters":'), characters.cast("string"), F.lit(',"officeFiles":'), office_files.cast("string"), F.lit("}"))
    return F.sha2(F.concat(F.lit('["'), digest, F.lit('",'), units, F.lit(","), maximum.cast("string"), F.lit("]")), 256)
