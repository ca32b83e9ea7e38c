"""Text functions: tokens, cleaning, escaping, comparison and small classifiers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lambdas import bound

TOKEN = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N}]"
COUNTED = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*"
#: What str.splitlines() breaks at.
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\u0085\u2028\u2029]"
SPACE = r"(?U)\s"


def tokens(text: Column) -> Column:
    """Words and single other characters; nothing is lost."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(COUNTED))


def split_lines(text: Column) -> Column:
    """Lines without terminators; a final terminator opens no empty line."""
    parts = F.split(text, LINE_BREAK, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def text_metrics(text: Column) -> Column:
    words = F.regexp_count(text, F.lit(r"(?U)\S+"))
    return F.struct(F.length(text).cast("long").alias("chars"), words.cast("long").alias("words"), F.size(split_lines(text)).cast("long").alias("lines"))


# The words that vote for each language.
PORTUGUESE = ("de", "da", "do", "em", "para", "com", "não", "que", "os", "as", "um", "uma")
ENGLISH = ("of", "the", "in", "to", "with", "not", "that", "and", "is", "are", "a", "an")


def _votes(text: Column, words: tuple[str, ...]) -> Column:
    # a look at the first letter is cheaper than a word boundary
    initials = "".join(sorted({w[0] for w in words}))
    return F.regexp_count(F.lower(text), F.lit(rf"(?U)(?=[{initials}])\b(?:{'|'.join(words)})\b"))


def language_vote(text: Column) -> Column:
    return F.when(_votes(text, PORTUGUESE) >= _votes(text, ENGLISH), F.lit("pt-BR")).otherwise(F.lit("en"))


def escape_xml(text: Column) -> Column:
    out = F.regexp_replace(text, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\uFFFE\\uFFFF]", "")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def escape_markdown(text: Column) -> Column:
    out = text
    for raw, safe in (("\\", "\\\\"), ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    out = F.regexp_replace(out, r"([*_\[\]`|])", r"\\$1")
    return F.when(text.rlike(r"(?U)^[-\s]{3,}$"), F.replace(out, F.lit("-"), F.lit("\\-"))).otherwise(out)


def clean_html_text(text: Column) -> Column:
    """Decodes six references one after another, so &amp;lt; ends as <; then collapses white space."""
    out = text
    for raw, plain in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")):
        out = F.replace(out, F.lit(raw), F.lit(plain))
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def match_case(source: Column, target: Column) -> Column:
    first = F.substring(source, 1, 1)
    capital = F.concat(F.upper(F.substring(target, 1, 1)), F.substring(target, 2, 1 << 30))
    return F.when((source == "") | (target == ""), target).when(source == F.upper(source), F.upper(target)).when(first == F.upper(first), capital).otherwise(target)


NEUTRAL = "[marcador_neutro]"


def sanitize_document_text(text: Column) -> Column:
    """Drops NULs, neutralises role tags, and bounds runs of blanks and line ends."""
    out = F.replace(text, F.lit("\x00"), F.lit(""))
    out = F.regexp_replace(out, r"(?i)</?(?U:\s*)(?:documento_fonte|sistema|system|instrucoes|assistant|user)\b[^>]*>", NEUTRAL.replace("[", r"[").replace("]", r"]"))
    out = F.regexp_replace(out, "\r\n?", "\n")
    out = F.regexp_replace(out, "[ \t]{3,}", " ")
    out = F.regexp_replace(out, "\n{4,}", "\n\n\n")
    return F.regexp_replace(out, r"(?U)^\s+|\s+$", "")


def page_citation(first: Column, last: Column) -> Column:
    one = F.concat(F.lit("[p. "), first.cast("string"), F.lit("]"))
    return F.when(first == last, one).otherwise(F.concat(F.lit("[p. "), first.cast("string"), F.lit("–"), last.cast("string"), F.lit("]")))


def clean_line(text: Column) -> Column:
    """Trimmed, with blanks for line ends and tabs; null if other control characters are inside."""
    t = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    spaced = F.translate(t, "\n\r\t", "   ")
    return F.when(spaced.rlike(r"[\x00-\x1F\x7F-\x9F]"), None).otherwise(spaced)


def digit_groups(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{Nd}+"), F.lit(0))


def numbers_missing(expected: Column, output: Column) -> Column:
    return F.array_except(expected, digit_groups(output))


def names_missing(names: Column, output: Column) -> Column:
    return F.filter(names, lambda n: ~F.contains(output, n))


# Negation words by language.
NEGATIONS = {
    "pt": ("não", "nunca", "nem", "jamais", "sem", "nenhum", "nenhuma", "ninguém", "nada"),
    "en": ("not", "no", "never", "cannot", "without", "neither", "nor", "none", "nothing", "nobody"),
    "es": ("no", "nunca", "ni", "jamás", "sin", "ningún", "ninguno", "ninguna", "nadie", "nada", "tampoco"),
}


def negation_count(text: Column, language: Column) -> Column:
    """Negation words of the language in the text; null for a language without a list."""
    words = F.split(F.lower(text), r"[^\p{L}\p{M}'’]+", -1)
    listed = F.create_map(*(x for lang, marks in NEGATIONS.items() for x in (F.lit(lang), F.array(*(F.lit(m) for m in marks)))))
    marks = F.element_at(listed, language)
    found = F.size(F.filter(words, lambda w: F.array_contains(marks, w)))
    contracted = F.when(language == "en", F.size(F.filter(words, lambda w: w.rlike("n['’]t$")))).otherwise(0)
    return F.when(marks.isNotNull(), found + contracted)


def negation_status(source: Column, source_language: Column, output: Column, output_language: Column) -> Column:
    before, after = negation_count(source, source_language), negation_count(output, output_language)
    return F.when(before.isNull() | after.isNull(), F.lit("language-not-covered")).when(before == 0, F.lit("absent-in-source")).when(after > 0, F.lit("marker-present")).otherwise(F.lit("marker-missing"))


def normalize_nfc(text: Column) -> Column:
    """NFC with white space collapsed and trimmed. Spark has no normalisation of its own; ICU, which it comes with, does it in the JVM."""
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(False))
    return F.when(text.isNotNull(), F.trim(F.regexp_replace(composed, r"(?U)[\s\x1C-\x1F]+", " ")))


@F.pandas_udf(StringType())
def strip_accents(text: pd.Series) -> pd.Series:
    """NFKD without combining marks; Spark has no normalisation of its own."""
    return text.map(lambda t: None if t is None else "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)))


def search_form(text: Column) -> Column:
    return F.lower(strip_accents(text))


def character_error_rate(reference: Column, output: Column) -> Column:
    """Edits by code point over the reference's length; null for an empty reference. Both sides already normalised."""
    return F.when(F.length(reference) > 0, F.levenshtein(reference, output) / F.length(reference))


def _lettered(words: Column, known: Column) -> Column:
    """One character a word: its place among the known ones, counted from U+10000."""
    places = F.transform(words, lambda w: F.lpad(F.hex(F.array_position(known, w) + 0xFFFF), 8, "0"))
    return F.decode(F.unhex(F.array_join(places, "")), "UTF-32")


def word_error_rate(reference: Column, output: Column) -> Column:
    """Edits by word over the reference's words; null for an empty reference. Words become characters, so that edits are Spark's own."""
    split = lambda text: F.split(text, " ", -1)
    edits = lambda sides, known: F.levenshtein(_lettered(sides[0], known), _lettered(sides[1], known))
    rate = bound(F.array(split(reference), split(output)), lambda sides: bound(F.array_distinct(F.flatten(sides)), lambda known: edits(sides, known)) / F.size(sides[0]))
    return F.when((F.length(reference) > 0) & output.isNotNull(), rate)
