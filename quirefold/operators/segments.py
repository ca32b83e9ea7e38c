"""Segmentation, placeholder masking, page chunking and citations."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.slices import map_slices
from ..functions.text import page_citation, sanitize_document_text

SEGMENT = 4000
MAX_SEGMENTS = 10_000
# What a translation must not touch.
PLACEHOLDER = r"https?://\S+|\{\{[^{}]+\}\}|\{[^{}]+\}|%\([^)]+\)[a-zA-Z]|%[a-zA-Z]"
SENTINEL = "QFPLACEHOLDER"


def line_segments(docs: DataFrame, length: int = SEGMENT) -> DataFrame:
    """doc_id, seq, segment: lines with their terminators, cut into pieces; concatenated they are the text."""
    blocks = F.regexp_extract_all("text", F.lit("[^\r\n]*(?:\r\n|\n|\r)|[^\r\n]+"), F.lit(0))
    cut = lambda b: F.transform(F.sequence(F.lit(0), F.floor((F.length(b) - 1) / length).cast("int")), lambda k: F.substring(b, (k * length + 1).cast("int"), F.lit(length)))
    pieces = F.flatten(F.transform(blocks, cut))
    return docs.select("doc_id", F.posexplode(pieces).alias("seq", "segment"))


def segment_errors(docs: DataFrame) -> DataFrame:
    """Documents with more segments than a request may have."""
    counts = line_segments(docs).groupBy("doc_id").count()
    return counts.filter(F.col("count") > MAX_SEGMENTS).select("doc_id", F.lit(f"more than {MAX_SEGMENTS} segments").alias("error"))


def mask_placeholders(text: Column) -> Column:
    """struct(masked, placeholders): each is replaced by a numbered sentinel, in order of appearance."""
    found = F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))
    between = F.split(text, PLACEHOLDER, -1)
    masked = F.array_join(F.transform(between, lambda part, i: F.concat(F.when(i > 0, F.concat(F.lit(SENTINEL), (i - 1).cast("string"), F.lit("TOKEN"))).otherwise(F.lit("")), part)), "")
    return F.struct(masked.alias("masked"), found.alias("placeholders"))


def restore_placeholders(text: Column, placeholders: Column) -> Column:
    """struct(text, error): null text unless every sentinel came back exactly once."""
    token = rf"{SENTINEL}(\d+)TOKEN"
    numbers = F.transform(F.regexp_extract_all(text, F.lit(token), F.lit(1)), lambda n: n.cast("int"))
    fine = (F.size(numbers) == F.size(placeholders)) & (F.array_sort(numbers) == F.transform(placeholders, lambda _, i: i))
    between = F.split(text, rf"{SENTINEL}\d+TOKEN", -1)
    restored = F.array_join(F.transform(between, lambda part, i: F.concat(F.when(i > 0, F.coalesce(F.get(placeholders, F.get(numbers, i - 1)), F.lit(""))).otherwise(F.lit("")), part)), "")
    return F.struct(F.when(fine, restored).alias("text"), F.when(~fine, F.lit("placeholders were lost, repeated or invented")).alias("error"))


LITERAL = r"https?://[^\s<>]*[^\s<>.,;:!?]|www\.[^\s<>]*[^\s<>.,;:!?]|[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}|\{\{[^{}]*\}\}|\$\{[^{}]*\}|%[A-Za-z_][A-Za-z_0-9]*%"
#: A sentence ends after ., !, ? or an ellipsis with closing marks, before white space; our rule in place of ICU's.
SENTENCE_END = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s)")


def _sentences(prose: str) -> Iterator[str]:
    """Sentences with the white space before them."""
    ends = [m.end() for m in SENTENCE_END.finditer(prose)]
    return (prose[a:b] for a, b in zip([0, *ends], [*ends, len(prose)], strict=True))


def translation_chunks(text: str | None, most: int = 400, names: tuple[str, ...] = ()) -> list[str]:
    """Pieces of at most `most` characters whose concatenation is the text; literals, names and line ends stay whole.

    Prose is cut into sentences, and a sentence into as many whole words as a piece holds; only a longer word is cut.
    White space between pieces is a piece, and so is text without a word character.
    """
    if most < 2:
        raise ValueError("chunks need two characters at least")
    if not (text or "").strip():
        return []
    longest_first = sorted({n.strip() for n in names} - {""}, key=lambda n: (-len(n), n))
    whole = [rf"(?<!\w)(?:{'|'.join(map(re.escape, longest_first))})(?!\w)"] if longest_first else []
    kept = re.compile("|".join([*whole, LITERAL, r"\r\n", r"[\r\n\t]+"]))
    piece = re.compile(rf"\s+|\S(?:.{{0,{most - 2}}}\S)?(?=\s|\Z)|\S{{1,{most}}}", re.S)
    chunks: list[str] = []
    at = 0
    for m in [*kept.finditer(text), None]:
        prose = text[at : m.start() if m else len(text)]
        if re.search(r"\w", prose):
            chunks += [p for s in _sentences(prose) for p in piece.findall(s)]
        elif prose:
            chunks.append(prose)
        if m:
            chunks.append(m[0])
            at = m.end()
    return chunks


def translation_segments(docs: DataFrame, most: int = 400, names: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, seq, chunk, preserved."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = re.compile(LITERAL)
        for frame in frames:
            rows = [(d, k, c, c in names or not re.search(r"\w", c) or bool(whole.fullmatch(c))) for d, text in zip(frame["doc_id"], frame["text"], strict=True) for k, c in enumerate(translation_chunks(text, most, names))]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "chunk", "preserved"])

    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scan, "doc_id long, seq int, chunk string, preserved boolean")


TARGET, OVERLAP, MAX_PAGES, MAX_CHUNKS, MIN_CHARACTERS = 3600, 240, 120, 18, 40


def page_chunks(pages: list[tuple[int, str]], target: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """first page, last page, text. As many pages as fit target together; a page beyond it alone, in overlapping slices."""
    target = max(400, target)
    step = target - sorted((0, overlap, target // 2))[1]
    shown = [(number, f"[Página {number}]\n", text) for number, text in pages if text]
    # of pages i to j, joined by two line feeds: ends[j] - ends[i] - 2
    ends = list(accumulate((len(head) + len(text) + 2 for _, head, text in shown), initial=0))
    at = 0
    while at < len(shown):
        number, head, text = shown[at]
        after = bisect_right(ends, ends[at] + target + 2) - 1
        if after > at:
            yield number, shown[after - 1][0], "\n\n".join(head + text for _, head, text in shown[at:after])
        else:
            yield from ((number, number, head + text[start : start + target]) for start in range(0, max(0, len(text) - target) + step, step))
        at = max(after, at + 1)


def pack_pages(pages: list[tuple[int, str]], target: int = TARGET, overlap: int = OVERLAP, most: int = MAX_CHUNKS) -> list[tuple[int, int, str]]:
    return list(islice(page_chunks(pages, target, overlap), most))


CHUNK_SCHEMA = "doc_id long, chunk_no int, first_page int, last_page int, text string, truncated boolean, error string"


def chunk_pages(pages: DataFrame, target: int = TARGET, overlap: int = OVERLAP, max_pages: int = MAX_PAGES, most: int = MAX_CHUNKS) -> DataFrame:
    """pages: doc_id, page_number, text. Only the first max_pages of a document enter its group, so groups are bounded."""

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("page_number")
        doc_id, total = int(frame["doc_id"].iloc[0]), int(frame["total"].iloc[0])
        if frame["solid"].sum() < MIN_CHARACTERS:
            return pd.DataFrame([(doc_id, 0, None, None, None, False, "too little text")], columns=_CHUNK_COLUMNS).astype(_CHUNK_TYPES)
        chunks = pack_pages(list(zip(frame["page_number"].tolist(), frame["text"], strict=True)), target, overlap, most)
        cut = total > max_pages or (bool(chunks) and chunks[-1][1] < int(frame["last_page"].iloc[0]))
        return pd.DataFrame([(doc_id, k, a, b, t, cut, None) for k, (a, b, t) in enumerate(chunks)], columns=_CHUNK_COLUMNS).astype(_CHUNK_TYPES)

    totals = pages.groupBy("doc_id").agg(F.count("*").alias("total"), F.max("page_number").alias("last_page"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))
    usable = pages.withColumn("place", place).filter(F.col("place") <= max_pages).join(totals, "doc_id")
    clean = usable.select(F.col("doc_id").cast("long").alias("doc_id"), "page_number", sanitize_document_text(F.coalesce("text", F.lit(""))).alias("text"), F.length(F.regexp_replace("text", r"\s+", "")).alias("solid"), "total", "last_page")
    return clean.groupBy("doc_id").applyInPandas(pack, CHUNK_SCHEMA)


_CHUNK_COLUMNS = [c.split()[0] for c in CHUNK_SCHEMA.split(", ")]
_CHUNK_TYPES = {"first_page": "Int32", "last_page": "Int32"}


def text_slices(docs: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, seq, first (code point), slice: one long text in overlapping windows."""
    step = target - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - target) / F.lit(step))).cast("int")
    sliced = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("seq"), (k * step).alias("first"), F.substring("text", k * step + 1, F.lit(target)).alias("slice")))
    return docs.filter(F.length("text") > 0).select("doc_id", F.explode(sliced).alias("s")).select("doc_id", "s.*")


CITATION = r"(?i)\[p\.\s*(\d+)(?:\s*[–-]\s*(\d+))?\]"


def citations(docs: DataFrame, total: str = "total_pages") -> DataFrame:
    """doc_id, seq, label, first_page, last_page: valid citations in first-seen order, ends held within the document."""
    both = F.arrays_zip(F.regexp_extract_all("text", F.lit(CITATION), F.lit(1)).alias("a"), F.regexp_extract_all("text", F.lit(CITATION), F.lit(2)).alias("b"))
    pages = F.greatest(F.lit(1), F.col(total))
    rows = docs.select("doc_id", pages.alias("pages"), F.posexplode(both).alias("at", "c"))
    first = F.expr("try_cast(c.a AS INT)")
    last = F.coalesce(F.expr("try_cast(NULLIF(c.b, '') AS INT)"), first)
    held = rows.withColumn("first_page", first).withColumn("last_page", F.least(F.col("pages"), F.greatest(first, last))).filter((F.col("first_page") >= 1) & (F.col("first_page") <= F.col("pages")))
    distinct = held.groupBy("doc_id", "first_page", "last_page").agg(F.min("at").alias("seq"))
    return distinct.select("doc_id", "seq", page_citation(F.col("first_page"), F.col("last_page")).alias("label"), "first_page", "last_page")


@F.pandas_udf(StringType())
def rewrite_citations(text: pd.Series, total: pd.Series) -> pd.Series:
    """Text with citations relabelled, out-of-range ones dropped, and blanks tidied."""
    pattern = re.compile(r"\[p\.\s*(\d+)(?:\s*[–-]\s*(\d+))?\]", re.I)

    def one(t: str | None, pages: int) -> str | None:
        if t is None:
            return None
        pages = max(1, int(pages))

        def label(m: re.Match) -> str:
            a = int(m[1])
            b = min(pages, max(a, int(m[2] or a)))
            return "" if not 1 <= a <= pages else f"[p. {a}]" if a == b else f"[p. {a}–{b}]"

        return re.sub(" {2,}", " ", re.sub(r"[ \t]+\n", "\n", pattern.sub(label, t))).strip()

    return pd.Series([one(t, p) for t, p in zip(text, total, strict=True)], dtype="object")


def summary_prompt(chunk: Column, citation: Column, mode: str) -> Column:
    """The request for one chunk; what stands inside the source tags is data."""
    tasks = {"executive": "Resuma os pontos principais.", "obligations-dates": "Liste obrigações, prazos e datas.", "by-section": "Resuma seção por seção."}
    return F.concat(F.lit(f"{tasks[mode]} Cite páginas como [p. X]. Trecho "), citation, F.lit(":\n<documento_fonte>\n"), chunk, F.lit("\n</documento_fonte>"))
