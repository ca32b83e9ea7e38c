r"""License scans: ordered signature rules behind a keyword prefilter, with priorities and interval containment.

Rules are regexes over the text with A-Z lowered, written by hand (license_rules). A document is searched by a rule only
if the rule's keywords occur in it. Detections are intervals; one that lies inside an interval of a rule with higher (or
equal, earlier) priority is suppressed, so "GNU Lesser General Public License" isn't reported as GPL too, and a full
identifier wins over the bare family name. Phrase labels of the base contract are never suppressed.

The score says how plainly the text names a license: the priority of its plainest detection, in hundredths (a base phrase
counts as a bare family name); 0 if there is none.

Null text: no words, no labels, score 0. Empty text: likewise. Very long texts: whole. Ties: of equal intervals and
priorities the rule listed first. Repeated rows: a row each. Extra columns are ignored. Empty table: empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES

#: Words of a lowered text: ASCII digits and letters, and anything beyond ASCII.
LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}

# The base phrases and their labels.
BASE_PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


@dataclass(frozen=True)
class Signature:
    label: str
    pattern: str
    keywords: tuple[str, ...]
    priority: int


#: Priority of a base phrase, in scores.
BASE_PRIORITY = 40
#: What a blank of a rule stands for: white space of any kind, and the comment marks that a wrapped line begins with.
GAP = r"(?:\s[\s*/#]*)"


def _regex(pattern: str) -> str:
    spaced = re.sub(r"\[[^\]]*\]| ", lambda m: GAP if m[0] == " " else m[0].replace(" ", r"\s"), pattern)
    return rf"(?<![^\W_])(?:{spaced})(?!\.?\d)(?![^\W_])"


def signatures() -> list[Signature]:
    """All rules in order: higher priority first, then as listed."""
    rows = (line.split(" ; ") for line in RULES.strip().splitlines())
    rules = [Signature(label, _regex(pattern), tuple(keywords.split(",")), int(priority)) for label, priority, keywords, pattern in rows]
    return sorted(rules, key=lambda r: -r.priority)


Compiled = list[tuple[Signature, re.Pattern]]


def detect(lowered: str, rules: Compiled, by_keyword: dict[str, list[tuple[int, tuple[str, ...]]]]) -> list[tuple[int, int, str, int]]:
    """start, end, label, priority of what is left after suppression, in text order."""
    wanted = sorted({i for k, found in by_keyword.items() if k in lowered for i, rest in found if all(x in lowered for x in rest)})
    kept: list[tuple[int, int, str, int]] = []
    starts: list[int] = []
    reach: list[int] = []  # the largest end among kept intervals that start no later
    for i in wanted:  # by priority
        rule, pattern = rules[i]
        for m in pattern.finditer(lowered):
            s, e = m.span()
            k = bisect_right(starts, s)
            if s == e or (k and reach[k - 1] >= e):
                continue
            starts.insert(k, s)
            kept.insert(k, (s, e, rule.label, rule.priority))
            reach.insert(k, max(e, reach[k - 1] if k else e))
            for j in range(k + 1, len(reach)):
                if reach[j] >= reach[k]:
                    break
                reach[j] = reach[k]
    return kept


def base_places(words: list[str]) -> list[tuple[int, str]]:
    """Word positions at which a base phrase starts, and its label."""
    firsts = {p[0]: (p, label) for p, label in BASE_PHRASES.items()}
    found = []
    for i, w in enumerate(words):
        if w in firsts:
            phrase, label = firsts[w]
            if tuple(words[i : i + len(phrase)]) == phrase:
                found.append((i, label))
    return found


def compiled() -> tuple[Compiled, dict[str, list[tuple[int, tuple[str, ...]]]]]:
    """Rules by priority; for each keyword, the rules that it may call up and what else they ask for."""
    rules = [(r, re.compile(r.pattern, re.S)) for r in signatures()]
    by_keyword: dict[str, list[tuple[int, tuple[str, ...]]]] = {}
    for i, (r, _) in enumerate(rules):
        for k in r.keywords:
            first, *rest = k.split("&")
            by_keyword.setdefault(first, []).append((i, tuple(rest)))
    return rules, by_keyword


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans (start, end, label in code points)."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", span)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules, by_keyword = compiled()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                lowered = (text or "").translate(LOWER) if not (text or "").isascii() else (text or "").lower()
                words = LICENSE_WORD.findall(lowered)
                places = base_places(words) if "license" in lowered else []
                spans = detect(lowered, rules, by_keyword)
                base = {label for _, label in places}
                labels = base | {label for _, _, label, _ in spans}
                score = max([BASE_PRIORITY] * bool(places) + [priority for *_, priority in spans], default=0) / 100
                rows.append((doc_id, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"start": s, "end": e, "label": label} for s, e, label, _ in spans]))
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<start: long, end: long, label: string>>"
    )
