"""Text review: rules with protected spans, context, greedy acceptance; merging and applying findings; spelling.

Offsets are code points. Findings of a document depend on each other only through overlap, in rule order, so a
document is reviewed in one go inside an Arrow batch; anti-joins and spell checking are joins.
"""

from __future__ import annotations

import re
import re._parser as parser
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.slices import map_slices
from .intervals import Taken, accept_spans, without_overlaps
from .review_rules import ALTERNATIVES, GROUPS, MESSAGES, SUGGESTED, WARNED

MAX_CHARACTERS = 1_000_000
INNER = "[\\w\u0300-\u036f]"
PROTECTED = re.compile(r"https?://\S+|www\.\S+|[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}|\{\{[^{}]*\}\}|\$\{[^{}]*\}", re.A)


@dataclass(frozen=True)
class Context:
    """Finds of `category` that begin with `found` are right as they stand if `near` says so.

    near is searched in the text before the find, or from it on; `unless` turns it round: right unless near is found.
    """

    category: str
    found: re.Pattern
    near: re.Pattern
    where: str  # before or from
    unless: bool = False

    def excuses(self, text: str, start: int, found: str) -> bool:
        if not self.found.match(found):
            return False
        around = text[max(0, start - AROUND) : start] if self.where == "before" else text[start : start + AROUND]
        return bool(self.near.search(around)) != self.unless


def _pattern(text: str) -> re.Pattern:
    return re.compile(text, re.I)


#: Characters that are looked at around a finding.
AROUND = 80
# Words that may stand as they are, by category, and the context that says so.
CONTEXTS = {
    # nouns whose bare spelling is a verb form: only a determiner or a noun before them makes them nouns
    "ACCENTUATION": [
        Context(
            "ACCENTUATION",
            _pattern(r"(?:negocios?|public[oa]s?|duvidas?|numeros?|modulos?|historias?|paginas?|veiculos?)\Z"),
            _pattern(r"(?:^|[\W\d_])(?:o|a|os|as|um|uma|uns|umas|este|esta|esse|essa|seu|sua|meu|minha|do|da|dos|das|no|na|pelo|pela|documento|escola|instituição|serviço|serviços)\s+\Z"),
            "before",
            unless=True,
        )
    ],
    "GRAMMAR_AGREEMENT": [
        # an idiom in which the plural is right
        Context("GRAMMAR_AGREEMENT", _pattern(r"houveram\s"), _pattern(r"\Ahouveram\s+por\s+bem\b"), "from"),
        # a pronoun that is a subject only where a clause begins
        Context("GRAMMAR_AGREEMENT", _pattern(r"nos\s"), _pattern(r"(?:^|[.!?:;]\s*)\Z"), "before", unless=True),
    ],
    # the noun, not the verb, where a determiner stands before it
    "PARONYM_CONTEXT": [Context("PARONYM_CONTEXT", _pattern(r"agente\s"), _pattern(r"(?:^|[\W\d_])(?:o|um|este|esse|aquele|ao|do|pelo|seu|meu)\s+\Z"), "before")],
}


def match_case(source: str, target: str) -> str:
    """target in capitals, with a capital first letter or as it is, as source is written; functions.text has it for columns."""
    if source and source == source.upper():
        return target.upper()
    if source and source[0] == source[0].upper():
        return target[:1].upper() + target[1:]
    return target


@dataclass(frozen=True)
class Rule:
    category: str
    severity: str
    pattern: re.Pattern
    correct: Callable[[re.Match], str]
    suggest: Callable[[re.Match], list[str]]
    heads: frozenset[str] = frozenset([""])  # every match starts with one of them, case-folded; a text without any needn't be searched


def _filled(template: str, match: re.Match, table: dict[str, str] | None) -> str:
    def group(m: re.Match) -> str:
        kind, number = m[1], int(m[2])
        text = match[number] or ""
        return table[text.lower()] if kind == "t" else text.lower() if kind == "l" else text

    return re.sub(r"\\([lt]?)(\d)", group, template)


def _corrector(correction: str | tuple[str, dict[str, str]]) -> Callable[[re.Match], str]:
    template, table = correction if isinstance(correction, tuple) else (correction, None)

    def correct(match: re.Match) -> str:
        if template[0] == "=":
            return _filled(template[1:], match, table)
        if template[0] == "@":  # only the first word follows the match's case
            word, rest = re.match(r"(\w+)(.*)", template[1:]).groups()
            return match_case(match[1], word) + _filled(rest, match, table)
        return match_case(match[0], _filled(template, match, table))

    return correct


#: Openings of a pattern that are told apart, at most.
HEADS = 24


def _openings(sequence) -> tuple[set[str], bool]:
    """Strings one of which any match begins with, and whether they are all that the pattern says."""
    heads = {""}
    for op, value in sequence:
        name, whole = str(op), True
        if name == "LITERAL":
            more = {chr(value)}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
            more = {chr(v) for _, v in value}
        elif name == "SUBPATTERN":
            more, whole = _openings(value[3])
        elif name == "BRANCH":
            parts = [_openings(branch) for branch in value[1]]
            more, whole = set().union(*(p[0] for p in parts)), all(p[1] for p in parts)
        elif name == "MAX_REPEAT" and value[0] == 0 and int(value[1]) == 1:
            more, whole = _openings(value[2])
            more = more | {""}
        elif name == "AT":
            continue
        else:
            return heads, False
        if len(heads) * len(more) > HEADS:
            return heads, False
        heads = {h + m for h in heads for m in more}
        if not whole:
            return heads, False
    return heads, True


def _heads(pattern: str) -> frozenset[str]:
    found = {h.casefold() for h in _openings(parser.parse(pattern))[0]}
    return frozenset(h for h in found if not any(h != x and h.startswith(x) for x in found))


def _rules() -> list[Rule]:
    out = [Rule("DUPLICATE_WORD", "warning", re.compile(rf"(?<!{INNER})([^\W_](?:[^\W_]|['’-])*)[ \t]+\1(?!{INNER})", re.I), lambda m: m[1], lambda m: [m[1]])]
    for category, severity, rules in GROUPS:
        for pattern, correction in rules:
            level = "suggestion" if pattern in SUGGESTED else "warning" if pattern in WARNED else severity
            correct = _corrector(correction)
            more = [_corrector(x) for x in ALTERNATIVES.get(pattern, ())]
            only = category == "STYLE_SUGGESTION" and len(more) > 1
            suggest = (lambda m, more=more: [f(m) for f in more]) if only else (lambda m, first=correct, more=more: [first(m), *(f(m) for f in more)])
            closed = pattern if "(?=" in pattern else rf"{pattern}(?!{INNER})"
            out.append(Rule(category, level, re.compile(rf"(?<!{INNER}){closed}", re.I), correct, suggest, _heads(pattern)))
    for category, pattern, text in (("SPACE_BEFORE_PUNCTUATION", r"[ \t]+(?=[,.;:!?])", ""), ("TRAILING_WHITESPACE", r"(?m)[ \t]+(?=\r?$)", ""), ("REPEATED_WHITESPACE", r"[ \t]{2,}", " ")):
        out.append(Rule(category, "suggestion", re.compile(pattern), lambda m, t=text: t, lambda m, t=text: [t]))
    return out


RULES = _rules()


def review_text(text: str | None) -> list[tuple]:
    """category, severity, start, end, original, replacement, suggestions; by start."""
    text = text or ""
    if len(text) > MAX_CHARACTERS:
        raise ValueError(f"more than {MAX_CHARACTERS} characters")
    guarded = [m.span() for m in PROTECTED.finditer(text)]
    starts = [s for s, _ in guarded]
    taken, out, folded = Taken(), [], text.casefold()
    for rule in RULES:
        if not any(head in folded for head in rule.heads):
            continue
        for m in rule.pattern.finditer(text):
            s, e = m.span()
            k = bisect_right(starts, e - 1)
            excused = any(c.excuses(text, s, m[0]) for c in CONTEXTS.get(rule.category, ()))
            if (k and guarded[k - 1][1] > s) or excused or not taken.add(s, e):
                continue
            out.append((rule.category, rule.severity, s, e, m[0], rule.correct(m), rule.suggest(m)))
    return sorted(out, key=lambda f: f[2:4])


FINDING_COLUMNS = ["doc_id", "category", "severity", "start", "end", "original", "replacement", "suggestions", "message", "error"]
FINDING_SCHEMA = "doc_id long, category string, severity string, start int, end int, original string, replacement string, suggestions array<string>, message string, error string"


def review(docs: DataFrame) -> DataFrame:
    """A row for each finding; a text over the limit yields one row with only its error."""

    def scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                try:
                    rows += [(doc_id, *f, MESSAGES[f[0]], None) for f in review_text(text)]
                except ValueError as problem:
                    rows.append((doc_id, *[None] * 8, str(problem)))
            yield pd.DataFrame(rows, columns=FINDING_COLUMNS).astype({"start": "Int32", "end": "Int32"})

    # texts are few bytes for much work: they are dealt out in a number of parts that Spark doesn't lower
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return map_slices(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartition(parts), scan, FINDING_SCHEMA)


def outside_spans(findings: DataFrame, protected: DataFrame) -> DataFrame:
    """Findings that overlap no protected span of their document."""
    return without_overlaps(findings, protected, ["doc_id"])


def merge_findings(primary: DataFrame, secondary: DataFrame) -> DataFrame:
    """Primary findings first, by position, then secondary ones in order; each only if it overlaps nothing accepted."""
    place = F.col("seq") if "seq" in secondary.columns else F.col("start")
    both = primary.select("*", F.lit(0).alias("rank"), F.col("start").alias("place")).unionByName(secondary.select("*", F.lit(1).alias("rank"), place.alias("place")))
    return accept_spans(both, ["doc_id"], ["rank", "place"]).select(*primary.columns)


def apply_findings(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """doc_id, text with replacements made from right to left, error where a finding is stale or overlaps another."""
    gathered = findings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "original", "replacement")), asc=False).alias("fs"))
    joined = docs.select("doc_id", "text").join(gathered, "doc_id", "left")
    start = F.struct(F.col("text").alias("text"), F.length("text").alias("bound"), F.lit(True).alias("fine"))

    def step(state: F.Column, f: F.Column) -> F.Column:
        held = F.substring(F.col("text"), f["start"] + 1, f["end"] - f["start"])
        fine = state["fine"] & (f["start"] >= 0) & (f["end"] > f["start"]) & (f["end"] <= state["bound"]) & (held == f["original"])
        text = F.concat(F.substring(state["text"], F.lit(1), f["start"]), f["replacement"], F.substring(state["text"], f["end"] + 1, F.length(state["text"])))
        return F.struct(F.when(fine, text).otherwise(state["text"]).alias("text"), f["start"].alias("bound"), fine.alias("fine"))

    done = F.aggregate(F.coalesce("fs", F.array().cast("array<struct<start: int, end: int, original: string, replacement: string>>")), start, step)
    return joined.withColumn("done", done).select("doc_id", F.when(F.col("done.fine"), F.col("done.text")).alias("text"), F.when(~F.col("done.fine"), F.lit("stale or overlapping finding")).alias("error"))


WORD = r"[\p{L}\p{M}\p{N}_'’-]+"


def vocabulary(words: DataFrame) -> DataFrame:
    """word: trimmed, lower case, distinct, without empty ones."""
    return words.select(F.lower(F.trim("word")).alias("word")).filter(F.col("word") != "").distinct()


def unknown_words(docs: DataFrame, dictionary: DataFrame, custom: DataFrame | None = None) -> DataFrame:
    """doc_id, word, count of words in neither list. Skipped: one character, acronyms, digits, underscores, addresses."""
    known = vocabulary(dictionary)
    if custom is not None:
        known = known.unionByName(vocabulary(custom)).distinct()
    bare = F.regexp_replace("text", r"https?://\S+|www\.\S+|[A-Za-z0-9_.%+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}", " ")
    words = docs.select("doc_id", F.explode(F.regexp_extract_all(bare, F.lit(WORD), F.lit(0))).alias("word"))
    checked = words.filter((F.length("word") > 1) & ~F.col("word").rlike(r"[\p{N}_]") & ~F.col("word").rlike(r"^\p{Lu}{2,8}$"))
    counted = checked.groupBy("doc_id", "word").agg(F.count("*").alias("count"))
    return counted.withColumn("lower", F.lower("word")).join(known.withColumnRenamed("word", "lower"), "lower", "left_anti").select("doc_id", "word", "count")


def _shortened(word: F.Column) -> F.Column:
    """The word and all it can become by deleting one or two characters."""
    without = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))
    once = without(word)
    return F.array_distinct(F.concat(F.array(word), once, F.flatten(F.transform(once, without))))


def suggestions(unknown: DataFrame, dictionary: DataFrame, most: int = 4, distance: int = 2) -> DataFrame:
    """word, suggestion, distance, place: the nearest known words of each distinct unknown one, ties by alphabet.

    Two words within two edits share a form that both reach by at most two deletions, so an equi-join finds all pairs and
    nothing is compared with the whole dictionary.
    """
    asked = unknown.select(F.lower("word").alias("word")).distinct().select("word", F.explode(_shortened(F.col("word"))).alias("form"))
    known = vocabulary(dictionary).select(F.col("word").alias("suggestion"), F.explode(_shortened(F.col("word"))).alias("form"))
    pairs = asked.join(known, "form").select("word", "suggestion").distinct()
    near = pairs.withColumn("distance", F.levenshtein("word", "suggestion")).filter(F.col("distance").between(1, distance))
    place = F.row_number().over(Window.partitionBy("word").orderBy("distance", "suggestion"))
    return near.withColumn("place", place).filter(F.col("place") <= most)
