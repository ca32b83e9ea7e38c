"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one long whose bit b is set if rule b
failed. Policies (a version and a mask of rules that reject) are applied later without reading texts again, and
ablations are bitwise aggregates over the distinct bitmasks.

Null text: no words, all counts 0. Empty text: likewise. Very long texts: whole. Repeated rows and ids: a ledger row for
each input row; ties don't occur. Empty table: empty ledger. Extra columns are ignored by the ledger and kept by keep_good,
whatever their names. A policy without the base rules may keep what they reject, so quality_report always applies both.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import WORD_BREAKS

SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stutter", "n_upper", "n_letters", "n_digits")
UPPER, LETTERS, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"0123456789"


@dataclass(frozen=True)
class Rule:
    """fails: SQL over the measurements, true if the document fails."""

    bit: int
    name: str
    fails: str


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "5 * n_symbols > n_words"),
    Rule(3, "duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule(4, "shouting", "n_letters >= 40 AND 2 * n_upper > n_letters"),
    Rule(5, "word_length", "word_chars < 2 * n_words OR word_chars > 25 * n_words"),
    Rule(6, "digits", "2 * n_digits > word_chars"),
    Rule(7, "stutter", "10 * n_stutter > 3 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STANDARD = Policy("2024.1", tuple(r.name for r in RULES))


def repeat_words(words: list[bytes], size: int = 5) -> int:
    """Words inside windows of `size` words found twice or more in the text."""
    if len(words) < size:
        return 0
    grams = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    covered = reach = 0
    for i, gram in enumerate(grams):
        if seen[gram] > 1:
            covered += i + size - max(i, reach)
            reach = i + size
    return covered


def measure(text: str | None) -> tuple[int, ...]:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in text.split("\n") if line.strip(WORD_BREAKS)]
    count = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words),
        len(text) - count(WORD_BREAKS.encode()),
        count(SYMBOLS.encode()),
        len(lines),
        len(lines) - len(set(lines)),
        repeat_words(words),
        sum(map(eq, words, words[1:])),
        count(UPPER),
        count(LETTERS),
        count(DIGITS),
    )


def measured(docs: DataFrame) -> DataFrame:
    """row (all columns of docs) and MEASURES of each row, in one pass over whole texts."""
    at = [c.lower() for c in docs.columns].index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [measure(t) for t in batch.column(at).to_pylist()]
            row = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
            yield pa.RecordBatch.from_arrays([row, *(pa.array([x[i] for x in found], pa.int64()) for i in range(len(MEASURES)))], names=["row", *MEASURES])

    return docs.mapInArrow(scan, StructType([StructField("row", docs.schema), *(StructField(m, LongType()) for m in MEASURES)]))


def with_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """row, MEASURES and failed (bit b set: rule b failed)."""
    bits = " | ".join(f"(CASE WHEN {r.fails} THEN {1 << r.bit}L ELSE 0L END)" for r in rules) or "0L"
    return measured(docs).withColumn("failed", F.expr(bits))


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, MEASURES and failed."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return with_ledger(narrow, rules).select("row.doc_id", *MEASURES, "failed")


def apply_policy(entries: DataFrame, policy: Policy, column: str = "kept") -> DataFrame:
    return entries.withColumn(column, F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0)


def ablations(entries: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rule, n_failed, n_only (rejected by this rule alone), n_kept_without, words_kept_without: from distinct bitmasks."""
    masks = entries.groupBy("failed").agg(F.count("*").alias("n"), F.sum("n_words").alias("words"))
    rows = [(r.name, 1 << r.bit, policy.mask & ~(1 << r.bit)) for r in rules if policy.mask >> r.bit & 1]
    spark = entries.sparkSession
    table = spark.createDataFrame(rows, "rule string, bit long, rest long")
    joined = masks.join(F.broadcast(table), F.col("n") > 0)  # a row for each rule of the policy: at most 63
    fails = F.col("failed").bitwiseAND(F.col("bit")) != 0
    spared = F.col("failed").bitwiseAND(F.col("rest")) == 0
    total = lambda test, value: F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0))
    return joined.groupBy("rule").agg(
        total(fails, "n").alias("n_failed"),
        total(fails & spared, "n").alias("n_only"),
        total(spared, "n").alias("n_kept_without"),
        total(spared, "words").alias("words_kept_without"),
    )


def quality_report(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The contract's row for each document."""
    out = apply_policy(apply_policy(ledger(docs), BASE, "base_kept"), policy)
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), (F.col("base_kept") & F.col("kept")).alias("kept"), F.col("failed").alias("failed_bits")
    )


def keep_good(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """The rows of docs that pass, with all their columns: the ledger's bits against the policy's mask, in one pass (no join back)."""
    return with_ledger(docs).filter(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")) == 0).select("row.*")
