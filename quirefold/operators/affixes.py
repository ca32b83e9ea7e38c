"""Spelling by stems and affix rules, without a list of all forms.

A word is taken apart instead of every stem being built up: its endings and beginnings, a few rows a word, meet the rules by
an equi-join on what a rule adds, and what is left of it meets the stems by an equi-join on (stem, flag). So the work
grows with the distinct words, and neither forms nor pairs of words and stems are ever listed.

stems: stem, flags (array of strings). rules: flag, kind (prefix or suffix), cross (joins with rules of the other kind),
strip, add, condition (a pattern for the end, or beginning, of the stem; "." for any). Comparison is in lower case; a word
is known as it is or by its lower case. Null words, stems and flags: left out. Repeated rows: as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A rule adds so many characters at most; longer ones are an error of the table.
LONGEST = 12


def _ends(word: Column, kind: str) -> Column:
    """The parts of a word that a rule may have added: from none to LONGEST characters, and what each leaves."""
    lengths = F.sequence(F.lit(0), F.least(F.lit(LONGEST), F.length(word) - 1))
    if kind == "suffix":
        return F.transform(lengths, lambda k: F.struct(F.substring(word, F.length(word) - k + 1, k).alias("add"), F.substring(word, F.lit(1), F.length(word) - k).alias("rest")))
    return F.transform(lengths, lambda k: F.struct(F.substring(word, F.lit(1), k).alias("add"), F.substring(word, k + 1, F.length(word)).alias("rest")))


def undone(words: DataFrame, rules: DataFrame, kind: str) -> DataFrame:
    """words with base, flag and cross added: each word without one affix of the given kind. words: form, which is taken apart."""
    parts = words.withColumn("part", F.explode(_ends(F.col("form"), kind))).select(*words.columns, F.col("part.add").alias("add"), F.col("part.rest").alias("rest"))
    met = parts.join(rules.filter(F.col("kind") == kind).drop("kind"), "add")
    strip = F.coalesce("strip", F.lit(""))
    base = F.concat("rest", strip) if kind == "suffix" else F.concat(strip, "rest")
    pattern = F.concat(F.col("condition"), F.lit("$")) if kind == "suffix" else F.concat(F.lit("^"), F.col("condition"))
    return met.withColumn("base", base).filter((F.col("condition") == ".") | F.regexp_like("base", pattern)).select(*words.columns, "base", "flag", "cross")


def known_words(words: DataFrame, stems: DataFrame, rules: DataFrame) -> DataFrame:
    """word: the distinct words that are stems or follow from one by a prefix, a suffix, or one of each that may join."""
    asked = words.select("word").filter(F.col("word") != "").distinct().select("word", F.lower("word").alias("form"))
    flagged = stems.filter(F.col("stem").isNotNull()).select(F.lower("stem").alias("stem"), F.coalesce("flags", F.array().cast("array<string>")).alias("flags"))
    plain = flagged.select(F.col("stem").alias("form")).distinct()
    each = flagged.select("stem", F.explode("flags").alias("flag")).distinct()
    checked = rules.filter(F.when(F.length("add") <= LONGEST, F.lit(True)).otherwise(F.raise_error(F.lit(f"a rule adds more than {LONGEST} characters"))))
    checked = checked.select("flag", "kind", "cross", "strip", F.lower("add").alias("add"), F.lower("condition").alias("condition")).distinct()
    by_stem = lambda df, base, flag: df.join(each, (df[base] == each["stem"]) & (df[flag] == each["flag"]), "left_semi").select("word")
    suffixed, prefixed = undone(asked, checked, "suffix"), undone(asked, checked, "prefix")
    # a prefix undone first, then a suffix of what is left: the stem must bear both flags
    inner = prefixed.filter("cross").select("word", F.col("base").alias("form"), F.col("flag").alias("prefix_flag"))
    both = undone(inner, checked, "suffix").filter("cross").select("word", "base", "prefix_flag", F.col("flag").alias("suffix_flag")).distinct()
    first = both.join(each, (both["base"] == each["stem"]) & (both["prefix_flag"] == each["flag"]), "left_semi")
    found = [asked.join(plain, "form", "left_semi").select("word"), by_stem(suffixed, "base", "flag"), by_stem(prefixed, "base", "flag"), by_stem(first, "base", "suffix_flag")]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def unknown_by_affixes(words: DataFrame, stems: DataFrame, rules: DataFrame) -> DataFrame:
    """word, n: words that nothing explains, and how often each occurs."""
    counted = words.filter(F.col("word") != "").groupBy("word").agg(F.count("*").alias("n"))
    return counted.join(known_words(counted, stems, rules), "word", "left_anti")
