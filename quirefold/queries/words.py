"""Queries over words: spelling by affix rules, collated order and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import affixes, collation
from .common import Rows, Table, load

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: The rules of the query: a few of English, for words of the benchmark.
RULES = Rows(
    "flag string, kind string, joins boolean, strip string, added string, condition string",
    [("S", "suffix", True, "", "s", "[^sxy]"), ("S", "suffix", True, "y", "ies", "[^aeiou]y"), ("D", "suffix", True, "", "ed", "[^ey]"), ("D", "suffix", True, "", "d", "e"), ("U", "prefix", True, "", "un", "."), ("R", "prefix", False, "", "re", "[^e]")],
)
_WORD = "[\\p{L}]+"
STEMS = Table("SELECT item_id, text FROM benchmark")
_FORMS = f"""r AS (SELECT * FROM {RULES.sql}),
b AS (SELECT DISTINCT lower(w) AS stem FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM {STEMS.sql})),
e AS (SELECT stem, unnest(CASE WHEN length(stem) % 2 = 0 THEN ['S', 'D', 'U', 'R'] ELSE ['S', 'U'] END) AS flag FROM b),
s AS (SELECT stem, r.flag AS flag, r.joins AS both, substr(stem, 1, length(stem) - length(strip)) || added AS form FROM e JOIN r ON r.flag = e.flag AND kind = 'suffix' AND ends_with(stem, strip) AND regexp_matches(stem, condition || '$')),
p AS (SELECT stem, r.joins AS both, added AS lead, added || stem AS form FROM e JOIN r ON r.flag = e.flag AND kind = 'prefix' AND regexp_matches(stem, '^' || condition)),
k AS (SELECT stem AS form FROM b UNION SELECT form FROM s UNION SELECT form FROM p UNION SELECT lead || s.form FROM s JOIN p ON p.stem = s.stem AND p.both AND s.both)"""


@query(f"WITH {_FORMS} SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_WORD}')) AS w FROM documents) WHERE lower(w) NOT IN (SELECT form FROM k) GROUP BY w")
def h13_unknown_by_affixes(spark, sf_dir):
    words = lambda df: df.select(F.explode(F.regexp_extract_all("text", F.lit(_WORD), F.lit(0))).alias("word"))
    stem = words(STEMS.frame(spark, sf_dir)).select(F.lower("word").alias("stem")).distinct()
    flags = F.when(F.length("stem") % 2 == 0, F.array(*map(F.lit, "SDUR"))).otherwise(F.array(*map(F.lit, "SU")))
    return affixes.unknown_by_affixes(words(load(spark, sf_dir, "documents")), stem.withColumn("flags", flags), RULES.frame(spark).withColumnsRenamed({"joins": "cross", "added": "add"}))


@query("SELECT DISTINCT lang, w AS word, dense_rank() OVER (PARTITION BY lang ORDER BY lower(strip_accents(w))) AS rank FROM (SELECT lang, unnest(regexp_extract_all(text, '[a-zA-ZáéíóúüñçàèìòùâêîôûäöÁÉÈÀÊÄÖÜ]+')) AS w FROM documents)")
def f5_collated_order(spark, sf_dir):
    found = F.regexp_extract_all("text", F.lit("[a-zA-ZáéíóúüñçàèìòùâêîôûäöÁÉÈÀÊÄÖÜ]+"), F.lit(0))
    words = load(spark, sf_dir, "documents").select("lang", F.explode(found).alias("word")).distinct()
    return collation.collated_ranks(words, ["lang"], "word").withColumn("rank", F.col("rank").cast("long"))


@query("SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'tion e') OR contains(lower(strip_accents(text)), 'que')")
def f5_collated_search(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.filter(collation.collated_search(F.col("text"), F.lit("TION é")) | collation.collated_search(F.col("text"), F.lit("Quê"))).select("doc_id")
