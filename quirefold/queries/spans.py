"""Queries over intervals: protected text, redaction boxes, acceptance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geometry, intervals
from .common import Table, load

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Spans of texts: one text has half of them, and every hundredth is long.
SPANS = Table(
    "SELECT CAST(CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE l_suppkey END AS BIGINT) AS doc_id, CAST(l_linenumber AS INT) AS place, CAST(l_orderkey AS BIGINT) * 37 + l_linenumber * 11 AS start, "
    "CAST(l_orderkey AS BIGINT) * 37 + l_linenumber * 11 + 1 + CAST(l_quantity AS INT) + CASE WHEN l_partkey % 100 = 0 THEN 1500 ELSE 0 END AS stop FROM lineitem"
)
GUARDS = Table("SELECT CAST(CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE o_custkey % 100 END AS BIGINT) AS doc_id, CAST(o_orderkey AS BIGINT) * 37 AS start, CAST(o_orderkey AS BIGINT) * 37 + 20 + CASE WHEN o_orderkey % 500 = 0 THEN 9000 ELSE 0 END AS stop FROM orders WHERE o_orderkey % 3 = 0")


@query(f"SELECT doc_id, place, start, stop FROM {SPANS.sql} WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS d, start AS s, stop AS e FROM {GUARDS.sql}) WHERE d = doc_id AND start < e AND stop > s)")
def c4_spans_outside_guards(spark, sf_dir):
    return intervals.without_overlaps(SPANS.frame(spark, sf_dir), GUARDS.frame(spark, sf_dir), ["doc_id"], "start", "stop").select("doc_id", "place", "start", "stop")


@query(f"SELECT a.doc_id, a.start AS start, a.stop AS stop, count(*) AS guards, CAST(sum(least(a.stop, g.stop) - greatest(a.start, g.start)) AS BIGINT) AS shared FROM (SELECT DISTINCT doc_id, start, stop FROM {SPANS.sql}) a JOIN (SELECT * FROM {GUARDS.sql}) g ON a.doc_id = g.doc_id AND a.start < g.stop AND a.stop > g.start GROUP BY a.doc_id, a.start, a.stop")
def c4_overlapping_spans(spark, sf_dir):
    pairs = intervals.overlap_pairs(SPANS.frame(spark, sf_dir).select("doc_id", "start", "stop").distinct(), GUARDS.frame(spark, sf_dir), ["doc_id"], "start", "stop")
    shared = F.least("l.stop", "r.stop") - F.greatest("l.start", "r.start")
    return pairs.groupBy("l.doc_id", "l.start", "l.stop").agg(F.count("*").alias("guards"), F.sum(shared).alias("shared"))


#: Candidates of short texts, as rules find them: by rule, then by place.
CANDIDATES = Table("SELECT CAST(l_orderkey % 3000 AS BIGINT) AS doc_id, CAST(l_partkey % 9 AS INT) AS rule, CAST(l_orderkey AS BIGINT) * 7 % 900 + l_linenumber AS start, CAST(l_orderkey AS BIGINT) * 7 % 900 + l_linenumber + 1 + CAST(l_quantity AS INT) AS stop, CAST(l_extendedprice AS BIGINT) AS price FROM lineitem")


@query(
    f"""WITH g AS (SELECT doc_id, list(list_value(struct_pack(rule := rule, s := start, e := stop)) ORDER BY rule, start, stop) AS l FROM (SELECT DISTINCT doc_id, rule, start, stop FROM {CANDIDATES.sql}) GROUP BY doc_id),
a AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, y: CASE WHEN len(list_filter(acc, lambda t: t.s < y[1].e AND t.e > y[1].s)) = 0 THEN list_concat(acc, y) ELSE acc END)) AS x FROM g)
SELECT doc_id, x.rule AS rule, x.s AS start, x.e AS stop FROM a"""
)
def c5_accepted_spans(spark, sf_dir):
    return intervals.accept_spans(CANDIDATES.frame(spark, sf_dir).select("doc_id", "rule", "start", "stop").distinct(), ["doc_id"], ["rule"], "start", "stop")


#: Pages of 2,000 characters in lines of 40, each line in two slices.
_PAGES = "SELECT doc_id, p + 1 AS page, substring(text, 1 + 2000 * p, 2000) AS text FROM (SELECT doc_id, text, {series} AS p FROM documents) WHERE 2000 * p < length(text)"
_BOXES = """WITH pages AS ($pages), m AS (SELECT doc_id, page, string_split_regex(text, '(?i)the') AS gaps, regexp_extract_all(text, '(?i)the') AS hits FROM pages),
x AS (SELECT doc_id, page, seq, CAST(list_sum(list_transform(gaps[1:seq + 1], lambda g: length(g))) + 3 * seq AS INT) AS s FROM (SELECT *, unnest(range(len(hits))) AS seq FROM m)),
sl AS (SELECT doc_id, page, 20 * k AS first, least(20 * k + 20, length(text)) AS last, 72.0 + 200 * (k % 2) AS x, 100.0 + 14 * (k // 2) AS y, 200.0 * (least(20 * k + 20, length(text)) - 20 * k) / 20 AS width FROM (SELECT *, unnest(range(100)) AS k FROM pages) WHERE 20 * k < length(text)),
b AS (SELECT x.doc_id, x.page, seq, y, sl.x + width / (last - first) * greatest(0, s - first) AS l, sl.x + width / (last - first) * least(last - first, s + 3 - first) AS r FROM x JOIN sl ON x.doc_id = sl.doc_id AND x.page = sl.page AND s < last AND s + 3 > first),
o AS (SELECT doc_id, page, seq, y, min(l) AS l, max(r) AS r, row_number() OVER (PARTITION BY doc_id, page, seq ORDER BY y) AS line FROM b GROUP BY doc_id, page, seq, y)
SELECT doc_id, CAST(page AS INT) AS page, CAST(seq AS INT) AS seq, line, round(greatest(0, least(100, l / 595 * 100)), 2) AS x, round(greatest(0, least(100, (y - 10) / 842 * 100)), 2) AS y, round(greatest(0, least(100, (r - l) / 595 * 100)), 2) AS width, round(greatest(0, least(100, 10 / 842.0 * 100)), 2) AS height FROM o"""


@query(_BOXES.replace("$pages", _PAGES.format(series="unnest(range(1 + length(text) // 2000))").replace("doc_id, p + 1", "doc_id, p + 1")))
def i18_redaction_boxes(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    numbered = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / 2000).cast("int"))).alias("p")).filter(2000 * F.col("p") < F.length("text"))
    pages = numbered.select("doc_id", (F.col("p") + 1).alias("page"), F.substring("text", F.col("p") * 2000 + 1, F.lit(2000)).alias("text"))
    last = F.least(F.col("k") * 20 + 20, F.length("text"))
    slices = pages.select("*", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k")).filter(20 * F.col("k") < F.length("text"))
    slices = slices.select(
        "doc_id", "page", (F.col("k") * 20).alias("first"), last.alias("last"), (72.0 + 200 * (F.col("k") % 2)).alias("x"), (100.0 + 14 * F.floor(F.col("k") / 2)).alias("y"),
        (200.0 * (last - F.col("k") * 20) / 20).alias("width"), F.lit(10.0).alias("font_size"), F.lit(595.0).alias("page_width"), F.lit(842.0).alias("page_height"),
    )
    return geometry.match_rectangles(geometry.sensitive_matches(pages, geometry.literal_pattern("the")), slices)
