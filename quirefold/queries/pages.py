"""Queries over positioned text: lines by their first item, cells, tables, Markdown and paragraphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout, rebuild
from .common import Table
from .scalars import FUNCTIONS, GRID

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Items at odd places: steps between them are smaller than a line's tolerance and add up beyond it.
SCATTERED = Table(
    "SELECT l_suppkey AS doc_id, CAST(1 + l_orderkey % 4 AS INT) AS page, CAST(l_partkey * 13 % 500 AS DOUBLE) AS x, CAST(l_orderkey * 7 % 900 AS DOUBLE) * 0.9 AS y, 20 + l_quantity AS width, CAST(10 AS DOUBLE) AS height, "
    "CAST(8 + 2 * (l_linenumber % 3) AS DOUBLE) AS font_size, l_linenumber < 3 AS bold, CAST(l_partkey AS STRING) AS str, CAST(600 AS DOUBLE) AS page_width FROM lineitem"
)
#: From each line's first item to the next one that is too far from it; then cells by the furthest right edge so far.
LINES = f"""WITH RECURSIVE g AS (SELECT doc_id, page, x, y, CAST(width AS DOUBLE) AS width, font_size, bold, str, row_number() OVER (PARTITION BY doc_id, page ORDER BY y, x, str, width, font_size, bold) AS rn FROM {SCATTERED.sql}),
f AS (SELECT doc_id, page, CAST(1 AS BIGINT) AS rn, y FROM g WHERE rn = 1
      UNION ALL
      SELECT n.doc_id, n.page, n.rn, n.y FROM (SELECT f.doc_id, f.page, min(g.rn) AS rn FROM f JOIN g ON g.doc_id = f.doc_id AND g.page = f.page AND g.rn > f.rn AND g.y - f.y > least(3.5, g.font_size * 0.3) GROUP BY f.doc_id, f.page) m JOIN g n ON n.doc_id = m.doc_id AND n.page = m.page AND n.rn = m.rn),
s AS (SELECT doc_id, page, rn, row_number() OVER (PARTITION BY doc_id, page ORDER BY rn) AS line FROM f),
i AS (SELECT g.*, s.line FROM g ASOF JOIN s ON g.doc_id = s.doc_id AND g.page = s.page AND g.rn >= s.rn),
c AS (SELECT *, max(x + width) OVER w AS reach, row_number() OVER (PARTITION BY doc_id, page, line ORDER BY x, rn) AS k FROM i WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY x, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT *, sum(CASE WHEN x - reach <= 24 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, line ORDER BY x, rn) AS cell FROM c),
e AS (SELECT doc_id, page, line, cell, trim(string_agg(CASE WHEN x - reach <= 24 AND x - reach > font_size * 0.12 THEN ' ' ELSE '' END || str, '' ORDER BY k)) AS t FROM d GROUP BY doc_id, page, line, cell),
t AS (SELECT doc_id, page, line, count(*) AS cells, string_agg(t, ' ' ORDER BY cell) AS text FROM e GROUP BY doc_id, page, line),
l AS (SELECT d.doc_id, d.page, d.line, min(CASE WHEN k = 1 THEN y END) AS y, min(x) AS x, max(font_size) AS size, bool_or(bold) AS bold, any_value(t.cells) AS cells, any_value(t.text) AS text FROM d JOIN t USING (doc_id, page, line) GROUP BY d.doc_id, d.page, d.line)"""


@query(f"{LINES} SELECT doc_id, page, CAST(line AS INT) AS line, y, x, size, bold, cells, text FROM l")
def f9_text_lines(spark, sf_dir):
    lines = layout.text_lines(layout.as_items(SCATTERED.frame(spark, sf_dir)), layout.PAGE)
    return lines.select("doc_id", "page", "line", F.col("top").alias("y"), F.get("items", F.lit(0))["x"].alias("x"), "size", "bold", F.size("cells").cast("long").alias("cells"), "text")


@query(f"""{LINES}, b AS (SELECT *, lag(y) OVER w AS py, lag(x) OVER w AS px, lag(size) OVER w AS ps FROM l WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
r AS (SELECT *, sum(CASE WHEN abs(ps - size) <= 0.5 AND abs(px - x) <= 6 AND y - py > 0 AND y - py <= size * 1.6 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line) - 1 AS seq FROM b)
SELECT doc_id, page, CAST(seq AS INT) AS seq, CAST(count(*) AS INT) AS lines, max(size) AS font_size, bool_and(bold) AS bold, string_agg(text, ' ' ORDER BY line) AS text FROM r GROUP BY doc_id, page, seq""")
def i19_page_paragraphs(spark, sf_dir):
    return layout.page_paragraphs(SCATTERED.frame(spark, sf_dir))


def joined_tables(df):
    return layout.page_tables(df).select("doc_id", "page", "row", F.array_join("cells", "|").alias("cells"), "error")


#: One span for each place of a line; places are columns.
_SPANS = f"""s AS (SELECT doc_id, page, y, x, max(x + width) AS r, string_agg(str, '' ORDER BY str) AS t, bool_or(bold) AS bold FROM {GRID.sql} GROUP BY doc_id, page, y, x),
l AS (SELECT doc_id, page, y, count(*) AS n, row_number() OVER (PARTITION BY doc_id, page ORDER BY y) AS line, bool_or(bold) AS bold FROM s GROUP BY doc_id, page, y)"""


@query(f"""WITH {_SPANS},
e AS (SELECT doc_id, page, unnest([x, r]) AS edge, unnest([1, -1]) AS d FROM s JOIN l USING (doc_id, page, y) WHERE n >= 2),
w AS (SELECT doc_id, page, edge, lag(edge) OVER (PARTITION BY doc_id, page ORDER BY edge, d) AS before, coalesce(sum(d) OVER (PARTITION BY doc_id, page ORDER BY edge, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS active FROM e),
b AS (SELECT doc_id, page, list((before + edge) / 2) AS bs FROM w WHERE active = 0 AND edge - before >= 8 GROUP BY doc_id, page),
c AS (SELECT s.*, coalesce(len(list_filter(bs, lambda v: x >= v - 1)), 0) AS col, coalesce(len(bs), 0) AS last FROM s LEFT JOIN b USING (doc_id, page)),
f AS (SELECT doc_id, page, y, k, coalesce(any_value(t) FILTER (col = k), '') AS cell FROM c, (SELECT unnest(range(3)) AS k) WHERE k <= last GROUP BY doc_id, page, y, k)
SELECT doc_id, page, CAST(line - 1 AS INT) AS row, string_agg(cell, '|' ORDER BY k) AS cells, CAST(NULL AS VARCHAR) AS error FROM f JOIN l USING (doc_id, page, y) GROUP BY doc_id, page, line""")
def i1_i4_page_tables(spark, sf_dir):
    return joined_tables(GRID.frame(spark, sf_dir))


@query(f"""WITH {_SPANS},
m0 AS (SELECT *, lag(n) OVER o AS pn, lag(y) OVER o AS py FROM l WINDOW o AS (PARTITION BY doc_id, page ORDER BY line)),
m AS (SELECT doc_id, page, y, line, n, bold, sum(CASE WHEN n >= 2 AND pn >= 2 AND y - py <= 40 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY line) AS run FROM m0),
x AS (SELECT s.doc_id, s.page, s.y, s.x, trim(s.t) AS t, line, n, m.bold, run FROM s JOIN m USING (doc_id, page, y)),
a AS (SELECT doc_id, page, run, x, count(*) AS c FROM x GROUP BY doc_id, page, run, x),
q AS (SELECT doc_id, page, run, count(*) AS wide, count(*) FILTER (c >= 2) AS met FROM a GROUP BY doc_id, page, run),
z AS (SELECT doc_id, page, run, any_value(n) AS n, count(DISTINCT line) AS high FROM x GROUP BY doc_id, page, run),
k AS (SELECT doc_id, page, run, n >= 2 AND high >= 2 AND wide >= 2 AND met >= 2 AS is_table, wide FROM q JOIN z USING (doc_id, page, run)),
f AS (SELECT m.doc_id, m.page, m.run, m.line, '| ' || string_agg(coalesce(x.t, ''), ' | ' ORDER BY a.x) || ' |' AS cells FROM m JOIN a USING (doc_id, page, run) LEFT JOIN x ON x.doc_id = m.doc_id AND x.page = m.page AND x.line = m.line AND x.x = a.x GROUP BY m.doc_id, m.page, m.run, m.line),
p AS (SELECT doc_id, page, run, line, any_value(bold) AS bold, string_agg(t, ' ' ORDER BY x) AS t FROM x GROUP BY doc_id, page, run, line),
v AS (SELECT f.doc_id, f.page, f.run, is_table, any_value(wide) AS wide,
      CASE WHEN is_table THEN string_agg(CASE WHEN f.line = s0 THEN cells || chr(10) || '| ' || repeat('--- | ', CAST(wide - 1 AS INT)) || '--- |' ELSE cells END, chr(10) ORDER BY f.line) ELSE string_agg(CASE WHEN bold AND length(t) <= 100 THEN '### ' || t ELSE t END, chr(10) || chr(10) ORDER BY f.line) END AS block
      FROM f JOIN k USING (doc_id, page, run) JOIN p USING (doc_id, page, run, line) JOIN (SELECT doc_id, page, run, min(line) AS s0 FROM m GROUP BY doc_id, page, run) USING (doc_id, page, run) GROUP BY f.doc_id, f.page, f.run, is_table)
SELECT doc_id, page, string_agg(block, chr(10) || chr(10) ORDER BY run) AS markdown FROM v GROUP BY doc_id, page""")
def i7_i10_page_markdown(spark, sf_dir):
    return layout.pages_to_markdown(GRID.frame(spark, sf_dir))


def _fragments(step: int, where: str) -> Table:
    """Words of lines 14 points apart, with a wider gap after every sixth, from the left edge in steps of `step` points."""
    return Table(
        f"SELECT l_suppkey AS doc_id, CAST(1 + l_orderkey % 8 AS INT) AS page, CAST(20 + {step} * (l_linenumber - 1) AS DOUBLE) AS x, CAST(40 + 14 * (l_partkey % 30) + 16 * floor(l_partkey % 30 / 6) AS DOUBLE) AS y, CAST(50 AS DOUBLE) AS width, "
        f"CAST(10 AS DOUBLE) AS font_size, CASE WHEN l_linenumber < 3 THEN 'Text-Bold' ELSE 'Text' END AS font_name, CAST(l_partkey AS STRING) AS str, CAST(600 AS DOUBLE) AS page_width FROM lineitem WHERE {where}"
    )


FLOWING, TABULAR = _fragments(8, "l_orderkey % 2 = 0"), _fragments(90, "l_orderkey % 2 = 1 AND l_linenumber <= 3")


@query(f"""WITH l AS (SELECT doc_id, page, y, string_agg(str, ' ' ORDER BY x, str) AS t, count(*) FILTER (font_name = 'Text-Bold') AS bold, count(*) AS n FROM {FLOWING.sql} GROUP BY doc_id, page, y),
b AS (SELECT *, lag(y) OVER (PARTITION BY doc_id, page ORDER BY y) AS py FROM l),
r AS (SELECT *, sum(CASE WHEN y - py <= 18.5 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY y) AS seq FROM b)
SELECT doc_id, page, CAST(seq AS INT) AS seq, 'paragraph' AS kind, string_agg(t, ' ' ORDER BY y) AS text, CAST(sum(CASE WHEN bold = 0 OR bold = n THEN 1 ELSE 2 END) AS BIGINT) AS runs FROM r GROUP BY doc_id, page, seq""")
def i11_rebuilt_paragraphs(spark, sf_dir):
    blocks = rebuild.rebuilt_blocks(FLOWING.frame(spark, sf_dir))
    return blocks.select("doc_id", "page", "seq", "kind", "text", F.size("runs").cast("long").alias("runs"))


@query(f"""WITH c AS (SELECT doc_id, page, y, x, string_agg(str, ' ' ORDER BY str) AS t FROM {TABULAR.sql} GROUP BY doc_id, page, y, x),
l AS (SELECT doc_id, page, y, count(*) AS n FROM c GROUP BY doc_id, page, y),
b AS (SELECT *, lag(n) OVER w AS pn, lag(y) OVER w AS py FROM l WINDOW w AS (PARTITION BY doc_id, page ORDER BY y)),
r AS (SELECT *, sum(CASE WHEN n >= 2 AND pn >= 2 AND y - py <= 35 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY y) AS run FROM b),
x AS (SELECT c.*, run, n FROM c JOIN r USING (doc_id, page, y) WHERE n >= 2),
k AS (SELECT doc_id, page, run, x, count(*) AS hits FROM x GROUP BY doc_id, page, run, x),
q AS (SELECT doc_id, page, run FROM k GROUP BY doc_id, page, run HAVING count(*) FILTER (hits >= 2) >= 2),
o AS (SELECT y.doc_id, y.page, y.run, y.y, string_agg(coalesce(x.t, ''), '|' ORDER BY k.x) AS cells FROM (SELECT DISTINCT doc_id, page, run, y FROM x) y JOIN q USING (doc_id, page, run) JOIN k USING (doc_id, page, run) LEFT JOIN x ON x.doc_id = y.doc_id AND x.page = y.page AND x.y = y.y AND x.x = k.x GROUP BY y.doc_id, y.page, y.run, y.y)
SELECT doc_id, page, string_agg(cells, chr(10) ORDER BY y) AS rows FROM o GROUP BY doc_id, page, run""")
def i11_rebuilt_tables(spark, sf_dir):
    blocks = rebuild.rebuilt_blocks(TABULAR.frame(spark, sf_dir)).filter("kind = 'table'")
    return blocks.select("doc_id", "page", F.array_join(F.transform("rows", lambda r: F.array_join(r, "|")), "\n").alias("rows"))


#: The same on worked examples, whose SQL would need other pages.
FUNCTIONS.update({"i1_i4_page_tables": (joined_tables, None), "i7_i10_page_markdown": (layout.pages_to_markdown, None), "i19_page_paragraphs": (layout.page_paragraphs, None)})
