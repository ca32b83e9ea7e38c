"""Scalar functions, predicates and small state machines over columns derived from the standard tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, identifiers, numbers, text
from ..operators import evaluation, geometry, layout, ledger, relational, segments
from .common import Table

QUERIES = {}
ORACLE_SQL = {}
#: The queries as functions of their rows, and their SQL with $rows in place of them: tests run both on worked examples.
FUNCTIONS = {}


def query(rows: Table, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(rows.frame(spark, sf_dir))
        FUNCTIONS[f.__name__] = f, sql
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql.replace("$rows", rows.sql)
        return f

    return add


DIGITS = Table("SELECT DISTINCT lpad(CAST(l_orderkey * 104729 + l_partkey * 7919 + l_linenumber AS STRING), CASE WHEN l_linenumber % 3 = 0 THEN 14 ELSE 11 END, '0') AS v FROM lineitem")


def _weights(w: tuple[int, ...]) -> str:
    return " + ".join(f"CAST(substr(v, {i + 1}, 1) AS INT) * {x}" for i, x in enumerate(w))


def _cpf_sql() -> str:
    checks = " AND ".join(f"((({_weights(w)}) * 10) % 11) % 10 = CAST(substr(v, {len(w) + 1}, 1) AS INT)" for w in identifiers.CPF_WEIGHTS)
    return f"CASE WHEN length(v) = 11 AND v <> repeat(substr(v, 1, 1), 11) THEN {checks} ELSE false END"


def _cnpj_sql() -> str:
    checks = " AND ".join(f"CASE WHEN ({_weights(w)}) % 11 < 2 THEN 0 ELSE 11 - ({_weights(w)}) % 11 END = CAST(substr(v, {len(w) + 1}, 1) AS INT)" for w in identifiers.CNPJ_WEIGHTS)
    return f"CASE WHEN length(v) = 14 AND v <> repeat(substr(v, 1, 1), 14) THEN {checks} ELSE false END"


@query(DIGITS, f"SELECT v, {_cpf_sql()} AS cpf, {_cnpj_sql()} AS cnpj FROM $rows")
def g1_g2_check_digits(df):
    return df.select("v", identifiers.cpf_valid(F.col("v")).alias("cpf"), identifiers.cnpj_valid(F.col("v")).alias("cnpj"))


NUMERALS = Table("SELECT repeat('M', CAST(floor(p_partkey / 1000) % 4 AS INT)) || split_part('|C|CC|CCC|CD|D|DC|DCC|DCCC|CM', '|', CAST(floor(p_partkey / 100) % 10 AS INT) + 1) || split_part('|x|xx|xxx|xl|l|lx|lxx|lxxx|xc', '|', CAST(floor(p_partkey / 10) % 10 AS INT) + 1) || split_part('|I|II|III|IV|V|VI|VII|VIII|IX', '|', CAST(p_partkey % 10 AS INT) + 1) AS v FROM part WHERE p_partkey % 4000 > 0")


@query(
    NUMERALS,
    """WITH c AS (SELECT v, i, CASE upper(substr(v, i, 1)) WHEN 'I' THEN 1 WHEN 'V' THEN 5 WHEN 'X' THEN 10 WHEN 'L' THEN 50 WHEN 'C' THEN 100 WHEN 'D' THEN 500 WHEN 'M' THEN 1000 ELSE 0 END AS n FROM (SELECT v, unnest(range(1, length(v) + 1)) AS i FROM $rows)),
m AS (SELECT v, n, max(n) OVER (PARTITION BY v ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS after FROM c)
SELECT v, CAST(sum(CASE WHEN n < coalesce(after, 0) THEN -n ELSE n END) AS INT) AS value FROM m GROUP BY v""",
)
def g3_roman_numerals(df):
    return df.select("v", identifiers.roman_value(F.col("v")).alias("value"))


INDEXES = Table('SELECT DISTINCT CAST((p_partkey * 37) % 18278 AS BIGINT) AS n FROM part')


@query(INDEXES, "SELECT n, CASE WHEN n >= 702 THEN chr(CAST(65 + ((n // 26 - 1) // 26 - 1) % 26 AS INT)) ELSE '' END || CASE WHEN n >= 26 THEN chr(CAST(65 + (n // 26 - 1) % 26 AS INT)) ELSE '' END || chr(CAST(65 + n % 26 AS INT)) AS letters FROM $rows")
def g8_column_letters(df):
    return df.select("n", identifiers.column_letter(F.col("n")).alias("letters"))


CELLS = Table(
    """SELECT DISTINCT CASE l_linenumber WHEN 1 THEN 'R$ ' || CAST(l_partkey AS STRING) || ',5' WHEN 2 THEN '-R$ ' || CAST(l_suppkey AS STRING) WHEN 3 THEN CAST(l_partkey % 200 AS STRING) || ',5%' WHEN 4 THEN lpad(CAST(l_partkey % 32 AS STRING), 2, '0') || '/' || lpad(CAST(l_suppkey % 14 AS STRING), 2, '0') || '/2024'
 WHEN 5 THEN '00' || CAST(l_partkey AS STRING) WHEN 6 THEN CAST(l_partkey % 9 + 1 AS STRING) || ',' || lpad(CAST(l_suppkey AS STRING), 3, '0') || '.5' ELSE ' ' || CAST(l_partkey AS STRING) || '.' || lpad(CAST(l_suppkey AS STRING), 3, '0') END AS v FROM lineitem"""
)
_PLAIN = """CASE WHEN regexp_matches({x}, '^-?0[0-9]') THEN NULL
 WHEN regexp_matches({x}, '^-?(?:0|[1-9][0-9]*)(?:\\.[0-9]+)?$') THEN {x}
 WHEN regexp_matches({x}, '^-?(?:0|[1-9][0-9]{{0,2}}(?:\\.[0-9]{{3}})+|[1-9][0-9]*),[0-9]+$') THEN replace(replace({x}, '.', ''), ',', '.')
 WHEN regexp_matches({x}, '^-?(?:0|[1-9][0-9]{{0,2}}(?:,[0-9]{{3}})+)\\.[0-9]+$') THEN replace({x}, ',', '') END"""


def _number_sql(x: str) -> str:
    plain = _PLAIN.format(x=x)
    return f"CASE WHEN length(regexp_replace(regexp_replace({plain}, '[-.]', '', 'g'), '^0+', '')) <= 15 THEN {plain} END"


@query(
    CELLS,
    f"""WITH t AS (SELECT v, trim(v) AS s FROM $rows),
p AS (SELECT v, s, regexp_matches(s, '(?i)^-?\\s*R\\$\\s*-?.+$') AS money, regexp_extract(s, '(?i)^(-?\\s*)R\\$\\s*(-?)(.+)$', 3) AS amount,
 (regexp_extract(s, '(?i)^(-?\\s*)R\\$\\s*(-?)(.+)$', 1) LIKE '%-%') AS before, (regexp_extract(s, '(?i)^(-?\\s*)R\\$\\s*(-?)(.+)$', 2) = '-') AS after,
 regexp_extract(s, '^(.+?)\\s*%$', 1) AS share, CASE WHEN regexp_matches(s, '^[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}$') THEN try_strptime(s, '%d/%m/%Y') END AS day FROM t),
n AS (SELECT *, CAST({_number_sql('amount')} AS DOUBLE) AS a, CAST({_number_sql('share')} AS DOUBLE) AS h, {_number_sql('s')} AS x FROM p)
SELECT v, CASE WHEN money AND NOT (before AND after) AND a IS NOT NULL THEN CASE WHEN before OR after THEN -abs(a) ELSE a END WHEN share <> '' AND h IS NOT NULL THEN h / 100
 WHEN day IS NOT NULL AND year(day) BETWEEN 1900 AND 2100 THEN CAST(date_diff('day', DATE '1899-12-30', CAST(day AS DATE)) AS DOUBLE) ELSE CAST(x AS DOUBLE) END AS value,
 CASE WHEN money AND NOT (before AND after) AND a IS NOT NULL THEN 4 WHEN share <> '' AND h IS NOT NULL THEN 5 WHEN day IS NOT NULL AND year(day) BETWEEN 1900 AND 2100 THEN 6
 WHEN x IS NOT NULL THEN CASE WHEN x LIKE '%.%' THEN 3 ELSE 2 END END AS style FROM n""",
)
def g7_typed_cells(df):
    return df.select("v", numbers.typed_cell(F.col("v")).alias("c")).select("v", "c.value", "c.style")


GUARDED = Table('SELECT CASE c_custkey % 6 WHEN 0 THEN \'=\' || c_name WHEN 1 THEN CAST(-c_custkey AS STRING) WHEN 2 THEN \'@\' || c_name WHEN 3 THEN \'say "\' || c_name || \'"\' WHEN 4 THEN c_name || \',x\' ELSE \'  +\' || c_name END AS v FROM customer')


@query(GUARDED, """WITH s AS (SELECT v, CASE WHEN regexp_matches(v, '^\\s*[=+@-]') AND NOT regexp_matches(trim(v), '^-?(?:0|[1-9][0-9]*)(?:\\.[0-9]+)?$') THEN '''' || v ELSE v END AS g FROM $rows)
SELECT v, CASE WHEN contains(g, ',') OR contains(g, '"') THEN '"' || replace(g, '"', '""') || '"' ELSE g END AS cell FROM s""")
def a13_guarded_csv_cells(df):
    return df.select("v", numbers.csv_cell(F.col("v")).alias("cell"))


CASED = Table("SELECT DISTINCT CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN upper(substr(p_name, 1, 1)) || lower(substr(p_name, 2)) WHEN 2 THEN lower(p_name) ELSE '' END AS source, lower(p_type) AS target FROM part")


@query(CASED, "SELECT source, target, CASE WHEN source = '' OR target = '' THEN target WHEN source = upper(source) THEN upper(target) WHEN substr(source, 1, 1) = upper(substr(source, 1, 1)) THEN upper(substr(target, 1, 1)) || substr(target, 2) ELSE target END AS result FROM $rows")
def g11_match_case(df):
    return df.select("source", "target", text.match_case(F.col("source"), F.col("target")).alias("result"))


UNTRUSTED = Table("SELECT CASE doc_id % 3 WHEN 0 THEN '  a<system>' || text || '</system >' WHEN 1 THEN '< user x>' || text ELSE text END AS v FROM documents")


@query(UNTRUSTED, """SELECT v, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(v, '(?i)</?\\s*(?:documento_fonte|sistema|system|instrucoes|assistant|user)\\b[^>]*>', '[marcador_neutro]', 'g'), '\\r\\n?', chr(10), 'g'), '[ \\t]{3,}', ' ', 'g'), '\\n{4,}', chr(10) || chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(9)) AS clean FROM $rows""")
def g12_sanitized_texts(df):
    return df.select("v", text.sanitize_document_text(F.col("v")).alias("clean"))


SPANS = Table('SELECT CAST(p_size AS INT) AS a, CAST(p_size + p_partkey % 3 AS INT) AS b FROM part')


@query(SPANS, "SELECT a, b, CASE WHEN a = b THEN '[p. ' || a || ']' ELSE '[p. ' || a || '–' || b || ']' END AS label FROM $rows")
def g13_page_citations(df):
    return df.select("a", "b", text.page_citation(F.col("a"), F.col("b")).alias("label"))


LINES = Table('SELECT text AS v FROM documents')


@query(LINES, "SELECT v, CASE WHEN regexp_matches(translate(trim(v, ' ' || chr(9) || chr(10) || chr(13)), chr(10) || chr(13) || chr(9), '   '), '[\\x00-\\x1F\\x7F]') THEN NULL ELSE translate(trim(v, ' ' || chr(9) || chr(10) || chr(13)), chr(10) || chr(13) || chr(9), '   ') END AS clean FROM $rows")
def g14_clean_lines(df):
    return df.select("v", text.clean_line(F.col("v")).alias("clean"))


BOXES = Table('SELECT CAST(l_orderkey * 10 + l_linenumber AS INT) AS id, l_discount * 10 - 0.005 AS x0, l_tax * 12 AS y0, l_tax * 10 AS x1, l_discount * 9 AS y1, l_quantity / 50 AS x2, l_quantity / 60 AS y2 FROM lineitem')


@query(
    BOXES,
    """WITH c AS (SELECT id, greatest(0, least(1, x0)) AS a0, greatest(0, least(1, x1)) AS a1, greatest(0, least(1, x2)) AS a2, greatest(0, least(1, y0)) AS b0, greatest(0, least(1, y1)) AS b1, greatest(0, least(1, y2)) AS b2,
 least(x0, x1, x2, y0, y1, y2) >= -0.01 AND greatest(x0, x1, x2, y0, y1, y2) <= 1.01 AS inside FROM $rows)
SELECT id, CASE WHEN ok THEN round(l, 6) END AS x, CASE WHEN ok THEN round(t, 6) END AS y, CASE WHEN ok THEN round(r - l, 6) END AS width, CASE WHEN ok THEN round(b - t, 6) END AS height
FROM (SELECT id, least(a0, a1, a2) AS l, greatest(a0, a1, a2) AS r, least(b0, b1, b2) AS t, greatest(b0, b1, b2) AS b, inside AND greatest(a0, a1, a2) > least(a0, a1, a2) AND greatest(b0, b1, b2) > least(b0, b1, b2) AS ok FROM c)""",
)
def g15_polygon_boxes(df):
    point = lambda k: F.struct(F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    return df.select("id", numbers.polygon_box(F.array(point(0), point(1), point(2))).alias("b")).select("id", "b.x", "b.y", "b.width", "b.height")


PAIRS = Table("SELECT p_name || ' ' || p_brand AS reference, p_type AS output FROM part")


@query(PAIRS, "SELECT reference, output, levenshtein(reference, output) / CAST(length(reference) AS DOUBLE) AS cer FROM $rows")
def g17_character_error_rate(df):
    return df.select("reference", "output", text.character_error_rate(F.col("reference"), F.col("output")).alias("cer"))


@query(PAIRS)
def g17_word_error_rate(df):
    return df.select("reference", "output", text.word_error_rate(F.col("reference"), F.col("output")).alias("wer"))


TRANSLATED = Table("SELECT CAST(doc_id AS STRING) || ' ' || text AS source, text AS output, split(lang || ',' || source, ',') AS names FROM documents")


@query(TRANSLATED, "SELECT source, array_to_string(list_filter(list_distinct(regexp_extract_all(source, '[0-9]+')), lambda x: NOT list_contains(regexp_extract_all(output, '[0-9]+'), x)), ',') AS numbers, array_to_string(list_filter(names, lambda x: NOT contains(output, x)), ',') AS names FROM $rows")
def g18_missing_numbers_and_names(df):
    return df.select("source", F.array_join(text.numbers_missing(F.array_distinct(text.digit_groups(F.col("source"))), F.col("output")), ",").alias("numbers"), F.array_join(text.names_missing(F.col("names"), F.col("output")), ",").alias("names"))


NEGATED = Table("SELECT text AS source, lang AS a, CASE doc_id % 2 WHEN 0 THEN substr(text, 1, 60) ELSE 'no, not ' || text END AS output, CASE doc_id % 3 WHEN 0 THEN 'pt' ELSE lang END AS b FROM documents")


def _negations_sql(column: str, language: str) -> str:
    words = f"list_filter(string_split_regex(lower({column}), '[^\\p{{L}}\\p{{M}}''’]+'), lambda x: %s)"
    cases = " ".join(f"WHEN '{lang}' THEN len({words % ('list_contains([' + ', '.join(repr(m) for m in marks) + '], x)')}){(' + len(' + words % ('regexp_matches(x, ' + repr('n[' + chr(39) * 2 + '’]t$').replace(chr(34), chr(39)) + ')') + ')') if lang == 'en' else ''}" for lang, marks in text.NEGATIONS.items())
    return f"CASE {language} {cases} END"


@query(NEGATED, f"SELECT source, CASE WHEN s IS NULL OR o IS NULL THEN 'language-not-covered' WHEN s = 0 THEN 'absent-in-source' WHEN o > 0 THEN 'marker-present' ELSE 'marker-missing' END AS status FROM (SELECT source, {_negations_sql('source', 'a')} AS s, {_negations_sql('output', 'b')} AS o FROM $rows)")
def g19_negation_status(df):
    return df.select("source", text.negation_status(F.col("source"), F.col("a"), F.col("output"), F.col("b")).alias("status"))


# The pilot's price book and limits.
BOOK = numbers.PriceBook(33_600, 3_500, 1_500_000, 20_000, 190_000_000, 14, 2_000, 240, 5, 120, 120, 120, 60, 120, 3, 94_371_840, 20_971_520, 31_457_280, 3_600, 900)
UNITS = Table('SELECT CAST(user_id % 20 AS BIGINT) AS ocr_pages, CAST(event_id % 5000 AS BIGINT) AS characters, CAST(event_id % 2 AS BIGINT) AS office_files FROM events')
_FIXED = 240 + 5 + 120 + 120 * 3
_EXTRA = -(-94_371_840 * 190_000_000 // (1 << 30)) + -(-(20_971_520 + 31_457_280) * 4_500 * 14 // (1 << 30))


@query(UNITS, f"SELECT *, CAST(((CAST({_FIXED} + CASE WHEN ocr_pages > 0 THEN 120 WHEN characters > 0 THEN 60 ELSE 120 END AS HUGEINT) * (2 * 33600 + 4 * 3500) + ocr_pages * 1500000 + characters * 20000 + {_EXTRA} + 999) // 1000) + 2000 AS BIGINT) AS micros FROM $rows")
def g21_price_estimates(df):
    return df.withColumn("micros", numbers.price_micros(F.col("ocr_pages"), F.col("characters"), F.col("office_files"), BOOK))


KEYS = Table('SELECT c_name AS member, c_mktsegment AS key FROM customer')


@query(KEYS, "SELECT member, key, sha256(member || '/' || key) AS id FROM $rows")
def g23_idempotency_ids(df):
    return df.select("member", "key", identifiers.idempotency_id(F.col("member"), F.col("key")).alias("id"))


IMAGES = Table('SELECT CAST(p_size * 83 + 1 AS BIGINT) AS w, CAST(p_partkey % 997 + 1 AS BIGINT) AS h, CASE WHEN p_partkey % 4 > 0 THEN CAST(p_partkey % 800 + 1 AS BIGINT) END AS want_w, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size * 11 + 1 AS BIGINT) END AS want_h FROM part')


@query(
    IMAGES,
    """SELECT w, h, want_w, want_h,
 CAST(greatest(1, CASE WHEN want_w IS NOT NULL AND want_h IS NOT NULL THEN CASE WHEN CAST(want_w AS DOUBLE) / want_h > CAST(w AS DOUBLE) / h THEN floor(want_h * (CAST(w AS DOUBLE) / h) + 0.5) ELSE want_w END WHEN want_w IS NOT NULL THEN want_w WHEN want_h IS NOT NULL THEN floor(want_h * CAST(w AS DOUBLE) / h + 0.5) ELSE w END) AS BIGINT) AS width,
 CAST(greatest(1, CASE WHEN want_w IS NOT NULL AND want_h IS NOT NULL THEN CASE WHEN CAST(want_w AS DOUBLE) / want_h > CAST(w AS DOUBLE) / h THEN want_h ELSE floor(want_w / (CAST(w AS DOUBLE) / h) + 0.5) END WHEN want_w IS NOT NULL THEN floor(want_w * CAST(h AS DOUBLE) / w + 0.5) WHEN want_h IS NOT NULL THEN want_h ELSE h END) AS BIGINT) AS height FROM $rows""",
)
def g24_resized_images(df):
    return df.withColumn("r", numbers.resize_to_fit(F.col("w"), F.col("h"), F.col("want_w"), F.col("want_h"))).select("w", "h", "want_w", "want_h", "r.width", "r.height")


CROPS = Table('SELECT l_quantity * 2 - 1 AS x, l_discount * 900 AS y, l_tax * 500 AS w, l_discount * 300 AS h, CAST(l_partkey % 300 AS BIGINT) AS before, CAST(l_suppkey % 200 AS BIGINT) AS after FROM lineitem')


@query(CROPS, "SELECT x, y, floor(x + 0.5) >= 0 AND floor(y + 0.5) >= 0 AND floor(w + 0.5) >= 1 AND floor(h + 0.5) >= 1 AND floor(x + 0.5) + floor(w + 0.5) <= 100 AND floor(y + 0.5) + floor(h + 0.5) <= 100 AS fits, CASE WHEN before <> 0 THEN floor((before - after) / CAST(before AS DOUBLE) * 1000 + 0.5) / 10 ELSE 0.0 END AS saved FROM $rows")
def g24_crops_and_savings(df):
    return df.select("x", "y", numbers.crop_fits(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(100), F.lit(100)).alias("fits"), numbers.saved_percent(F.col("before"), F.col("after")).alias("saved"))


RANGES = Table("SELECT DISTINCT CAST(l_linenumber AS STRING) || ' - ' || CAST(l_linenumber + l_partkey % 4 AS STRING) || ',' || CAST(l_suppkey % 12 AS STRING) || CASE WHEN l_partkey % 9 = 0 THEN ',' ELSE '' END AS v, CAST(10 AS BIGINT) AS n FROM lineitem")


@query(
    RANGES,
    """WITH p AS (SELECT v, n, trim(unnest(string_split(v, ','))) AS part FROM $rows),
b AS (SELECT v, n, part, regexp_matches(part, '^[0-9]+(?:\\s*-\\s*[0-9]+)?$') AS good, TRY_CAST(regexp_extract(part, '^([0-9]+)', 1) AS BIGINT) AS a, TRY_CAST(regexp_extract(part, '([0-9]+)$', 1) AS BIGINT) AS z FROM p),
g AS (SELECT v, bool_and(good AND least(a, z) >= 1 AND greatest(a, z) <= n) AS fine FROM b GROUP BY v),
e AS (SELECT DISTINCT b.v, unnest(range(least(a, z), greatest(a, z) + 1)) AS page FROM b JOIN g ON g.v = b.v WHERE fine)
SELECT g.v, (g.v = '' OR coalesce(fine, false)) AS valid, coalesce((SELECT string_agg(CAST(page AS VARCHAR), ',' ORDER BY page) FROM e WHERE e.v = g.v), '') AS pages FROM g""",
)
def b8_page_ranges(df):
    return df.select("v", relational.page_range(F.col("v"), F.col("n")).alias("r")).select("v", "r.valid", F.array_join(F.transform("r.pages", lambda p: p.cast("string")), ",").alias("pages"))


REGIONS = Table('SELECT CAST(l_linenumber - 1 AS INT) AS page, l_discount * 10 - 0.1 AS x, l_tax * 10 AS y, l_discount * 4 AS w, l_tax * 5 AS h FROM lineitem')


@query(REGIONS, "SELECT page, x, y, w, h, page >= 1 AND x >= 0 AND y >= 0 AND w > 0 AND h > 0 AND x + w <= 1 AND y + h <= 1 AS valid FROM $rows")
def b7_region_predicates(df):
    return df.withColumn("valid", numbers.region_valid(*(F.col(c) for c in ("page", "x", "y", "w", "h"))))


SELECTORS = Table("SELECT DISTINCT split_part('TEXT_RANGE,PDF_REGION,OCR_LINE,OTHER', ',', CAST(p_size % 4 AS INT) + 1) AS selector, split_part('text/plain,application/pdf,application/vnd.ocr+json,text/markdown', ',', CAST(p_partkey % 4 AS INT) + 1) AS mime FROM part")


@query(SELECTORS, "SELECT selector, mime, (selector = 'TEXT_RANGE' AND mime IN ('text/plain', 'text/markdown')) OR (selector = 'PDF_REGION' AND mime = 'application/pdf') OR (selector = 'OCR_LINE' AND mime = 'application/vnd.ocr+json') AS fits FROM $rows")
def b6_selector_types(df):
    return df.withColumn("fits", relational.selector_fits(F.col("selector"), F.col("mime")))


TOOLS = Table("SELECT s_name AS id, split(CASE s_suppkey % 3 WHEN 0 THEN 'launcher' WHEN 1 THEN 'launcher,flow' ELSE 'other' END, ',') AS surfaces, split(CASE s_suppkey % 4 WHEN 0 THEN 'net' WHEN 1 THEN 'gpu' ELSE 'net,gpu' END, ',') AS capabilities FROM supplier")


@query(TOOLS, "SELECT id, array_to_string(list_filter(capabilities, lambda x: x <> 'net'), ',') AS missing, len(list_filter(capabilities, lambda x: x <> 'net')) = 0 AS available FROM $rows WHERE list_contains(surfaces, 'launcher') OR list_contains(surfaces, 'flow')")
def b3_b4_tool_availability(df):
    listed = relational.tools_on(df, "launcher").unionByName(relational.tools_on(df, "flow")).dropDuplicates(["id"])
    return relational.availability(listed, ["net"]).select("id", F.array_join("missing", ",").alias("missing"), "available")


CITED = Table("SELECT doc_id, text || ' [p. ' || CAST(doc_id % 9 AS STRING) || '] x [P. 2-' || CAST(doc_id % 5 AS STRING) || ']' AS text, CAST(doc_id % 7 AS INT) AS total_pages FROM documents")


@query(
    CITED,
    """WITH m AS (SELECT doc_id, greatest(1, total_pages) AS n, unnest(regexp_extract_all(text, '(?i)\\[p\\.\\s*([0-9]+)(?:\\s*[–-]\\s*([0-9]+))?\\]', 0)) AS c FROM $rows),
s AS (SELECT doc_id, n, CAST(regexp_extract(c, '([0-9]+)', 1) AS INT) AS a, coalesce(TRY_CAST(nullif(regexp_extract(c, '[–-]\\s*([0-9]+)', 1), '') AS INT), CAST(regexp_extract(c, '([0-9]+)', 1) AS INT)) AS z FROM m)
SELECT DISTINCT doc_id, a AS first_page, least(n, greatest(a, z)) AS last_page FROM s WHERE a BETWEEN 1 AND n""",
)
def h21_citations(df):
    return segments.citations(df).select("doc_id", "first_page", "last_page")


HEADINGS = Table("SELECT CASE p_partkey % 3 WHEN 0 THEN p_name || '.' ELSE p_name END AS text, p_retailprice / 100 AS size, p_size % 2 = 0 AS bold FROM part")


@query(HEADINGS, "SELECT text, CASE WHEN length(text) <= 100 AND NOT regexp_matches(text, '[.!?]$') THEN CASE WHEN size / 11 >= 1.6 THEN 1 WHEN size / 11 >= 1.3 THEN 2 WHEN size / 11 >= 1.15 OR bold THEN 3 END END AS level FROM $rows")
def i9_heading_levels(df):
    return df.select("text", layout.heading_level(F.col("text"), F.col("size"), F.col("bold"), F.lit(11.0)).alias("level"))


PLACED = Table('SELECT l_orderkey AS doc_id, 1 AS page, l_quantity * 2 AS x, l_discount * 1000 AS y, l_tax * 400 AS width, CASE WHEN l_linenumber = 2 THEN 0 ELSE CAST(10 AS DOUBLE) END AS height, CAST(12 AS DOUBLE) AS font_size, false AS bold, CAST(l_partkey AS STRING) AS str, CAST(100 AS DOUBLE) AS page_width, CAST(100 AS DOUBLE) AS page_height FROM lineitem')


@query(PLACED, "SELECT str, x < 20 - 0.01 OR x + width > 80.0 + 0.01 OR y - CASE WHEN height > 0 THEN height ELSE font_size END < 5.0 - 0.01 OR y > 75.0 + 0.01 AS cut FROM $rows WHERE NOT (x + width <= 20 OR x >= 80 OR y <= 5 OR y - CASE WHEN height > 0 THEN height ELSE font_size END >= 75)")
def i5_region_filter(df):
    return geometry.region_filter(df, 0.2, 0.05, 0.6, 0.7).select("str", "cut")


GRID = Table('SELECT l_suppkey AS doc_id, CAST(1 + l_orderkey % 4 AS INT) AS page, CAST(40 + 150 * (l_linenumber % 3) AS DOUBLE) AS x, CAST(50 + 20 * (l_partkey % 40) AS DOUBLE) AS y, CAST(60 AS DOUBLE) AS width, CAST(10 AS DOUBLE) AS height, CAST(10 AS DOUBLE) AS font_size, l_linenumber < 3 AS bold, CAST(l_partkey AS STRING) AS str, CAST(600 AS DOUBLE) AS page_width FROM lineitem')


@query(GRID, """WITH e AS (SELECT doc_id, page, x AS edge, 1 AS d FROM $rows WHERE font_size < 15 UNION ALL SELECT doc_id, page, x + width, -1 FROM $rows WHERE font_size < 15),
w AS (SELECT doc_id, page, edge, lag(edge) OVER (PARTITION BY doc_id, page ORDER BY edge, d) AS before, coalesce(sum(d) OVER (PARTITION BY doc_id, page ORDER BY edge, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS active FROM e)
SELECT doc_id, page, (before + edge) / 2 AS boundary FROM w WHERE active = 0 AND edge - before >= 8""")
def f12_gap_sweep(df):
    spans = df.filter("font_size < 15").select("doc_id", "page", "x", (F.col("x") + F.col("width")).alias("right"))
    return layout.gap_sweep(spans).select("doc_id", "page", "boundary")


PDFS = Table('SELECT CAST(p_partkey AS INT) AS id, p_size % 7 = 0 AS signed, CAST(p_partkey * 71 % 100000 AS BIGINT) AS total, CAST(p_size % 4 AS BIGINT) AS images, CAST(p_partkey * 13 % 90000 AS BIGINT) AS image_bytes, p_partkey % 2 = 0 AS streams FROM part')


@query(
    PDFS,
    """WITH m AS (SELECT *, greatest(5, floor(image_bytes / CAST(nullif(total, 0) AS DOUBLE) * 25 + 0.5)) AS lo FROM $rows)
SELECT id, CAST(CASE WHEN signed OR total = 0 OR images = 0 THEN 0 ELSE lo END AS INT) AS low, CAST(CASE WHEN signed OR total = 0 THEN 0 WHEN images = 0 THEN CASE WHEN streams OR total < 4096 THEN 6 ELSE 10 END ELSE least(85, greatest(lo + 10, floor(image_bytes / CAST(total AS DOUBLE) * 65 + CASE WHEN streams THEN 0 ELSE 8 END + 0.5))) END AS INT) AS high FROM m""",
)
def m_savings_range(df):
    return df.select("id", geometry.savings_range(*(F.col(c) for c in ("signed", "total", "images", "image_bytes", "streams"))).alias("r")).select("id", "r.low", "r.high")


HELD = Table("SELECT CAST(o_custkey % 200 AS STRING) AS participant, substr(CAST(o_orderdate AS STRING), 1, 7) AS period, split_part('settled,queued,cancelled,running,needs_reconciliation', ',', CAST(o_orderkey % 5 AS INT) + 1) AS state, CAST(o_orderkey % 90000 AS BIGINT) AS maximum_micros, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_orderkey % 80000 AS BIGINT) END AS actual_micros FROM orders")


@query(HELD, "SELECT participant, period, CAST(coalesce(sum(actual_micros) FILTER (state = 'settled'), 0) AS BIGINT) AS used_micros, CAST(coalesce(sum(maximum_micros) FILTER (state IN ('queued', 'running', 'needs_reconciliation')), 0) AS BIGINT) AS reserved_micros, CAST(greatest(0, 200000 - coalesce(sum(actual_micros) FILTER (state = 'settled'), 0) - coalesce(sum(maximum_micros) FILTER (state IN ('queued', 'running', 'needs_reconciliation')), 0)) AS BIGINT) AS remaining_micros FROM $rows GROUP BY participant, period")
def k4_usage(df):
    return ledger.usage(df)


@query(HELD, "SELECT participant, count(*) FILTER (state IN ('running', 'needs_reconciliation')) AS running, (SELECT count(*) FILTER (state IN ('running', 'needs_reconciliation')) FROM $rows) AS running_all FROM $rows GROUP BY participant")
def d9_running_counts(df):
    return ledger.running_counts(df)


JOBS = Table("SELECT CAST(o_orderkey AS STRING) AS job_id, split_part('settled,queued,cancelled,running,needs_reconciliation', ',', CAST(o_orderkey % 5 AS INT) + 1) AS state, CAST(o_custkey % 1000 AS BIGINT) AS enqueued_at, CAST(o_custkey % 2000 AS BIGINT) AS lease_until, o_custkey % 2 = 0 AS external_started, CASE WHEN o_orderkey % 5 = 4 THEN CAST(o_custkey % 1000 AS BIGINT) END AS unknown_since FROM orders")


@query(JOBS, """SELECT job_id, CASE state WHEN 'queued' THEN CASE WHEN 1000 - enqueued_at > 300 THEN 'expired' ELSE 'fresh' END WHEN 'running' THEN CASE WHEN 1000 < lease_until THEN 'active' WHEN external_started THEN 'lease_expired' ELSE 'requeued' END
 WHEN 'needs_reconciliation' THEN CASE WHEN 1000 - unknown_since >= 600 THEN 'quarantined' ELSE 'reconcile' END ELSE 'final' END AS outcome FROM $rows""")
def k5_k6_k8_sweep(df):
    return ledger.sweep(df, F.lit(1000)).select("job_id", "outcome")


QUOTES = Table("SELECT CAST(l_orderkey * 10 + l_linenumber AS INT) AS id, CAST(l_partkey % 400 AS BIGINT) AS expires_at, CASE WHEN l_suppkey % 9 = 0 THEN 'old' ELSE 'p' END AS policy_version, CAST(l_quantity AS BIGINT) AS bytes, CAST(l_suppkey % 90 + 10 AS BIGINT) AS max_bytes, CAST(l_quantity * (l_partkey % 120) AS BIGINT) AS expanded_bytes, l_returnflag AS found_mime, CASE WHEN l_linenumber = 3 THEN 'x' ELSE l_returnflag END AS mime, l_linestatus AS found_units, CASE WHEN l_linenumber = 4 THEN 'x' ELSE l_linestatus END AS units, CAST(l_partkey % 10 AS BIGINT) AS found_maximum, CAST(l_suppkey % 10 AS BIGINT) AS maximum FROM lineitem")


@query(QUOTES, "SELECT id, CASE WHEN 100 >= expires_at OR policy_version <> 'p' THEN 'expired' WHEN bytes > max_bytes OR expanded_bytes > greatest(bytes, 1) * 100 THEN 'invalid' WHEN found_mime <> mime OR found_units <> units OR found_maximum > maximum THEN 'changed' ELSE 'ok' END AS status FROM $rows")
def k10_finalize(df):
    return ledger.finalize_status(df, F.lit(100), "p").select("id", "status")


LOG = Table("SELECT event_id AS seq, unix_seconds(CAST(ts AS TIMESTAMP)) AS at, split_part('reserve,claim,started,settle', ',', CAST(event_id % 4 AS INT) + 1) AS action, CAST(user_id AS STRING) AS job_id, CAST(user_id % 50 AS STRING) AS participant, CAST(event_id % 3000 AS BIGINT) AS maximum, CAST(event_id % 3 AS BIGINT) AS ocr_pages, CAST(0 AS BIGINT) AS characters, CAST(0 AS BIGINT) AS office_files, CAST(user_id AS STRING) AS fingerprint, CAST(120 AS BIGINT) AS lease, CAST(event_id % 3 AS INT) AS fence, CAST(event_id % 900 AS BIGINT) AS actual FROM events")


@query(LOG)
def k2_k3_k5_ledger(df):
    return ledger.run_ledger(df)


MATRIX = Table("SELECT o_custkey % 100 AS run, CAST(o_orderkey % 2 AS INT) AS engine_order, CAST(o_orderkey % 1000 AS INT) AS item_order, CASE WHEN o_orderkey % 2 = 0 THEN 'local' ELSE 'cloud' END AS engine, CAST(o_orderkey AS STRING) AS item, o_orderkey % 2 = 1 AS cloud, o_orderkey % 7 = 0 AS private, CASE WHEN o_orderkey % 5 > 0 THEN CAST(o_totalprice AS BIGINT) END AS estimate, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_totalprice / 2 AS BIGINT) END AS cost FROM orders")


@query(MATRIX)
def l2_run_gates(df):
    return evaluation.run_gates(df)


SCORED = Table("SELECT CASE WHEN l_linenumber % 2 = 1 THEN 'a' ELSE 'b' END AS engine, 'ocr' AS kind, CAST(l_orderkey AS STRING) || '-' || CAST(CAST(floor((l_linenumber + 1) / 2) AS INT) AS STRING) AS item, CAST(l_orderkey * 10 + l_linenumber AS INT) AS seq, CASE WHEN l_partkey % 31 = 0 THEN 'error' WHEN l_partkey % 37 = 0 THEN 'skipped' ELSE 'ok' END AS status, l_suppkey % 19 = 0 AS cold, l_extendedprice AS ms, l_discount AS cer, l_tax AS wer, CAST(l_partkey % 2 AS INT) AS failures, CAST(l_quantity AS BIGINT) AS cost_micros FROM lineitem")


@query(
    SCORED,
    """SELECT engine, kind, count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'skipped') AS skipped, round(avg(cer) FILTER (status = 'ok'), 9) AS mean_cer,
 min_by(ms, seq) FILTER (status = 'ok' AND cold) AS cold_ms, quantile_disc(ms, 0.5) FILTER (status = 'ok' AND NOT cold) AS warm_p50_ms, quantile_disc(ms, 0.95) FILTER (status = 'ok' AND NOT cold) AS warm_p95_ms, CAST(coalesce(sum(cost_micros) FILTER (status = 'ok'), 0) AS BIGINT) AS cost_micros FROM $rows GROUP BY engine, kind""",
)
def d5_d6_l3_summary(df):
    return evaluation.summarize(df).withColumn("mean_cer", F.round("mean_cer", 9))


@query(
    SCORED,
    """WITH p AS (SELECT x.cer AS a, y.cer AS b, x.wer AS c, y.wer AS d, x.failures AS e, y.failures AS f FROM (SELECT * FROM $rows WHERE engine = 'a' AND status = 'ok') x JOIN (SELECT * FROM $rows WHERE engine = 'b' AND status = 'ok') y ON x.item = y.item),
s AS (SELECT count(*) AS n, avg(a) AS ca, avg(b) AS cb, avg(c) AS wa, avg(d) AS wb, sum(e) AS fa, sum(f) AS fb FROM p)
SELECT n, CASE WHEN n < 10 THEN 'inconclusive' WHEN cb > ca * 1.1 + 1e-12 OR fb > fa THEN 'worse' WHEN ca > 0 AND cb <= ca * 0.8 AND wb <= wa THEN 'better' ELSE 'equivalent' END AS verdict, round(ca, 9) AS mean_base, round(cb, 9) AS mean_candidate, CAST(fa AS BIGINT) AS failures_base, CAST(fb AS BIGINT) AS failures_candidate FROM s""",
)
def c3_l4_paired_verdict(df):
    return evaluation.paired_verdict(df, "a", "b", "ocr").withColumn("mean_base", F.round("mean_base", 9)).withColumn("mean_candidate", F.round("mean_candidate", 9))


@query(SCORED)
def l6_summary_rows(df):
    return evaluation.summary_rows(evaluation.summarize(df))


HYBRID = Table('SELECT doc_id, 1 AS page, substr(text, 1, CAST(doc_id % 60 AS INT)) AS native, CASE WHEN doc_id % 3 > 0 THEN substr(text, 1, 40) END AS recognized FROM documents')


@query(HYBRID, """SELECT doc_id, page, CASE WHEN t = '' THEN 'empty' WHEN o THEN 'ocr' ELSE 'native' END AS status, CASE WHEN t = '' THEN '*Página ' || page || ' vazia.*' ELSE t END AS text
FROM (SELECT doc_id, page, length(trim(native)) < 30 AND length(trim(coalesce(recognized, ''))) > length(trim(native)) AS o, CASE WHEN length(trim(native)) < 30 AND length(trim(coalesce(recognized, ''))) > length(trim(native)) THEN trim(recognized) ELSE trim(native) END AS t FROM $rows)""")
def a10_hybrid_pages(df):
    from ..sources.documents import hybrid_pages

    return hybrid_pages(df)


STREAM = Table("SELECT o_custkey AS doc_id, 1 AS page, CAST(o_orderkey AS INT) AS seq, CAST(o_orderkey % 50 AS DOUBLE) AS y, o_orderstatus || CAST(o_orderkey AS STRING) AS str FROM orders")


@query(STREAM, """WITH g AS (SELECT *, y - lag(y) OVER (PARTITION BY doc_id, page ORDER BY seq) AS gap FROM $rows)
SELECT doc_id, page, string_agg(CASE WHEN gap IS NULL THEN '' WHEN abs(gap) > 5 THEN chr(10) ELSE ' ' END || str, '' ORDER BY seq) AS text FROM g GROUP BY doc_id, page""")
def a9_page_text(df):
    return geometry.page_text(df)


MASKED = Table("SELECT text || CASE doc_id % 3 WHEN 0 THEN ' {name}, see https://x.y/z and %(n)s or %d' WHEN 1 THEN '{{a}}{b} 5%x' ELSE '' END AS v FROM documents")


@query(MASKED, "SELECT v, len(regexp_extract_all(v, 'https?://\\S+|\\{\\{[^{}]+\\}\\}|\\{[^{}]+\\}|%\\([^)]+\\)[a-zA-Z]|%[a-zA-Z]')) AS n, true AS same FROM $rows")
def h17_placeholders(df):
    masked = df.select("v", segments.mask_placeholders(F.col("v")).alias("m"))
    return masked.select("v", F.size("m.placeholders").cast("long").alias("n"), (segments.restore_placeholders(F.col("m.masked"), F.col("m.placeholders"))["text"] == F.col("v")).alias("same"))


EPOCHS = Table('SELECT DISTINCT unix_seconds(CAST(ts AS TIMESTAMP)) AS at FROM events')


@query(EPOCHS)
def g22_billing_periods(df):
    return df.select("at", dates.billing_period(F.col("at")).alias("period"), dates.billing_period_end(F.col("at")).alias("ends_at"), dates.in_guard(F.col("at")).alias("guarded"))


SCORES = Table('SELECT doc_id AS pair_id, CAST(l AS INT) AS left_page, CAST(r AS INT) AS right_page, CAST(((doc_id + l * 7 + r * 3) % 11) AS DOUBLE) / 10 AS similarity FROM documents LATERAL VIEW explode(sequence(1, 4)) a AS l LATERAL VIEW explode(sequence(1, 5)) b AS r')


@query(SCORES)
def c7_i13_aligned_pages(df):
    return geometry.aligned_pages(df)


ALIGNED = Table('SELECT CAST(l_orderkey * 10 + l_linenumber AS INT) AS seq, CASE WHEN l_linenumber <> 2 THEN CAST(l_linenumber AS INT) END AS left_page, CASE WHEN l_linenumber <> 3 THEN CAST(l_linenumber AS INT) END AS right_page, l_returnflag AS left_text, CASE WHEN l_partkey % 5 = 0 THEN l_linestatus ELSE l_returnflag END AS right_text, CASE WHEN l_partkey % 3 > 0 THEN CAST(l_suppkey % 4 AS BIGINT) END AS changed_pixels, l_partkey % 11 = 0 AS geometry_changed FROM lineitem')


@query(ALIGNED, "SELECT seq, CASE WHEN left_page IS NULL THEN 'added' WHEN right_page IS NULL THEN 'removed' WHEN coalesce(left_text, '') <> coalesce(right_text, '') OR coalesce(changed_pixels, 0) > 0 OR coalesce(geometry_changed, false) THEN 'modified' ELSE 'unchanged' END AS status FROM $rows")
def i15_page_status(df):
    return geometry.page_status(df).select("seq", "status")


PIXELS = Table('SELECT DISTINCT l_suppkey AS page_id, CAST(l_partkey % 100 AS INT) AS x, CAST(l_suppkey % 100 AS INT) AS y FROM lineitem')


@query(PIXELS)
def i14_changed_regions(df):
    return geometry.changed_regions(df, 100, 100)


FILES = Table('SELECT CAST(o_custkey AS INT) AS batch_id, CAST(floor(o_totalprice) * 100 AS BIGINT) AS size, CAST(floor(o_totalprice) AS BIGINT) AS before, CAST(floor(o_totalprice) - o_orderkey % 700 AS BIGINT) AS after FROM orders')


@query(FILES, "SELECT batch_id, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, count(*) > 50 OR sum(size) > 536870912 AS exceeds FROM $rows GROUP BY batch_id")
def d10_batch_totals(df):
    return relational.batch_totals(df)


@query(FILES, "SELECT CAST(sum(before) AS BIGINT) AS before, CAST(sum(after) AS BIGINT) AS after, CAST(sum(before) - sum(after) AS BIGINT) AS saved, floor((sum(before) - sum(after)) / CAST(sum(before) AS DOUBLE) * 1000 + 0.5) / 10 AS percent FROM $rows")
def d10_result_totals(df):
    return relational.result_totals(df)


ANSWERS = Table("SELECT CAST(doc_id AS INT) AS response_id, CAST(doc_id % 7 AS INT) AS source_characters, split(CASE doc_id % 4 WHEN 0 THEN substr(text, 1, 40) WHEN 1 THEN 'a;;b' WHEN 2 THEN '   ' ELSE substr(text, 1, 15) END, ';;') AS translations FROM documents")


@query(ANSWERS, "SELECT response_id, CASE WHEN len(translations) <> 1 THEN 'shape' WHEN regexp_matches(translations[1], '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]') THEN 'text' WHEN source_characters > 0 AND trim(translations[1]) = '' THEN 'text' WHEN length(translations[1]) > 20 THEN 'too large' END AS error FROM $rows")
def i17_translation_responses(df):
    return evaluation.normalize_translation(df, 5).select("response_id", "error")


RECOGNIZED = Table("SELECT CAST(doc_id AS INT) AS response_id, CAST(1 + CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 0 END AS INT) AS expected_pages, substr(text, 1, 50) AS text, array(named_struct('number', 1, 'lines', array(named_struct('segments', array(named_struct('start', 0, 'end', CAST(length(substr(text, 1, 50)) + CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END AS INT))), 'confidence', 0.9D, 'vertices', array(named_struct('x', 0.1D, 'y', 0.1D), named_struct('x', 0.5D, 'y', 0.1D), named_struct('x', 0.5D, 'y', 0.2D)))))) AS pages FROM documents")


@query(RECOGNIZED)
def i16_recognition_responses(df):
    return evaluation.normalize_recognition(df).select("response_id", "page", "seq", "text", "confidence", "box.x", "box.width", "error")


OCR = Table('SELECT CAST(doc_id AS STRING) AS item, substr(text, 1, 200) AS reference, substr(text, CAST(1 + doc_id % 3 AS INT), 200) AS output FROM documents')


@query(OCR)
def l1_recognition_scores(df):
    return evaluation.score_recognition(df).select("item", "cer", "wer", F.array_join("numbers_missing", ",").alias("numbers"), "error")


LETTERS = Table("SELECT CAST(doc_id AS STRING) AS item, CAST(doc_id AS STRING) || ' ' || substr(text, 1, 300) AS source, lang AS source_language, substr(text, 1, 200) AS output, 'en' AS output_language, split(lang || ',' || source, ',') AS names FROM documents")


@query(LETTERS)
def l1_translation_scores(df):
    return evaluation.score_translation(df).select("item", F.array_join("names_missing", ",").alias("names"), F.array_join("numbers_missing", ",").alias("numbers"), "negation")


OFFICE = Table("SELECT CAST(doc_id AS STRING) AS item, substr(text, 1, 200) AS reference, substr(text, 1, CAST(150 + doc_id % 60 AS INT)) AS output, CAST(doc_id % 3 AS INT) AS reference_pages, CAST(doc_id % 4 AS INT) AS output_pages, split(lang || ',' || source, ',') AS reference_fonts, split(lang, ',') AS output_fonts, CAST(doc_id % 5 AS INT) AS reference_tables, CAST(doc_id % 2 AS INT) AS output_tables FROM documents")


@query(OFFICE)
def l5_office_scores(df):
    return evaluation.score_office(df).select("item", "pages_equal", "cer", "wer", F.array_join("fonts_missing", ",").alias("fonts"), "tables_difference")


@query(UNTRUSTED, "SELECT v, 'Resuma os pontos principais. Cite p\u00e1ginas como [p. X]. Trecho [p. 1]:' || chr(10) || '<documento_fonte>' || chr(10) || v || chr(10) || '</documento_fonte>' AS prompt FROM $rows")
def h20_prompts(df):
    return df.select("v", segments.summary_prompt(F.col("v"), F.lit("[p. 1]"), "executive").alias("prompt"))
