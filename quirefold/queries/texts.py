"""Text operators over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import diff, extraction, geometry, html_blocks, review, segments
from .common import Table, load

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+')"


def _listed(words: tuple[str, ...]) -> str:
    return f"len(list_filter({_TOKENS}, lambda x: x IN ({', '.join(repr(w) for w in words)})))"


@query(
    rf"""SELECT doc_id, CAST(length(text) AS BIGINT) AS chars, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words,
 CAST(len(string_split(text, chr(10))) - CASE WHEN suffix(text, chr(10)) OR text = '' THEN 1 ELSE 0 END AS BIGINT) AS lines, CASE WHEN {_listed(text.PORTUGUESE)} >= {_listed(text.ENGLISH)} THEN 'pt-BR' ELSE 'en' END AS language FROM documents"""
)
def g25_g26_metrics_and_language(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", text.text_metrics(F.col("text")).alias("m"), text.language_vote(F.col("text")).alias("language")).select("doc_id", "m.*", "language")


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{N}][\\p{L}\\p{M}\\p{N}]*')) AS INT) AS counted, CAST(len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}]+|[^\\p{L}\\p{M}\\p{N}]')) AS INT) AS tokens FROM documents")
def g5_g6_tokens(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    return docs.select("doc_id", text.count_words(F.col("text")).alias("counted"), F.size(text.tokens(F.col("text"))).alias("tokens"))


_FOUND = {
    "cpf": r"\b[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2}\b|\b[0-9]{11}\b",
    "cnpj": r"\b[0-9]{2}\.[0-9]{3}\.[0-9]{3}/[0-9]{4}-[0-9]{2}\b|\b[0-9]{14}\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    "cep": r"\b[0-9]{5}-[0-9]{3}\b",
    "date": r"(?i)\b[0-9]{1,2}[/.-][0-9]{1,2}[/.-][0-9]{4}\b|\b[0-9]{1,2}\s+de\s+(?:janeiro|fevereiro|março|marco|abril|maio|junho|julho|agosto|setembro|outubro|novembro|dezembro)\s+de\s+[0-9]{4}\b",
    "money": r"(?i)(?:(?:R\$|\$|€|USD|EUR|BRL)\s*(?:[0-9]{1,3}(?:\.[0-9]{3})*|[0-9]+)(?:,[0-9]{2})?)|(?:(?:[0-9]{1,3}(?:\.[0-9]{3})*|[0-9]+),[0-9]{2}\s*(?:reais|dólares|dolares|euros))",
}
_ENTITIES = " UNION ALL ".join(f"SELECT doc_id, '{c}' AS category, trim({'lower' if c == 'email' else ''}(unnest(regexp_extract_all(text, '{p}')))) AS value FROM $docs" for c, p in _FOUND.items())
#: Documents with a line of personal data and amounts, so that every category occurs.
RECORDS = Table("SELECT doc_id, text || '\nContratante: Ana Souza; CPF ' || lpad(CAST(doc_id * 7919 AS STRING), 11, '0') || '. Valor: R$ 1.' || lpad(CAST(doc_id % 1000 AS STRING), 3, '0') || ',56 ou ' || CAST(doc_id AS STRING) || ',00 reais. CEP 01310-' || lpad(CAST(doc_id % 1000 AS STRING), 3, '0') || '. Em ' || CAST(1 + doc_id % 28 AS STRING) || '/12/2024 e 5 de maio de 2023; Mail: A.b' || CAST(doc_id AS STRING) || '@X.com.br' AS text FROM documents")


@query("SELECT doc_id, category, value, count(*) AS count FROM (" + _ENTITIES.replace("$docs", RECORDS.sql) + ") GROUP BY doc_id, category, value")
def h1_contract_entities(spark, sf_dir):
    return extraction.extract_entities(RECORDS.frame(spark, sf_dir)).filter("category <> 'phone'").select("doc_id", "category", "value", "count")


@query()
def h1_entities(spark, sf_dir):
    return extraction.extract_entities(load(spark, sf_dir, "documents"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')")
def i18_documents_with_email(spark, sf_dir):
    pages = load(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    return geometry.sensitive_matches(pages, geometry.PRESETS["email"]).select("doc_id").distinct()


@query("SELECT doc_id, start - 1 AS start, start + 2 AS stop FROM (SELECT doc_id, instr(lower(text), 'and') AS start FROM documents) WHERE start > 0")
def i18_first_literal_match(spark, sf_dir):
    pages = load(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("page"), "text")
    found = geometry.sensitive_matches(pages, geometry.literal_pattern("and"))
    return found.filter("seq = 0").select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"))


_PAIR = r"'(?:^|[.;\n])\s*([A-ZÀ-Úa-zà-ú0-9\s_\-]{2,40})\s*[:=]\s*([^.;\n]+)'"


@query(
    rf"""WITH m AS (SELECT doc_id, regexp_extract_all(text, {_PAIR}, 1) AS ks, regexp_extract_all(text, {_PAIR}, 2) AS vs FROM documents),
p AS (SELECT doc_id, unnest(range(1, len(ks) + 1)) AS pos, unnest(ks) AS k, unnest(vs) AS v FROM m),
c AS (SELECT doc_id, pos, regexp_replace(k, '^\s+|\s+$', '', 'g') AS key, regexp_replace(v, '^\s+|\s+$', '', 'g') AS value FROM p)
SELECT doc_id, key, arg_max(value, pos) AS value FROM c WHERE key <> '' AND value <> '' AND length(value) < 200 GROUP BY doc_id, key"""
)
def h2_key_values(spark, sf_dir):
    return extraction.extract_key_values(load(spark, sf_dir, "documents"))


@query("SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}][\\p{L}\\p{M}\\p{N}]*')) AS word FROM documents) GROUP BY word")
def d7_word_counts(spark, sf_dir):
    words = F.regexp_extract_all(F.lower("text"), F.lit(text.COUNTED), F.lit(0))
    return load(spark, sf_dir, "documents").select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


#: Documents under headings and above a table of their own.
OUTLINES = Table(
    "SELECT doc_id, 'INTRODUÇÃO ' || upper(lang) || '\n1. Um\n1.1 Dois\nA. Letra ' || CAST(doc_id AS STRING) || '\nI. Romano\nII. Outro\nCapítulo ' || CAST(doc_id AS STRING) || '\n# Marca\n' || text || '\nTabela ' || CAST(doc_id AS STRING) || ':\n| a | b' || CAST(doc_id % 7 AS STRING) || ' |\n|---|---|\n| 1 | 2 |\n| ' || CAST(doc_id AS STRING) || ' | |\n\nfim' AS text FROM documents"
)


@query()
def h4_sections(spark, sf_dir):
    return extraction.extract_sections(OUTLINES.frame(spark, sf_dir))


@query(rf"""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS line FROM {OUTLINES.sql})
SELECT doc_id, line, CAST(CASE WHEN regexp_matches(line, '^#{{1,6}}\s') THEN length(regexp_extract(line, '^#+')) WHEN length(line) > 160 THEN NULL WHEN regexp_matches(line, '^(?i:Capítulo|Capitulo|Seção|Secao|Parte|Unidade|Módulo|Modulo|Tópico|Topico|Item|Artigo|Art\.|Cláusula|Clausula|Apêndice|Apendice|Anexo)\s+[0-9A-Za-zº°ª.-]') THEN 2 WHEN upper(line) = line AND lower(line) <> line AND length(line) BETWEEN 3 AND 60 AND line NOT LIKE '%.' THEN 1
 WHEN regexp_matches(line, '^[0-9]+(\.[0-9]+)*\.?(\s|$)') THEN least(6, length(regexp_extract(line, '^[0-9]+(?:\.[0-9]+)*')) - length(replace(regexp_extract(line, '^[0-9]+(?:\.[0-9]+)*'), '.', '')) + 2) END AS INT) AS level FROM l WHERE line <> ''""")
def h4_levels_of_single_lines(spark, sf_dir):
    lines = OUTLINES.frame(spark, sf_dir).select("doc_id", F.explode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("line")).filter("line <> ''")
    return extraction.outline_levels(lines)


@query("SELECT doc_id, 'Tabela ' || doc_id AS title, 'a|b' || doc_id % 7 AS headers, '1,2;' || doc_id || ',' AS cells FROM documents")
def h3_tables(spark, sf_dir):
    cells = F.array_join(F.transform("rows", lambda r: F.array_join(r, ",")), ";")
    return extraction.extract_tables(OUTLINES.frame(spark, sf_dir)).select("doc_id", "title", F.array_join("headers", "|").alias("headers"), cells.alias("cells"))


@query()
def h5_structured_markdown(spark, sf_dir):
    docs = OUTLINES.frame(spark, sf_dir)
    return extraction.structured_markdown(docs, extraction.extract_sections(docs))


@query()
def h6_extract_information(spark, sf_dir):
    found = extraction.extract_information(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "mode", "metrics.words", "language", F.size("entities").alias("n_entities"), F.size("key_values").alias("n_key_values"), F.size("sections").alias("n_sections"))


def _revisions(spark, sf_dir):
    """doc_id, original, modified: each document and the next one of its source. Only ids are ordered; texts join by id."""
    docs = load(spark, sf_dir, "documents")
    order = Window.partitionBy("source").orderBy("doc_id")
    follows = docs.select("doc_id", F.lead("doc_id").over(order).alias("next_id")).filter("next_id IS NOT NULL")
    after = docs.select(F.col("doc_id").alias("next_id"), F.col("text").alias("modified"))
    return docs.select("doc_id", F.col("text").alias("original")).join(follows, "doc_id").join(after, "next_id").select("doc_id", "original", "modified")


@query()
def h7_h9_diff_stats(spark, sf_dir):
    """Each document against the next one of its source, as consecutive revisions."""
    return diff.diff_stats(_revisions(spark, sf_dir).withColumnRenamed("doc_id", "pair_id"))


@query()
def h10_review_findings(spark, sf_dir):
    return review.review(load(spark, sf_dir, "documents")).groupBy("category", "severity").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


#: The first " the " of each document as a finding, and the first " of ", which may be stale or overlap it.
FINDINGS = Table("SELECT doc_id, CAST(instr(text, ' the ') - 1 AS INT) AS start, CAST(instr(text, ' the ') + 4 AS INT) AS stop, ' the ' AS original, ' THE ' AS replacement FROM documents WHERE instr(text, ' the ') > 0")
SECOND = Table(
    "SELECT doc_id, CAST(instr(text, ' of ') - 3 - doc_id % 3 AS INT) AS start, CAST(instr(text, ' of ') + 2 AS INT) AS stop, substr(text, CAST(instr(text, ' of ') - 2 - doc_id % 3 AS INT), CAST(5 + doc_id % 3 AS INT)) AS original, CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE ' OF ' END AS replacement FROM documents WHERE instr(text, ' of ') > 6"
)
GUARDED = Table("SELECT doc_id, CAST(doc_id % 400 AS INT) AS start, CAST(doc_id % 400 + 200 AS INT) AS stop FROM documents")


def _findings(table, spark, sf_dir):
    return table.frame(spark, sf_dir).withColumnRenamed("stop", "end")


@query(f"SELECT doc_id, start, stop FROM {FINDINGS.sql} WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id AS d, start AS s, stop AS e FROM {GUARDED.sql}) WHERE d = doc_id AND start < e AND stop > s)")
def c4_findings_outside_spans(spark, sf_dir):
    return review.outside_spans(_findings(FINDINGS, spark, sf_dir), _findings(GUARDED, spark, sf_dir)).select("doc_id", "start", F.col("end").alias("stop"))


@query(f"""WITH f AS (SELECT * FROM {FINDINGS.sql}), s AS (SELECT * FROM {SECOND.sql})
SELECT doc_id, start, stop, replacement FROM f UNION ALL SELECT doc_id, start, stop, replacement FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.doc_id = s.doc_id AND f.start < s.stop AND f.stop > s.start)""")
def h11_merged_findings(spark, sf_dir):
    found = review.merge_findings(_findings(FINDINGS, spark, sf_dir), _findings(SECOND, spark, sf_dir))
    return found.select("doc_id", "start", F.col("end").alias("stop"), "replacement")


@query(f"""WITH f AS (SELECT * FROM {FINDINGS.sql} UNION ALL SELECT * FROM {SECOND.sql}),
o AS (SELECT doc_id, start, stop, replacement, lead(start) OVER (PARTITION BY doc_id ORDER BY start, stop) < stop AS hits FROM f),
e AS (SELECT doc_id, bool_or(coalesce(hits, false)) AS bad FROM o GROUP BY doc_id),
x AS (SELECT doc_id, min(start) AS s1, arg_min(stop, start) AS e1, arg_min(replacement, start) AS r1, count(*) AS n, max(start) AS s2, arg_max(stop, start) AS e2, arg_max(replacement, start) AS r2 FROM f GROUP BY doc_id),
p AS (SELECT d.doc_id, d.text, coalesce(e.bad, false) AS bad, s1, e1, r1, CASE WHEN n > 1 THEN s2 END AS s2, e2, r2 FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id)
SELECT doc_id, CASE WHEN bad THEN NULL WHEN s1 IS NULL THEN md5(text) WHEN s2 IS NULL THEN md5(substr(text, 1, s1) || r1 || substr(text, e1 + 1)) ELSE md5(substr(text, 1, s1) || r1 || substr(text, e1 + 1, s2 - e1) || r2 || substr(text, e2 + 1)) END AS result,
 CASE WHEN bad THEN 'stale or overlapping finding' END AS error FROM p""")
def h12_applied_findings(spark, sf_dir):
    found = _findings(FINDINGS, spark, sf_dir).unionByName(_findings(SECOND, spark, sf_dir))
    return review.apply_findings(load(spark, sf_dir, "documents"), found).select("doc_id", F.md5(F.col("text").cast("binary")).alias("result"), "error")


@query(
    r"""WITH k AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}_''’-]+'))) AS word FROM benchmark),
w AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, 'https?://\S+|www\.\S+|[A-Za-z0-9_.%+-]+@[A-Za-z0-9_.-]+\.[A-Za-z]{2,}', ' ', 'g'), '[\p{L}\p{M}\p{N}_''’-]+')) AS word FROM documents),
c AS (SELECT doc_id, word, count(*) AS n FROM w WHERE length(word) > 1 AND NOT regexp_matches(word, '[\p{N}_]') AND NOT regexp_matches(word, '^\p{Lu}{2,8}$') GROUP BY doc_id, word)
SELECT doc_id, count(*) AS words, CAST(sum(n) AS BIGINT) AS places FROM c WHERE lower(word) NOT IN (SELECT word FROM k) GROUP BY doc_id"""
)
def h13_h25_unknown_words(spark, sf_dir):
    known = load(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(review.WORD), F.lit(0))).alias("word"))
    found = review.unknown_words(load(spark, sf_dir, "documents"), known)
    return found.groupBy("doc_id").agg(F.count("*").alias("words"), F.sum("count").alias("places"))


@query(
    r"""WITH k AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[a-zA-Z]{3,}'))) AS word FROM benchmark),
u AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[a-zA-Z]{4,}'))) AS word FROM conversations),
p AS (SELECT u.word, k.word AS suggestion, levenshtein(u.word, k.word) AS distance FROM u JOIN k ON abs(length(u.word) - length(k.word)) <= 2 WHERE u.word NOT IN (SELECT word FROM k)),
r AS (SELECT word, suggestion, CAST(distance AS INT) AS distance, CAST(row_number() OVER (PARTITION BY word ORDER BY distance, suggestion) AS INT) AS place FROM p WHERE distance <= 2)
SELECT word, suggestion, distance, place FROM r WHERE place <= 4"""
)
def f3_suggestions(spark, sf_dir):
    known = load(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]{3,}"), F.lit(0))).alias("word"))
    words = load(spark, sf_dir, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[a-zA-Z]{4,}"), F.lit(0))).alias("word"))
    return review.suggestions(words.select(F.lower("word").alias("word")).distinct().join(review.vocabulary(known), "word", "left_anti"), known)


@query()
def h15_translation_segments(spark, sf_dir):
    found = segments.translation_segments(load(spark, sf_dir, "documents"))
    return found.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if("preserved").alias("preserved"), F.sum(F.length("chunk")).alias("chars"), F.max(F.length("chunk")).alias("longest"))


@query("SELECT doc_id, CAST(seq - 1 AS INT) AS seq, segment FROM (SELECT doc_id, unnest(ss) AS segment, unnest(range(1, len(ss) + 1)) AS seq FROM (SELECT doc_id, flatten(list_transform(regexp_extract_all(text, '[^\\r\\n]*(?:\\r\\n|\\n|\\r)|[^\\r\\n]+'), lambda b: list_transform(range(0, (length(b) - 1) // 4000 + 1), lambda k: substr(b, k * 4000 + 1, 4000)))) AS ss FROM documents))")
def h16_line_segments(spark, sf_dir):
    return segments.line_segments(load(spark, sf_dir, "documents"))


@query("SELECT doc_id, CAST(k AS INT) AS seq, CAST(k * 3360 AS INT) AS first, substr(text, CAST(k * 3360 + 1 AS BIGINT), 3600) AS slice FROM (SELECT doc_id, text, unnest(range(0, CAST(greatest(0, ceil((length(text) - 3600) / 3360.0)) AS BIGINT) + 1)) AS k FROM documents WHERE length(text) > 0)")
def h19_text_slices(spark, sf_dir):
    return segments.text_slices(load(spark, sf_dir, "documents"))


def _pages(spark, sf_dir):
    return load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).cast("int").alias("page"), "text")


@query()
def h19_page_chunks(spark, sf_dir):
    pages = _pages(spark, sf_dir).withColumnRenamed("page", "page_number")
    return segments.chunk_pages(pages).select("doc_id", "chunk_no", "first_page", "last_page", F.length("text").alias("chars"), "truncated", "error")


@query("SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page, 'Página ' || row_number() OVER (PARTITION BY conv_id ORDER BY turn) || ' de ' || count(*) OVER (PARTITION BY conv_id) AS label FROM conversations")
def f11_page_labels(spark, sf_dir):
    return geometry.page_labels(_pages(spark, sf_dir))


@query("SELECT conv_id AS doc_id, CAST(turn + 1 AS INT) AS page, substr(text, 1, CAST(300 - before AS BIGINT)) AS text, before + length(text) > 300 AS cut FROM (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations) WHERE before < 300")
def f10_running_budget(spark, sf_dir):
    return geometry.running_budget(_pages(spark, sf_dir), 300)


@query("SELECT doc_id FROM documents WHERE contains(lower(strip_accents(text)), 'mentre')")
def b5_accent_free_search(spark, sf_dir):
    return load(spark, sf_dir, "documents").filter(F.contains(text.search_form(F.col("text")), F.lit("mentre"))).select("doc_id")


@query("SELECT doc_id, nfc_normalize(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS text FROM documents")
def g4_g16_normalized_texts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", text.normalize_nfc(F.col("text")).alias("text"))


@query("""SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;')) AS xml,
 md5(regexp_replace(replace(replace(replace(replace(text, '\\', '\\\\'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '([*_\\[\\]`|])', '\\\\\\1', 'g')) AS markdown FROM documents""")
def g9_escaped_texts(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.md5(text.escape_xml(F.col("text")).cast("binary")).alias("xml"), F.md5(text.escape_markdown(F.col("text")).cast("binary")).alias("markdown"))


_CLEAN = "trim(regexp_replace(replace(replace(replace(replace(replace(replace({x}, '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '\\s+', ' ', 'g'))"
_STRIPPED = "html"
for _name in html_blocks.STRIPPED:
    _STRIPPED = f"regexp_replace({_STRIPPED}, '(?is)<{_name}\\b[^>]*>.*?</{_name}>', '', 'g')"


@query(f"SELECT page_id, {_CLEAN.format(x=chr(114) + chr(101) + 'gexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)')} AS title, length(regexp_replace({_STRIPPED}, '(?i)<!DOCTYPE[^>]*>', '', 'g')) AS kept, CAST(len(regexp_extract_all(html, '(?i)<(?:{'|'.join(html_blocks.BLOCKED)})[\\s/>]')) AS INT) AS blocked FROM pages")
def g10_h23_h24_page_titles_and_stripping(spark, sf_dir):
    html = F.col("html")
    return load(spark, sf_dir, "pages").select("page_id", html_blocks.page_title(html).alias("title"), F.length(html_blocks.without_stripped(html)).cast("long").alias("kept"), html_blocks.element_count(html).alias("blocked"))


@query("SELECT page_id, CAST(len(regexp_extract_all(html, '<h1>')) AS BIGINT) AS headings, CAST(len(regexp_extract_all(html, '<li>')) AS BIGINT) AS items FROM pages")
def h23_page_blocks(spark, sf_dir):
    blocks = html_blocks.page_blocks(load(spark, sf_dir, "pages"))
    return blocks.groupBy("page_id").agg(F.count_if(F.col("kind") == "heading").alias("headings"), F.count_if(F.col("kind") == "item").alias("items"))


#: Pages with handlers, scripts and script addresses put into them.
_HOSTILE = """replace(replace(html, '<p>', '<p onclick="go()" onmouseover=''x''>'), '<li>', '<li><script>steal()</script>')"""


@query("SELECT page_id, false AS handlers, false AS scripts, CAST(len(regexp_extract_all(html, '<p>')) AS INT) AS paragraphs, CAST(len(regexp_extract_all(html, '<li>')) AS INT) AS items FROM pages")
def h24_sanitized_pages(spark, sf_dir):
    clean = load(spark, sf_dir, "pages").select("page_id", html_blocks.sanitized(F.expr(_HOSTILE)).alias("clean"))
    count = lambda tag: F.regexp_count("clean", F.lit(tag))
    return clean.select("page_id", F.col("clean").rlike("(?i)onclick|onmouseover|go\\(\\)").alias("handlers"), F.col("clean").rlike(r"(?i)<script|steal\(").alias("scripts"), count("<p[ >]").alias("paragraphs"), count("<li>").alias("items"))


@query(
    r"""WITH p AS (SELECT doc_id, text AS a, lead(text) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM documents),
w AS (SELECT doc_id, a = b AS same, a <> '' AND b <> '' AS filled, list_distinct(regexp_extract_all(lower(a), '[\p{L}\p{M}\p{N}]+')) AS x, list_distinct(regexp_extract_all(lower(b), '[\p{L}\p{M}\p{N}]+')) AS y FROM p WHERE b IS NOT NULL)
SELECT doc_id, round(CASE WHEN filled AND same THEN 1.0 WHEN filled THEN 0.85 * CASE WHEN len(x) + len(y) - len(list_intersect(x, y)) > 0 THEN len(list_intersect(x, y)) / CAST(len(x) + len(y) - len(list_intersect(x, y)) AS DOUBLE) ELSE 0 END + 0.15 ELSE 1.0 END, 9) AS similarity FROM w"""
)
def d12_i12_page_similarity(spark, sf_dir):
    return _revisions(spark, sf_dir).select("doc_id", F.round(geometry.page_similarity(F.col("original"), F.col("modified"), F.lit(1.0)), 9).alias("similarity"))


@query()
def a16_protocol(spark, sf_dir):
    from ..sources.protocol import respond

    requests = load(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), F.to_json(F.struct(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("turn") % 3 == 0, "segment").when(F.col("turn") % 3 == 1, "extract").otherwise("other").alias("method"), F.struct("text").alias("params"))).alias("value"))
    return respond(requests)
