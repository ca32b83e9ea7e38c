"""Queries of the sanitizer: hostile pages and addresses derived from the pages table, and each rule in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import css
from ..operators import html_blocks as html
from .common import Table, literal

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


_ID, _BACK = "CAST(page_id AS STRING)", "chr(92)"
#: Pages with hidden imports and addresses in style sheets, handlers, scripts, scripts that removal joins, and safe images.
HOSTILE = Table(
    "SELECT page_id, replace(replace(replace(replace(html, '<p>', '<p onclick=\"go()\" STYLE=''color:red; background: url(http://x.y/' || "
    + _ID
    + " || '.png)'' class=k data-n=' || "
    + _ID
    + " || '>'), '<li>', '<li><script>steal()</script><a HREF=\"&#106;avascript:go()\" id=\"l\">x</a><a href=\" #top\">y</a><img/src=\"data:image/png;base64,AAAA\" alt=''A \"q\"''/><img src=http://e.vil/t.png hidden><scr<script></script>ipt>bad()</scr<script></script>ipt>1 <2 <b'), '</head>', '<style>/*c*/@' || "
    + _BACK
    + " || '69 mport \"x\"; p{color:red;width:expression(alert(1));background:' || "
    + _BACK
    + " || '75 rl(''http://e/b.png'');behavior:url(#x);-moz-binding:url(y);list-style:url( \"data:image/gif;base64,AAAA\" )} .a' || "
    + _ID
    + " || '{content: \"' || "
    + _BACK
    + " || '1F600' || '\"; background-image:image-set(url(a) 1x)}</style></head>'), '<body>', '<body onload=go() style=\"margin:' || "
    + _ID
    + " || 'px\" class=\"page\" lang=en>') AS html FROM pages"
)
#: One address of an image, a document or a script for each page.
ADDRESSES = Table(
    f"""SELECT page_id, CASE page_id % 12 WHEN 0 THEN 'data:image/png;base64,AAAA' || {_ID} WHEN 1 THEN ' da ta:image/JPG;a=b;base64,x' WHEN 2 THEN 'data:text/html,<b>' || {_ID} WHEN 3 THEN 'https://x.y/' || {_ID} || '.png'
 WHEN 4 THEN 'data:image/svg+xml,%3Csvg%20id=%22a' || {_ID} || '%22/%3E' WHEN 5 THEN 'data:image/svg+xml,%3Csvg%20onLoad%20=%22x%22/%3E' WHEN 6 THEN 'data:image/svg+xml;base64,PHNjcmlwdD4x' WHEN 7 THEN 'data:image/svg+xml;base64,PHN2Zy8+'
 WHEN 8 THEN 'data:image/svg+xml,<a href="javascript:go()">' WHEN 9 THEN 'data:image/svg+xml,100%' WHEN 10 THEN 'data:image/png;base65,A' ELSE 'DATA:IMAGE/SVG+XML;base64,PHNjcm lwdD4x' END AS address FROM pages"""
)


def _replaced(x: str, pattern: str, instead: str = "''") -> str:
    return f"regexp_replace({x}, {literal(pattern)}, {instead}, 'g')"


def _rewritten(x: str, pattern: str, group: int, change: str, v: str, gap: str | None = None) -> str:
    """The SQL twin of css.rewritten: `change` names a match $h, `gap` what lies between as $g; v names the lambda."""
    gap = (gap or "$g").replace("$g", f"{v}[1]")
    return f"array_to_string(list_transform(list_zip(string_split_regex({x}, {literal(pattern)}), list_append(regexp_extract_all({x}, {literal(pattern)}, {group}), NULL)), lambda {v}: {gap} || coalesce({change.replace('$h', f'{v}[2]')}, '')), '')"


_TRIM = r"(?U)^\s+|\s+\z".replace("(?U)", "")
_SAFE = (
    "CASE WHEN NOT regexp_matches({b}, " + literal(css.DATA_IMAGE) + r") THEN false WHEN regexp_matches({b}, '(?i)^data:image/svg\+xml') THEN NOT regexp_matches("
    r"CASE WHEN contains(lower(split_part({x}, ',', 1)), ';base64') THEN CASE WHEN regexp_matches({p}, '^[A-Za-z0-9+/]*={{0,2}}$') AND length(rtrim({p}, '=')) % 4 <> 1 THEN decode(from_base64(rpad(rtrim({p}, '='), CAST(ceil(length(rtrim({p}, '=')) / 4.0) AS INT) * 4, '='))) ELSE {p} END ELSE url_decode({r}) END, "
    + literal(css.ACTIVE)
    + ") ELSE true END"
)


def _safe(x: str) -> str:
    t = _replaced(x, _TRIM)
    rest = f"regexp_replace({t}, '(?s)^[^,]*,', '')"
    return _SAFE.format(x=t, b=_replaced(t, r"[\x00-\x20\x7F]"), r=rest, p=_replaced(rest, r"[\t\n\f\r ]"))


def _unescaped(x: str) -> str:
    one = r"CASE WHEN regexp_matches($h, '^[0-9a-fA-F]{1,6}[\t\n\f\r ]?$') THEN chr(CAST('0x' || regexp_extract($h, '^[0-9a-fA-F]+') AS INT)) ELSE $h END"
    return _rewritten(x, css.ESCAPE, 1, one, "e")


def _address(v: str) -> str:
    bare = rf"""trim(regexp_replace(regexp_replace(trim($h), '(?s)^''(.*)''$', '\1'), '(?s)^"(.*)"$', '\1'))"""
    return f"CASE WHEN {_safe(bare)} THEN 'url(\"' || replace({bare}, '\"', '\\\"') || '\")' ELSE 'none' END"


def _steps(name: str, source: str, keys: str, column: str) -> str:
    """CTEs name0, name1, ... that clean the style sheets of a column step by step; the last is name."""
    steps = [_replaced(column, css.COMMENT), _unescaped("x"), _replaced("x", css.COMMENT)]
    steps += [_replaced("x", pattern, literal(instead)) for pattern, instead in css.REMOVED]
    steps += [_rewritten("x", css.ADDRESS, 1, _address("u"), "u"), _replaced("x", css.IMAGE_SET, "'none'")]
    ctes, before = [], source
    for k, step in enumerate(steps):
        after = name if k == len(steps) - 1 else f"{name}{k}"
        ctes.append(f"{after} AS (SELECT {keys}, {step} AS x FROM {before})")
        before = after
    return ",\n".join(ctes)


def _without(x: str) -> str:
    for tag in html.UNSAFE_CONTENT:
        x = _replaced(x, rf"(?is)<{tag}\b[^>]*>.*?(?:</{tag}\s*>|\z)")
    return _replaced(x, rf"(?i)</?(?:{'|'.join(html.UNSAFE_TAGS)})\b[^>]*>")


@query(f"SELECT page_id, address, {_safe('address')} AS safe FROM {ADDRESSES.sql}")
def h24_image_addresses(spark, sf_dir):
    return ADDRESSES.frame(spark, sf_dir).select("page_id", "address", css.is_safe_image(F.col("address")).alias("safe"))


_SHEETS = f"""s AS (SELECT page_id, unnest(l) AS sheet, unnest(range(len(l))) AS k FROM (SELECT page_id, regexp_extract_all({_without('html')}, '(?is)<style\\b[^>]*>(.*?)(?:</style\\s*>|\\z)', 1) AS l FROM {HOSTILE.sql}))"""


@query(f"WITH {_SHEETS}, {_steps('c', 's', 'page_id, k', 'sheet')} SELECT page_id, string_agg(x, chr(10) ORDER BY k) AS style_css FROM c WHERE regexp_matches(x, '\\S') GROUP BY page_id")
def h24_style_sheets(spark, sf_dir):
    return HOSTILE.frame(spark, sf_dir).select("page_id", html.style_sheets(html.without_elements(F.col("html"))).alias("style_css"))


_VALUE = html._VALUE
_RE2_MARKUP = rf"(?s)<!--.*?(?:-->|\z)|</[A-Za-z][^>]*(?:>|\z)|<[A-Za-z][^\s/>]*(?:[\s/]+{html._NAME}(?:\s*=\s*{_VALUE})?)*[\s/]*>"
#: Every kind of markup of a page is a row, then every attribute of a start tag.
_DOCUMENTS = f"""
WITH p AS (SELECT page_id, {_without('html')} AS h FROM {HOSTILE.sql}),
b AS (SELECT page_id, regexp_extract({_replaced(_replaced('h', r'(?is)<style' + chr(92) + r'b[^>]*>.*?</style' + chr(92) + 's*>'), r'(?is)<title' + chr(92) + r'b[^>]*>.*?</title' + chr(92) + 's*>')}, '(?is)<body\\b[^>]*>(.*?)(?:</body\\s*>|\\z)', 1) AS h FROM p),
z AS (SELECT page_id, list_zip(string_split_regex(h, {literal(_RE2_MARKUP)}), list_append(regexp_extract_all(h, {literal(_RE2_MARKUP)}), '')) AS l FROM b),
t AS (SELECT page_id, i, l[i][1] AS gap, l[i][2] AS tag, lower(regexp_extract(l[i][2], '^</?([A-Za-z][^\\s/>]*)', 1)) AS name FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM z)),
f AS (SELECT page_id, i, name, regexp_extract_all(tag[length(name) + 2:length(tag) - 1], {literal(html.ATTRIBUTE)}, 1) AS names, regexp_extract_all(tag[length(name) + 2:length(tag) - 1], {literal(html.ATTRIBUTE)}, 2) AS vs FROM t WHERE name <> '' AND NOT starts_with(tag, '</')),
a AS (SELECT page_id, i, j, lower(names[j]) AS n, replace(regexp_replace(coalesce(vs[j], ''), '(?s)^["''](.*)["'']$', '\\1'), '&#106;', 'j') AS v FROM (SELECT *, unnest(range(1, len(names) + 1)) AS j FROM f)),
st AS (SELECT page_id, i, j, v FROM a WHERE n = 'style'),
{_steps('cs', 'st', 'page_id, i, j', 'v')},
k AS (SELECT a.page_id, a.i, a.j, a.n, coalesce(cs.x, a.v) AS v FROM a LEFT JOIN cs USING (page_id, i, j)
      WHERE NOT starts_with(n, 'on') AND n NOT IN ({', '.join(map(literal, html.UNSAFE_ATTRIBUTES))}) AND (n <> 'style' OR regexp_matches(cs.x, '\\S')) AND (n NOT IN ('src', 'background') OR {_safe('a.v')}) AND (n NOT IN ('href', 'xlink:href') OR starts_with(trim(a.v), '#'))),
w AS (SELECT page_id, i, string_agg(' ' || n || '="' || replace(replace(v, '&', '&amp;'), '"', '&quot;') || '"', '' ORDER BY j) AS attributes FROM k GROUP BY page_id, i)
SELECT page_id, string_agg(regexp_replace(gap, '<([A-Za-z/!?])', '&lt;\\1', 'g') || CASE WHEN name = '' OR name IN ({', '.join(map(literal, (*html.UNSAFE_TAGS, 'style', 'title')))}) THEN '' WHEN starts_with(tag, '</') THEN '</' || name || '>' ELSE '<' || name || coalesce(attributes, '') || '>' END, '' ORDER BY i) AS body_html,
       'margin:' || CAST(page_id AS VARCHAR) || 'px' AS body_style, 'page' AS body_class, '' AS body_dir, 'en' AS body_lang
FROM t LEFT JOIN w USING (page_id, i) GROUP BY page_id"""


@query(_DOCUMENTS)
def h24_clean_documents(spark, sf_dir):
    pages = HOSTILE.frame(spark, sf_dir).select("page_id", html.sanitized_document(F.col("html")).alias("d"))
    return pages.select("page_id", *(F.col(f"d.{c}").alias(c) for c in ("body_html", "body_style", "body_class", "body_dir", "body_lang")))
