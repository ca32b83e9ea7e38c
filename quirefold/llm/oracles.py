"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality import RULES, STANDARD
from .secrets import BASE_RULES
from .secrets import RULES as SECRET_RULES

WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"

OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, {WORDS} AS ws FROM d),
p AS (SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT r, i, word || chr(10) || lead(word, 1) OVER o || chr(10) || lead(word, 2) OVER o || chr(10) || lead(word, 3) OVER o || chr(10) || lead(word, 4) OVER o AS gram
      FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
c AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM g WHERE gram IS NOT NULL),
cover AS (SELECT r, count(DISTINCT j) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS j FROM c WHERE n > 1) GROUP BY r),
stutter AS (SELECT r, count(*) FILTER (word = before) AS n_stutter FROM (SELECT r, word, lag(word) OVER (PARTITION BY r ORDER BY i) AS before FROM p) GROUP BY r),
lines AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
m AS (
  SELECT w.r, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) AS BIGINT) AS n_lines,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(n_stutter, 0) AS BIGINT) AS n_stutter,
         CAST(length(regexp_replace(t, '[^A-Z]', '', 'g')) AS BIGINT) AS n_upper,
         CAST(length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS BIGINT) AS n_letters,
         CAST(length(regexp_replace(t, '[^0-9]', '', 'g')) AS BIGINT) AS n_digits
  FROM w JOIN lines ON lines.r = w.r LEFT JOIN cover ON cover.r = w.r LEFT JOIN stutter ON stutter.r = w.r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
       NOT ({" OR ".join(f"({r.fails})" for r in RULES if STANDARD.mask >> r.bit & 1)}) AS kept,
       CAST({" + ".join(f"CASE WHEN {r.fails} THEN {1 << r.bit} ELSE 0 END" for r in RULES)} AS BIGINT) AS failed_bits
FROM m
"""

OP2 = rf"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
s AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS i FROM w),
v AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 19], ' ')) AS k FROM s),
f AS (SELECT k, min(doc_id * 1000000 + i) AS first FROM v GROUP BY k HAVING count(*) > 1),
dup AS (SELECT v.doc_id, v.i FROM v JOIN f ON v.k = f.k WHERE v.doc_id * 1000000 + v.i > f.first),
cut AS (SELECT DISTINCT doc_id, j FROM (SELECT doc_id, unnest(range(i, i + 20)) AS j FROM dup)),
p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w),
kept AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.j) AS t FROM p LEFT JOIN cut ON cut.doc_id = p.doc_id AND cut.j = p.j WHERE cut.j IS NULL GROUP BY p.doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM cut GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans() -> str:
    """All matches of all rules: r, kind number, start, stop."""
    parts = []
    for k, rule in enumerate(SECRET_RULES):
        p = _quoted(rule.plain or rule.pattern)
        parts.append(
            f"""SELECT r, {k} AS k, s, s + length(hits[j]) AS e FROM (
  SELECT r, hits, grp, j, list_sum(list_transform(segs[1:j], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:j - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT r, segs, hits, grp, unnest(range(1, len(hits) + 1)) AS j FROM (
    SELECT r, string_split_regex(t, {p}) AS segs, regexp_extract_all(t, {p}, 0) AS hits, regexp_extract_all(t, {p}, {rule.group}) AS grp FROM d WHERE regexp_matches(t, {p}))))
  WHERE length(grp[j]) >= {rule.least}"""
        )
    return "\nUNION ALL\n".join(parts)


OP7 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({_spans()}),
y AS (SELECT r, k, s, list_extract([{", ".join(_quoted(rule.kind) for rule in SECRET_RULES)}], k + 1) || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) AS span FROM x),
z AS (SELECT r, CAST(count(*) FILTER (k = 0) AS BIGINT) AS n_assign, CAST(count(*) FILTER (k = 1) AS BIGINT) AS n_access, CAST(count(*) FILTER (k = 2) AS BIGINT) AS n_hex,
             string_agg(span, ',' ORDER BY s, k) FILTER (k < {len(BASE_RULES)}) AS base, string_agg(span, ',' ORDER BY s, k) AS spans FROM y GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN z ON z.r = d.r
"""

#: Bytes as pairs of hexadecimal digits; every window by its hash, cut from blocks that overlap (a cut counts from the start).
OP8 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT r, b, substr(h, 2000 * b + 1, 2798) AS c FROM (SELECT r, h, unnest(range((length(h) // 2 - 400) // 1000 + 1)) AS b FROM d WHERE length(h) >= 800)),
s AS (SELECT r, 1000 * b + j AS i, hash(substr(c, 2 * j + 1, 800)) AS k FROM (SELECT r, b, c, unnest(range(least(1000, length(c) // 2 - 399))) AS j FROM q)),
w AS (SELECT r, i FROM s WHERE k IN (SELECT k FROM s GROUP BY k HAVING count(*) > 1)),
f AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM w),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS n FROM f),
x AS (SELECT r, n, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY r, n),
y AS (SELECT x.r, a, b, coalesce(lag(b) OVER (PARTITION BY x.r ORDER BY a), 0) AS before, h FROM x JOIN d USING (r)),
z AS (SELECT r, sum(b - a) AS removed, count(*) AS spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM y GROUP BY r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN z USING (r)
"""

OP9 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
f AS (SELECT page_id, n, h, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) END AS first FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to,
       true AS complete, true AS intact
FROM f
"""

OP11 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS us, [CAST('0x' || x[8 * i + 1:8 * i + 8] AS BIGINT) for i in range(4)] AS h FROM d),
c AS (SELECT doc_id, t, us, CAST(len(us) AS BIGINT) AS n, least(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS a, greatest(h[1] % (len(us) + 1), h[2] % (len(us) + 1)) AS b,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT doc_id, t, n, form, array_to_string(us[1:a], '') AS prefix, array_to_string(us[a + 1:b], '') AS middle, array_to_string(us[b + 1:], '') AS suffix FROM c)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""



def _assigned(t: int) -> str:
    """The nearest entry of every part in the codebooks of round t, and its squared distance."""
    return f"""a{t} AS (SELECT r, p, v, m % 64 AS e, m // 64 AS dist FROM (
  SELECT r, p, any_value(x.v) AS v, min(64 * list_sum(list_transform(list_zip(x.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) + e) AS m
  FROM parts x JOIN c{t} c USING (p) GROUP BY r, p))"""


def _moved(t: int) -> str:
    """The codebooks of round t + 1: floors of means, entries without parts as they were."""
    return f"""n{t} AS (SELECT p, e, i, (s - ((s % n) + n) % n) // n AS x FROM (
  SELECT p, e, i, sum(v[i + 1]) AS s, count(*) AS n FROM a{t}, (SELECT unnest(range(len(v))) AS i FROM (SELECT v FROM parts LIMIT 1)) GROUP BY p, e, i)),
c{t + 1} AS (SELECT p, e, coalesce(m.v, c.v) AS v FROM c{t} c LEFT JOIN (SELECT p, e, list(CAST(x AS BIGINT) ORDER BY i) AS v FROM n{t} GROUP BY p, e) m USING (p, e))"""


OP12 = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
           FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (SELECT r, p, q[p * (len(q) // 16) + 1:(p + 1) * (len(q) // 16)] AS v FROM k, (SELECT unnest(range(16)) AS p)),
c0 AS (SELECT p, r AS e, v FROM parts WHERE r < 64),
{_assigned(0)},
{_moved(0)},
{_assigned(1)},
{_moved(1)},
{_assigned(2)},
f AS (SELECT r, string_agg(lpad(to_hex(e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(dist) AS BIGINT) AS error FROM a2 GROUP BY r)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256
FROM k JOIN f USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op1_quality_rules": OP1, "op2_substring_dedup": OP2, "op7_secret_scans": OP7, "op8_suffix_dedup": OP8, "op9_warc": OP9, "op11_fill_in_middle": OP11, "op12_vector_codes": OP12}
