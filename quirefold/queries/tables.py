"""Relational operators over the standard tables, read as documents, artifacts, operations and events.

orders are operations of the document o_custkey; lineitem links an operation to its input (part) and output (supplier).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates
from ..operators import evaluation, geometry, ledger, relational, selection
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


def _operations(spark, sf_dir):
    return load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.col("o_orderpriority").alias("tool_id"), F.col("o_orderdate").alias("created_at"))


def _edges(spark, sf_dir, column):
    return load(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("operation_id"), F.col(column).alias("artifact_id"))


def _artifacts(spark, sf_dir):
    return load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))


@query("SELECT o_orderkey AS operation_id, o_orderpriority AS tool_id, i.l_partkey AS input_id, u.l_suppkey AS output_id, o_orderdate AS created_at FROM orders JOIN lineitem i ON i.l_orderkey = o_orderkey JOIN lineitem u ON u.l_orderkey = o_orderkey JOIN supplier ON s_suppkey = u.l_suppkey WHERE o_custkey = 7")
def c1_e1_lineage_of_a_document(spark, sf_dir):
    return relational.lineage(_operations(spark, sf_dir), _edges(spark, sf_dir, "l_partkey"), _edges(spark, sf_dir, "l_suppkey"), _artifacts(spark, sf_dir), 7)


@query("SELECT o_orderpriority AS tool_id, count(*) AS edges FROM orders JOIN lineitem i ON i.l_orderkey = o_orderkey JOIN lineitem u ON u.l_orderkey = o_orderkey JOIN supplier ON s_suppkey = u.l_suppkey GROUP BY o_orderpriority")
def c1_lineage_edges_by_tool(spark, sf_dir):
    edges = relational.lineage(_operations(spark, sf_dir), _edges(spark, sf_dir, "l_partkey"), _edges(spark, sf_dir, "l_suppkey"), _artifacts(spark, sf_dir))
    return edges.groupBy("tool_id").agg(F.count("*").alias("edges"))


@query("SELECT c_custkey AS hash FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 9 = 0)")
def c2_orphan_blobs(spark, sf_dir):
    used = load(spark, sf_dir, "orders").filter("o_orderkey % 9 = 0")  # some artifacts of every document are gone
    return relational.orphan_blobs(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hash")), used.select(F.col("o_custkey").alias("hash")))


@query("SELECT c_custkey AS hash FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def c2_referenced_blobs(spark, sf_dir):
    return relational.referenced_blobs(load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("hash")), load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("hash")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def c6_broken_references(spark, sf_dir):
    parents = load(spark, sf_dir, "orders").filter("o_orderstatus <> 'P'")
    return relational.broken_references(load(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", parents, "o_orderkey")


@query("""WITH i AS (SELECT l_orderkey AS k, l_partkey % 50 AS a FROM lineitem), u AS (SELECT l_orderkey AS k, l_suppkey % 50 AS a FROM lineitem)
SELECT k AS operation_id, 'inputs must be 1 to 32 and distinct' AS problem FROM i GROUP BY k HAVING count(*) > 32 OR count(*) <> count(DISTINCT a)
UNION ALL SELECT DISTINCT i.k, 'an input is also an output' FROM i JOIN u ON i.k = u.k AND i.a = u.a UNION ALL SELECT DISTINCT k, 'no input' FROM u WHERE k NOT IN (SELECT k FROM i)""")
def c6_graph_violations(spark, sf_dir):
    modulo = lambda c: _edges(spark, sf_dir, c).withColumn("artifact_id", F.col("artifact_id") % 50)
    return relational.graph_violations(modulo("l_partkey"), modulo("l_suppkey"))


@query("SELECT CAST(coalesce(sum(p_size), 0) AS BIGINT) AS used, coalesce(sum(p_size), 0) + 1000 <= 60000 AS fits FROM part")
def d1_capacity(spark, sf_dir):
    return relational.capacity(load(spark, sf_dir, "part").select(F.col("p_size").alias("size")), 1000, 60000)


@query("SELECT count(*) AS n, count(*) = 1 AS fine FROM region")
def d2_single_project(spark, sf_dir):
    return relational.single_project(load(spark, sf_dir, "region"))


@query("SELECT coalesce(max(n_nationkey), 0) AS version FROM nation")
def d3_schema_version(spark, sf_dir):
    return relational.schema_version(load(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("version")))


@query("SELECT event_type AS tool_id, count(*) FILTER (user_id % 3 = 0) AS succeeded, count(*) FILTER (user_id % 3 = 1) AS failed, count(*) FILTER (user_id % 3 = 2) AS cancelled, round(coalesce(avg(value), 0), 6) AS mean_ms FROM events GROUP BY event_type")
def d4_tool_metrics(spark, sf_dir):
    outcome = F.when(F.col("user_id") % 3 == 0, "succeeded").when(F.col("user_id") % 3 == 1, "failed").otherwise("cancelled")
    runs = load(spark, sf_dir, "events").select(F.col("event_type").alias("tool_id"), outcome.alias("outcome"), F.col("value").alias("duration_ms"))
    return evaluation.tool_metrics(runs).withColumn("mean_ms", F.round("mean_ms", 6))


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, round(avg(l_discount), 9) AS mean FROM lineitem GROUP BY l_returnflag")
def d6_percentiles(spark, sf_dir):
    rows = load(spark, sf_dir, "lineitem")
    ranks = {"p50": selection.nearest_rank(0.5), "p95": selection.nearest_rank(0.95)}
    prices = selection.select_ranks(rows, ["l_returnflag"], "l_extendedprice", ranks, nan_last=True)
    means = rows.groupBy("l_returnflag").agg(F.round(F.avg("l_discount"), 9).alias("mean"))
    return selection.with_statistics(means, prices, ["l_returnflag"]).select("l_returnflag", "p50", "p95", "mean")


@query("SELECT conv_id AS doc_id, count(*) AS total_rows, max(len(regexp_extract_all(text, '\\S+'))) AS total_columns FROM conversations GROUP BY conv_id")
def d11_sheet_summary(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)).alias("cells"))
    return geometry.sheet_summary(rows)


@query("SELECT o_orderpriority, list_extract(list_sort(list(o_totalprice)), CAST(count(*) // 2 + 1 AS BIGINT)) AS median FROM orders GROUP BY o_orderpriority")
def d13_upper_median(spark, sf_dir):
    rank = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice DESC)")  # the upper of two middle values
    return load(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(rank.alias("median"))


@query("SELECT sha256(text) AS hash, min(doc_id) AS first, count(*) AS copies, CAST(any_value(octet_length(encode(text))) AS BIGINT) AS size FROM documents GROUP BY text")
def e5_distinct_contents(spark, sf_dir):
    return relational.distinct_contents(load(spark, sf_dir, "documents"))


@query("""WITH a AS (SELECT page_id AS id, sha256(html) AS hash, octet_length(encode(html)) AS size FROM pages),
b AS (SELECT sha256(html) AS hash, max(octet_length(encode(html)) + CASE WHEN page_id % 11 = 0 THEN 1 ELSE 0 END) AS actual_size, max(CASE WHEN page_id % 7 = 0 THEN 'zz' ELSE sha256(html) END) AS actual_hash FROM pages WHERE page_id % 5 <> 0 GROUP BY sha256(html))
SELECT id AS artifact_id, CASE WHEN actual_hash IS NULL THEN 'missing' WHEN actual_size <> size OR actual_hash <> a.hash THEN 'corrupted' ELSE 'valid' END AS status FROM a LEFT JOIN b ON a.hash = b.hash""")
def e4_a17_integrity_audit(spark, sf_dir):
    pages = load(spark, sf_dir, "pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("hash"), F.octet_length("html").cast("long").alias("size"))
    there = pages.filter("page_id % 5 <> 0").groupBy("hash").agg(F.max(F.col("size") + F.when(F.col("page_id") % 11 == 0, 1).otherwise(0)).alias("actual_size"), F.max(F.when(F.col("page_id") % 7 == 0, "zz").otherwise(F.col("hash"))).alias("actual_hash"))
    return relational.integrity_audit(pages.withColumnRenamed("page_id", "id"), there)


@query("SELECT count(*) FILTER (m = 1) AS valid, count(*) FILTER (m = 0) AS corrupted, count(*) FILTER (m = 2) AS missing, count(*) FILTER (m <> 1) = 0 AS healthy FROM (SELECT doc_id % 3 AS m FROM documents)")
def e4_audit_summary(spark, sf_dir):
    status = F.when(F.col("doc_id") % 3 == 1, "valid").when(F.col("doc_id") % 3 == 0, "corrupted").otherwise("missing")
    return relational.audit_summary(load(spark, sf_dir, "documents").select(status.alias("status")))


@query("""WITH x AS (SELECT o_custkey AS document_id, o_orderkey AS layer_id, 'artifact' AS source, CASE WHEN o_orderstatus = 'O' THEN 'ORIGINAL' ELSE 'DERIVED' END AS kind, o_orderdate AS c FROM orders
UNION ALL SELECT conv_id, turn, 'overlay', 'OVERLAY', TIMESTAMP '2024-01-01' FROM conversations)
SELECT document_id, layer_id, source, kind, CAST(row_number() OVER (PARTITION BY document_id, source ORDER BY c, layer_id) - 1 AS INT) AS ordinal, layer_id <> 3 AS visible FROM x""")
def e6_b11_layers(spark, sf_dir):
    kind = F.when(F.col("o_orderstatus") == "O", "ORIGINAL").otherwise("COPY")
    artifacts = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("id"), kind.alias("kind"), F.col("o_orderdate").alias("created_at"))
    overlays = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("id"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
    return relational.toggle_layer(relational.layers(artifacts, overlays), 3)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 250")
def f1_paged_listing(spark, sf_dir):
    return relational.paged(load(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", offset=250, limit=100)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 OR (o_totalprice = 150000 AND o_orderkey > 7) ORDER BY o_totalprice, o_orderkey LIMIT 100")
def f1_page_after_a_row(spark, sf_dir):
    return relational.paged_after(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", after=(150000.0, 7), limit=100)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 15")
def f2_preview_rows(spark, sf_dir):
    return relational.top_rows(load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey")


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_custkey = 11")
def b1_b2_artifacts_of_a_document(spark, sf_dir):
    rows = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("document_id"), F.col("o_orderdate").alias("created_at"))
    return relational.artifacts_of(rows, 11).select("id", "created_at")


@query("SELECT conv_id AS doc_id, turn AS page FROM conversations WHERE turn NOT IN (0, 2)")
def b9_f7_removed_pages(spark, sf_dir):
    pages = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"))
    return relational.select_pages(pages, [0, 2], remove=True)


@query("SELECT conv_id AS doc_id FROM conversations GROUP BY conv_id HAVING count(*) FILTER (turn NOT IN (0, 1)) = 0")
def b9_emptied_documents(spark, sf_dir):
    pages = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"))
    return relational.emptied_documents(pages, [0, 1])


@query("SELECT part, page, row_number() OVER (ORDER BY part, page) AS position FROM (SELECT 0 AS part, turn AS page FROM conversations WHERE conv_id = 1 UNION ALL SELECT 1, turn FROM conversations WHERE conv_id = 2)")
def f6_merged_pages(spark, sf_dir):
    pages = load(spark, sf_dir, "conversations").withColumnRenamed("turn", "page")
    return relational.merged_pages(pages.filter("conv_id = 1"), pages.filter("conv_id = 2")).select("part", "page", F.col("position").cast("long").alias("position"))


@query("SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A'")
def f8_common_items(spark, sf_dir):
    items = load(spark, sf_dir, "lineitem")
    side = lambda f: items.filter(F.col("l_returnflag") == f).select(F.col("l_suppkey").alias("k"))
    return side("R").intersect(side("A"))


@query("SELECT conv_id AS doc_id, 1000 - turn AS position, turn AS page, (90 * (turn % 4) + 270 + 180) % 360 AS rotation FROM conversations WHERE turn % 2 = 0")
def m_organized_pages(spark, sf_dir):
    pages = load(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), (90 * (F.col("turn") % 4)).alias("current_rotation"))
    plan = pages.filter("page % 2 = 0").select("doc_id", "page", (1000 - F.col("page")).alias("position"), F.lit(180).alias("rotation"), F.lit(-90).alias("turn"))
    return relational.organized_pages(pages, plan)


@query("SELECT event_type AS field, array_to_string(list_sort(list(DISTINCT user_id % 40)), ',') AS pages FROM events GROUP BY event_type")
def m_form_pages(spark, sf_dir):
    widgets = load(spark, sf_dir, "events").select(F.col("event_type").alias("field"), (F.col("user_id") % 40).alias("page"))
    return relational.form_pages(widgets).select("field", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query("SELECT s_suppkey, s_acctbal >= 0 AND s_acctbal / 100 < 95 AS fits FROM supplier")
def m_crop_margins(spark, sf_dir):
    share = F.col("s_acctbal") / 100
    return load(spark, sf_dir, "supplier").select("s_suppkey", relational.margins_fit(share, F.lit(0), F.lit(0), share).alias("fits"))


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("at", F.unix_seconds(F.col("ts").cast("timestamp")))


@query("SELECT strftime(ts - INTERVAL 8 HOUR + CASE WHEN ts >= TIMESTAMP '2024-03-10 10:00:00' AND ts < TIMESTAMP '2024-11-03 09:00:00' THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END, '%Y-%m') AS period, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def k1_monthly_totals(spark, sf_dir):
    return ledger.monthly_totals(_events(spark, sf_dir)).select("period", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, epoch(date_trunc('second', ts)) AS sec, event_id FROM events),
g AS (SELECT *, lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS before FROM e),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR sec - before >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS session_no FROM g)
SELECT user_id, CAST(session_no AS BIGINT) AS session_no, CAST(min(sec) AS BIGINT) AS first_at, CAST(max(sec) AS BIGINT) AS last_at, count(*) AS n FROM n GROUP BY user_id, session_no""")
def k7_sessions(spark, sf_dir):
    return ledger.sessions(_events(spark, sf_dir))


@query("SELECT user_id, CAST(max(epoch(date_trunc('second', ts))) AS BIGINT) AS last_at, 1706745600 - max(epoch(date_trunc('second', ts))) >= 1800 AS expired FROM events GROUP BY user_id")
def k7_inactive_sessions(spark, sf_dir):
    return ledger.inactive_sessions(_events(spark, sf_dir), F.lit(1706745600))


@query("SELECT participant, first_at, CASE WHEN row_number() OVER (ORDER BY first_at, participant) <= 100 THEN CAST(row_number() OVER (ORDER BY first_at, participant) AS INT) END AS place, row_number() OVER (ORDER BY first_at, participant) <= 100 AS admitted FROM (SELECT user_id AS participant, CAST(min(epoch(date_trunc('second', ts))) AS BIGINT) AS first_at FROM events GROUP BY user_id)")
def k9_admissions(spark, sf_dir):
    requests = _events(spark, sf_dir).select(F.col("user_id").alias("participant"), "at")
    return ledger.admissions(requests, 100)


@query("SELECT event_id, substr(props, 3, 4) AS part FROM events")
def k12_byte_ranges(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", ledger.byte_range(F.col("props"), F.lit(2), F.lit(4)).alias("part"))


@query("SELECT event_id, strftime(ts, '%Y-%m') AS month FROM events")
def g22_months_in_utc(spark, sf_dir):
    return _events(spark, sf_dir).select("event_id", dates.billing_period(F.col("at"), "UTC").alias("month"))


#: Events as commands of their users' documents.
COMMANDS = Table("SELECT user_id AS doc_id, event_id AS seq, CASE event_id % 5 WHEN 3 THEN 'undo' WHEN 4 THEN 'redo' WHEN 2 THEN 'undo' ELSE 'edit' END AS kind FROM events")


@query(f"""WITH RECURSIVE c AS (SELECT doc_id, seq, kind, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS k FROM {COMMANDS.sql}),
r AS (SELECT doc_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS seq, CAST([] AS BIGINT[]) AS done, CAST([] AS BIGINT[]) AS undone FROM c WHERE k = 1
UNION ALL SELECT c.doc_id, c.k, c.seq, CASE WHEN kind = 'edit' THEN list_append(done, c.seq) WHEN kind = 'undo' THEN list_slice(done, 1, len(done) - 1) WHEN len(undone) > 0 THEN list_append(done, undone[len(undone)]) ELSE done END,
 CASE WHEN kind = 'edit' THEN CAST([] AS BIGINT[]) WHEN kind = 'undo' THEN CASE WHEN len(done) > 0 THEN list_append(undone, done[len(done)]) ELSE undone END ELSE list_slice(undone, 1, len(undone) - 1) END FROM r JOIN c ON c.doc_id = r.doc_id AND c.k = r.k + 1)
SELECT doc_id, seq, CASE WHEN len(done) > 0 THEN done[len(done)] END AS state FROM r WHERE k > 0""")
def m_command_history(spark, sf_dir):
    return relational.command_history(COMMANDS.frame(spark, sf_dir)).select("doc_id", "seq", F.col("state").cast("long").alias("state"))


@query("SELECT page_id, octet_length(encode(html)) AS size, sha256(html) AS hash FROM pages")
def a2_imported_bytes(spark, sf_dir):
    from ..sources.documents import verified

    blobs = load(spark, sf_dir, "pages").select("page_id", F.col("html").cast("binary").alias("content"), F.sha2(F.col("html").cast("binary"), 256).alias("hash"))
    return verified(blobs).filter("intact").select("page_id", F.octet_length("content").cast("long").alias("size"), "hash")


@query("SELECT conv_id, turn, to_json({'role': role, 'chars': length(text)}) AS value FROM conversations")
def a15_b10_json_report(spark, sf_dir):
    rows = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars"))
    return rows.select("conv_id", "turn", F.to_json(F.struct("role", "chars")).alias("value"))


@query("SELECT doc_id, md5(regexp_replace(text, '\\r\\n?', chr(10), 'g') || chr(10) || 'a' || doc_id || chr(9) || 'b') AS text, 1 AS tables, 'Heading1' AS style FROM documents")
def a5_a8_docx_round_trip(spark, sf_dir):
    """Documents as a heading and a table in DOCX, read again."""
    from ..sources.docx import read_docx, write_docx

    cells = F.array(F.array(F.concat(F.lit("a"), F.col("doc_id").cast("string")), F.lit("b")))
    docs = load(spark, sf_dir, "documents").select("doc_id", F.array(F.struct("text", F.lit("Heading1").alias("style"))).alias("paragraphs"), F.array(cells).alias("tables"))
    files = write_docx(docs).select(F.col("doc_id").cast("string").alias("path"), "content")
    return read_docx(files).select(F.col("path").cast("long").alias("doc_id"), F.md5(F.col("text").cast("binary")).alias("text"), F.size("tables").alias("tables"), F.col("paragraphs")[0]["style"].alias("style"))


@query("""WITH c AS (SELECT conv_id AS doc_id, turn, unnest(['R$ ' || turn || ',50', role, CAST(length(text) AS VARCHAR)]) AS text, unnest(['A', 'B', 'C']) AS col FROM conversations)
SELECT doc_id, 1 AS sheet, CAST(row_number() OVER (PARTITION BY doc_id, col ORDER BY turn) AS INT) AS row, col || row_number() OVER (PARTITION BY doc_id, col ORDER BY turn) AS cell, CASE col WHEN 'A' THEN turn + 0.5 WHEN 'C' THEN CAST(text AS DOUBLE) END AS number, CASE col WHEN 'B' THEN text END AS text FROM c""")
def a14_workbook_round_trip(spark, sf_dir):
    """Conversations as typed tables in XLSX, read again."""
    from ..sources.sinks import typed_rows
    from ..sources.workbooks import read_workbooks, write_workbooks

    turns = load(spark, sf_dir, "conversations")
    cells = F.array(F.concat(F.lit("R$ "), F.col("turn").cast("string"), F.lit(",50")), F.col("role"), F.length("text").cast("string"))
    rows = turns.select(F.col("conv_id").alias("doc_id"), F.lit(1).alias("page"), F.col("turn").cast("int").alias("row"), cells.alias("cells"))
    return read_workbooks(write_workbooks(typed_rows(rows)))
