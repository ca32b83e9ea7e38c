"""Queries that work in rounds: ranks of graphs, stable orders, exact order statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graphs, selection
from ..sources import blobs
from ..sources.scratch import scratch
from ..streaming.sessions import replayed_sessions
from .common import Table, load

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: Operations and artifacts: an order is made of its lines' parts and of its customer's order before; every fiftieth customer's first order also of the last.
EDGES = Table(
    "SELECT DISTINCT CAST('p' || CAST(l_partkey AS STRING) AS STRING) AS src, CAST('o' || CAST(l_orderkey AS STRING) AS STRING) AS dst FROM lineitem "
    "UNION ALL SELECT CAST('o' || CAST(a AS STRING) AS STRING) AS src, CAST('o' || CAST(o_orderkey AS STRING) AS STRING) AS dst FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS a FROM orders) AS x WHERE a IS NOT NULL "
    "UNION ALL SELECT CAST('o' || CAST(max(o_orderkey) AS STRING) AS STRING) AS src, CAST('o' || CAST(min(o_orderkey) AS STRING) AS STRING) AS dst FROM orders WHERE o_custkey % 50 = 1 GROUP BY o_custkey"
)


@query(
    """WITH o AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
h AS (SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS parts, n, o_custkey FROM o),
r AS (SELECT *, max(CASE WHEN parts AND n = 1 THEN 1 WHEN parts THEN 2 - n ELSE 1 - n END) OVER (PARTITION BY o_custkey ORDER BY n) + n - 1 AS rank FROM h)
SELECT 'o' || CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_custkey % 50 = 1 THEN NULL ELSE CAST(rank AS INT) END AS rank, CASE WHEN o_custkey % 50 = 1 THEN 'cycle' ELSE 'ranked' END AS place FROM r
UNION ALL SELECT DISTINCT 'p' || CAST(l_partkey AS VARCHAR), 0, 'ranked' FROM lineitem"""
)
def e2_e3_ranks(spark, sf_dir):
    nodes = load(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"))
    return graphs.topological_ranks(nodes, EDGES.frame(spark, sf_dir))


#: Recipes of a customer's orders: every step needs the one two places later, if there is one, and even ones the first.
STEPS = Table(
    "SELECT o_custkey AS recipe, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS INT) AS position, CAST(o_orderkey AS STRING) AS id, CAST(lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS STRING) AS need FROM orders"
)


@query(
    f"""WITH s AS (SELECT *, count(*) OVER (PARTITION BY recipe) AS n FROM {STEPS.sql}),
-- the last two have no needs; each of the others waits for the one two places on, and the smaller place goes first when both are ready
k AS (SELECT *, (n - position) // 2 AS wave FROM s),
o AS (SELECT recipe, id, position, n, CASE WHEN n <= 2 THEN position ELSE NULL END AS small FROM k),
c AS (SELECT recipe, id, CASE WHEN n <= 2 THEN position WHEN (n - position) % 2 = 1 THEN (n - position + 1) // 2 ELSE n // 2 + (n - position) // 2 + 1 END AS place FROM k)
SELECT recipe, id, CAST(place AS INT) AS place FROM c"""
)
def e3_stable_order(spark, sf_dir):
    steps = STEPS.frame(spark, sf_dir).select("recipe", "position", "id", F.array_compact(F.array("need")).alias("needs"))
    return graphs.recipe_order(steps)


@query("SELECT l_returnflag, quantile_disc(l_extendedprice, 0.5) AS p50, quantile_disc(l_extendedprice, 0.95) AS p95, max(l_extendedprice) AS p100 FROM lineitem GROUP BY l_returnflag")
def d6_selected_percentiles(spark, sf_dir):
    ranks = {"p50": selection.nearest_rank(0.5), "p95": selection.nearest_rank(0.95), "p100": selection.nearest_rank(1.0)}
    return selection.select_ranks(load(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", ranks)


@query("SELECT event_type, list_extract(list_sort(list(value)), CAST(count(*) // 2 + 1 AS BIGINT)) AS median FROM events WHERE value IS NOT NULL GROUP BY event_type")
def d13_selected_medians(spark, sf_dir):
    return selection.select_ranks(load(spark, sf_dir, "events"), ["event_type"], "value", {"median": selection.upper_median_rank()})


@query(
    """SELECT CAST(page_id AS VARCHAR) AS document_id, 'ORIGINAL' AS kind, sha256(html) AS hash, CAST(octet_length(encode(html)) AS BIGINT) AS size, NULL AS made_of, true AS intact FROM pages
UNION ALL SELECT CAST(page_id AS VARCHAR), 'DERIVED', sha256(regexp_replace(html, '<[^>]*>', '', 'g')), CAST(octet_length(encode(regexp_replace(html, '<[^>]*>', '', 'g'))) AS BIGINT), sha256(html), true FROM pages"""
)
def a1_a4_committed_artifacts(spark, sf_dir):
    """Pages and their bare texts through the content store: two operations, the second written twice; then read back."""
    pages = load(spark, sf_dir, "pages")
    row = lambda kind, content, inputs: pages.select(F.col("page_id").cast("string").alias("document_id"), F.lit(kind).alias("kind"), F.lit("text/html").alias("mime_type"), content.cast("binary").alias("content"), inputs.alias("inputs"))
    originals = row("ORIGINAL", F.col("html"), F.array().cast("array<string>"))
    derived = row("DERIVED", F.regexp_replace("html", "<[^>]*>", ""), F.array(F.sha2(F.col("html").cast("binary"), 256)))
    with scratch(spark, "blobs") as made:
        blobs.write_artifacts(originals, made.path, "import")
        for _ in range(2):
            blobs.write_artifacts(derived, made.path, "derive")
        rows = blobs.read_artifacts(spark, made.path).join(blobs.read_contents(spark, made.path), "hash")
        found = rows.filter(F.col("size") == F.col("actual_size")).select("document_id", "kind", "hash", "size", F.get("inputs", F.lit(0)).alias("made_of"), "intact")
        return made.write(found)


@query(
    """WITH e AS (SELECT user_id, epoch(date_trunc('second', ts)) AS sec FROM events),
g AS (SELECT *, lag(sec) OVER (PARTITION BY user_id ORDER BY sec) AS before FROM e),
n AS (SELECT *, sum(CASE WHEN before IS NULL OR sec - before >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS session_no FROM g),
s AS (SELECT user_id, CAST(min(sec) AS BIGINT) AS first_at, CAST(max(sec) AS BIGINT) AS last_at, count(*) AS n FROM n GROUP BY user_id, session_no)
SELECT * FROM s WHERE (last_at + 1800) * 1000 <= (SELECT epoch_ms(max(ts)) - 600000 FROM events)"""
)
def k7_streamed_sessions(spark, sf_dir):
    """Sessions that a stream over all events has closed: the batch rows but for those that its watermark hasn't passed."""
    return replayed_sessions(spark, f"{sf_dir}/events.parquet", "event_id long, ts timestamp, user_id long, event_type string, value double, props string")
