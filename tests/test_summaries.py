"""Percentiles of summaries without a buffer for each group."""

from pyspark.sql import functions as F

from quirefold.operators import evaluation
from quirefold.queries import tables


def test_summary_percentiles_meet_in_no_buffer(spark):
    rows = spark.range(2000).select(F.lit("a").alias("engine"), F.lit("ocr").alias("kind"), F.col("id").alias("seq"), F.lit("ok").alias("status"), (F.col("id") == 7).alias("cold"), (F.col("id") % 1000 / 2).alias("ms"), F.lit(0.5).alias("cer"), F.lit(2).alias("cost_micros"))
    rows = rows.unionByName(rows.limit(1).withColumns({"engine": F.lit(None).cast("string"), "status": F.lit("error")}))
    summary = evaluation.summarize(rows)
    assert "percentile" not in summary._jdf.queryExecution().optimizedPlan().toString()
    got = {r.engine: r for r in summary.collect()}
    exact = rows.filter("engine = 'a' AND NOT cold").agg(*(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY ms)") for p in (0.5, 0.95))).first()
    assert (got["a"].warm_p50_ms, got["a"].warm_p95_ms) == tuple(exact) and (got["a"].cold_ms, got["a"].total, got["a"].cost_micros) == (3.5, 2000, 4000)
    assert (got[None].errors, got[None].warm_p50_ms) == (1, None)


def test_percentile_query_meets_in_no_buffer(spark):
    df = tables.QUERIES["d6_percentiles"](spark, "/root/testdata/sf0.001")
    assert "percentile" not in df._jdf.queryExecution().optimizedPlan().toString()
