"""Comparing engines on items: scores, gates, grouped summaries, paired verdicts, reports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import character_error_rate, digit_groups, names_missing, negation_status, normalize_nfc, numbers_missing, word_error_rate
from .selection import nearest_rank, select_ranks, with_statistics

BUDGET = 5_000_000
MIN_ITEMS, GAIN = 10, 0.2


def score_recognition(items: DataFrame) -> DataFrame:
    """Adds cer, wer, numbers_missing from reference and output; error for an empty reference."""
    clean = items.withColumn("__r", normalize_nfc(F.col("reference"))).withColumn("__o", normalize_nfc(F.col("output")))
    scored = clean.withColumn("cer", character_error_rate(F.col("__r"), F.col("__o"))).withColumn("wer", word_error_rate(F.col("__r"), F.col("__o")))
    scored = scored.withColumn("numbers_missing", numbers_missing(F.array_distinct(digit_groups(F.col("reference"))), F.col("output")))
    return scored.withColumn("error", F.when(F.col("__r") == "", F.lit("empty reference"))).drop("__r", "__o")


def score_translation(items: DataFrame) -> DataFrame:
    """Adds names_missing, numbers_missing, negation from source, source_language, output, output_language, names."""
    return items.withColumn("names_missing", names_missing(F.col("names"), F.col("output"))).withColumn("numbers_missing", numbers_missing(F.array_distinct(digit_groups(F.col("source"))), F.col("output"))).withColumn("negation", negation_status(F.col("source"), F.col("source_language"), F.col("output"), F.col("output_language")))


def score_office(items: DataFrame) -> DataFrame:
    """Adds pages_equal, cer, wer, fonts_missing (sorted), tables_difference."""
    scored = score_recognition(items)
    return scored.withColumn("pages_equal", F.col("reference_pages") == F.col("output_pages")).withColumn("fonts_missing", F.array_sort(F.array_except("reference_fonts", "output_fonts"))).withColumn("tables_difference", F.col("output_tables") - F.col("reference_tables"))


def run_gates(matrix: DataFrame, budget: int = BUDGET, allow_private: bool = False) -> DataFrame:
    """matrix: run, engine_order, item_order, engine, item, cloud, private, estimate, cost. Adds status and reason.

    The budget is spent in order, so a run is one group; its size is engines times items of one evaluation.
    """

    def gate(frame: pd.DataFrame) -> pd.DataFrame:
        spent, out = 0, []
        for r in frame.sort_values(["engine_order", "item_order"]).to_dict("records"):
            reason = None
            if r["cloud"]:
                estimate = r["estimate"]
                if r["private"] and not allow_private:
                    reason = "PRIVATE_ITEM"
                elif pd.isna(estimate):
                    reason = "NO_ESTIMATE"
                elif estimate < 0:
                    reason = "INVALID_ESTIMATE"
                elif spent + estimate > budget:
                    reason = "BUDGET"
                else:
                    spent += int(estimate if pd.isna(r["cost"]) else r["cost"])
            out.append((r["run"], r["engine"], r["item"], "skipped" if reason else "ok", reason, spent))
        return pd.DataFrame(out, columns=["run", "engine", "item", "status", "reason", "spent"])

    return matrix.groupBy("run").applyInPandas(gate, "run long, engine string, item string, status string, reason string, spent long")


def summarize(results: DataFrame) -> DataFrame:
    """By engine and kind: counts by status, means over defined values, first cold time, warm P50 and P95, cost.

    An engine has few kinds and any number of times, so these are ranked by narrowing bins.
    """
    ok = F.col("status") == "ok"
    cold = F.when(ok & F.col("cold"), F.col("seq"))
    keys, counts = ["engine", "kind"], ["total", "ok", "errors", "skipped", "mean_cer", "cold_ms"]
    warm = select_ranks(results.withColumn("warm", F.when(ok & ~F.col("cold"), F.col("ms"))), keys, "warm", {"warm_p50_ms": nearest_rank(0.5), "warm_p95_ms": nearest_rank(0.95)}, nan_last=True)
    sums = results.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(ok).alias("ok"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.avg(F.when(ok, F.col("cer"))).alias("mean_cer"),
        F.min_by("ms", cold).alias("cold_ms"),
        F.coalesce(F.sum(F.when(ok, F.col("cost_micros"))), F.lit(0)).alias("cost_micros"),
    )
    return with_statistics(sums, warm, keys).select(*keys, *counts, "warm_p50_ms", "warm_p95_ms", "cost_micros")


def paired_verdict(results: DataFrame, base: str, candidate: str, kind: str, least: int = MIN_ITEMS, gain: float = GAIN) -> DataFrame:
    """n, verdict, mean_base, mean_candidate, failures_base, failures_candidate over items on which both engines worked."""
    ok = results.filter((F.col("status") == "ok") & (F.col("kind") == kind))
    side = lambda engine, tag: ok.filter(F.col("engine") == engine).select("item", F.col("cer").alias(f"cer_{tag}"), F.col("wer").alias(f"wer_{tag}"), F.col("failures").alias(f"failures_{tag}"))
    both = side(base, "base").join(side(candidate, "candidate"), "item")
    sums = both.agg(F.count("*").alias("n"), *(F.avg(f"{m}_{t}").alias(f"{m}_{t}") for m in ("cer", "wer") for t in ("base", "candidate")), *(F.coalesce(F.sum(f"failures_{t}"), F.lit(0)).alias(f"failures_{t}") for t in ("base", "candidate")))
    c = F.col
    if kind == "translation":
        worse = c("failures_candidate") > c("failures_base")
        better = (c("failures_base") > 0) & (c("failures_candidate") <= c("failures_base") * (1 - gain))
    else:
        worse = (c("cer_candidate") > c("cer_base") * 1.1 + 1e-12) | (c("failures_candidate") > c("failures_base"))
        better = (c("cer_base") > 0) & (c("cer_candidate") <= c("cer_base") * (1 - gain)) & (c("wer_candidate") <= c("wer_base"))
    verdict = F.when(c("n") < least, F.lit("inconclusive")).when(worse, F.lit("worse")).when(better, F.lit("better")).otherwise(F.lit("equivalent"))
    return sums.select("n", verdict.alias("verdict"), c("cer_base").alias("mean_base"), c("cer_candidate").alias("mean_candidate"), "failures_base", "failures_candidate")


def summary_rows(summary: DataFrame) -> DataFrame:
    """engine, kind, line: rows of the Markdown report."""
    percent = F.when(F.col("mean_cer").isNull(), F.lit("—")).otherwise(F.concat(F.expr("format_number(mean_cer * 100, '0.00')"), F.lit("%")))
    ms = lambda c: F.when(F.col(c).isNull(), F.lit("—")).otherwise(F.concat(F.floor(F.col(c) + 0.5).cast("string"), F.lit(" ms")))
    counts = F.concat_ws("/", F.col("ok").cast("string"), F.col("errors").cast("string"), F.col("skipped").cast("string"))
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("engine"), F.col("kind"), counts, percent, ms("cold_ms"), ms("warm_p50_ms"), ms("warm_p95_ms"), F.col("cost_micros").cast("string")), F.lit(" |"))
    return summary.select("engine", "kind", line.alias("line"))


def tool_metrics(runs: DataFrame) -> DataFrame:
    """tool_id, succeeded, failed, cancelled, mean_ms (0 for none)."""
    count = lambda o: F.count_if(F.col("outcome") == o)
    return runs.groupBy("tool_id").agg(count("succeeded").alias("succeeded"), count("failed").alias("failed"), count("cancelled").alias("cancelled"), F.coalesce(F.avg("duration_ms"), F.lit(0.0)).alias("mean_ms"))


def normalize_recognition(responses: DataFrame) -> DataFrame:
    """responses: response_id, expected_pages, text, pages array<struct<number, lines array<struct<segments
    array<struct<start, end>>, confidence, vertices array<struct<x, y>>>>>>. A row for each line with text, in page order;
    error instead of lines where pages, anchors, confidence or boxes are wrong."""
    from ..functions.numbers import polygon_box
    from ..functions.text import clean_line

    numbers = F.transform("pages", lambda p: p["number"])
    pages_fine = (F.size("pages") == F.col("expected_pages")) & (F.col("expected_pages") > 0) & (F.size(F.array_distinct(numbers)) == F.size(numbers)) & F.forall(numbers, lambda n: n.between(1, F.col("expected_pages")))
    rows = responses.withColumn("pages_fine", pages_fine).select("response_id", "text", "pages_fine", F.posexplode_outer("pages").alias("p_at", "page")).select("response_id", "text", "pages_fine", "page.number", F.posexplode_outer("page.lines").alias("seq", "line"))
    anchored = F.forall("line.segments", lambda s: (s["start"] >= 0) & (s["start"] <= s["end"]) & (s["end"] <= F.length("text")))
    words = F.array_join(F.transform("line.segments", lambda s: F.substring(F.col("text"), s["start"] + 1, s["end"] - s["start"])), "")
    read = rows.withColumn("anchored", F.coalesce(anchored, F.lit(False))).withColumn("words", clean_line(words)).withColumn("box", polygon_box(F.col("line.vertices")))
    solid = read.filter(F.col("words").isNull() | (F.col("words") != ""))
    confident = F.coalesce(F.col("line.confidence").between(0, 1), F.lit(False))
    error = F.when(~F.col("pages_fine"), F.lit("pages")).when(~F.col("anchored"), F.lit("anchor")).when(F.col("words").isNull(), F.lit("text")).when(~confident, F.lit("confidence")).when(F.col("box").isNull(), F.lit("box"))
    return solid.select("response_id", F.col("number").alias("page"), "seq", F.col("words").alias("text"), F.round("line.confidence", 6).alias("confidence"), "box", error.alias("error"))


def normalize_translation(responses: DataFrame, most: int = 5000) -> DataFrame:
    """responses: response_id, source_characters, translations array<string> -> response_id, text, error."""
    text = F.get("translations", F.lit(0))
    error = F.when(F.size("translations") != 1, F.lit("shape")).when(text.rlike(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"), F.lit("text")).when((F.col("source_characters") > 0) & (F.trim(text) == ""), F.lit("text")).when(F.length(text) > 4 * most, F.lit("too large"))
    return responses.select("response_id", F.when(error.isNull(), text).alias("text"), error.alias("error"))
