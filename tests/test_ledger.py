from collections import defaultdict

from quirefold.operators import ledger
from quirefold.queries import scalars

from .test_examples import EXAMPLES


def rows(spark, name):
    return scalars.FUNCTIONS[name][0](EXAMPLES[name].frame(spark))


def test_ledger_log(spark):
    got = {r["seq"]: r for r in rows(spark, "k2_k3_k5_ledger").collect()}
    assert [got[k]["outcome"] for k in range(1, 12)] == ["queued", "same", "conflict", "busy", "ok", "quota_exceeded", "ok", "ok", "ok", "same", "conflict"]
    assert got[7]["fence"] == 2  # the first lease ran out before the outside call
    assert (got[8]["reserved_micros"], got[9]["reserved_micros"], got[9]["used_micros"], got[9]["state"]) == (1000, 0, 700, "settled")


def test_gates(spark):
    got = {(r["engine"], r["item"]): (r["status"], r["reason"]) for r in rows(spark, "l2_run_gates").collect()}
    assert got["local", "i1"] == ("ok", None) and got["cloud", "i0"] == ("ok", None)
    assert got["cloud", "i1"] == ("skipped", "PRIVATE_ITEM") and got["cloud", "i2"] == ("skipped", "BUDGET") and got["cloud", "i3"] == ("skipped", "NO_ESTIMATE")


def test_periods(spark):
    got = {r["at"]: (r["period"], r["ends_at"], r["guarded"]) for r in rows(spark, "g22_billing_periods").collect()}
    assert got[1767225599] == ("2025-12", 1767254400, False) and got[1767254399] == ("2025-12", 1767254400, True)
    assert got[1767254400] == ("2026-01", 1769932800, False)


def test_scores(spark):
    got = {r["item"]: r for r in rows(spark, "l1_recognition_scores").collect()}
    assert got["a"]["numbers"] == "30" and got["b"]["error"] == "empty reference" and got["c"]["cer"] == 0.0
    office = {r["item"]: r for r in rows(spark, "l5_office_scores").collect()}
    assert (office["a"]["fonts"], office["a"]["tables_difference"], office["b"]["pages_equal"], office["b"]["wer"]) == ("B", -1, False, 0.5)
    lines = {r["engine"]: r["line"] for r in rows(spark, "l6_summary_rows").collect()}
    assert lines["a"].startswith("| a | ocr | 13/0/1 |")
    seen = {(r["response_id"], r["text"]): r["error"] for r in rows(spark, "i16_recognition_responses").collect()}
    assert seen == {(1, "hello"): None, (1, "world"): None, (2, "x"): "pages", (3, "x"): "anchor"}


def test_a_period_is_read_in_batches(spark):
    """No task gets a whole period at once; counts and sums hold over batches, and the next period begins anew."""
    names = "seq long, at long, action string, job_id string, participant string, maximum long, ocr_pages long, characters long, office_files long, fingerprint string, lease long, fence int, actual long"
    at = {"2026-01": 1768000000, "2026-02": 1771000000}
    log = [(k, at[m] + k, a, f"j{k // 4}", f"p{k // 4 % 5}", 900, 1, 0, 0, "f", 60, 1, 700) for m in at for k, a in zip(range(4 * 60), ("reserve", "claim", "started", "settle") * 60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = ledger.run_ledger(spark.createDataFrame(log, names).orderBy("participant"))
        assert "MapInPandas" in df._jdf.queryExecution().executedPlan().toString()
        got = sorted(df.collect(), key=lambda r: r["seq"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    used = defaultdict(int)
    for r in got[::2]:  # both months say the same
        used[r["participant"]] += 700 if r["action"] == "settle" else 0
        assert (r["outcome"], r["used_micros"]) == ("queued" if r["action"] == "reserve" else "ok", used[r["participant"]])
    assert len(got) == len(log) and got[::2] == got[1::2]
