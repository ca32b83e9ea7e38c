"""Sessions with timers and list state: late and unordered events, several batches."""

import random

from quirefold.streaming import sessions


def plain(events, gap):
    out = []
    for user in {u for _, u in events}:
        run = []
        for t in sorted(t for t, u in events if u == user):
            if run and t - run[-1] >= gap:
                out.append((user, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        out.append((user, run[0], run[-1], len(run)))
    return out


def test_unordered_files_give_the_closed_sessions(spark, tmp_path):
    """Events of a file in any order, files less late than the watermark allows."""
    r = random.Random(3)
    events = sorted((r.randrange(20_000), r.randrange(4)) for _ in range(250))
    for k in range(0, 250, 50):
        part = events[k : k + 50]
        r.shuffle(part)
        spark.createDataFrame(part, "at long, user_id long").selectExpr("timestamp_seconds(at) AS ts", "user_id").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = sessions.replayed_sessions(spark, str(tmp_path / "in"), "ts timestamp, user_id long", gap=300, lateness="100 seconds", files_per_batch=2).collect()
    last = max(t for t, _ in events)
    assert sorted(tuple(x) for x in got) == sorted(s for s in plain(events, 300) if s[2] + 300 <= last - 100)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") != sessions.PROVIDER
