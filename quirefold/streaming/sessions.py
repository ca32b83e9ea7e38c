"""Sessions over a stream with timers: events wait in list state until the watermark has passed the gap behind them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import Scratch

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SESSIONS = "user_id long, first_at long, last_at long, n long"


class Sessions(StatefulProcessor):
    """A session is final once no event that the watermark still lets in can join it.

    State of a user: the seconds of events of open sessions, which may come in any order, and one timer at the earliest
    end of such a session. So state holds what the last gap and the lateness can hold, not all users ever seen.
    """

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long")

    def _cut(self, seconds: list[int]) -> list[list[int]]:
        out: list[list[int]] = []
        for s in sorted(seconds):
            if out and s - out[-1][-1] < self.gap:
                out[-1].append(s)
            else:
                out.append([s])
        return out

    def _wake(self, first_end: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(first_end * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.waiting.appendList([(int(s),) for s in frame["at"]])
        self._wake(min(s[-1] for s in self._cut([r[0] for r in self.waiting.get()])) + self.gap)
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sessions = self._cut([r[0] for r in self.waiting.get()])
        now = timerValues.getCurrentWatermarkInMs()
        closed = [s for s in sessions if (s[-1] + self.gap) * 1000 <= now]
        left = [s for s in sessions if (s[-1] + self.gap) * 1000 > now]
        if left:
            self.waiting.put([(x,) for s in left for x in s])
            self._wake(min(s[-1] for s in left) + self.gap)
        else:
            self.waiting.clear()
        yield pd.DataFrame([(key[0], s[0], s[-1], len(s)) for s in closed], columns=["user_id", "first_at", "last_at", "n"])

    def close(self) -> None:
        pass


def timed_sessions(events: DataFrame, gap: int = 1800, lateness: str = "10 minutes") -> DataFrame:
    """user_id, first_at, last_at, n of closed sessions: runs of events less than gap seconds apart. events: ts, user_id, as a stream."""
    seconds = events.withWatermark("ts", lateness).select("ts", "user_id", F.unix_seconds("ts").alias("at"))
    return seconds.groupBy("user_id").transformWithStateInPandas(Sessions(gap), SESSIONS, "Append", "EventTime")


def replayed_sessions(spark: SparkSession, path: str, schema: str, gap: int = 1800, lateness: str = "10 minutes", files_per_batch: int = 1000) -> DataFrame:
    """The files at path run through the stream once (AvailableNow) into a table. State store settings stay in a session of their own."""
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    made = Scratch(spark, "sessions")
    out = f"{made.path}/table"
    files = own.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():  # streams read folders only
        files, path = files.option("pathGlobFilter", place.getName()), place.getParent().toString()
    stream = timed_sessions(files.parquet(path), gap, lateness)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{made.path}/checkpoint").outputMode("append").trigger(availableNow=True).start(out)
    query.awaitTermination()
    return spark.read.schema(SESSIONS).parquet(out)
