"""Rests of hosts as timers: a trouble begins a rest, and event time ends it, whether or not the host is seen again."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from harvestry.plans.registry import query
from harvestry.streaming.plans import drain, stream_of

#: Milliseconds of a rest, and how late a visit may come.
REST_MS, LATE_HOURS = 18 * 3600 * 1000, 6
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Rests(StatefulProcessor):
    """State of a host: its open rests by their ends (more than one where a batch spans several), with the troubles inside.

    A trouble outside any rest begins one and sets a timer for its end; one inside is counted. When a timer fires, its rest is given
    out and forgotten, so a host that has no open rest has no state.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "end long", "start long, troubles long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        times = sorted(t for frame in rows for t in frame["at"].tolist())
        rests = {end[0]: list(of) for end, of in self.open.iterator()}
        for at in times:
            inside = next((end for end, (start, _) in rests.items() if start <= at < end), None)
            if inside is not None:
                rests[inside][1] += 1
            else:
                rests[at + REST_MS] = [at, 1]
                self.handle.registerTimer(at + REST_MS)
        for end, of in rests.items():
            self.open.updateValue((end,), tuple(of))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end = expiredTimerInfo.getExpiryTimeInMs()
        if self.open.containsKey((end,)):
            start, troubles = self.open.getValue((end,))
            self.open.removeKey((end,))
            yield pd.DataFrame({"user_id": [key[0]], "start_ms": [start], "end_ms": [end], "troubles": [troubles]})

    def close(self) -> None:
        pass


def ended_rests(spark: SparkSession, visits: DataFrame) -> DataFrame:
    """user_id, start_ms, end_ms, troubles of the rests that event time has ended, from a stream of visits (user_id, ts, event_type)."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        bad = visits.where("event_type = 'error'").withWatermark("ts", f"{LATE_HOURS} hours").select("user_id", "ts", F.unix_millis("ts").alias("at"))
        out = bad.groupBy("user_id").transformWithStateInPandas(statefulProcessor=Rests(), outputStructType="user_id long, start_ms long, end_ms long, troubles long", outputMode="Append", timeMode="EventTime")
        return drain(out, "append")
    finally:
        spark.conf.set(PROVIDER, before)


@query(f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms FROM events WHERE event_type = 'error'),
r AS (SELECT user_id, min(ms) AS start_ms FROM e GROUP BY 1 UNION ALL SELECT r.user_id, min(e.ms) FROM r JOIN e ON e.user_id = r.user_id AND e.ms >= r.start_ms + {REST_MS} GROUP BY r.user_id)
SELECT r.user_id, start_ms, start_ms + {REST_MS} AS end_ms, count(*) AS troubles FROM r JOIN e ON e.user_id = r.user_id AND e.ms >= start_ms AND e.ms < start_ms + {REST_MS}
WHERE start_ms + {REST_MS} <= (SELECT max(ms) FROM e) - {LATE_HOURS * 3600 * 1000} GROUP BY 1, 2""")
def stream_rests(spark, base):
    """Rests that a host's troubles began and a timer has ended; those still open when the stream ends are not given out."""
    return ended_rests(spark, stream_of(spark, base).select("user_id", "ts", "event_type"))
