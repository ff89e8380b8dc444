"""Structured Streaming forms of the stateful behaviours; each run drains what is there and stops."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from harvestry.plans.registry import query
from harvestry.sources.tables import shared_dir


def stream_of(spark: SparkSession, base: str, name: str = "events") -> DataFrame:
    """A table's files as a stream; its event time is a proper timestamp."""
    path = f"{base}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    files = spark.read.parquet(path).inputFiles()
    folder = path if len(files) > 1 else path.rsplit("/", 1)[0]
    reader = spark.readStream.schema(schema)
    if len(files) == 1:
        reader = reader.option("pathGlobFilter", f"{name}.parquet")
    rows = reader.parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(df: DataFrame, mode: str) -> DataFrame:
    """Run the stream until its input is read, and return what it wrote, from the shared folder."""
    spark = df.sparkSession
    out = f"{shared_dir(spark)}/harvestry-stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(write).start()
    q.awaitTermination()
    rows = spark.read.option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    if mode == "complete":
        last = rows.agg(F.max("batch")).first()[0]
        rows = rows.where(F.col("batch") == last)
    return rows.drop("batch")


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, base):
    """Tumbling windows of a day under a watermark."""
    rows = stream_of(spark, base).withWatermark("ts", "1 hour")
    daily = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return drain(daily, "complete").select(F.col("window.start").cast("date").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedup(spark, base):
    """The first sight of each key."""
    return drain(stream_of(spark, base).select("user_id", "event_type").dropDuplicates(["user_id", "event_type"]), "append")


@query("""WITH h AS (SELECT user_id, ts, event_id, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
 s AS (SELECT user_id, ts, sum(CASE WHEN gap IS NULL OR gap >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM h)
SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, count(*) AS n FROM s GROUP BY user_id, session""")
def stream_sessions(spark, base):
    """Sessions that end after twelve quiet hours."""
    rows = stream_of(spark, base).withWatermark("ts", "1 hour")
    sessions = rows.groupBy(F.session_window("ts", "12 hours"), "user_id").agg(F.count("*").alias("n"))
    return drain(sessions, "complete").select("user_id", F.unix_micros("session_window.start").alias("start_us"), "n")


BREAKER = "user_id long, visits long, rate double, trouble int, downs int, rest_hours int"
#: Troubles in a row that rest a host, hours of its first rest, and of its longest.
TROUBLES, FIRST_REST, LONGEST_REST = 3, 2, 24


def host_state(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A host's visits, moving average, run of troubles, rests in a row and hours of the last one: TROUBLES in a row rest it, each
    time for twice as long; a visit without trouble ends all that."""
    visits, rate, trouble, downs = state.get if state.exists else (0, 0.0, 0, 0)
    rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
    for kind in rows.event_type:
        visits += 1
        rate = 0.8 * rate + 0.2 * (kind == "purchase")
        trouble, downs = (trouble + 1, downs) if kind == "error" else (0, 0)
        if trouble == TROUBLES:
            downs, trouble = downs + 1, 0
    rest = min(LONGEST_REST, FIRST_REST * 2 ** (downs - 1)) if downs else 0
    state.update((visits, rate, trouble, downs))
    yield pd.DataFrame({"user_id": [key[0]], "visits": [visits], "rate": [rate], "trouble": [trouble], "downs": [downs], "rest_hours": [rest]})


@query(f"""WITH l AS (SELECT user_id, count(*) AS visits, list(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY ts, event_id) AS xs, list(event_type ORDER BY ts, event_id) AS kinds FROM events GROUP BY 1),
 r AS (SELECT *, visits - coalesce(list_max(list_filter(range(1, visits + 1), lambda i: kinds[i] <> 'error')), 0) AS bad FROM l)
SELECT user_id, visits, round(list_reduce(list_prepend(0.0::DOUBLE, xs), lambda a, x: 0.8 * a + 0.2 * x), 9) AS rate, CAST(bad % {TROUBLES} AS INT) AS trouble, CAST(bad // {TROUBLES} AS INT) AS downs, CAST(CASE WHEN bad >= {TROUBLES} THEN least({LONGEST_REST}, {FIRST_REST} * power(2, bad // {TROUBLES} - 1)) ELSE 0 END AS INT) AS rest_hours FROM r""")
def stream_host_state(spark, base):
    """Counters, averages and rests per host as keyed state; the last row of each host is its current state."""
    rows = stream_of(spark, base).select("user_id", "ts", "event_id", "event_type")
    out = rows.groupBy("user_id").applyInPandasWithState(host_state, BREAKER, "visits long, rate double, trouble int, downs int", "update", GroupStateTimeout.NoTimeout)
    latest = drain(out, "update").groupBy("user_id").agg(F.max_by(F.struct("visits", F.round("rate", 9).alias("rate"), "trouble", "downs", "rest_hours"), "visits").alias("x"))
    return latest.select("user_id", "x.*")


@query("SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_dedup_watermark(spark, base):
    """Keys seen once within the watermark's reach; the table spans less than the reach."""
    rows = stream_of(spark, base).withWatermark("ts", "40 days").select("ts", "user_id", "event_type")
    return drain(rows.dropDuplicatesWithinWatermark(["user_id", "event_type"]).select("user_id", "event_type"), "append")


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1")
def stream_upsert(spark, base):
    """Each batch merged by key into a collection: rows seen again replace what is there."""
    from harvestry.sources.collections import merge_into, read_collection

    path = f"{shared_dir(spark)}/harvestry-upsert-{uuid.uuid4().hex}"
    rows = stream_of(spark, base).select("user_id", "event_id", "event_type", "ts")

    def merge(batch: DataFrame, number: int) -> None:
        merge_into(batch, f"{path}/rows", ["user_id"], ["ts", "event_id"])

    rows.writeStream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(merge).start().awaitTermination()
    return read_collection(spark, f"{path}/rows", rows.schema).select("user_id", "event_id", "event_type")


@query("""WITH w AS (SELECT event_type, ts, value, unnest([0, 12]) AS o FROM events), b AS (SELECT event_type, value, time_bucket(INTERVAL 1 DAY, ts - INTERVAL (o) HOUR, TIMESTAMP '2024-01-01') + INTERVAL (o) HOUR AS s FROM w)
SELECT event_type, CAST(epoch_us(s) AS BIGINT) AS start_us, count(*) AS n FROM b GROUP BY 1, 2""")
def stream_sliding(spark, base):
    """Windows of a day that slide by twelve hours."""
    rows = stream_of(spark, base).withWatermark("ts", "1 hour")
    w = rows.groupBy(F.window("ts", "1 day", "12 hours"), "event_type").agg(F.count("*").alias("n"))
    return drain(w, "complete").select("event_type", F.unix_micros("window.start").alias("start_us"), "n")


def interval_state(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Hours until a site's next visit: shorter after news, longer without, between twelve hours and a week."""
    hours = state.get[0] if state.exists else 48.0
    for kind in pd.concat(list(frames)).sort_values(["ts", "event_id"]).event_type:
        hours = min(168.0, max(12.0, hours * (0.8 if kind == "purchase" else 1.25)))
    state.update((hours,))
    yield pd.DataFrame({"user_id": [key[0]], "hours": [hours]})


@query("""WITH l AS (SELECT user_id, list(CASE WHEN event_type = 'purchase' THEN 0.8::DOUBLE ELSE 1.25::DOUBLE END ORDER BY ts, event_id) AS xs FROM events GROUP BY 1)
SELECT user_id, round(list_reduce(list_prepend(48.0::DOUBLE, xs), lambda a, x: least(168.0, greatest(12.0, a * x))), 6) AS hours FROM l""")
def stream_intervals(spark, base):
    rows = stream_of(spark, base).select("user_id", "ts", "event_id", "event_type")
    out = rows.groupBy("user_id").applyInPandasWithState(interval_state, "user_id long, hours double", "hours double", "update", GroupStateTimeout.NoTimeout)
    return drain(out, "update").select("user_id", F.round("hours", 6).alias("hours"))
