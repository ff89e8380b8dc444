"""Sequences: runs of days, streaks, moving averages, capped ranks, previous values."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harvestry.functions.scores import ema
from harvestry.plans.registry import Tables, query


def by_user():
    """Each user's events in time order."""
    return Window.partitionBy("user_id").orderBy("ts", "event_id")



@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), g AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) <= 1 THEN 0 ELSE 1 END AS fresh FROM d),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY day) AS run FROM g)
SELECT user_id, CAST(run AS BIGINT) AS run, CAST(min(day) AS VARCHAR) AS first_day, CAST(max(day) AS VARCHAR) AS last_day, count(*) AS days FROM i GROUP BY user_id, run""")
def day_runs(spark, base):
    """Runs of days that are at most one apart."""
    w = Window.partitionBy("user_id").orderBy("day")
    days = Tables(spark, base).events.select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    fresh = F.when(F.datediff("day", F.lag("day").over(w)) <= 1, 0).otherwise(1)
    runs = days.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w))
    return runs.groupBy("user_id", "run").agg(F.min("day").cast("string").alias("first_day"), F.max("day").cast("string").alias("last_day"), F.count("*").alias("days"))


@query("""WITH o AS (SELECT user_id, event_type = 'error' AS bad, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
 s AS (SELECT user_id, island, count(*) FILTER (WHERE bad) AS streak FROM o GROUP BY ALL)
SELECT user_id, max(streak) AS longest, max_by(streak, island) AS latest FROM s GROUP BY user_id""")
def failure_streaks(spark, base):
    """The longest and the latest run of failures since a success."""
    bad = F.col("event_type") == "error"
    rows = Tables(spark, base).events.withColumn("island", F.sum((~bad).cast("int")).over(by_user()))
    streaks = rows.groupBy("user_id", "island").agg(F.count_if(bad).alias("streak"))
    return streaks.groupBy("user_id").agg(F.max("streak").alias("longest"), F.max_by("streak", "island").alias("latest"))


@query("""WITH l AS (SELECT user_id, list(CASE WHEN event_type = 'purchase' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY ts, event_id) AS xs FROM events GROUP BY 1)
SELECT user_id, round(list_reduce(list_prepend(0.0::DOUBLE, xs), lambda a, x: 0.8 * a + 0.2 * x), 9) AS host_rate, round(list_reduce(list_prepend(0.0::DOUBLE, xs), lambda a, x: 0.7 * a + 0.3 * x), 9) AS template_rate FROM l""")
def moving_averages(spark, base):
    """Exponential moving averages in time order, with the two keeps of hosts and templates."""
    item = F.struct("ts", "event_id", (F.col("event_type") == "purchase").cast("double").alias("x"))
    lists = Tables(spark, base).events.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s["x"]).alias("xs"))
    return lists.select("user_id", F.round(ema(F.col("xs"), 0.8), 9).alias("host_rate"), F.round(ema(F.col("xs"), 0.7), 9).alias("template_rate"))


@query("""WITH m AS (SELECT user_id, event_id, ts, event_type, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS fresh FROM events),
 i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, any_value(event_type) AS message, count(*) AS times FROM i GROUP BY user_id, run""")
def repeated_messages(spark, base):
    """Equal messages in a row as one with a count."""
    fresh = F.when(F.col("event_type") == F.lag("event_type").over(by_user()), 0).otherwise(1)
    rows = Tables(spark, base).events.select("user_id", "event_id", "ts", "event_type", fresh.alias("fresh"))
    runs = rows.withColumn("run", F.sum("fresh").over(by_user()))
    return runs.groupBy("user_id", "run").agg(F.first("event_type").alias("message"), F.count("*").alias("times"))


@query("SELECT user_id, event_id, CAST(r AS BIGINT) AS place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS r FROM events) WHERE r <= 3")
def host_caps(spark, base):
    """At most three of a host, best first."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return Tables(spark, base).events.withColumn("place", place).where("place <= 3").select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query("SELECT user_id, arg_max(event_id, (value, -event_id)) AS best FROM events GROUP BY 1")
def best_match(spark, base):
    """The best of a key; of equal ones the first."""
    return Tables(spark, base).events.groupBy("user_id").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"))


@query("""SELECT user_id, list_sort(h)[1:5] AS history FROM (SELECT user_id, list(event_id ORDER BY ts DESC, event_id DESC)[1:5] AS h FROM events GROUP BY 1)""")
def bounded_history(spark, base):
    """The latest five of each key; a rank before the grouping keeps the groups small."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return Tables(spark, base).events.withColumn("place", place).where("place <= 5").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("history"))


@query("""SELECT event_id, user_id, prev, changed FROM (SELECT event_id, user_id, lag(event_type) OVER w AS prev, lag(event_type) OVER w IS DISTINCT FROM event_type AS changed FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def status_changes(spark, base):
    prev = F.lag("event_type").over(by_user())
    return Tables(spark, base).events.select("event_id", "user_id", prev.alias("prev"), (~prev.eqNullSafe(F.col("event_type"))).alias("changed"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE n <= 3 OR floor(k * 3.0 / n) <> floor((k - 1) * 3.0 / n)""")
def even_sample(spark, base):
    """At most three of each group, evenly spread over its ranks: the sampling is the feature."""
    w = Window.partitionBy("o_custkey")
    r = Tables(spark, base).orders.select("o_custkey", "o_orderkey", (F.row_number().over(w.orderBy("o_orderkey")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    step = lambda k: F.floor(k * 3.0 / F.col("n"))
    return r.where((F.col("n") <= 3) | (step(F.col("k")) != step(F.col("k") - 1))).select("o_custkey", "o_orderkey")


@query("""SELECT user_id, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-23' AND ts < TIMESTAMP '2024-01-30') AS week, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-29' AND ts < TIMESTAMP '2024-01-30') AS day FROM events GROUP BY 1""")
def recent_counts(spark, base):
    since = lambda d: F.count_if((F.col("ts") >= F.lit(d).cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-30").cast("timestamp_ntz")))
    return Tables(spark, base).events.groupBy("user_id").agg(since("2024-01-23").alias("week"), since("2024-01-29").alias("day"))


@query("""WITH o AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 40 AS INT) AS e, o_orderkey AS id FROM orders),
 p AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
 i AS (SELECT *, sum(CASE WHEN before IS NOT NULL AND s - before <= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY s, id) AS run FROM p)
SELECT k, CAST(run AS BIGINT) AS run, CAST(min(s) AS VARCHAR) AS start_day, CAST(max(e) AS VARCHAR) AS end_day, count(*) AS rows FROM i GROUP BY k, run""")
def joined_runs(spark, base):
    """Overlapping or adjacent spans of a key as one."""
    w = Window.partitionBy("k").orderBy("s", "id")
    start = F.col("o_orderdate").cast("date")
    o = Tables(spark, base).orders.select(F.col("o_custkey").alias("k"), start.alias("s"), F.date_add(start, (F.col("o_orderkey") % 40).cast("int")).alias("e"), F.col("o_orderkey").alias("id"))
    before = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    i = o.withColumn("before", before).withColumn("fresh", F.when(F.datediff("s", "before") <= 1, 0).otherwise(1)).withColumn("run", F.sum("fresh").over(w))
    return i.groupBy("k", "run").agg(F.min("s").cast("string").alias("start_day"), F.max("e").cast("string").alias("end_day"), F.count("*").alias("rows"))
