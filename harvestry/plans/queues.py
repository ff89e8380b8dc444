"""Work lists: priorities, budgets, back-off and admission. Limits are the feature of each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harvestry.functions.scores import backoff_days
from harvestry.plans.registry import Tables, query


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def frontier_view(spark, base):
    return Tables(spark, base).orders.where("o_orderstatus = 'O'").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey")


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_totalprice + CASE o_orderpriority WHEN '1-URGENT' THEN 50000 WHEN '2-HIGH' THEN 20000 ELSE 0 END AS score FROM orders),
 r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY score DESC, o_orderkey) AS k FROM s)
SELECT o_orderkey FROM r WHERE k <= 3 ORDER BY score DESC, o_orderkey LIMIT 100""")
def frontier_pick(spark, base):
    """The best hundred, at most three of one host."""
    bonus = F.when(F.col("o_orderpriority") == "1-URGENT", 50000).when(F.col("o_orderpriority") == "2-HIGH", 20000).otherwise(0)
    s = Tables(spark, base).orders.select("o_orderkey", "o_custkey", (F.col("o_totalprice") + bonus).alias("score"))
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("score"), "o_orderkey"))
    return s.withColumn("k", k).where("k <= 3").orderBy(F.desc("score"), "o_orderkey").limit(100).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderpriority = '1-URGENT' DESC, o_orderpriority, o_orderdate, o_orderkey LIMIT 1000")
def job_queue(spark, base):
    """Repairs first, then by priority and age."""
    return Tables(spark, base).orders.orderBy(F.desc(F.col("o_orderpriority") == "1-URGENT"), "o_orderpriority", "o_orderdate", "o_orderkey").limit(1000).select("o_orderkey")


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def one_per_site(spark, base):
    r = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return Tables(spark, base).orders.withColumn("r", r).where("r = 1").select("o_custkey", "o_orderkey")


@query("""WITH f AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS failures, max(ts) AS last FROM events GROUP BY 1)
SELECT user_id, failures, CAST(CASE WHEN failures > 0 THEN least(30, power(2, failures - 1)) ELSE 30 END AS DOUBLE) AS wait_days, last < TIMESTAMP '2024-01-20' AS due FROM f""")
def retry_backoff(spark, base):
    f = Tables(spark, base).events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("failures"), F.max("ts").alias("last"))
    return f.select("user_id", "failures", backoff_days(F.col("failures")).alias("wait_days"), (F.col("last") < F.lit("2024-01-20").cast("timestamp_ntz")).alias("due"))


@query("""WITH n AS (SELECT c_nationkey AS place, count(*) AS events FROM customer GROUP BY 1) SELECT place, events FROM n ORDER BY events DESC, place LIMIT 40""")
def geocode_queue(spark, base):
    """Places to look up, those of most listings first."""
    return Tables(spark, base).customer.groupBy(F.col("c_nationkey").alias("place")).agg(F.count("*").alias("events")).orderBy(F.desc("events"), "place").limit(40)


@query("""WITH cells AS (SELECT c_nationkey AS town, c_mktsegment AS kind, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1, 2),
 towns AS (SELECT n_nationkey AS town FROM nation), kinds AS (SELECT DISTINCT c_mktsegment AS kind FROM customer), recent AS (SELECT DISTINCT s_nationkey AS town FROM supplier WHERE s_acctbal > 9000)
SELECT t.town, k.kind, coalesce(n, 0) AS n, round(1.0 / (1 + coalesce(n, 0)), 6) AS gap FROM towns t, kinds k LEFT JOIN cells c ON c.town = t.town AND c.kind = k.kind WHERE t.town NOT IN (SELECT town FROM recent)""")
def discovery_targets(spark, base):
    """Every town with every kind, those covered least first; recently searched towns are out. Both sides are small dimensions."""
    t = Tables(spark, base)
    town = F.col("c_nationkey").alias("town")
    cells = t.customer.where("c_acctbal > 5000").groupBy(town, F.col("c_mktsegment").alias("kind")).agg(F.count("*").alias("n"))
    recent = t.supplier.where("s_acctbal > 9000").select(F.col("s_nationkey").alias("town")).distinct()
    towns = t.nation.select(F.col("n_nationkey").alias("town")).join(recent, "town", "left_anti")
    kinds = t.customer.select(F.col("c_mktsegment").alias("kind")).distinct()
    rows = towns.crossJoin(kinds).join(cells, ["town", "kind"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return rows.select("town", "kind", "n", F.round(1.0 / (1 + F.col("n")), 6).alias("gap"))


@query("SELECT l_suppkey, l_orderkey FROM (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r <= 5")
def sitemap_newest(spark, base):
    """The newest five pages of each site."""
    r = F.row_number().over(Window.partitionBy("l_suppkey").orderBy(F.desc("l_shipdate"), "l_orderkey", "l_linenumber"))
    return Tables(spark, base).lineitem.withColumn("r", r).where("r <= 5").select("l_suppkey", "l_orderkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'irrelevant' WHEN n >= 2 THEN 'events' ELSE 'unknown' END AS kind, least(168, greatest(12, CASE WHEN n > 10 THEN 19.2 ELSE 30.0 END))::DOUBLE AS hours FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def source_lifecycle(spark, base):
    """A site's kind from what it has published, and its next interval: shorter after news, longer without, within bounds."""
    t = Tables(spark, base)
    n = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    kind = F.when(F.col("c_acctbal") < 0, "irrelevant").when(F.col("n") >= 2, "events").otherwise("unknown")
    hours = F.least(F.lit(168.0), F.greatest(F.lit(12.0), 24 * F.when(F.col("n") > 10, 0.8).otherwise(1.25)))
    return t.customer.join(n, "c_custkey", "left").select("c_custkey", kind.alias("kind"), F.round(hours, 6).alias("hours"))
