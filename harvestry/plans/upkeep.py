"""Upkeep of listings: primary rows, merging, retention, outages, retries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harvestry.plans.registry import Tables, query
from harvestry.plans.resolution import GREEDY_SQL, grouped


@query("""WITH r AS (SELECT l_orderkey AS e, l_suppkey AS site, CAST(l_shipdate AS DATE) AS d, l_linenumber AS n, l_comment FROM (SELECT *, l_returnflag AS l_comment FROM lineitem))
SELECT e, arg_min(site, (d, n, site)) AS primary_site, CAST(min(d) AS VARCHAR) AS first_day, CAST(max(d) AS VARCHAR) AS last_day, count(DISTINCT site) AS sites, list_sort(list_distinct(list(l_comment))) AS tags FROM r GROUP BY e""")
def synced_events(spark, base):
    """A listing from its sightings: the first one's fields, the span of all, distinct sites and tags."""
    day = F.col("l_shipdate").cast("date")
    return Tables(spark, base).lineitem.groupBy(F.col("l_orderkey").alias("e")).agg(
        F.min_by("l_suppkey", F.struct(day, "l_linenumber", "l_suppkey")).alias("primary_site"), F.min(day).cast("string").alias("first_day"), F.max(day).cast("string").alias("last_day"),
        F.countDistinct("l_suppkey").alias("sites"), F.sort_array(F.collect_set("l_returnflag")).alias("tags"))


@query(f"""WITH RECURSIVE {GREEDY_SQL}, h AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS site FROM pages), g(i, gs) AS (SELECT 0::BIGINT, (SELECT list({{'ids': [page_id], 'sites': [site]}}) FROM h) UNION ALL
 SELECT n, CASE WHEN x = y OR len(list_intersect(x.sites, y.sites)) > 0 THEN gs ELSE list_append(list_filter(gs, lambda l: l <> x AND l <> y), {{'ids': list_concat(x.ids, y.ids), 'sites': list_concat(x.sites, y.sites)}}) END
 FROM (SELECT k.i AS n, gs, list_filter(gs, lambda l: list_contains(l.ids, k.a))[1] AS x, list_filter(gs, lambda l: list_contains(l.ids, k.b))[1] AS y FROM g JOIN k ON k.i = g.i + 1)),
z AS (SELECT unnest(gs) AS l FROM g WHERE i = (SELECT max(i) FROM g)) SELECT unnest(l.ids) AS page_id, list_min(l.ids) AS survivor FROM z""")
def joined_duplicates(spark, base):
    """Similar listings of different sites as one, the best pairs first."""
    t = Tables(spark, base)
    return grouped(t, t.pages.select(F.col("page_id").alias("id"), F.regexp_extract("url", "^https?://([^/]+)", 1).alias("key")), "share", "survivor")


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE ts >= TIMESTAMP '2024-01-16' OR r <= 2")
def retention(spark, base):
    """What is younger than fourteen days, and the latest two of each key whatever their age."""
    r = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id")))
    return Tables(spark, base).events.withColumn("r", r).where((F.col("ts") >= F.lit("2024-01-16").cast("timestamp_ntz")) | (F.col("r") <= 2)).select("user_id", "event_id")


@query("""WITH o AS (SELECT r_regionkey AS k, TIMESTAMP '2024-01-02' + INTERVAL (CAST(r_regionkey * 5 AS INT)) DAY AS a, TIMESTAMP '2024-01-02 18:00:00' + INTERVAL (CAST(r_regionkey * 5 AS INT)) DAY AS b FROM region)
SELECT event_id FROM events e WHERE NOT EXISTS (SELECT 1 FROM o WHERE e.ts >= o.a AND e.ts < o.b AND e.event_type = 'error')""")
def outside_outages(spark, base):
    """Visits without those that failed while the network was down: an interval join on days."""
    t = Tables(spark, base)
    a = F.date_add(F.lit("2024-01-02").cast("date"), (F.col("r_regionkey") * 5).cast("int"))
    outage = t.region.select(a.alias("day"), a.cast("timestamp_ntz").alias("a"), (a.cast("timestamp_ntz") + F.expr("interval 18 hours")).alias("b"))
    e = t.events.withColumn("day", F.col("ts").cast("date"))
    inside = e.alias("e").join(outage.alias("o"), (F.col("e.day") == F.col("o.day")) & (F.col("e.ts") >= F.col("o.a")) & (F.col("e.ts") < F.col("o.b")) & (F.col("e.event_type") == "error"), "left_anti")
    return inside.select("event_id")


@query("""WITH t AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS tries FROM events GROUP BY 1)
SELECT user_id, tries, CASE WHEN tries < 4 THEN CAST(power(2, greatest(tries - 1, 0)) AS BIGINT) END AS hours, tries >= 4 AS dropped FROM t""")
def job_retries(spark, base):
    """Hours until a failed job runs again: 1, 2, 4; after four tries it is dropped."""
    t = Tables(spark, base).events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("tries"))
    hours = F.when(F.col("tries") < 4, F.pow(F.lit(2.0), F.greatest(F.col("tries") - 1, F.lit(0))).cast("long"))
    return t.select("user_id", "tries", hours.alias("hours"), (F.col("tries") >= 4).alias("dropped"))


@query("""SELECT page_id, unnest(['https://x.example/town/' || n.n_name || '/list']) AS variant FROM (SELECT page_id FROM pages) p, nation n WHERE n.n_regionkey = 0""")
def town_variants(spark, base):
    """An address for each town of a region: pages with a small dimension of fixed size."""
    t = Tables(spark, base)
    towns = F.broadcast(t.nation.where("n_regionkey = 0").select("n_name"))
    return t.pages.select("page_id").crossJoin(towns).select("page_id", F.concat(F.lit("https://x.example/town/"), F.col("n_name"), F.lit("/list")).alias("variant"))


@query("SELECT DISTINCT n_name AS town FROM nation UNION SELECT 'NATION_' || (s_suppkey % 40) FROM supplier")
def towns(spark, base):
    t = Tables(spark, base)
    return t.nation.select(F.col("n_name").alias("town")).union(t.supplier.select(F.concat(F.lit("NATION_"), (F.col("s_suppkey") % 40).cast("string")))).distinct()


@query("""WITH l AS (SELECT l_suppkey % 20 AS site, l_partkey % 30 AS page, l_returnflag AS job, l_quantity AS cost FROM lineitem), g AS (SELECT site, page, job, round(sum(cost), 2) AS cost, GROUPING(site) * 4 + GROUPING(page) * 2 + GROUPING(job) AS lvl FROM l GROUP BY ROLLUP (site, page, job))
SELECT site, page, job, cost, lvl FROM (SELECT *, row_number() OVER (PARTITION BY lvl, site, CASE WHEN lvl = 1 THEN 0 ELSE page END ORDER BY cost DESC, page, job) AS r FROM g) WHERE lvl <> 1 OR r <= 15""")
def usage_tree(spark, base):
    """Site, page and job as a tree of sums; of each site's pages the fifteen that cost most."""
    l_ = Tables(spark, base).lineitem.select((F.col("l_suppkey") % 20).alias("site"), (F.col("l_partkey") % 30).alias("page"), F.col("l_returnflag").alias("job"), "l_quantity")
    g = l_.rollup("site", "page", "job").agg(F.round(F.sum("l_quantity"), 2).alias("cost"), (F.grouping("site") * 4 + F.grouping("page") * 2 + F.grouping("job")).cast("long").alias("lvl"))
    r = F.row_number().over(Window.partitionBy("lvl", "site", F.when(F.col("lvl") == 1, 0).otherwise(F.col("page"))).orderBy(F.desc("cost"), "page", "job"))
    return g.withColumn("r", r).where("lvl <> 1 or r <= 15").drop("r")


@query("SELECT user_id, CAST(round(sum(value)) AS BIGINT) AS units, median_n FROM events, (SELECT CAST(quantile_disc(n, 0.5) AS BIGINT) AS median_n FROM (SELECT count(*) AS n FROM events GROUP BY user_id)) GROUP BY user_id, median_n HAVING count(*) > median_n")
def heavy_hosts(spark, base):
    """Hosts with more visits than the median host, next to it.

    A sum of doubles hangs on its order, and with it on which side of a half a host falls: values are added by event_id, so
    neither files nor partitions change a row.
    """
    so_far = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = Tables(spark, base).events.select("user_id", F.count("*").over(so_far).alias("n"), F.sum("value").over(so_far).alias("units"))
    counts = sums.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.max_by("units", "n")).cast("long").alias("units"))
    median = counts.agg(F.expr("percentile_disc(0.5) within group (order by n)").cast("long").alias("median_n"))
    return counts.crossJoin(F.broadcast(median)).where("n > median_n").select("user_id", "units", "median_n")
