"""The public views: filtered, faceted, grouped and ordered listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harvestry.functions.text import fold
from harvestry.plans.listings import ASOF, LISTINGS_SQL, last_day, listings, upcoming
from harvestry.plans.registry import Tables, query

UP = f"coalesce(end_day, start_day) >= DATE '{ASOF}'"
RANGE = f"start_day <= DATE '{ASOF}' + 60 AND {UP}"


def in_range(df, days: int = 60):
    """Whole days from ASOF on, both ends included."""
    return upcoming(df).where(F.col("start_day") <= F.date_add(F.lit(ASOF).cast("date"), days))


@query(f"""WITH {LISTINGS_SQL} SELECT event_id, CAST(start_day AS VARCHAR) AS start_day, CAST(end_day AS VARCHAR) AS end_day, tag, town, title FROM listing
WHERE {RANGE} AND contains(lower(title), 'mach') ORDER BY start_day, event_id LIMIT 500""")
def public_list(spark, base):
    """Upcoming listings of a range with a substring in their folded title, first days first."""
    rows = in_range(listings(Tables(spark, base))).where(fold(F.col("title")).contains("mach"))
    return rows.orderBy("start_day", "event_id").limit(500).select("event_id", F.col("start_day").cast("string").alias("start_day"), F.col("end_day").cast("string").alias("end_day"), "tag", "town", "title")


@query(f"WITH {LISTINGS_SQL}, f AS (SELECT tag, count(*) AS n FROM listing WHERE {RANGE} GROUP BY tag), k AS (SELECT DISTINCT o_orderpriority AS tag FROM orders) SELECT k.tag, coalesce(n, 0) AS n FROM k LEFT JOIN f USING (tag)")
def tag_facets(spark, base):
    """A count for each kind that there is, also where no listing is in range."""
    t = Tables(spark, base)
    kinds = t.orders.select(F.col("o_orderpriority").alias("tag")).distinct()
    counts = in_range(listings(t)).groupBy("tag").agg(F.count("*").alias("n"))
    return kinds.join(counts, "tag", "left").select("tag", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"WITH {LISTINGS_SQL} SELECT event_id, tag FROM listing WHERE {RANGE} AND tag NOT IN ('1-URGENT', '5-LOW')")
def hidden_tags(spark, base):
    hidden = F.array(F.lit("1-URGENT"), F.lit("5-LOW"))
    return in_range(listings(Tables(spark, base))).where(F.exists(F.array("tag"), lambda x: ~F.array_contains(hidden, x))).select("event_id", "tag")


@query(f"""WITH {LISTINGS_SQL} SELECT event_id, CAST(greatest(start_day, DATE '{ASOF}') AS VARCHAR) AS shown, start_day < DATE '{ASOF}' AS running,
 row_number() OVER (PARTITION BY greatest(start_day, DATE '{ASOF}') ORDER BY start_day < DATE '{ASOF}', price, event_id) AS place FROM listing WHERE {RANGE}""")
def day_order(spark, base):
    """Listings by the first visible day; what is still running comes after what starts then."""
    asof = F.lit(ASOF).cast("date")
    rows = in_range(listings(Tables(spark, base))).select("event_id", F.greatest("start_day", asof).alias("day"), (F.col("start_day") < asof).alias("running"), "price")
    place = F.row_number().over(Window.partitionBy("day").orderBy("running", "price", "event_id"))
    return rows.select("event_id", F.col("day").cast("string").alias("shown"), "running", place.cast("long").alias("place"))


@query(f"""WITH {LISTINGS_SQL}, b AS (SELECT DATE '{ASOF}' AS d), w AS (SELECT d + CAST((12 - isodow(d)) % 7 AS INT) AS friday, d FROM b)
SELECT 'today' AS span, count(*) FILTER (WHERE start_day <= d AND coalesce(end_day, start_day) >= d) AS n FROM listing, b
UNION ALL SELECT 'week', count(*) FILTER (WHERE start_day <= d + 6 AND coalesce(end_day, start_day) >= d) FROM listing, b
UNION ALL SELECT 'weekend', count(*) FILTER (WHERE start_day <= friday + 2 AND coalesce(end_day, start_day) >= greatest(friday, d)) FROM listing, w
UNION ALL SELECT 'all', count(*) FILTER (WHERE coalesce(end_day, start_day) >= d) FROM listing, b""")
def range_bounds(spark, base):
    """How many listings each named span of days has, in one pass."""
    d = F.lit(ASOF).cast("date")
    friday = F.date_add(d, (12 - (F.weekday(d) + 1)) % 7)
    spans = {"today": (d, d), "week": (d, F.date_add(d, 6)), "weekend": (F.greatest(friday, d), F.date_add(friday, 2)), "all": (d, F.lit("9999-12-31").cast("date"))}
    one = listings(Tables(spark, base)).agg(*(F.count_if((F.col("start_day") <= b) & (last_day() >= a)).alias(k) for k, (a, b) in spans.items()))
    return one.unpivot([], list(spans), "span", "n")


@query(f"WITH {LISTINGS_SQL} SELECT town, count(*) AS events, count(DISTINCT site) AS sites, round(sum(price), 2) AS total, count(*) FILTER (WHERE end_day IS NOT NULL) AS runs FROM listing WHERE {UP} GROUP BY town")
def load_summary(spark, base):
    rows = upcoming(listings(Tables(spark, base)))
    return rows.groupBy("town").agg(F.count("*").alias("events"), F.countDistinct("site").alias("sites"), F.round(F.sum("price"), 2).alias("total"), F.count("end_day").alias("runs"))


@query(f"WITH {LISTINGS_SQL} SELECT count(*) AS events, count(*) FILTER (WHERE {UP}) AS upcoming, count(DISTINCT tag) AS kinds, count(*) FILTER (WHERE {UP} AND town IS NOT NULL) AS located, count(*) FILTER (WHERE start_day = DATE '{ASOF}') AS today FROM listing")
def snapshot(spark, base):
    up = last_day() >= F.lit(ASOF).cast("date")
    return listings(Tables(spark, base)).agg(F.count("*").alias("events"), F.count_if(up).alias("upcoming"), F.countDistinct("tag").alias("kinds"), F.count_if(up & F.col("town").isNotNull()).alias("located"), F.count_if(F.col("start_day") == F.lit(ASOF).cast("date")).alias("today"))


@query(f"""WITH {LISTINGS_SQL} SELECT event_id, town,
 CASE WHEN town IN ('NATION_1', 'FRANCE', 'GERMANY') THEN true WHEN town IS NULL THEN site % 2 = 0 ELSE false END AS shown FROM listing WHERE {UP}""")
def shown_country(spark, base):
    """Known home places are shown; unknown ones only when a source of home vouches for them."""
    home = F.col("town").isin("NATION_1", "FRANCE", "GERMANY")
    shown = F.when(home, True).when(F.col("town").isNull(), F.col("site") % 2 == 0).otherwise(False)
    return upcoming(listings(Tables(spark, base))).select("event_id", "town", shown.alias("shown"))


@query(f"""WITH {LISTINGS_SQL} SELECT a.event_id, b.event_id AS other, CAST(a.start_day AS VARCHAR) AS start_day FROM listing a JOIN listing b
 ON a.site = b.site AND a.event_id < b.event_id AND b.start_day BETWEEN a.start_day AND coalesce(a.end_day, a.start_day)""")
def agrees(spark, base):
    """Pairs of one site where the second starts within the first's run."""
    a, b = (listings(Tables(spark, base)).alias(k) for k in "ab")
    inside = F.col("b.start_day").between(F.col("a.start_day"), F.coalesce("a.end_day", "a.start_day"))
    return a.join(b, (F.col("a.site") == F.col("b.site")) & (F.col("a.event_id") < F.col("b.event_id")) & inside).select("a.event_id", F.col("b.event_id").alias("other"), F.col("a.start_day").cast("string").alias("start_day"))


@query("""WITH s AS (SELECT l_orderkey AS event_id, CAST(l_shipdate AS DATE) AS day, l_suppkey % 7 AS venue, 'venue ' || l_suppkey AS name, printf('%02d:00', CAST(10 + l_linenumber AS INT)) AS time FROM lineitem),
v AS (SELECT event_id, day, venue, min_by(name, length(name) * 1000000 + CAST(substr(name, 7) AS INT)) AS name, array_to_string(list_sort(list_distinct(list(time))), ',') AS times, count(DISTINCT time) AS n FROM s GROUP BY ALL),
d AS (SELECT event_id, day FROM v GROUP BY ALL HAVING count(*) > 1 OR max(n) > 1)
SELECT v.event_id, CAST(v.day AS VARCHAR) AS day, CAST(v.venue AS BIGINT) AS venue, v.name, v.times FROM v JOIN d USING (event_id, day)""")
def showings(spark, base):
    """Days with more than one venue or time: per venue its shortest name and its times."""
    t = Tables(spark, base)
    number = F.col("l_suppkey").cast("int")
    s = t.lineitem.select(F.col("l_orderkey").alias("event_id"), F.col("l_shipdate").cast("date").alias("day"), (F.col("l_suppkey") % 7).alias("venue"), F.concat(F.lit("venue "), F.col("l_suppkey").cast("string")).alias("name"), number.alias("number"), F.format_string("%02d:00", F.col("l_linenumber") + 10).alias("time"))
    v = s.groupBy("event_id", "day", "venue").agg(F.min_by("name", F.struct(F.length("name"), "number")).alias("name"), F.sort_array(F.collect_set("time")).alias("times"))
    day = Window.partitionBy("event_id", "day")
    kept = v.withColumn("venues", F.count("*").over(day)).withColumn("most", F.max(F.size("times")).over(day)).where("venues > 1 or most > 1")
    return kept.select("event_id", F.col("day").cast("string").alias("day"), "venue", "name", F.array_join("times", ",").alias("times"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type = 'purchase' AND value > 50")
def point_filter(spark, base):
    return Tables(spark, base).events.where((F.col("event_type") == "purchase") & (F.col("value") > 50)).select("event_id", "user_id", "event_type")
