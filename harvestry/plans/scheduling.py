"""What to read next and why: gates, due sources, siblings, waits, schedules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from harvestry.functions import urls as U
from harvestry.functions.text import fold, words
from harvestry.plans.listings import ASOF, LISTINGS_SQL, last_day, listings
from harvestry.plans.registry import Tables, query
from harvestry.plans.urls import PARTS_SQL


@query(f"WITH {LISTINGS_SQL} SELECT site, count(DISTINCT title || start_day) AS titles, count(DISTINCT title || start_day) >= 2 AS is_listing FROM listing WHERE coalesce(end_day, start_day) >= DATE '{ASOF}' GROUP BY site")
def is_listing(spark, base):
    """Sites with two or more different upcoming listings."""
    up = listings(Tables(spark, base)).where(last_day() >= F.lit(ASOF).cast("date"))
    n = F.countDistinct(F.concat("title", F.col("start_day").cast("string")))
    return up.groupBy("site").agg(n.alias("titles")).withColumn("is_listing", F.col("titles") >= 2)


@query(f"WITH {LISTINGS_SQL} SELECT event_id, start_day > DATE '{ASOF}' + 400 AS too_far, coalesce(end_day - start_day > 3, false) AS placeholder_end FROM listing")
def date_limits(spark, base):
    """Starts that are too far ahead, and ends that stand for none."""
    asof = F.lit(ASOF).cast("date")
    return listings(Tables(spark, base)).select("event_id", (F.col("start_day") > F.date_add(asof, 400)).alias("too_far"), F.coalesce(F.datediff("end_day", "start_day") > 3, F.lit(False)).alias("placeholder_end"))


@query(f"""WITH {LISTINGS_SQL}, k AS (SELECT *, coalesce(nullif(town, 'NATION_3'), CASE WHEN site % 2 = 0 THEN 'NATION_1' END) AS place FROM listing)
SELECT site, count(*) FILTER (WHERE place IN ('NATION_1', 'NATION_2')) AS home, count(*) FILTER (WHERE place NOT IN ('NATION_1', 'NATION_2')) AS abroad, count(*) FILTER (WHERE place IS NULL) AS unknown FROM k GROUP BY site""")
def home_only(spark, base):
    """A missing place is filled from a trusted site, then listings are tallied by where they are."""
    place = F.coalesce(F.nullif("town", F.lit("NATION_3")), F.when(F.col("site") % 2 == 0, "NATION_1"))
    rows = listings(Tables(spark, base)).withColumn("place", place)
    home = F.col("place").isin("NATION_1", "NATION_2")
    return rows.groupBy("site").agg(F.count_if(home).alias("home"), F.count_if(~home).alias("abroad"), F.count_if(F.col("place").isNull()).alias("unknown"))


@query(f"""WITH {PARTS_SQL}, own AS (SELECT DISTINCT coarse FROM named WHERE page_id % 50 = 0), like_ AS (SELECT coarse, count(DISTINCT url_key) AS n FROM named GROUP BY 1)
SELECT o.coarse, l.n, l.n >= 2 * (SELECT count(DISTINCT url_key) FROM named n WHERE n.coarse = o.coarse AND page_id % 50 = 0) + 3 AS partial FROM own o JOIN like_ l USING (coarse)""")
def partial_structured(spark, base):
    """Templates that have many more pages than those that gave rows."""
    url = F.col("url")
    p = Tables(spark, base).pages.select("page_id", U.coarse_pattern(url).alias("coarse"), U.url_key(url).alias("url_key"))
    all_ = p.groupBy("coarse").agg(F.countDistinct("url_key").alias("n"), F.countDistinct(F.when(F.col("page_id") % 50 == 0, F.col("url_key"))).alias("own"))
    return all_.where("own > 0").select("coarse", "n", (F.col("n") >= 2 * F.col("own") + 3).alias("partial"))


@query("""WITH r AS (SELECT l_suppkey AS host, l_linenumber AS depth, l_partkey AS recipe, sum(l_quantity) AS events FROM lineitem GROUP BY ALL),
 k AS (SELECT a.host, a.depth, a.recipe, b.recipe AS sibling, row_number() OVER (PARTITION BY a.host, a.depth, a.recipe ORDER BY b.events DESC, b.recipe) AS n FROM r a JOIN r b ON a.host = b.host AND a.depth = b.depth AND a.recipe <> b.recipe WHERE a.recipe < 3)
SELECT host, depth, recipe, sibling FROM k WHERE n <= 3""")
def sibling_recipes(spark, base):
    """For templates without rows, the three best recipes of the same host and depth: candidates are ranked once per host
    and depth, and no more than four of them can be among anyone's three."""
    r = Tables(spark, base).lineitem.groupBy(F.col("l_suppkey").alias("host"), F.col("l_linenumber").alias("depth"), F.col("l_partkey").alias("recipe")).agg(F.sum("l_quantity").alias("events"))
    w = Window.partitionBy("host", "depth").orderBy(F.desc("events"), "recipe")
    best = r.withColumn("n", F.row_number().over(w)).where("n <= 4").select("host", "depth", F.col("recipe").alias("sibling"), "n")
    need = r.where("recipe < 3").select("host", "depth", "recipe")
    met = need.join(best, ["host", "depth"]).where("recipe <> sibling")
    k = F.row_number().over(Window.partitionBy("host", "depth", "recipe").orderBy("n"))
    return met.withColumn("k", k).where("k <= 3").select("host", "depth", "recipe", "sibling")


@query("""WITH p AS (SELECT c_custkey AS site, c_nationkey AS kind, o_orderkey AS page, o_orderdate AS read FROM customer LEFT JOIN orders ON o_custkey = c_custkey),
 k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY read, page) AS n FROM p WHERE page IS NOT NULL AND read < TIMESTAMP '1999-01-01') SELECT site, page FROM k WHERE n <= 12""")
def due_pages(spark, base):
    """Of each due site the twelve pages that were read longest ago."""
    t = Tables(spark, base)
    p = t.customer.select(F.col("c_custkey").alias("site")).join(t.orders.select(F.col("o_custkey").alias("site"), F.col("o_orderkey").alias("page"), F.col("o_orderdate").alias("read")), "site")
    n = F.row_number().over(Window.partitionBy("site").orderBy("read", "page"))
    return p.where(F.col("read") < F.lit("1999-01-01").cast("timestamp_ntz")).withColumn("n", n).where("n <= 12").select("site", "page")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01' ORDER BY o_orderdate, o_orderkey LIMIT 15")
def verification_queue(spark, base):
    return Tables(spark, base).orders.where(F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz")).orderBy("o_orderdate", "o_orderkey").limit(15).select("o_orderkey")


@query("""SELECT o_orderkey, o_totalprice > 1000 AND o_orderstatus <> 'P' AND o_orderpriority <> '5-LOW' AND NOT coalesce(c_acctbal < 0, false) AND (c_mktsegment = 'MACHINERY' OR o_totalprice > 200000) AS worthy FROM orders JOIN customer ON o_custkey = c_custkey""")
def reading_gate(spark, base):
    """A page that deserves a model's reading: every gate is open, and it is of a kind or a size that pays."""
    t = Tables(spark, base)
    gates = [F.col("o_totalprice") > 1000, F.col("o_orderstatus") != "P", F.col("o_orderpriority") != "5-LOW", ~F.coalesce(F.col("c_acctbal") < 0, F.lit(False)), (F.col("c_mktsegment") == "MACHINERY") | (F.col("o_totalprice") > 200000)]
    worthy = gates[0]
    for g in gates[1:]:
        worthy = worthy & g
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", worthy.alias("worthy"))


@query("""WITH s AS (SELECT user_id, event_type <> 'purchase' AS fruitless, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
 m AS (SELECT user_id, max(island) AS island FROM s GROUP BY 1), r AS (SELECT s.user_id, count(*) FILTER (WHERE fruitless) AS run FROM s JOIN m USING (user_id, island) GROUP BY 1)
SELECT user_id, run, CAST(7 * power(2, least(run, 3)) AS BIGINT) AS wait_days FROM r""")
def search_waits(spark, base):
    """Fruitless searches since the last that found something, and the wait that follows."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    hit = F.col("event_type") == "purchase"
    s = Tables(spark, base).events.select("user_id", hit.alias("hit"), F.sum(hit.cast("int")).over(w).alias("island"))
    last = s.withColumn("last", F.max("island").over(Window.partitionBy("user_id"))).where("island = last")
    return last.groupBy("user_id").agg(F.count_if(~F.col("hit")).alias("run")).withColumn("wait_days", (7 * F.pow(F.lit(2.0), F.least("run", F.lit(3)))).cast("long"))


@query("SELECT n_nationkey AS host, count(*) AS sites, round(sum(c_acctbal), 2) AS total, max(c_custkey) AS newest FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def hosts_from_sources(spark, base):
    t = Tables(spark, base)
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("host")).agg(F.count("*").alias("sites"), F.round(F.sum("c_acctbal"), 2).alias("total"), F.max("c_custkey").alias("newest"))


@query("""SELECT l_orderkey AS e, CAST(CAST(l_shipdate AS DATE) + unnest(range(CAST(l_linenumber % 3 + 1 AS INT)))::INT AS VARCHAR) AS day, printf('%02d:30', CAST(10 + l_linenumber AS INT)) AS opens FROM lineitem""")
def schedule_days(spark, base):
    """A schedule's days one by one, each with its hour."""
    day = F.col("l_shipdate").cast("date")
    days = F.sequence(day, F.date_add(day, F.col("l_linenumber") % 3))
    return Tables(spark, base).lineitem.select(F.col("l_orderkey").alias("e"), F.explode(F.transform(days, lambda d: d.cast("string"))).alias("day"), F.format_string("%02d:30", F.col("l_linenumber") + 10).alias("opens"))


@query(r"""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS block, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents)
SELECT doc_id, place, md5(block) AS hash FROM b WHERE len(regexp_extract_all(block, '(the|der|la|el) ')) >= 2 AND len(regexp_extract_all(block, '[0-9]')) >= 2""")
def schedule_blocks(spark, base):
    """Blocks of a text that look like a schedule: enough of two kinds of tokens."""
    block = F.col("block")
    rows = Tables(spark, base).documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "block"))
    kept = rows.where((F.regexp_count(block, F.lit("(the|der|la|el) ")) >= 2) & (F.regexp_count(block, F.lit("[0-9]")) >= 2))
    return kept.select("doc_id", F.col("place").cast("long").alias("place"), F.md5(block.cast("binary")).alias("hash"))


@query("""WITH w AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ('red', 'blue', 'green'))) AS w FROM part)
SELECT p_partkey, list_sort(w) AS rest, len(w) = 0 AS only_town FROM w""")
def without_towns(spark, base):
    """Words of a title without those that name a town."""
    towns = F.array(*map(F.lit, ("red", "blue", "green")))
    rest = F.sort_array(F.array_distinct(F.array_except(words(fold(F.col("p_name"))), towns)))
    return Tables(spark, base).part.select("p_partkey", rest.alias("rest"), (F.size(rest) == 0).alias("only_town"))


@query("""SELECT event_id, CAST(ts AS VARCHAR)[1:16] AS written, CAST(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Europe/Bratislava') AS VARCHAR)[1:16] AS local FROM events""")
def local_times(spark, base):
    """Instants as local wall-clock time."""
    ts = F.col("ts").cast("timestamp_ntz")
    local = F.convert_timezone(F.lit("UTC"), F.lit("Europe/Bratislava"), ts)
    return Tables(spark, base).events.select("event_id", F.substring(ts.cast("string"), 1, 16).alias("written"), F.substring(local.cast("string"), 1, 16).alias("local"))
