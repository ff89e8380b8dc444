"""Statistics: coverage estimates, visit counters, usage roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.functions.scores import chao1, half_up, region_of
from harvestry.plans.registry import Tables, query
from harvestry.sources.tables import keep

LEAST = 8

SIGHTINGS_SQL = """
sight AS (SELECT l_partkey AS event_id, l_suppkey AS site, p_brand AS town, p_type AS tag FROM lineitem JOIN part ON l_partkey = p_partkey
          WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-03-01'),
ev AS (SELECT event_id, town, tag, count(DISTINCT site) AS n FROM sight GROUP BY ALL),
su AS (SELECT GROUPING(town) + 2 * GROUPING(tag) AS lvl, town, tag, count(*) AS events, count(*) FILTER (WHERE n = 1) AS once, count(*) FILTER (WHERE n = 2) AS twice,
       count(*) FILTER (WHERE n > 2) AS more FROM ev GROUP BY GROUPING SETS ((), (town), (tag), (town, tag))),
si AS (SELECT GROUPING(town) + 2 * GROUPING(tag) AS lvl, town, tag, count(DISTINCT site) AS sites FROM sight GROUP BY GROUPING SETS ((), (town), (tag), (town, tag))),
es AS (SELECT su.*, sites, greatest(events, floor(CASE WHEN twice > 0 THEN events + once * once / (2.0 * twice) ELSE events + once * (once - 1) / 2.0 END + 0.5)) AS est
       FROM su JOIN si ON su.lvl = si.lvl AND su.town IS NOT DISTINCT FROM si.town AND su.tag IS NOT DISTINCT FROM si.tag)
"""


def sightings(t: Tables) -> DataFrame:
    """event_id, site, town, tag from a span of shipments."""
    inside = (F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1996-03-01").cast("timestamp_ntz"))
    return t.lineitem.where(inside).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_partkey").alias("event_id"), F.col("l_suppkey").alias("site"), F.col("p_brand").alias("town"), F.col("p_type").alias("tag"))


def coverage_report(rows: DataFrame, min_events: int = LEAST) -> DataFrame:
    """Per grouping set ((), town, tag, town and tag): events seen once, twice and more often, sites, Chao's estimate and the coverage.

    An event in several kinds counts once in what is not by kind; estimates need min_events.
    """
    town, tag = F.col("town"), F.col("tag")
    seen = keep(rows.select("event_id", "town", "tag", "site").distinct(), "seen")  # the one pass over the sightings
    level = (F.grouping("town") + 2 * F.grouping("tag")).cast("long").alias("lvl")
    whole = F.grouping("town").cast("long") + 2

    def events(*more):
        return [F.count("*").alias("events"), F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"), F.count_if(F.col("n") > 2).alias("more"), *more]

    by_kind = seen.groupBy("event_id", "town", "tag").agg(F.count("*").alias("n")).groupingSets([[tag], [town, tag]], town, tag).agg(*events(level))
    in_all = seen.groupBy("event_id", "town").agg(F.countDistinct("site").alias("n")).groupingSets([[], [town]], town).agg(*events(whole.alias("lvl")))
    columns = ["lvl", "town", "tag", "events", "once", "twice", "more"]
    out = by_kind.select(*columns).unionByName(in_all.withColumn("tag", F.lit(None).cast("string")).select(*columns))
    sites = seen.groupingSets([[], [town], [tag], [town, tag]], town, tag).agg(level, F.countDistinct("site").alias("sites"))
    s = sites.select("lvl", F.col("town").alias("s_town"), F.col("tag").alias("s_tag"), "sites")
    out = out.join(s, (out.lvl == s.lvl) & out.town.eqNullSafe(s.s_town) & out.tag.eqNullSafe(s.s_tag)).select(out.lvl, "town", "tag", "events", "once", "twice", "more", "sites")
    estimate = F.greatest(F.col("events"), half_up(chao1(F.col("events"), F.col("once"), F.col("twice")))).cast("long")
    enough = F.col("events") >= min_events
    return out.withColumn("estimate", F.when(enough, estimate)).withColumn("coverage", F.round(F.col("events") / F.col("estimate"), 6))


@query(f"WITH {SIGHTINGS_SQL} SELECT lvl, town, tag, events, once, twice, more, sites, CAST(CASE WHEN events >= 8 THEN est END AS BIGINT) AS estimate, round(CASE WHEN events >= 8 THEN events / est END, 6) AS coverage FROM es")
def coverage(spark, base):
    return coverage_report(sightings(Tables(spark, base)))


@query("""WITH t AS (SELECT user_id, count(*) AS visits, count(*) FILTER (WHERE event_type <> 'error') AS ok, count(*) FILTER (WHERE event_type = 'error') AS errors,
 count(*) FILTER (WHERE event_type = 'purchase') AS with_events, round(sum(value), 4) AS total, max(ts) AS last FROM events GROUP BY user_id)
SELECT user_id, visits, ok, errors, with_events, total, CAST(epoch_us(last) AS BIGINT) AS last_us FROM t""")
def host_counters(spark, base):
    """Per host: visits by outcome, sums and the last visit."""
    kind = F.col("event_type")
    rows = Tables(spark, base).events.groupBy("user_id").agg(
        F.count("*").alias("visits"), F.count_if(kind != "error").alias("ok"), F.count_if(kind == "error").alias("errors"), F.count_if(kind == "purchase").alias("with_events"),
        F.round(F.sum("value"), 4).alias("total"), F.max("ts").alias("last"))
    return rows.withColumn("last_us", F.unix_micros(F.col("last").cast("timestamp"))).drop("last")


@query("""WITH t AS (SELECT c_nationkey AS host, count(*) FILTER (WHERE c_acctbal > 2000) AS home, count(*) FILTER (WHERE c_acctbal < -500) AS abroad FROM customer GROUP BY 1)
SELECT host, home, abroad, CASE WHEN home + abroad < 3 THEN NULL WHEN home / (home + abroad) < 0.15 THEN 'abroad' WHEN home / (home + abroad) > 0.85 THEN 'home' ELSE 'mixed' END AS verdict FROM t""")
def region_verdicts(spark, base):
    t = Tables(spark, base).customer.groupBy(F.col("c_nationkey").alias("host")).agg(F.count_if(F.col("c_acctbal") > 2000).alias("home"), F.count_if(F.col("c_acctbal") < -500).alias("abroad"))
    return t.withColumn("verdict", region_of(F.col("home"), F.col("abroad")))


@query("""SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS job, count(*) AS calls, round(sum(value), 4) AS cost, count(*) FILTER (WHERE value > 50) AS large,
 GROUPING(CAST(ts AS DATE)) * 2 + GROUPING(event_type) AS lvl FROM events GROUP BY ROLLUP (CAST(ts AS DATE), event_type)""")
def usage_rollup(spark, base):
    """Calls and costs by day and job, per day, and in all."""
    rows = Tables(spark, base).events.select(F.col("ts").cast("date").cast("string").alias("day"), F.col("event_type").alias("job"), "value")
    return rows.rollup("day", "job").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.count_if(F.col("value") > 50).alias("large"), (F.grouping("day") * 2 + F.grouping("job")).cast("long").alias("lvl"))


@query("SELECT event_type AS model, count(*) AS calls, round(sum(value), 4) AS cost, CAST(max_by(event_id, (ts, event_id)) AS BIGINT) AS last_call FROM events GROUP BY 1")
def usage_by_model(spark, base):
    return Tables(spark, base).events.groupBy(F.col("event_type").alias("model")).agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last_call"))


@query("""WITH h AS (SELECT user_id, count(*) AS visits FROM events GROUP BY 1), q AS (SELECT c_custkey AS user_id, count(*) AS queued FROM customer GROUP BY 1),
 p AS (SELECT l_suppkey AS user_id, count(*) AS pages FROM lineitem GROUP BY 1)
SELECT coalesce(h.user_id, q.user_id, p.user_id) AS host, coalesce(visits, 0) AS visits, coalesce(queued, 0) AS queued, coalesce(pages, 0) AS pages
FROM h FULL JOIN q ON h.user_id = q.user_id FULL JOIN p ON coalesce(h.user_id, q.user_id) = p.user_id""")
def domains_merge(spark, base):
    """Counters of three sources per host: a full outer merge as one grouped union, so each source shuffles once."""
    t = Tables(spark, base)
    each = [t.events.select(F.col("user_id").alias("host"), F.lit("visits").alias("k")), t.customer.select(F.col("c_custkey").alias("host"), F.lit("queued").alias("k")), t.lineitem.select(F.col("l_suppkey").alias("host"), F.lit("pages").alias("k"))]
    rows = each[0].unionByName(each[1]).unionByName(each[2])
    return rows.groupBy("host").agg(*(F.count_if(F.col("k") == k).alias(k) for k in ("visits", "queued", "pages")))


@query("""WITH r AS (SELECT l_orderkey AS url, count(*) AS n, avg(CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 0 END) AS timed, avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0 END) AS located, count(DISTINCT l_partkey) / count(*) AS titles FROM lineitem GROUP BY 1)
SELECT url, n, round(timed, 2) AS timed, round(located, 2) AS located, round(titles, 4) AS titles, CASE WHEN n < 2 THEN 'few rows' WHEN titles < 0.9 THEN 'same titles' WHEN timed = 0 THEN 'no times' WHEN located = 0 THEN 'no places' END AS trouble FROM r""")
def recipe_quality(spark, base):
    """Shares of filled fields among the rows of a page, and the first rule that they break."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    r = Tables(spark, base).lineitem.groupBy(F.col("l_orderkey").alias("url")).agg(F.count("*").alias("n"), share(F.col("l_discount") > 0.05).alias("timed"), share(F.col("l_tax") > 0.04).alias("located"), (F.countDistinct("l_partkey") / F.count("*")).alias("titles"))
    trouble = F.when(F.col("n") < 2, "few rows").when(F.col("titles") < 0.9, "same titles").when(F.col("timed") == 0, "no times").when(F.col("located") == 0, "no places")
    return r.select("url", "n", F.round("timed", 2).alias("timed"), F.round("located", 2).alias("located"), F.round("titles", 4).alias("titles"), trouble.alias("trouble"))


@query("""WITH e AS (SELECT DISTINCT p_brand AS key, p_type AS tag, p_name AS title FROM part), n AS (SELECT key, count(DISTINCT title) AS n FROM e GROUP BY 1), c AS (SELECT key, tag, count(DISTINCT title) AS c FROM e GROUP BY 1, 2)
SELECT key, tag, n, c FROM c JOIN n USING (key) WHERE n >= 3 AND c / n >= 0.1""")
def learned_rules(spark, base):
    """A rule per key and tag: enough distinct titles, and a large enough share of them with the tag."""
    e = Tables(spark, base).part.select(F.col("p_brand").alias("key"), F.col("p_type").alias("tag"), F.col("p_name").alias("title")).distinct()
    n, c = e.groupBy("key").agg(F.countDistinct("title").alias("n")), e.groupBy("key", "tag").agg(F.countDistinct("title").alias("c"))
    return c.join(n, "key").where("n >= 3 and c / n >= 0.1").select("key", "tag", "n", "c")


@query("SELECT s_nationkey AS town, CASE WHEN count(*) >= 2 AND max(c) / sum(c) >= 0.6 THEN max_by(city, (c, city)) END AS city, CAST(sum(c) AS BIGINT) AS votes FROM (SELECT s_nationkey, s_suppkey % 3 AS city, count(*) AS c FROM supplier GROUP BY 1, 2) GROUP BY 1")
def majority_city(spark, base):
    """The city that most of a site's events name, unless too few agree."""
    c = Tables(spark, base).supplier.groupBy(F.col("s_nationkey").alias("town"), (F.col("s_suppkey") % 3).alias("city")).agg(F.count("*").alias("c"))
    best = F.max_by("city", F.struct("c", "city"))
    return c.groupBy("town").agg(F.when((F.count("*") >= 2) & (F.max("c") / F.sum("c") >= 0.6), best).alias("city"), F.sum("c").alias("votes"))
