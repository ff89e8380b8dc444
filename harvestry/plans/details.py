"""Smaller readings of listings: what has ended, facts written after a title, labelled places, countries in addresses."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from harvestry.functions.locations import clean_location, country_in_url, zone_country
from harvestry.functions.reading import with_title_facts
from harvestry.functions.text import clean
from harvestry.plans.registry import Tables, query

#: Minutes after its start at which a listing without an end time counts as over, and the minute that stands for now.
OVER_AFTER, NOW_MINUTE = 120, 20 * 60


@query(f"""WITH t AS (SELECT l_orderkey, l_linenumber, l_linenumber * 150 AS starts, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 150 + 90 END AS ends FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(ends, starts + {OVER_AFTER}) <= {NOW_MINUTE} AS ended FROM t""")
def ended_today(spark, base):
    """Over at a given minute: by the end time, else some time after the start."""
    starts = F.col("l_linenumber") * 150
    clock = lambda m: F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int"))
    minutes = lambda t: F.substring(t, 1, 2).cast("int") * 60 + F.substring(t, 4, 2).cast("int")
    rows = Tables(spark, base).lineitem.select("l_orderkey", "l_linenumber", clock(starts).alias("time"), F.when(F.col("l_linenumber") % 2 == 0, clock(starts + 90)).alias("end_time"))
    over = F.coalesce(minutes(F.col("end_time")), minutes(F.col("time")) + OVER_AFTER) <= NOW_MINUTE
    return rows.select("l_orderkey", "l_linenumber", over.alias("ended"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name ELSE p_name || ' — ' || p_type END AS title, CASE WHEN p_partkey % 3 > 0 THEN lower(p_type) END AS kind, CASE WHEN p_partkey % 3 > 0 THEN 'Hall, ' || p_brand END AS place FROM part")
def title_facts(spark, base):
    """A title taken apart where a date follows its kind; any other stays whole."""
    facts = F.concat(F.col("p_name"), F.lit(" — "), F.lower("p_type"), F.lit(", 20.11.2026 20:30, Hall, "), F.col("p_brand"), F.lit("."))
    line = F.when(F.col("p_partkey") % 3 > 0, facts).otherwise(F.concat_ws(" — ", "p_name", "p_type"))
    told = with_title_facts(Tables(spark, base).part.select("p_partkey", line.alias("line")), "line")
    return told.select("p_partkey", F.col("t_title").alias("title"), F.col("t_kind").alias("kind"), F.col("t_place").alias("place"))


@query("SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN '' WHEN 1 THEN 'Mill ' || s_suppkey || ', Brookton' WHEN 5 THEN 'Mill ' || s_suppkey ELSE 'Mill ' || s_suppkey || ', Brookton' END AS place FROM supplier")
def clean_locations(spark, base):
    """Places with labels, dates, times, prices and marks beside them, as six kinds of listings write them."""
    k = F.col("s_suppkey")
    mill = F.concat(F.lit("Mill "), k.cast("string"))
    raw = (
        F.when(k % 6 == 0, " TBD. ").when(k % 6 == 1, F.concat(F.lit("Dátum: 8.2.2031 and others Miesto: "), mill, F.lit(" | Brookton")))
        .when(k % 6 == 2, F.concat(F.lit("8. 2. 2031 19:15 · "), mill, F.lit(" – Brookton"))).when(k % 6 == 3, F.concat(F.lit("@ "), mill, F.lit(" ,Brookton • 12,50 EUR")))
        .when(k % 6 == 4, F.concat(F.lit("Where : "), mill, F.lit(" — Brookton /"))).otherwise(F.concat(mill, F.lit(" · When: later")))
    )
    return Tables(spark, base).supplier.select("s_suppkey", clean_location(raw).alias("place"))


@query("""WITH u AS (SELECT page_id, list_filter(list_transform(regexp_split_to_array(lower(url), '[^a-z]+'), lambda w: CASE WHEN w IN ('news', 'articles') THEN 'home' WHEN w IN ('blog', 'post', 'posts') THEN 'abroad' END), lambda x: x IS NOT NULL) AS named FROM pages)
SELECT page_id, named[1] AS country FROM u""")
def country_in_urls(spark, base):
    """Which country an address names; the one that comes first in it counts. Words of the pages' paths stand for names."""
    return Tables(spark, base).pages.select("page_id", country_in_url(F.col("url"), ["news", "articles"], ["blog", "post", "posts"]).alias("country"))


@query("""WITH s AS (SELECT event_id, CAST(event_id % 14 - 5 AS INT) AS z FROM events) SELECT event_id, CASE WHEN z < 0 OR z > 2 THEN 'abroad' END AS country FROM s""")
def zone_countries(spark, base):
    """A time zone west of Greenwich or more than two hours east of it is abroad; fourteen zones, and times without one."""
    z = (F.col("event_id") % 14 - 5).cast("int")
    sign = F.when(z < 0, "-").otherwise("+")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.when(z == 0, "Z").otherwise(F.concat(sign, F.lpad(F.abs(z).cast("string"), 2, "0"), F.lit(":00"))))
    return Tables(spark, base).events.select("event_id", zone_country(stamp).alias("country"))


@query("SELECT n_nationkey, n_name || ' & friends read' AS plain FROM nation")
def plain_text(spark, base):
    """Text of strings that hold markup, also where it is written as entities."""

    @F.pandas_udf(StringType())
    def unescape(texts: pd.Series) -> pd.Series:
        return texts.map(html.unescape, na_action="ignore")

    raw = F.concat(F.lit("&lt;b&gt;"), F.col("n_name"), F.lit("&lt;/b&gt; &amp;amp; friends<br>read"))
    once = F.regexp_replace(unescape(raw), "<[^>]*>", " ")
    return Tables(spark, base).nation.select("n_nationkey", clean(F.regexp_replace(unescape(once), "<[^>]*>", " ")).alias("plain"))


def draw(key: str, seed: int):
    """A number in (0, 1) from a key and a seed by a hash: the same draw on any cluster, after any retry."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 1) / float(1 << 48)


def _draw_sql(key: str, seed: int) -> str:
    return f"((('0x' || substr(md5('{seed}:' || {key}), 1, 12))::BIGINT::DOUBLE + 1) / {float(1 << 48)})"


@query(f"SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' ORDER BY {_draw_sql('o_orderkey', 7)}, o_orderkey LIMIT 12")
def unknown_sample(spark, base):
    """Twelve listings drawn with a seed: the draw is the feature."""
    return Tables(spark, base).orders.where("o_orderstatus = 'P'").orderBy(draw("o_orderkey", 7), "o_orderkey").limit(12).select("o_orderkey")


@query(f"""WITH c AS (SELECT c_nationkey, sum(c_acctbal) AS w FROM customer GROUP BY 1 HAVING sum(c_acctbal) > 0 ORDER BY w DESC, c_nationkey LIMIT 5)
SELECT c_nationkey FROM c ORDER BY -ln({_draw_sql('c_nationkey', 7)}) / w, c_nationkey LIMIT 1""")
def discovery_pick(spark, base):
    """One of the five best targets, drawn by weight with a seed."""
    c = Tables(spark, base).customer.groupBy("c_nationkey").agg(F.sum("c_acctbal").alias("w")).where("w > 0").orderBy(F.desc("w"), "c_nationkey").limit(5)
    return c.orderBy(-F.log(draw("c_nationkey", 7)) / F.col("w"), "c_nationkey").limit(1).select("c_nationkey")
