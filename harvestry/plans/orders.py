"""Work lists by their orders: date formats, sites to judge, site maps and their pages, harvested links, the frontier.

Each limit is the feature. Ties end with a key, so every list is the same on any cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from harvestry.plans.details import _draw_sql, draw
from harvestry.plans.registry import Tables, query
from harvestry.sources.tables import keep

#: Most of each list.
FORMATS, JUDGED, MAPS, LINKS, PER_PAGE, PER_SITE, FRONTIER = 12, 100, 4, 100, 80, 150, 5000
#: Site map files that are read of a site, and children that an index opens.
FILES, CHILDREN = 6, 3


def best_per(df: DataFrame, key: str, order: list[Column], most: int) -> DataFrame:
    """The first `most` rows of each key; a limit inside the window keeps a large key from being sorted whole."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= most).drop("place")


def due_formats(formats: DataFrame, most: int = FORMATS) -> DataFrame:
    """Date formats (shape, status, unsure, uses) to look at: new ones first, then the unsure, then the most used."""
    return formats.orderBy(F.desc(F.col("status") == "new"), F.desc("unsure"), F.desc("uses"), "shape").limit(most)


_FORMATS = "SELECT strftime(l_shipdate, '%m-%d') AS shape, CASE WHEN max(l_linenumber) < 7 THEN 'new' ELSE 'ok' END AS status, count(*) FILTER (WHERE l_returnflag = 'R') AS unsure, count(*) AS uses FROM lineitem GROUP BY 1"


@query(f"SELECT shape, status, unsure, uses FROM ({_FORMATS}) ORDER BY status = 'new' DESC, unsure DESC, uses DESC, shape LIMIT {FORMATS}")
def formats_due(spark, base):
    status = F.when(F.max("l_linenumber") < 7, "new").otherwise("ok")
    formats = Tables(spark, base).lineitem.groupBy(F.date_format("l_shipdate", "MM-dd").alias("shape")).agg(status.alias("status"), F.count_if(F.col("l_returnflag") == "R").alias("unsure"), F.count("*").alias("uses"))
    return due_formats(formats)


def sites_to_judge(sites: DataFrame, most: int = JUDGED) -> DataFrame:
    """Sites (site, judged_at, events): those never judged first, then those with most events."""
    return sites.orderBy(F.desc(F.col("judged_at").isNull()), F.desc("events"), "site").limit(most)


@query(f"""WITH s AS (SELECT c_custkey AS site, CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS BIGINT) END AS judged_at, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS events FROM customer)
SELECT site, judged_at, events FROM s ORDER BY judged_at IS NULL DESC, events DESC, site LIMIT {JUDGED}""")
def judging_queue(spark, base):
    t = Tables(spark, base)
    events = t.orders.groupBy(F.col("o_custkey").alias("site")).agg(F.count("*").alias("events"))
    sites = t.customer.select(F.col("c_custkey").alias("site"), F.when(F.col("c_acctbal") > 0, F.round("c_acctbal").cast("long")).alias("judged_at")).join(events, "site", "left")
    return sites_to_judge(sites.withColumn("events", F.coalesce("events", F.lit(0))))


@query(f"SELECT s_suppkey AS origin, s_acctbal AS priority FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT {MAPS}")
def sitemaps_due(spark, base):
    """The site maps of highest priority among those that are due."""
    return Tables(spark, base).supplier.where("s_acctbal > 0").orderBy(F.desc("s_acctbal"), "s_suppkey").limit(MAPS).select(F.col("s_suppkey").alias("origin"), F.col("s_acctbal").alias("priority"))


def link_score(url: Column, anchor: Column) -> Column:
    """An integer score of a link from words in its address and anchor, its depth and its query."""
    term = lambda condition, n: F.when(condition, n).otherwise(0)
    path = F.regexp_extract(url, r"^(?:https?://[^/?#]*)?([^?#]*)", 1)
    return (F.lit(1) + term(F.lower(F.concat_ws(" ", url, anchor)).rlike("event|program|festival|concert|ticket|news"), 3) + term(F.size(F.split(path, "/")) > 5, -1)
            + term(F.length(F.regexp_extract(url, r"\?([^#]*)", 1)) > 60, -1) + term(path.rlike("archiv"), -2)).cast("long")


_LINKS = r"""x AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"#]+)[^>]*>([^<]*)</a>', 1) AS hs, regexp_extract_all(html, '<a href="([^"#]+)[^>]*>([^<]*)</a>', 2) AS ts FROM pages),
a AS (SELECT page_id, unnest(range(len(hs))) AS place, unnest(hs) AS href, unnest(ts) AS anchor FROM x), u AS (SELECT page_id, href, min(place) AS place, arg_min(anchor, place) AS anchor FROM a GROUP BY 1, 2),
p AS (SELECT *, regexp_extract(href, '^(?:https?://[^/?#]*)?([^?#]*)', 1) AS path FROM u),
k AS (SELECT page_id, href, place, CAST(1 + CASE WHEN regexp_matches(lower(href || ' ' || anchor), 'event|program|festival|concert|ticket|news') THEN 3 ELSE 0 END - CASE WHEN len(string_split(path, '/')) > 5 THEN 1 ELSE 0 END - CASE WHEN length(regexp_extract(href, '\?([^#]*)', 1)) > 60 THEN 1 ELSE 0 END - CASE WHEN regexp_matches(path, 'archiv') THEN 2 ELSE 0 END AS BIGINT) AS score FROM p)"""


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, href, place, anchor: distinct links of a page (page_id, html), each with its first anchor."""
    pattern = F.lit(r'<a href="([^"#]+)[^>]*>([^<]*)</a>')
    both = F.arrays_zip(F.regexp_extract_all("html", pattern, F.lit(1)).alias("href"), F.regexp_extract_all("html", pattern, F.lit(2)).alias("anchor"))
    rows = pages.select("page_id", F.posexplode(both).alias("place", "l")).select("page_id", "place", "l.href", "l.anchor")
    return rows.groupBy("page_id", "href").agg(F.min("place").cast("long").alias("place"), F.min_by("anchor", "place").alias("anchor"))


@query(f"WITH {_LINKS} SELECT page_id, href, score FROM k QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, place) <= {PER_PAGE}")
def harvested_links(spark, base):
    """Of each page the eighty best links, those of one score in the page's order."""
    links = page_links(Tables(spark, base).pages).withColumn("score", link_score(F.col("href"), F.col("anchor")))
    return best_per(links, "page_id", [F.desc("score"), F.col("place")], PER_PAGE).select("page_id", "href", "score")


@query(f"WITH {_LINKS}, b AS (SELECT href, max(score) AS score FROM k GROUP BY 1) SELECT href, score FROM b ORDER BY score DESC, href LIMIT {LINKS}")
def links_to_read(spark, base):
    """The hundred best links of all pages."""
    links = page_links(Tables(spark, base).pages).select("href", link_score(F.col("href"), F.col("anchor")).alias("score"))
    return links.groupBy("href").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "href").limit(LINKS)


@query(f"SELECT l_suppkey AS site, l_orderkey AS page, l_linenumber AS n FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) <= {PER_SITE}")
def sitemap_pages(spark, base):
    """Of each site the hundred and fifty newest pages."""
    newest = best_per(Tables(spark, base).lineitem, "l_suppkey", [F.desc("l_shipdate"), F.col("l_orderkey"), F.col("l_linenumber")], PER_SITE)
    return newest.select(F.col("l_suppkey").alias("site"), F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"))


_EFFECTIVE = "o_totalprice / 10000 + CASE o_orderpriority WHEN '1-URGENT' THEN 8 WHEN '2-HIGH' THEN 4 WHEN '5-LOW' THEN -6 ELSE 0 END"


def _effective() -> Column:
    p = F.col("o_orderpriority")
    return F.col("o_totalprice") / 10000 + F.when(p == "1-URGENT", 8).when(p == "2-HIGH", 4).when(p == "5-LOW", -6).otherwise(0)


@query(f"SELECT o_orderkey FROM orders ORDER BY {_EFFECTIVE} DESC, o_orderkey LIMIT {FRONTIER}")
def frontier_trim(spark, base):
    """What stays of a frontier that has grown too long: the best by score and learned bonus."""
    return Tables(spark, base).orders.orderBy(F.desc(_effective()), "o_orderkey").limit(FRONTIER).select("o_orderkey")


@query(f"SELECT o_orderkey FROM orders ORDER BY {_EFFECTIVE} + 4 * {_draw_sql('o_orderkey', 11)} DESC, o_orderkey LIMIT 1")
def frontier_next(spark, base):
    """The next page: the best by score, learned bonus and a draw of up to four. A top-k by all three needs no bound to prune by."""
    return Tables(spark, base).orders.orderBy(F.desc(_effective() + 4 * draw("o_orderkey", 11)), "o_orderkey").limit(1).select("o_orderkey")


#: Pages whose entries one rendered site map file holds, by their numbers.
PAGES_OF_A_FILE = 1000


def sitemap_rows(files: DataFrame) -> DataFrame:
    """url, kind ('sitemap' or 'url'), loc, lastmod of the entries of site map files (url, xml), CDATA and entities read."""
    entry = r"(?s)<(sitemap|url)>(.*?)</(?:sitemap|url)>"
    both = F.arrays_zip(F.regexp_extract_all("xml", F.lit(entry), F.lit(1)).alias("kind"), F.regexp_extract_all("xml", F.lit(entry), F.lit(2)).alias("body"))
    rows = files.select("url", F.explode(both).alias("e")).select("url", "e.kind", "e.body")
    inner = lambda tag: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("body", rf"(?s)<{tag}>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</{tag}>", 1), "&amp;", "&"), r"\s+", " "))
    return rows.select("url", "kind", inner("loc").alias("loc"), F.nullif(inner("lastmod"), F.lit("")).alias("lastmod"))


def name_score(loc: Column) -> Column:
    """How likely a child of an index lists events, by its name; below 1 it is not opened."""
    name = F.lower(F.element_at(F.split(loc, "/"), -1))
    return F.when(name.rlike("event|program"), 3).when(name.rlike("post|page"), 1).when(name.rlike("image|video|tag"), -1).otherwise(1)


def read_sitemaps(files: DataFrame, starts: DataFrame, files_most: int = FILES, children: int = CHILDREN, pages: int = PER_SITE) -> DataFrame:
    """site, loc, lastmod: the newest pages that each site's maps list, through indexes.

    files: url, xml. starts: site, url. Level by level an index opens its best `children` by name and date (those that say
    nothing of events last, unlikely ones never), until `files_most` files of a site are read. A file is read once; one that
    is not there has no entries. Levels end when nothing new is opened, after `files_most` at the latest.
    """
    entries = keep(sitemap_rows(files), "entries")
    opened = keep(best_per(starts.select("site", "url").distinct(), "site", [F.col("url")], files_most), "opened")
    fresh = opened
    for _ in range(files_most - 1):
        listed = fresh.join(entries.where("kind = 'sitemap'"), "url").withColumn("score", name_score(F.col("loc"))).where("score >= 1")
        order = [F.desc("score"), F.desc_nulls_last("lastmod"), F.col("loc")]
        picked = listed.withColumn("place", F.row_number().over(Window.partitionBy("site", "url").orderBy(*order))).where(F.col("place") <= children)
        picked = picked.groupBy("site", F.col("loc").alias("url")).agg(F.max("score").alias("score"), F.max("lastmod").alias("lastmod")).join(opened, ["site", "url"], "left_anti")
        room = opened.groupBy("site").agg((files_most - F.count("*")).alias("room"))
        ranked = picked.join(room, "site").withColumn("place", F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), F.desc_nulls_last("lastmod"), "url")))
        fresh = keep(ranked.where("place <= room").select("site", "url"), "opened")
        if fresh.isEmpty():
            break
        opened = keep(opened.union(fresh), "opened")
    found = opened.join(entries.where("kind = 'url'"), "url").groupBy("site", "loc").agg(F.max("lastmod").alias("lastmod"))
    return best_per(found, "site", [F.desc_nulls_last("lastmod"), F.col("loc")], pages)


#: Per site of the pages: an index of four maps, of which the one of tags is never opened; days by the page's number.
_MAP_ROWS = "WITH m AS (SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS site, page_id, page_id % 4 AS map, 'https://' || regexp_extract(url, '^https?://([^/]+)', 1) || '/p/' || page_id || '?a=1&b=2' AS loc, CAST(DATE '2031-01-01' + CAST(page_id % 300 AS INT) AS VARCHAR) AS lastmod FROM pages)"
MAP_NAMES = ["posts-0", "posts-1", "events", "tags"]


@query(f"{_MAP_ROWS}, r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY lastmod DESC, loc) AS place FROM m WHERE map < 3) SELECT site, loc, lastmod FROM r WHERE place <= {PER_SITE}")
def sitemap_walk(spark, base):
    """The newest pages of each site through site maps that are rendered from the pages: an index, three maps, one unlikely."""
    site = F.regexp_extract("url", "^https?://([^/]+)", 1)
    root = F.concat(F.lit("https://"), F.col("site"))
    pages = Tables(spark, base).pages.select(site.alias("site"), "page_id", F.element_at(F.array(*map(F.lit, MAP_NAMES)), (F.col("page_id") % 4 + 1).cast("int")).alias("map"))
    day = F.date_add(F.lit("2031-01-01").cast("date"), (F.col("page_id") % 300).cast("int")).cast("string")
    entry = F.concat(F.lit("<url><loc><![CDATA["), root, F.lit("/p/"), F.col("page_id").cast("string"), F.lit("?a=1&amp;b=2]]></loc><lastmod>"), day, F.lit("</lastmod></url>"))
    # A map's text is made in parts of some pages, so no site's pages meet in one row: each part is a file of its own.
    part = F.floor(F.col("page_id") / PAGES_OF_A_FILE)
    name = F.concat(root, F.lit("/"), F.col("map"), F.lit("-"), F.col("part").cast("string"), F.lit(".xml"))
    maps = keep(pages.select("site", "map", part.alias("part"), entry.alias("entry")).groupBy("site", "map", "part").agg(F.concat(F.lit("<urlset>"), F.array_join(F.collect_list("entry"), ""), F.lit("</urlset>")).alias("xml")).select("site", name.alias("url"), "xml"), "maps")
    child = F.concat(F.lit("<sitemap><loc>"), F.col("url"), F.lit("</loc></sitemap>"))
    index = maps.groupBy("site").agg(F.concat(F.lit("<sitemapindex>"), F.array_join(F.collect_list(child), ""), F.lit("</sitemapindex>")).alias("xml")).select("site", F.concat(root, F.lit("/sitemap.xml")).alias("url"), "xml")
    files = keep(maps.select("url", "xml").union(index.select("url", "xml")), "files")
    most = maps.groupBy("site").count().agg(F.max("count")).first()[0] or 1
    return read_sitemaps(files, index.select("site", "url"), files_most=most + 1, children=most)
