"""From pages to rows: titles, links, structured data, site maps, dates."""

from __future__ import annotations

import json
from datetime import date
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from harvestry.functions import dates as D
from harvestry.plans.registry import Tables, query

NOW = date(1998, 6, 1)


class Links(HTMLParser):
    """The anchors of a page in order: (href, text)."""

    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[list[str]] = []
        self._open = False
        self.feed(html)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a" and (href := dict(attrs).get("href")):
            self.found.append([href, ""])
            self._open = True

    def handle_endtag(self, tag: str) -> None:
        self._open = self._open and tag != "a"

    def handle_data(self, data: str) -> None:
        if self._open:
            self.found[-1][1] += data


@udtf(returnType="place int, href string, anchor string")
class ExtractLinks:
    """Distinct absolute links of a page, each with its first anchor text of at most 100 characters."""

    def eval(self, html: str, base: str):
        seen: dict[str, str] = {}
        for href, text in Links(html or "").found:
            full = urljoin(base or "", href).split("#")[0]
            seen.setdefault(full, " ".join(text.split())[:100])
        yield from ((i, h, t) for i, (h, t) in enumerate(seen.items()))


@udtf(returnType="name string, start string, end string, place string, url string, country string")
class JsonLdRows:
    """Rows of @type ...Event in a page's JSON-LD, through arrays, graphs and sub-events; broken scripts are skipped."""

    def eval(self, html: str):
        import re

        for script in re.findall(r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>", html or ""):
            try:
                todo = [json.loads(script)]
            except ValueError:
                continue
            while todo:
                x = todo.pop(0)
                if isinstance(x, list):
                    todo = x + todo
                elif isinstance(x, dict):
                    kinds = x.get("@type") or []
                    if any(str(k).endswith("Event") for k in ([kinds] if isinstance(kinds, str) else kinds)):
                        at = x.get("location") if isinstance(x.get("location"), dict) else {}
                        address = at.get("address") if isinstance(at.get("address"), dict) else {}
                        yield x.get("name"), x.get("startDate"), x.get("endDate"), at.get("name"), x.get("url"), address.get("addressCountry")
                    todo = [v for k in ("@graph", "subEvent") if (v := x.get(k))] + todo


def register(spark) -> None:
    """Make the table functions and the URL key known to SQL in this session."""
    spark.udtf.register("extract_links", ExtractLinks)
    spark.udtf.register("json_ld_rows", JsonLdRows)


@query("SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title, trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)) AS heading, len(regexp_extract_all(html, '<a href=\"')) AS links FROM pages")
def page_titles(spark, base):
    html = F.col("html")
    return Tables(spark, base).pages.select("page_id", F.trim(F.regexp_extract(html, "<title>([^<]*)</title>", 1)).alias("title"), F.trim(F.regexp_extract(html, "<h1>([^<]*)</h1>", 1)).alias("heading"), F.regexp_count(html, F.lit('<a href="')).cast("long").alias("links"))


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"#]*)', 1)) AS href FROM pages) SELECT page_id, count(DISTINCT href) AS links FROM l WHERE href LIKE '/%' GROUP BY 1""")
def link_counts(spark, base):
    """Distinct site-relative links per page, by expressions alone."""
    hrefs = Tables(spark, base).pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"#]*)'), F.lit(1))).alias("href"))
    return hrefs.where("href like '/%'").groupBy("page_id").agg(F.countDistinct("href").alias("links"))


@query(r"""WITH x AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+') AS origin, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 1) AS hs, regexp_extract_all(html, '<a href="([^"]*)"[^>]*>([^<]*)</a>', 2) AS ts FROM pages),
a AS (SELECT page_id, unnest(range(len(hs))) AS n, origin || unnest(hs) AS href, unnest(ts) AS anchor FROM x),
u AS (SELECT page_id, regexp_replace(href, '#.*$', '') AS href, min(n) AS n, arg_min(trim(regexp_replace(anchor, '\s+', ' ', 'g'))[1:100], n) AS anchor FROM a GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY n) - 1 AS INT) AS place, href, anchor FROM u""".replace("GROUP BY ALL", "GROUP BY page_id, 2"))
def page_links(spark, base):
    """Every page's links through the table function in SQL."""
    register(spark)
    Tables(spark, base).pages.createOrReplaceTempView("landed_pages")
    return spark.sql("SELECT page_id, place, href, anchor FROM landed_pages, LATERAL extract_links(html, url)")


@query("SELECT n_name || ' night' AS name, '1998-06-' || lpad(CAST(n_nationkey % 28 + 1 AS VARCHAR), 2, '0') AS \"start\", 'hall ' || n_nationkey AS place FROM nation")
def json_ld_rows(spark, base):
    """Structured data rendered into pages from nations, and read back."""
    register(spark)
    body = F.to_json(F.struct(F.lit("MusicEvent").alias("@type"), F.concat("n_name", F.lit(" night")).alias("name"), F.concat(F.lit("1998-06-"), F.lpad((F.col("n_nationkey") % 28 + 1).cast("string"), 2, "0")).alias("startDate"), F.struct(F.concat(F.lit("hall "), F.col("n_nationkey").cast("string")).alias("name")).alias("location")))
    html = F.concat(F.lit('<script type="application/ld+json">{"@graph": ['), body, F.lit(']}</script><script type="application/ld+json">{broken</script>'))
    Tables(spark, base).nation.select(html.alias("html")).createOrReplaceTempView("structured_pages")
    return spark.sql("SELECT name, start, place FROM structured_pages, LATERAL json_ld_rows(html)")


@query("SELECT r_regionkey AS site, 'https://' || lower(r_name) || '.example/' || n_nationkey AS loc, CAST(DATE '1998-01-01' + CAST(n_nationkey AS INT) AS VARCHAR) AS lastmod FROM nation JOIN region ON n_regionkey = r_regionkey")
def sitemap_entries(spark, base):
    """Site maps rendered per region, and their entries read back with XPath."""
    t = Tables(spark, base)
    entry = F.concat(F.lit("<url><loc>https://"), F.lower("r_name"), F.lit(".example/"), F.col("n_nationkey").cast("string"), F.lit("</loc><lastmod>"), F.date_add(F.lit("1998-01-01").cast("date"), F.col("n_nationkey").cast("int")).cast("string"), F.lit("</lastmod></url>"))
    xml = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_regionkey").alias("site")).agg(F.concat(F.lit("<urlset>"), F.array_join(F.sort_array(F.collect_list(entry)), ""), F.lit("</urlset>")).alias("xml"))
    both = F.explode(F.arrays_zip(F.xpath("xml", F.lit("//url/loc/text()")).alias("loc"), F.xpath("xml", F.lit("//url/lastmod/text()")).alias("lastmod")))
    return xml.select("site", both.alias("e")).select("site", F.col("e.loc").alias("loc"), F.col("e.lastmod").alias("lastmod"))


#: How each order's day is written: by its key, one of six forms.
def written_dates(t: Tables):
    day = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey") % 6
    months = F.array(*(F.lit(D.MONTH_NAMES[m].split()[0]) for m in range(1, 13)))
    text = (
        F.when(k == 0, day.cast("string")).when(k == 1, F.date_format(day, "d.M.yyyy")).when(k == 2, F.concat(F.date_format(day, "dd. MM. yyyy"), F.lit(" o 19:30")))
        .when(k == 3, F.concat(F.date_format(day, "d. "), F.element_at(months, F.month(day)), F.date_format(day, " yyyy")))
        .when(k == 4, F.concat(F.date_format(day, "d.M.yyyy"), F.lit(" - "), F.date_format(F.date_add(day, 2), "d.M.yyyy"))).otherwise(F.concat(day.cast("string"), F.lit("T18:15")))
    )
    return t.orders.select("o_orderkey", text.alias("text"))


@query("""SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS start, CASE WHEN o_orderkey % 6 = 4 THEN CAST(CAST(o_orderdate AS DATE) + 2 AS VARCHAR) END AS "end",
 CASE o_orderkey % 6 WHEN 2 THEN '19:30' WHEN 5 THEN '18:15' END AS time FROM orders""")
def parsed_dates(spark, base):
    """Days written in six ways and read again; each distinct text is parsed once, then joined back."""
    rows = written_dates(Tables(spark, base))
    read = rows.select("text").distinct().withColumn("r", D.parse_column(F.col("text"), NOW))
    return rows.join(read, "text").select("o_orderkey", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("r.time").alias("time"))


#: Short names of months, as they stand between two dates.
SHORT = "jan feb mar apr maj jun jul aug sep okt nov dec".split()


def worded_dates(t: Tables):
    """Each order's day in one of eight wordier forms: ranges that borrow a year, offsets, half days, places, days ago."""
    first = F.col("o_orderdate").cast("date")
    last, k = F.date_add(first, 3), F.col("o_orderkey") % 8
    short = lambda d: F.concat(F.date_format(d, "d. "), F.element_at(F.array(*map(F.lit, SHORT)), F.month(d)))
    text = (
        F.when(k == 0, F.concat(F.date_format(first, "dd.MM"), F.lit(" - "), F.date_format(last, "dd.MM.yyyy"), F.lit(" 19:00"))).when(k == 1, F.concat(short(first), F.lit(" – "), short(last), F.date_format(last, " yyyy")))
        .when(k == 2, F.concat(first.cast("string"), F.lit("T10:00:00+01:00"))).when(k == 3, F.concat(F.date_format(first, "d.M.yyyy"), F.lit(" 7 pm")))
        .when(k == 4, F.concat(F.date_format(first, "d.M.yyyy"), F.lit(" 20:00 - Old Mill, 29. augusta 5"))).when(k == 5, F.concat(F.lit("pred "), (F.col("o_orderkey") % 50 + 1).cast("string"), F.lit(" dňami")))
        .when(k == 6, F.concat(F.date_format(first, "d. M."), F.lit(" - "), F.date_format(last, "d. M. yy"))).otherwise(F.concat(F.date_format(first, "dd. MM. yyyy"), F.lit(" | 19.00")))
    )
    return t.orders.select("o_orderkey", text.alias("text"))


@query("""WITH d AS (SELECT o_orderkey, o_orderkey % 8 AS k, CAST(o_orderdate AS DATE) AS d, CASE WHEN year(CAST(o_orderdate AS DATE) + 3) < 2000 THEN 100 ELSE 0 END AS century FROM orders)
SELECT o_orderkey, CAST(CASE k WHEN 5 THEN DATE '1998-06-01' - CAST(o_orderkey % 50 + 1 AS INT) WHEN 6 THEN CAST(d + INTERVAL 1 YEAR * century AS DATE) ELSE d END AS VARCHAR) AS start, CAST(CASE WHEN k IN (0, 1) THEN d + 3 WHEN k = 6 THEN CAST((d + 3) + INTERVAL 1 YEAR * century AS DATE) END AS VARCHAR) AS "end",
 CASE k WHEN 0 THEN '19:00' WHEN 2 THEN '10:00' WHEN 3 THEN '19:00' WHEN 4 THEN '20:00' WHEN 7 THEN '19:00' END AS time FROM d""")
def read_dates(spark, base):
    """Wordier days read again; each distinct text is parsed once, then joined back."""
    rows = worded_dates(Tables(spark, base))
    read = rows.select("text").distinct().withColumn("r", D.parse_column(F.col("text"), NOW))
    return rows.join(read, "text").select("o_orderkey", F.col("r.start").alias("start"), F.col("r.end").alias("end"), F.col("r.time").alias("time"))


@query("""SELECT CASE o_orderkey % 6 WHEN 0 THEN 'Y-N-N' WHEN 1 THEN 'N.N.Y' WHEN 2 THEN 'N. N. Y w N:N' WHEN 3 THEN 'N. M Y' WHEN 4 THEN 'N.N.Y - N.N.Y' ELSE 'Y-N-Nw N:N' END AS shape, count(*) AS uses FROM orders GROUP BY 1""")
def date_shapes(spark, base):
    return written_dates(Tables(spark, base)).groupBy(D.date_shape(F.col("text")).alias("shape")).agg(F.count("*").alias("uses"))
