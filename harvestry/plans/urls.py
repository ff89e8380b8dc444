"""Queries over page addresses: identity, templates, counters per template."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.functions import urls as U
from harvestry.plans.registry import Tables, query

#: Parts of a URL and its key in SQL; the names are used by several counterparts below.
PARTS_SQL = r"""
parts AS (
  SELECT page_id, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) AS scheme,
         lower(regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)) AS host,
         regexp_extract(url, '^[A-Za-z]+://[^/?#:]*(?::[0-9]+)?([^?#]*)', 1) AS raw_path,
         list_filter(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&'), lambda p: p <> '') AS raw_params
  FROM pages
), clean AS (
  SELECT *, regexp_replace(host, '^www[.]', '') AS bare, CASE WHEN raw_path = '' THEN '/' ELSE raw_path END AS path,
         list_filter(raw_params, lambda p: NOT regexp_matches(regexp_extract(p, '^([^=]*)', 1), '^(?i)(utm_[0-9A-Za-z_]+|fbclid|gclid|dclid|msclkid|mc_cid|mc_eid|_ga|_gl|igshid|ref_src|yclid)$')) AS params
  FROM parts
), keyed AS (
  SELECT *, scheme || '://' || host || path || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END AS normalized,
         bare || CASE WHEN regexp_replace(path, '/+$', '') = '' THEN '/' ELSE regexp_replace(path, '/+$', '') END
           || CASE WHEN len(params) > 0 THEN '?' || array_to_string(list_sort(params), '&') ELSE '' END AS url_key,
         list_filter(string_split(path, '/'), lambda s: s <> '') AS segs
  FROM clean
), shaped AS (
  SELECT *, list_transform(segs[1:5], lambda s: CASE WHEN regexp_matches(s, '^[0-9]+$') THEN '#' WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}(-[0-9]{2})?$') THEN 'D'
           WHEN length(s) <= 24 AND regexp_matches(lower(s), '^[a-z_]+(-[a-z_]+)?([.](html?|php|aspx?))?$') THEN lower(s) ELSE '*' END) AS shapes,
         list_sort(list_distinct(list_transform(raw_params, lambda p: regexp_extract(p, '^([^=]*)', 1)))) AS names
  FROM keyed
), named AS (
  SELECT *, bare || '/' || array_to_string(CASE WHEN len(segs) > 5 THEN list_append(shapes, '…') ELSE shapes END, '/')
           || CASE WHEN len(names) > 0 THEN '?' || array_to_string(names, '&') ELSE '' END AS pattern,
         CASE WHEN len(segs) > 0 THEN bare || '/' || shapes[1] || '/…' || len(segs) ELSE bare || '/' END AS coarse
  FROM shaped
)
"""


@query(f"WITH {PARTS_SQL} SELECT page_id, normalized, url_key FROM named")
def url_identity(spark, base):
    t = Tables(spark, base)
    return t.pages.select("page_id", U.normalize_url(F.col("url")).alias("normalized"), U.url_key(F.col("url")).alias("url_key"))


@query(f"WITH {PARTS_SQL} SELECT page_id, host, pattern, coarse FROM named")
def url_templates(spark, base):
    url = F.col("url")
    return Tables(spark, base).pages.select("page_id", U.host(url).alias("host"), U.url_pattern(url).alias("pattern"), U.coarse_pattern(url).alias("coarse"))


@query(f"""WITH {PARTS_SQL}, labels AS (SELECT page_id, bare, string_split(bare, '.') AS l FROM named)
SELECT CASE WHEN regexp_matches(bare, '^[0-9.]+$') THEN bare
            WHEN regexp_matches(array_to_string(l[-2:], '.'), '^(co|com|net|org|gov|ac|edu)[.][a-z]{{2}}$') THEN array_to_string(l[-3:], '.')
            ELSE array_to_string(l[-2:], '.') END AS domain, count(*) AS pages, count(DISTINCT bare) AS hosts
FROM labels GROUP BY 1""")
def pages_by_domain(spark, base):
    url = F.col("url")
    rows = Tables(spark, base).pages.select(U.domain_of(U.bare_host(url)).alias("domain"), U.bare_host(url).alias("host"))
    return rows.groupBy("domain").agg(F.count("*").alias("pages"), F.countDistinct("host").alias("hosts"))


@query(f"""WITH {PARTS_SQL}, visits AS (
  SELECT unnest(list_distinct([pattern, coarse])) AS key, url, page_id, page_id % 4 AS events, CASE WHEN page_id % 4 > 1 THEN 1 ELSE 0 END AS added FROM named)
SELECT key, count(*) AS visits, count(*) FILTER (WHERE events > 0) AS with_events, CAST(sum(events) AS BIGINT) AS events, CAST(sum(added) AS BIGINT) AS added,
       max_by(url, page_id) AS example FROM visits GROUP BY key""")
def template_counters(spark, base):
    """Counters of the exact and the coarse template of each visit in one pass, with the latest page as an example."""
    url, events = F.col("url"), F.col("page_id") % 4
    visits = Tables(spark, base).pages.select(F.explode(F.array_distinct(F.array(U.url_pattern(url), U.coarse_pattern(url)))).alias("key"), "url", "page_id", events.alias("events"), (events > 1).cast("long").alias("added"))
    return visits.groupBy("key").agg(F.count("*").alias("visits"), F.count_if(F.col("events") > 0).alias("with_events"), F.sum("events").alias("events"), F.sum("added").alias("added"), F.max_by("url", "page_id").alias("example"))


@query(f"""WITH {PARTS_SQL}, s AS (
  SELECT coarse, count(*) AS visits, count(*) FILTER (WHERE page_id % 3 = 0) AS with_events, count(*) FILTER (WHERE page_id % 6 = 0) AS added FROM named GROUP BY coarse),
r AS (SELECT *, least(0.5, added / visits) AS new_rate FROM s),
g AS (SELECT *, least(7, floor(1 + 6 * with_events / visits + 0.5)) + CASE WHEN added > 0 THEN 1 ELSE 0 END AS good FROM r)
SELECT coarse, visits, CAST(CASE WHEN with_events = 0 THEN -least(6, 1 + visits // 3) WHEN visits >= 5 AND new_rate < 0.1 THEN least(1, good) ELSE good END AS BIGINT) AS score,
  CAST(CASE WHEN new_rate < 0.05 THEN 0 WHEN added >= 10 THEN 2 WHEN added > 0 OR with_events > 0 THEN 1 WHEN visits >= 6 THEN -least(5, 1 + visits // 8) ELSE 0 END AS BIGINT) AS bonus
FROM g""")
def template_scores(spark, base):
    from harvestry.functions.scores import host_bonus, yield_score

    rows = Tables(spark, base).pages.select(U.coarse_pattern(F.col("url")).alias("coarse"), "page_id")
    counts = rows.groupBy("coarse").agg(F.count("*").alias("visits"), F.count_if(F.col("page_id") % 3 == 0).alias("with_events"), F.count_if(F.col("page_id") % 6 == 0).alias("added"))
    c = {k: F.col(k) for k in ("visits", "with_events", "added")}
    rate = F.least(F.lit(0.5), c["added"] / c["visits"])
    return counts.select("coarse", "visits", yield_score(*c.values(), rate).alias("score"), host_bonus(c["added"], c["with_events"], c["visits"], rate).alias("bonus"))


@query(f"""WITH {PARTS_SQL}, seen AS (SELECT url_key, max(page_id) AS last, count(*) AS pages FROM named GROUP BY 1)
SELECT n.page_id, s.last AS last_page, s.pages FROM named n JOIN seen s USING (url_key)""")
def seen_page(spark, base):
    """Each page with the latest one of the same identity."""
    rows = Tables(spark, base).pages.select("page_id", U.url_key(F.col("url")).alias("url_key"))
    seen = rows.groupBy("url_key").agg(F.max("page_id").alias("last_page"), F.count("*").alias("pages"))
    return rows.join(seen, "url_key").select("page_id", "last_page", "pages")


@query(f"""WITH {PARTS_SQL}, visited AS (SELECT DISTINCT url_key FROM named WHERE page_id % 3 = 0)
SELECT page_id FROM named n WHERE NOT EXISTS (SELECT 1 FROM visited v WHERE v.url_key = n.url_key)""")
def unvisited_pages(spark, base):
    rows = Tables(spark, base).pages.select("page_id", U.url_key(F.col("url")).alias("url_key"))
    return rows.join(rows.where("page_id % 3 = 0").select("url_key").distinct(), "url_key", "left_anti").select("page_id")


@query(f"""WITH {PARTS_SQL}, scored AS (SELECT page_id, 1 + CASE WHEN regexp_matches(url, 'event|program|festival|koncert|ticket') THEN 3 ELSE 0 END
   + CASE WHEN regexp_matches(host, '[.]sk$') THEN 1 ELSE 0 END - CASE WHEN len(segs) > 4 THEN 1 ELSE 0 END - CASE WHEN regexp_matches(path, '/(news|blog|article|articles|forum)(/|$)') THEN 2 ELSE 0 END
   - CASE WHEN regexp_matches(path, 'archiv') THEN 2 ELSE 0 END AS score FROM named)
SELECT page_id, CAST(score AS BIGINT) AS score FROM scored""")
def link_scores(spark, base):
    """Priority of a link from its address alone: a sum of independent terms."""
    url = F.col("url")
    term = lambda condition, n: F.when(condition, n).otherwise(0)
    score = (
        F.lit(1) + term(url.rlike("event|program|festival|koncert|ticket"), 3) + term(U.host(url).endswith(".sk"), 1) + term(F.size(U.segments(url)) > 4, -1)
        + term(U.path(url).rlike("/(news|blog|article|articles|forum)(/|$)"), -2) + term(U.path(url).contains("archiv"), -2)
    )
    return Tables(spark, base).pages.select("page_id", score.cast("long").alias("score"))
