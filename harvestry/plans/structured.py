"""What sites say for machines: structured data in pages, in the ways that sites write it, and robots files."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.functions.robots import allowed, robots_groups
from harvestry.functions.structured import structured_events
from harvestry.plans.registry import Tables, query

#: Scripts of a page by its number: # stands for the number.
SCRIPTS = [
    ['{"@type": "MusicEvent", "name": "Night #", "startDate": "2031-05-05T19:00:00-05:00", "endDate": "2031-05-06", "description": "Loud", "location": {"@type": "Place", "name": "Hall #", "address": {"streetAddress": "Dock #", "addressLocality": "Brookton"}, "geo": {"latitude": "48.5", "longitude": 17}}}'],
    ['[{"@type": ["Thing", "Festival"], "name": "none"}, {"@type": ["Thing", "SocialEvent"], "name": "Fair #", "url": "/e/#", "location": "Old Mill"}]'],
    ['{"@graph": [{"@type": "WebSite"}, {"@type": "Event", "name": "Night #", "URL": "/u/#", "location": [{"@type": "VirtualLocation"}, {"@type": "Place", "name": "Hall #", "address": "Street #", "geo": {"latitude": 0, "longitude": 0}}]}]}'],
    ['{"@type": "EventSeries", "name": "Series #", "subEvent": [{"@type": "TheaterEvent", "name": "Part #", "startDate": "2031-06-01", "location": {"address": {"addressCountry": {"name": "Lundia"}}}, "subEvent": {"@type": "Event", "name": "Part of part #"}}]}'],
    ['{"@type": "Event", "name": ', '{"@type": "Event", "name": "Late #", "eventAttendanceMode": "https://schema.org/OnlineEventAttendanceMode"}'],
    ["5", "null", "[]", '{"name": "no type"}'],
]


@query("""WITH p AS (SELECT page_id AS n, page_id % 6 AS k FROM pages)
SELECT n AS page_id, 'Night ' || n AS title, '2031-05-05T19:00:00-05:00' AS start, 'Hall ' || n || ', Dock ' || n || ', Brookton' AS place, NULL AS url, CAST(48.5 AS DOUBLE) AS lat, CAST(17 AS DOUBLE) AS lon, 'abroad' AS country, false AS online FROM p WHERE k = 0
UNION ALL SELECT n, 'Fair ' || n, NULL, 'Online', '/e/' || n, NULL, NULL, NULL, true FROM p WHERE k = 1
UNION ALL SELECT n, 'Night ' || n, NULL, 'Hall ' || n || ', Street ' || n, '/u/' || n, NULL, NULL, NULL, false FROM p WHERE k = 2
UNION ALL SELECT n, 'Part ' || n, '2031-06-01', 'Online', NULL, NULL, NULL, 'Lundia', true FROM p WHERE k = 3
UNION ALL SELECT n, 'Part of part ' || n, NULL, NULL, NULL, NULL, NULL, NULL, false FROM p WHERE k = 3
UNION ALL SELECT n, 'Late ' || n, NULL, 'Online', NULL, NULL, NULL, NULL, true FROM p WHERE k = 4""")
def structured_rows(spark, base):
    """Events of structured data in pages: single, in arrays and graphs, nested, online, with broken scripts beside them."""
    scripts = F.array(*(F.lit("".join(f'<script type="application/ld+json">{s}</script>' for s in several)) for several in SCRIPTS))
    page = F.concat(F.col("html"), F.replace(F.get(scripts, (F.col("page_id") % len(SCRIPTS)).cast("int")), F.lit("#"), F.col("page_id").cast("string")))
    found = structured_events(Tables(spark, base).pages.select("page_id", page.alias("html")), "page_id", "html")
    return found.select("page_id", "title", "start", "place", "url", "lat", "lon", "country", "online")


#: A host's robots file, by how many letters it has (# stands for it): several agents in a group, rules inside rules, nothing
#: for a named agent, an empty rule, no file.
ROBOTS = [
    "# hello\nUser-agent: *\nDisallow: /\nAllow: /en\n", "User-agent: other\nUser-agent: *\nDisallow: /fr\nAllow: /fr/1\nDisallow: /fr/12\n\nSitemap: https://x.example/m.xml", "User-agent: *\nDisallow: /\n\nUser-agent: Harvester # us\nDisallow:\n",
    "User-agent: harvester\nUser-agent: other\nDisallow: /es\nDisallow: /de\nAllow: /es\n\nUser-agent: *\nDisallow: /\n", None,
]


@query(f"""WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_replace(url, '^https?://[^/]+', '') AS path FROM pages)
SELECT page_id, CASE length(host) % {len(ROBOTS)} WHEN 0 THEN starts_with(path, '/en') WHEN 1 THEN NOT starts_with(path, '/fr') OR (starts_with(path, '/fr/1') AND NOT starts_with(path, '/fr/12')) WHEN 3 THEN NOT starts_with(path, '/de') ELSE true END AS allowed FROM p""")
def robots_allowed(spark, base):
    """Whether each page may be fetched, by the longest rule of its host's group for us."""
    pages = Tables(spark, base).pages.select("page_id", F.regexp_extract("url", "^https?://([^/]+)", 1).alias("host"), F.regexp_replace("url", "^https?://[^/]+", "").alias("path"))
    files = pages.select("host").distinct().withColumn("text", F.get(F.array(*map(F.lit, ROBOTS)), F.length("host") % len(ROBOTS)))
    return allowed(pages, robots_groups(files), "Harvester").select("page_id", "allowed")
