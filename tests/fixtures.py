"""Small invented tables with the odd cases of some operators, as DataFrames."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession

#: SQL names of the types that fixtures use.
KINDS = {"int": "INTEGER", "long": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "array<string>": "VARCHAR[]"}


class Fixture:
    """Rows under columns "name kind, ..."."""

    def __init__(self, columns: str, rows: list[tuple]) -> None:
        self.columns, self.rows = columns, rows

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.columns)

    @property
    def sql(self) -> str:
        kinds = dict(x.split(" ") for x in self.columns.split(", "))
        rows = ", ".join("(" + ", ".join(f"CAST({literal(v)} AS {KINDS[k]})" for v, k in zip(r, kinds.values(), strict=True)) + ")" for r in self.rows)
        return f"(SELECT * FROM (VALUES {rows}) AS x({', '.join(f'"{c}"' for c in kinds)}))"


def literal(v: object) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, (bool, int, float)):
        return str(v).lower()
    if isinstance(v, (list, tuple)):
        return "[" + ", ".join(map(literal, v)) + "]"
    return "'" + str(v).replace("'", "''") + "'"


#: Towns of an invented country, folded.
TOWNS = ["brookton", "millford", "harrowdale", "eastmere"]

#: Sightings of events by several sites: spellings, runs, towns, times, screenings, matches and series.
SIGHTINGS = Fixture(
    "id long, site string, title string, start date, end date, time string, town string, city string, host_town string, screening boolean, venue array<string>, street string",
    [
        (1, "a", "Lanterns over Brookton", date(2031, 5, 3), None, "19:00", "brookton", None, None, False, [], None),
        (2, "b", "Lanterns Over Brookton (premiere)", date(2031, 5, 3), None, "19:30", None, None, "brookton", False, [], None),
        (3, "c", "Lanterns over Millford", date(2031, 5, 3), None, "19:00", "millford", None, None, False, [], None),
        (4, "a", "Velvet Orchestra plays Dvorak", date(2031, 5, 10), None, "18:00", "eastmere", None, None, False, [], None),
        (5, "d", "Velvet orchestra plays Dvořák", date(2031, 5, 12), None, None, None, "Eastmere", None, False, [], None),
        (6, "a", "Velvet Orchestra plays Dvorak", date(2031, 5, 12), None, "18:00", "eastmere", None, None, False, [], None),
        (7, "e", "Copper Fair", date(2031, 6, 1), date(2031, 6, 9), None, "harrowdale", None, None, False, [], None),
        (8, "f", "Copper Fair evening: String quartet", date(2031, 6, 4), None, "20:00", "harrowdale", None, None, False, [], None),
        (9, "g", "The Iron Harbour 2D ATMOS (ct)", date(2031, 6, 20), None, "17:30", "millford", None, None, True, ["tidal"], None),
        (10, "h", "Iron Harbour", date(2031, 6, 20), None, "17:40", "millford", None, None, True, ["orion"], "dock street 4"),
        (11, "i", "Iron Harbour 3D", date(2031, 6, 20), None, "17:30", "millford", None, None, True, ["tidal", "cinem"], None),
        (12, "h", "Iron Harbour", date(2031, 6, 20), None, "20:10", "millford", None, None, True, ["orion"], "dock street 4"),
        (13, "j", "HK Falcons vs. Brookton Bears", date(2031, 7, 2), None, "16:00", None, None, None, False, [], None),
        (14, "k", "Falcons vs Bears", date(2031, 7, 2), None, "16:30", None, None, None, False, [], None),
        (15, "k", "Falcons vs Otters", date(2031, 7, 2), None, "16:30", None, None, None, False, [], None),
        (16, "l", "Summer stage: Night of drums", date(2031, 7, 8), None, None, None, None, None, False, [], None),
        (17, "m", "Summer Stage: Night of Drums and bells", date(2031, 7, 8), None, "00:00", None, None, None, False, [], None),
        (18, "m", "Summer Stage: Quiet letters", date(2031, 7, 8), None, None, None, None, None, False, [], None),
        (19, "n", "Brookton", date(2031, 7, 9), None, None, None, None, None, False, [], None),
        (20, "o", None, date(2031, 7, 9), None, None, None, None, None, False, [], None),
    ],
)

#: Listings of an invented country, each with one kind of evidence more than those before it lack.
LISTED = Fixture(
    "id long, title string, description string, location string, via string, country string, page_country string, lat double, lon double",
    [
        (1, "Concert", None, "Old Mill, Brookton", "https://a.ld/list", None, "av", 60.0, 60.0),
        (2, "Concert", None, "Hall, Arvia", "https://a.ld/list", None, None, None, None),
        (3, "Concert", None, "Dolany", "https://b.example/list", None, None, None, None),
        (4, "Concert", None, "Dolany", "https://away.example/list", None, None, None, None),
        (5, "Concert", None, "Club 9", "https://b.example/list", None, "AV", 47.0, 18.0),
        (6, "Concert", None, "Club 9", "https://b.example/list", "av", None, 47.0, 18.0),
        (7, "Concert", None, "Club 9", "https://b.example/list", None, None, 10.0, 18.0),
        (8, "Concert", None, "Salo Vastra", "https://b.example/list", "ld", None, None, None),
        (9, "Concert", None, "Salo nameste", "https://b.example/list", "av", None, None, None),
        (10, "Bears (LD)", None, "Somewhere", "https://b.example/list", None, None, None, None),
        (11, "Bears - AV tour", None, "Somewhere", "https://b.example/list", None, None, None, None),
        (12, "Concert", None, "Somewhere", "https://b.example/arvia/lundia", None, None, None, None),
        (13, "Concert", None, None, "https://b.example/lundia/arvia", None, None, None, None),
        (14, "Concert", None, "Somewhere", "https://b.example/lundia/arvia", None, None, None, None),
        (15, "Concert", None, "Big stage", "https://town.example/list", None, None, None, None),
        (16, "Concert", None, "Big stage", "https://venue.example/list", None, None, None, None),
        (17, "Concert", None, None, "https://c.ld/list", None, None, None, None),
        (18, "Concert", None, None, "https://mixed.ld/list", None, None, None, None),
        (19, "Velo nera soŵ vasi", "elo nera", "Somewhere", "https://b.example/list", None, None, None, None),
        (20, "Velo jera", "ela nero syř ela", "Somewhere", "https://b.example/list", None, None, None, None),
        (21, "Velo jera", "ela nero syř ela", "Somewhere", "https://home.example/list", None, None, None, None),
        (22, "Join us for the day", "with the best of the town", "Somewhere", "https://b.example/list", None, None, None, None),
        (23, "Join us for the day", "with the best of Eastmere", "Somewhere", "https://b.example/list", None, None, None, None),
        (24, "Concert", None, "Rialto", "https://b.example/list", None, None, None, None),
        (25, "Concert", None, None, "https://home.example/list", None, None, None, None),
        (26, "Concert", None, "Somewhere", "https://b.example/list", None, None, None, None),
        (27, "Concert", None, "Rialto", "no address", None, None, None, None),
        (28, None, None, None, None, None, None, None, None),
        (29, "Join us for the day", "with the best of the town", None, "https://c.ld/list", None, None, None, None),
        (30, "Concert", None, "New Harrowdale Pier", "https://b.example/list", None, None, None, None),
    ],
)
GAZETTEER = Fixture(
    "name string, kind string",
    [("brookton", "town"), ("eastmere", "town"), ("harrowdale", "town"), ("new harrowdale", "foreign town"), ("dolany", "village"), ("vastra", "foreign town"), ("lundia", "home country"), ("arvia", "foreign country"), ("bolia", "foreign country")],
)
SITES = Fixture("host string, city string, venue_town string, judged string", [("town.example", "Brookton", None, None), ("venue.example", None, "Vastra", None), ("mixed.ld", None, None, "mixed"), ("a.ld", None, None, None)])
VENUES = Fixture("location string, lat double, lon double, precision string", [("rialto", 47.5, 18.5, "venue"), ("old mill, brookton", 10.0, 10.0, "venue")])
REGIONS = Fixture("host string, region string", [("away.example", "abroad"), ("home.example", "home"), ("mixed.ld", "home")])

_ENTRY = lambda kind, loc, day=None: f"<{kind}><loc>{loc}</loc>{f'<lastmod>{day}</lastmod>' if day else ''}</{kind}>"
#: Site map files: an index with children of every rank, a loop back, a child that is not there, CDATA and entities.
SITEMAPS = Fixture(
    "url string, xml string",
    [
        ("https://a.example/sitemap.xml", "<sitemapindex>" + "".join(_ENTRY("sitemap", f"https://a.example/{n}.xml", d) for n, d in (("tags", "2031-05-05"), ("posts-1", "2030-01-01"), ("posts-2", "2031-01-01"), ("posts-3", None), ("events", None))) + "</sitemapindex>"),
        ("https://a.example/events.xml", "<urlset>" + _ENTRY("url", "<![CDATA[https://a.example/e/1]]>", "2031-02-01") + _ENTRY("url", "https://a.example/e/2?x=1&amp;y=2", "2031-03-01") + "</urlset>"),
        ("https://a.example/posts-2.xml", "<urlset>" + _ENTRY("url", "https://a.example/p/1") + _ENTRY("sitemap", "https://a.example/sitemap.xml") + _ENTRY("sitemap", "https://a.example/missing-events.xml") + "</urlset>"),
        ("https://a.example/posts-1.xml", "<urlset>" + _ENTRY("url", "https://a.example/p/9", "2030-01-01") + "</urlset>"),
        ("https://a.example/posts-3.xml", "<urlset>" + _ENTRY("url", "https://a.example/p/never") + "</urlset>"),
        ("https://a.example/tags.xml", "<urlset>" + _ENTRY("url", "https://a.example/t/never") + "</urlset>"),
        ("https://b.example/map.xml", "<urlset>" + _ENTRY("url", "https://b.example/1", "2031-01-01") + _ENTRY("url", "https://b.example/2") + "</urlset>"),
    ],
)

_ITEM = lambda t, title, more="": f'<div class="eventon_list_event evo" data-time="{t}"><span class="evcal_event_title">{title}</span>{more}</div>'
#: Calendar pages of a plugin: timed, whole days, one day, a repeat, items without a start or a title.
CALENDARS = Fixture(
    "page_id int, html string",
    [
        (1, _ITEM("1940691600-1940700600", "Evening", '<em class="evo_location_name">Old Mill</em><em class="evo_location_address">Dock street 4</em><div class="evo_event_schema"><a href="/e/1">x</a></div>')
            + _ITEM("1940882400-1941141540", "Fair") + _ITEM("1941228000-1941314340", "One day", '<em class="evo_location_name">Old Mill</em><em class="evo_location_address">Old Mill</em>') + _ITEM("1940882400-1941141540", "Fair")),
        (2, _ITEM("1926277200-1926370740", "Late") + _ITEM("x-y", "No time") + _ITEM("0-5", "Zero") + _ITEM("1926277200", "") + '<div class="eventon_list_event">none</div>'),
        (3, None),
    ],
)
#: Stored rows of an older reading.
STORED = Fixture(
    "id int, title string, location string, url string, via string",
    [
        (1, "Lantern night20:30", "Miesto: Old Mill | Brookton", "https://a.example/e/1", "https://a.example/list"),
        (2, "Lantern night — concert, 5.5.2031 20:30, Hall Nine, Brookton.", "Brookton", "https://a.example/list", "https://www.a.example/list/"),
        (3, "Reds – Blues – 3:1", "Arena", "mailto:x@a.example", "https://a.example/list"),
        (4, "5. 5. 2031", "Arena", None, None),
        (5, "ZRUŠENÉ: Lantern night", None, None, None),
        (6, "Quiet — letters -", "TBA", "https://a.example/e/6.pdf", None),
        (7, None, None, None, None),
        (8, "1984", "Stage", "https://a.example/e/8", "https://a.example/list"),
    ],
)
