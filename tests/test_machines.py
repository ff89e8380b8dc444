"""Structured data, robots files, readings against good ones, and rests by timers, on odd rows."""

from datetime import datetime

from pyspark.sql import functions as F

from harvestry.functions.health import against_last_good
from harvestry.functions.robots import allowed, robots_groups
from harvestry.functions.structured import structured_events


def page(*scripts):
    return "<html>" + "".join(f'<script type="application/ld+json">{s}</script>' for s in scripts) + "</html>"


def test_structured_data(spark):
    deep = '{"@type": "Event", "name": "deep"}'
    for _ in range(4):
        deep = '{"@graph": [' + deep + "]}"
    pages = [
        (1, page('{"@type": "Event", "name": " A ", "location": {"name": "Hall", "address": "Street 1", "geo": {"latitude": "x", "longitude": 2}}}')), (2, page("{broken", '{"@type": "Event", "name": "B", "location": [{"@type": "VirtualLocation"}]}')),
        (3, page(deep)), (4, page('"Event"', '{"@type": 5}', '{"@type": null, "name": "x"}')), (5, None), (6, ""), (7, page('{"@type": "Event", "location": {"address": {"addressCountry": "LD", "addressLocality": ""}}}')),
        (8, page('{"@type": "Eventful"}', '{"subEvent": {"@type": ["X", "DanceEvent"], "name": "C"}}')),
    ]
    got = {(r.page_id, r.title): (r.place, r.lat, r.country, r.online) for r in structured_events(spark.createDataFrame(pages, "page_id long, html string"), "page_id", "html").collect()}
    assert got == {(1, "A"): ("Hall, Street 1", None, None, False), (2, "B"): ("Online", None, None, True), (3, "deep"): (None, None, None, False), (7, None): ("Online", None, "LD", True), (8, "C"): (None, None, None, False)}


def test_robots(spark):
    files = [
        ("a", "Disallow: /early\nUser-agent: *\nDisallow: /p # all\nAllow: /p/open\nDisallow: /p/open/not"), ("b", "USER-AGENT: Me\r\nuser-agent: other\r\nDisallow:\r\n\r\nUser-agent: *\r\nDisallow: /"),
        ("c", "User-agent: *\nDisallow: /x\nAllow: /x"), ("d", None), ("e", "User-agent: *"), ("f", "User-agent: *\nDisallow: /" + "y" * 300),
    ]
    urls = [("a", "/p"), ("a", "/p/open"), ("a", "/p/open/not/x"), ("a", "/early"), ("b", "/z"), ("c", "/x"), ("d", "/x"), ("e", "/x"), ("f", "/" + "y" * 300), ("f", "/" + "y" * 299), ("g", "/p"), ("a", None)]
    rules = robots_groups(spark.createDataFrame(files, "host string, text string"))
    got = {(r.host, r.path): r.allowed for r in allowed(spark.createDataFrame(urls, "host string, path string"), rules, "me").collect()}
    shut = {("a", "/p"), ("a", "/p/open/not/x"), ("f", "/" + "y" * 300)}
    assert got == {u: u not in shut for u in urls}
    other = {(r.host, r.path): r.allowed for r in allowed(spark.createDataFrame([("b", "/z")], "host string, path string"), rules, "someone").collect()}
    assert other == {("b", "/z"): False}


def test_good_is_what_was_good_before(spark):
    """A bad reading doesn't become the measure, however long it lasts; a better one does."""
    days = [(1, 10, 0.9), (2, 2, 0.9), (3, 2, 0.1), (4, 0, 0.0), (5, 9, 0.1), (6, 12, 0.9), (7, 11, 0.2)]
    rows = [("s", d, n, t, 1.0, 1.0, 1.0) for d, n, t in days] + [("t", 1, 0, 0.0, 0.0, 0.0, 0.0), ("t", 2, 3, 0.9, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "site string, day int, n long, timed double, located double, linked double, titles double")
    got = {(r.site, r.day): (r.trouble, r.good) for r in against_last_good(df, "site", "day", ["n", "timed", "located", "linked", "titles"]).collect()}
    assert got == {
        ("s", 1): (None, None), ("s", 2): ("fewer", 1), ("s", 3): ("fewer", 1), ("s", 4): ("none", 1), ("s", 5): ("timed", 1), ("s", 6): (None, 1), ("s", 7): ("timed", 6), ("t", 1): (None, None), ("t", 2): (None, None),
    }


def test_rests_end_by_their_timers(spark, tmp_path):
    """Over several batches: a trouble inside a rest prolongs nothing, and an open rest isn't given out."""
    from harvestry.streaming.rests import REST_MS, ended_rests

    hour = 3600 * 1000
    batches = [[(1, 0, "error"), (1, 5, "error"), (2, 1, "visit")], [(1, 20, "error"), (2, 21, "error")], [(3, 60, "error"), (2, 61, "visit")]]
    for i, batch in enumerate(batches):
        rows = [(u, datetime.fromtimestamp(3_600_000 + h * 3600), k) for u, h, k in batch]
        spark.createDataFrame(rows, "user_id long, ts timestamp, event_type string").coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    stream = spark.readStream.schema("user_id long, ts timestamp, event_type string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = sorted((r.user_id, r.start_ms // hour, (r.end_ms - r.start_ms) == REST_MS, r.troubles) for r in ended_rests(spark, stream).collect())
    first = got[0][1]
    assert [(u, s - first, e, n) for u, s, e, n in got] == [(1, 0, True, 2), (1, 20, True, 1), (2, 21, True, 1)]


def test_shares_of_nothing(spark):
    empty = spark.createDataFrame([], "site string, day int, n long, timed double, located double, linked double, titles double")
    assert against_last_good(empty, "site", "day", ["n", "timed", "located", "linked", "titles"]).where(F.col("trouble").isNotNull()).count() == 0
