"""Operators on the small invented tables of odd cases."""

from pyspark.sql import functions as F

from harvestry.functions import evidence, reading
from harvestry.plans.evidence import LUNDIA
from harvestry.plans.matching import best_matches, same_event_pairs, title_matches
from harvestry.plans.orders import read_sitemaps
from harvestry.plans.reading import CalendarRows
from tests import fixtures as X


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_site_maps(spark):
    """Children ranked, unlikely ones left, a loop and a missing file stood."""
    starts = spark.createDataFrame([("a", "https://a.example/sitemap.xml"), ("b", "https://b.example/map.xml"), ("c", "https://c.example/none.xml")], "site string, url string")
    want = [
        ("a", "https://a.example/e/1", "2031-02-01"), ("a", "https://a.example/e/2?x=1&y=2", "2031-03-01"), ("a", "https://a.example/p/1", None),
        ("a", "https://a.example/p/9", "2030-01-01"), ("b", "https://b.example/1", "2031-01-01"), ("b", "https://b.example/2", None),
    ]
    assert rows(read_sitemaps(X.SITEMAPS.frame(spark), starts).select("site", "loc", "lastmod")) == sorted(want, key=str)


def test_calendars(spark):
    spark.udtf.register("calendar_rows", CalendarRows)
    X.CALENDARS.frame(spark).createOrReplaceTempView("odd_calendars")
    got = spark.sql("SELECT page_id, title, start, end, place, href FROM odd_calendars, LATERAL calendar_rows(html, 'Europe/Berlin')")
    want = [
        (1, "Evening", "2031-07-01T19:00", "2031-07-01T21:30", "Old Mill, Dock street 4", "/e/1"), (1, "Fair", "2031-07-04", "2031-07-06", None, None),
        (1, "One day", "2031-07-08", None, "Old Mill", None), (2, "Late", "2031-01-15T22:00", "2031-01-16", None, None),
    ]
    assert rows(got) == sorted(want, key=str)


def test_stored_rows(spark):
    want = [
        (1, "Lantern night", "Old Mill, Brookton", "https://a.example/e/1"), (2, "Lantern night", "Hall Nine, Brookton", None), (3, "Reds – Blues", "Arena", None),
        (6, "Quiet — letters", None, None), (8, "1984", "Stage", "https://a.example/e/8"),
    ]
    assert rows(reading.repaired(X.STORED.frame(spark))) == sorted(want, key=str)


def test_evidence(spark):
    """Each listing is decided by another step; a row of nulls by none."""
    got = evidence.country_evidence(X.LISTED.frame(spark), X.GAZETTEER.frame(spark), X.SITES.frame(spark), X.VENUES.frame(spark), X.REGIONS.frame(spark), LUNDIA)
    steps = {r.id: (r.verdict, r.step) for r in got.collect()}
    assert steps[28] == (None, None) and steps[1] == ("home", "location") and steps[2] == ("abroad", "location") and steps[4] == ("abroad", "village")
    assert {s for _, s in steps.values() if s} >= {"village", "location", "page", "title code", "address", "site city", "domain", "text", "region"}


def test_sightings(spark):
    pairs = same_event_pairs(X.SIGHTINGS.frame(spark), X.TOWNS)
    said = {(r.a, r.b): r for r in pairs.collect()}
    assert said[1, 3].clash == "town" and said[9, 10].clash == "venue" and said[14, 15].score == 0 and said[1, 2].score > 0
    best = {r.id: r.best for r in best_matches(pairs).collect()}
    assert best[1] == 2 and best[2] == 1 and best[13] == 14 and best[16] == 17 and 15 not in best and 20 not in best


def test_a_run_without_an_end_has_few_buckets(spark):
    """An end that stands for none doesn't make a bucket for each week until then."""
    from datetime import date

    other = (None, None, None, None, False, [], None)
    known = [(1, "a", "Copper fair", date(2031, 6, 1), date(9999, 12, 31), *other), (2, "b", "Copper fair", date(2031, 6, 2), None, *other), (3, "c", "Copper fair", date(2031, 6, 30), None, *other)]
    got = same_event_pairs(spark.createDataFrame(known, X.SIGHTINGS.columns), [])
    assert {(r.a, r.b) for r in got.where(F.col("score") > 0).collect()} == {(1, 2)}


def test_titles_are_compared_once(spark):
    """More sightings of the same titles compare no more titles; the best match is the copy."""
    once = X.SIGHTINGS.frame(spark)
    twice = once.union(once.withColumn("id", F.col("id") + 100))
    assert title_matches(once, X.TOWNS, 6)[0].count() == title_matches(twice, X.TOWNS, 6)[0].count()
    best = best_matches(same_event_pairs(twice, X.TOWNS))
    assert {r.id: r.best for r in best.collect()}[4] == 104
