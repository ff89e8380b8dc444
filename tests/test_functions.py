"""Scalar functions: what they give for small inputs, and properties."""

from datetime import date

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from harvestry.functions import dates, scores, text, urls

NOW = date(2026, 11, 15)


@pytest.mark.parametrize(
    ("written", "want"),
    [
        ("2027-03-04", ("2027-03-04", None, None, None)),
        ("2027-03-04T18:30", ("2027-03-04", None, "18:30", None)),
        ("4. 3. 2027", ("2027-03-04", None, None, None)),
        ("4. 3.", ("2027-03-04", None, None, None)),
        ("1. 10.", ("2026-10-01", None, None, None)),
        ("3. decembra 2026 o 19:00", ("2026-12-03", None, "19:00", None)),
        ("9. - 11. 12. 2026", ("2026-12-09", "2026-12-11", None, None)),
        ("28. decembra - 3. januara", ("2026-12-28", "2027-01-03", None, None)),
        ("1.12.2026 10:00 - 3.12.2026 18:00", ("2026-12-01", "2026-12-03", "10:00", "18:00")),
        ("4.12.2026 22:00 - 5.12.2026 04:00", ("2026-12-04", None, "22:00", "04:00")),
        ("2.1.2027 - 31.12.9999", ("2027-01-02", None, None, None)),
        ("zajtra 20:00", ("2026-11-16", None, "20:00", None)),
        ("december 5, 2026 7 pm", ("2026-12-05", None, "19:00", None)),
        ("31. 11. 2026", None),
        ("no date here", None),
        (None, None),
    ],
)
def test_dates(written, want):
    got = dates.parse(written, NOW)
    assert (got and tuple(None if x is None else str(x) for x in got)) == want


@pytest.mark.parametrize(
    ("written", "want"),
    [
        ("07.12 - 12.12.2026 17:15", ("2026-12-07", "2026-12-12", "17:15", None)), ("7.12 - 2.02.27", ("2026-12-07", "2027-02-02", None, None)), ("1. 12. - 6. 12. 20.15 hod", ("2026-12-01", "2026-12-06", "20:15", None)),
        ("29. nov - 2. dec 2026", ("2026-11-29", "2026-12-02", None, None)), ("17. dec – 4. jan", ("2026-12-17", "2027-01-04", None, None)), ("4 March – 9 April, 2027 18:45", ("2027-03-04", "2027-04-09", None, None)[:2] + ("18:45", None)),
        ("st 2. 12. 9:30 – pi 4. 12. 16:00", ("2026-12-02", "2026-12-04", "09:30", "16:00")), ("2. – 4. decembra 2026", ("2026-12-02", "2026-12-04", None, None)), ("od 2.12.2026 09:00 do 4.12.2026 16:00", ("2026-12-02", "2026-12-04", "09:00", "16:00")),
        ("19.30 – 21.00 hod. 4.12.2026", ("2026-12-04", None, "19:30", "21:00")), ("4 prosinec Pá | 18.30", ("2026-12-04", None, "18:30", None)), ("utorok 8.12.2026 o 17.45", ("2026-12-08", None, "17:45", None)),
        ("4.12.2026 18:30 - Old Mill, 3. maja 12", ("2026-12-04", None, "18:30", None)), ("pred 3 dnami", ("2026-11-12", None, None, None)), ("o 2 tyzdne", ("2026-11-29", None, None, None)), ("in 4 days 20:15", ("2026-11-19", None, "20:15", None)),
        ("3 weeks ago", ("2026-10-25", None, None, None)), ("v stredu o 18.15", ("2026-11-18", None, "18:15", None)), ("stvrtok 31. 11. 18:00", None), ("pi 12. 6.", ("2026-06-12", None, None, None)), ("12.6. PI", ("2026-06-12", None, None, None)),
        ("12. 7. so zborom", ("2027-07-12", None, None, None)), ("stvrtok 10. decembrast10 18:00", ("2026-12-10", None, "18:00", None)), ("2026-12-04T22:45:00Z", ("2026-12-04", None, "23:45", None)), ("2026-07-04T23:10:00Z", ("2026-07-05", None, "01:10", None)[:2] + ("01:10", None)),
        ("2026-07-04T18:00:00+01:00", ("2026-07-04", None, "18:00", None)), ("2026-12-04T10:00:00-04:00", ("2026-12-04", None, "15:00", None)), ("4.12.2026 6:30 p.m. - 8 pm", ("2026-12-04", None, "18:30", "20:00")), ("4.12.2026 o 7 a spol", ("2026-12-04", None, None, None)),
        ("4.1.99999", ("2027-01-04", None, None, None)), ("2026-13-40", None), ("November 30, 2026 7 pm", ("2026-11-30", None, "19:00", None)), ("14 januara, 2027", ("2027-01-14", None, None, None)),
    ],
)
def test_dates_by_tokens(written, want):
    got = dates.parse(written, NOW)
    assert (got and tuple(None if x is None else str(x) for x in got)) == want


def test_a_weekday_that_fits_no_year():
    assert dates.reading("piatok, 18. november", NOW)[4] and not dates.reading("streda 18. november", NOW)[4]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="0123456789.:-–, |TZ+oapmjdecnvsutrkhi\n", max_size=40))
def test_dates_of_any_text(text):
    got = dates.reading(text, NOW)
    assert got is None or (got[1] is None or got[0] < got[1])


@settings(max_examples=200, deadline=None)
@given(st.dates(date(2020, 1, 1), date(2030, 12, 31)))
def test_dates_round_trip(day):
    for form in (day.isoformat(), f"{day.day}.{day.month}.{day.year}", f"{day.day}. {dates.MONTH_NAMES[day.month].split()[0]} {day.year}"):
        assert dates.parse(form, NOW)[0] == day


def column(spark, values, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "x string").select(f(F.col("x"))).collect()]


def test_url_key(spark):
    same = ["http://www.a.sk/x/?b=2&a=1", "https://a.sk/x?a=1&b=2#top", "https://a.sk/x/?utm_source=z&a=1&b=2", "https://a.sk:443/x;jsessionid=9?a=1&b=2"]
    assert set(column(spark, same, urls.url_key)) == {"a.sk/x?a=1&b=2"}
    assert column(spark, ["https://a.sk", "https://a.sk:8080/", "mailto:a@b.sk"], urls.url_key) == ["a.sk/", "a.sk:8080/", "mailto:a@b.sk"]
    keys = column(spark, same, urls.normalize_url)
    assert column(spark, keys, urls.normalize_url) == keys


def test_url_patterns(spark):
    got = column(spark, ["https://www.a.sk/akcie/1022-x-y-z/2026-11-02/77?p=1&a=2", "https://a.sk/1/2/3/4/5/6", "https://a.sk/"], urls.url_pattern)
    assert got == ["a.sk/akcie/*/D/#?a&p", "a.sk/#/#/#/#/#/…", "a.sk/"]
    assert column(spark, ["https://a.sk/sk/x/y", "https://a.sk/"], urls.coarse_pattern) == ["a.sk/sk/…3", "a.sk/"]
    assert column(spark, ["x.a.co.uk", "www.a.sk", "10.0.0.1"], urls.domain_of) == ["a.co.uk", "a.sk", "10.0.0.1"]


def test_titles(spark):
    assert column(spark, ["Film (CD)19:30", "7-8:30", "A  B - ", None], text.clean_title) == ["Film (CD)", "7-8:30", "A B", ""]
    assert column(spark, ["19.11.2026", "1970", "", "Jazz"], text.junk_title) == [True, False, True, False]
    assert column(spark, ["Ženský zbor a Čaj"], text.fold) == ["zensky zbor a caj"]
    assert column(spark, ["Workshop on 5 tanec tancov 2026"], text.title_stems) == [["works", "tanec", "tanco"]]


def test_scores(spark):
    df = spark.createDataFrame([(10, 4, 3), (10, 4, 0), (3, 3, 0)], "s long, a long, b long")
    assert [r[0] for r in df.select(scores.chao1(F.col("s"), F.col("a"), F.col("b"))).collect()] == [10 + 16 / 6, 16.0, 6.0]
    df = spark.createDataFrame([(1, 1), (1, 9), (9, 1), (5, 5)], "h long, a long")
    assert [r[0] for r in df.select(scores.region_of(F.col("h"), F.col("a"))).collect()] == [None, "abroad", "home", "mixed"]


def test_blocking_loses_no_pair(spark):
    """The blocked similarity join against all pairs, on titles with common and rare words."""
    import math
    import random

    from harvestry.plans.resolution import similar_titles

    random.seed(3)
    words = [f"w{i}q" for i in range(12)] + ["common", "often"]
    titles = [(i, " ".join(random.sample(words, random.randint(1, 6)))) for i in range(120)]
    got = {(r.a, r.b): r.sim for r in similar_titles(spark.createDataFrame(titles, "id long, title string"), "id").collect()}
    stems = {i: {w if len(w) <= 5 or any(c.isdigit() for c in w) else w[:5] for w in t.split()} for i, t in titles}
    distinct = {t: stems[i] for i, t in titles}
    n = len(distinct) + 1
    weight = {w: math.log(n / (sum(w in s for s in distinct.values()) + 1)) for s in distinct.values() for w in s}
    want = {}
    for i, a in stems.items():
        for j, b in stems.items():
            if i < j:
                wa, wb, common = (sum(weight[w] for w in x) for x in (a, b, a & b))
                small, light = (wa, a) if wa <= wb else (wb, b)
                enough = small >= math.log(n / 6) and max(weight[w] for w in light) >= math.log(n / 41)
                sim = max(common / (wa + wb - common), 0.9 * common / small if enough and common / small >= 0.75 else 0)
                if sim >= 0.5 + 1e-9:
                    want[i, j] = sim
    assert {k for k, v in got.items() if v >= 0.5 + 1e-9} == set(want)
    assert all(abs(got[k] - v) < 1e-9 for k, v in want.items())


def test_no_bridge(spark):
    """A row without a place must not join rows of two places."""
    from harvestry.operators.merging import greedy_groups

    pairs = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8)], "a long, b long, score double")
    towns = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id long, key string")
    assert {r.id: r.group for r in greedy_groups(pairs, towns, "differ").collect()} == {1: 1, 2: 1, 3: 3}


def test_polygon(spark):
    from harvestry.functions.geo import polygon

    ring = [(0.0, 0.0), (0.0, 2.0), (1.0, 1.0), (2.0, 2.0), (2.0, 0.0)]
    points = [(0.5, 0.5), (1.0, 1.5), (1.0, -0.004), (1.0, -0.5), (None, 1.0)]
    df = spark.createDataFrame(points, "lat double, lon double")
    assert [r[0] for r in df.select(polygon(ring)("lat", "lon")).collect()] == [True, False, False, False, None]
    assert [r[0] for r in df.select(polygon(ring, 1.0)("lat", "lon")).collect()] == [True, False, True, False, None]


def test_places_and_signs(spark):
    from harvestry.functions import locations

    raw = ["Kde nič | Dom kultúry", "Miesto: Mlyn – Horná", "Mlyn (1. floor) | 5 €", "TBA", None, "Začiatok: 18:00 Adresa: Mlyn 7"]
    assert column(spark, raw, locations.clean_location) == ["Kde nič, Dom kultúry", "Mlyn, Horná", "Mlyn (1. floor)", "", "", "Mlyn 7"]
    urls_ = ["https://x.example/arvia/brookton", "https://x.example/brookton/arvia", "https://x.example/arvian", "https://x.example/"]
    assert column(spark, urls_, lambda c: locations.country_in_url(c, ["brookton"], ["arvia"])) == ["abroad", "home", None, None]
    stamps = ["2030-01-01T10:00:00-05:00", "2030-01-01T10:00:00+0200", "2030-01-01T10:00Z", "2030-01-01"]
    assert column(spark, stamps, locations.zone_country) == ["abroad", None, None, None]


def test_title_ends(spark):
    raw = ["Night tour20:15", "Tour 20:15", "Reds – Blues – 3:1", "Reds – Blues - 3 : 1", "9:00 – 10 - 12", "One – two –", "Tour: ", "Bolero!9:05", "Track 25:99", "- –"]
    assert column(spark, raw, text.clean_title) == ["Night tour", "Tour 20:15", "Reds – Blues", "Reds – Blues - 3 : 1", "9:00 – 10 - 12", "One – two", "Tour:", "Bolero!", "Track 25:99", "-"]


def test_shapes(spark):
    raw = ["12", "2030-01", "2030-01-02", "20-01", "news", "news-list", "a-b-c", "list.php", "list.exe", "caf%C3%A9", "x" * 25, "-", "a-"]
    assert column(spark, raw, urls.shape) == ["#", "D", "D", "*", "news", "news-list", "*", "list.php", "*", "*", "*", "*", "*"]


def test_repairs():
    day = lambda d: date(2030, 5, d)
    for given_, want in [
        ((day(5), day(4), "10:00", "11:00"), (day(5), None, "10:00", None)),
        ((day(5), day(7), "20:00", "00:00"), (day(5), day(6), "20:00", None)),
        ((day(5), day(6), "20:00", "00:00"), (day(5), None, "20:00", None)),
        ((day(5), day(6), "20:00", "04:00"), (day(5), None, "20:00", "04:00")),
        ((day(5), None, "00:00", "23:59"), (day(5), None, None, None)),
        ((day(5), None, "00:30", "23:30"), (day(5), None, None, None)),
        ((day(5), None, "18:00", "09:00"), (day(5), None, "18:00", None)),
        ((day(5), None, "18:00", "18:00"), (day(5), None, "18:00", None)),
        ((day(5), date(2033, 5, 5), None, None), (day(5), None, None, None)),
    ]:
        assert dates.tidy(*given_) == want


def test_equal_pages_are_read_once(monkeypatch):
    """Both texts of a page come from one tree, and a batch's equal pages are one page; null stays null."""
    import pandas as pd

    from harvestry.functions import html as H
    from harvestry.plans.reading import shortened

    read, parse = [], H.parse
    monkeypatch.setattr(H, "parse", lambda h: read.append(h) or parse(h))
    pages = ["<body><ul><li>a</li></ul><nav>m</nav></body>", "<p>b</p>", "", None]
    got = shortened.func(pd.Series(pages * 3))
    assert sorted(read) == sorted(pages[:3])
    assert list(got["skeleton"][:3]) == [H.skeleton(p) for p in pages[:3]] and list(got["said"][:3]) == ["a", "b", ""]
    assert got["skeleton"].isna().tolist() == [False, False, False, True] * 3
