"""Where a listing is: fourteen kinds of evidence in a fixed order, the first that says something decides.

What a country is made of (its names, language, borders) is a parameter; names of places come as a table, so that they may
be many. Learned regions, sites and venues are tables that are joined.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions import urls as U
from harvestry.functions.locations import country_in_url
from harvestry.functions.text import fold, words

HOME, ABROAD = "home", "abroad"
#: Words of a place's name at most.
NAME_WORDS = 3


@dataclass(frozen=True)
class Language:
    """Words (lower case, no word of another language) and letters that only this language has."""

    words: list[str]
    letters: str = ""


@dataclass(frozen=True)
class Country:
    """What tells a country's listings from others': codes, domain, words in addresses, a box of coordinates, languages."""

    code: str
    foreign_codes: list[str]
    suffix: str
    in_urls: tuple[list[str], list[str]]
    box: tuple[float, float, float, float]
    place_words: list[str]
    foreign_place_words: list[str]
    home: Language
    sister: Language
    world: Language
    names: list[str] = field(default_factory=list)


def listed(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def with_language(df: DataFrame, text: str, country: Country, name: str = "language") -> DataFrame:
    """Adds 'home', 'sister', 'world' or null: the language of a text by its small words, where there are enough of them and
    clearly more than of the others. Letters alone never make the sister language, and without a letter that marks either
    language a text is of neither."""
    df = df.withColumn("l_words", F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+"), lambda w: w != ""))
    count = lambda known: F.size(F.filter("l_words", lambda w: F.array_contains(listed(known), w)))
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    letters = lambda known: F.length(lower) - F.length(F.translate(lower, known, "")) if known else F.lit(0)
    df = df.withColumns({"l_h": count(country.home.words), "l_s": count(country.sister.words), "l_w": count(country.world.words), "l_hl": letters(country.home.letters), "l_sl": letters(country.sister.letters)})
    h, s, w, sl = F.col("l_h"), F.col("l_s"), F.col("l_w"), F.col("l_sl")
    whole, marked = h + F.col("l_hl"), (F.col("l_hl") + sl) > 0
    found = (
        F.when(marked & (h >= 1) & (whole >= 2) & (whole >= 2 * s) & (whole >= w / 2), HOME)
        .when(marked & (s >= 2) & (s >= 2 * whole) & (s + sl >= w / 2), "sister").when((w >= 4) & (w >= 4 * (h + s)), "world")
    )
    return df.withColumn(name, found).drop("l_words", "l_h", "l_s", "l_w", "l_hl", "l_sl")


def named_kinds(texts: DataFrame, gazetteer: DataFrame) -> DataFrame:
    """id and the set of `kinds` of the places that `text` names (id, text), by the gazetteer (name, kind) of folded names.

    Every run of up to NAME_WORDS words is looked up by an equal join. Rows that name none are left out.
    """
    df = texts.withColumn("w", words(F.col("text")))
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("w", i, n), " "))
    spoken = F.array_distinct(F.flatten(F.array(*(F.when(F.size("w") >= n, runs(n)).otherwise(F.array().cast("array<string>")) for n in range(1, NAME_WORDS + 1)))))
    return df.select("id", F.explode(spoken).alias("name")).join(gazetteer, "name").groupBy("id").agg(F.collect_set("kind").alias("kinds"))


def _has(kinds: str, *names: str) -> Column:
    return F.coalesce(F.arrays_overlap(F.col(kinds), listed(list(names))), F.lit(False))


def _place(kinds: str) -> Column:
    """What the places of a text say: a named country first, a town of the country, places abroad alone, then a village."""
    return F.when(_has(kinds, "home country"), HOME).when(_has(kinds, "foreign country"), ABROAD).when(_has(kinds, "town"), HOME).when(_has(kinds, "foreign town"), ABROAD).when(_has(kinds, "village"), "village")


def country_evidence(listings: DataFrame, gazetteer: DataFrame, sites: DataFrame, venues: DataFrame, regions: DataFrame, country: Country) -> DataFrame:
    """id, verdict ('home', 'abroad' or null), the `step` that decided, and `strong`, the verdict without what is learned.

    listings: id, title, description, location, via (the listing page), country (an answer), page_country (structured data),
    lat, lon. gazetteer: name, kind ('town', 'village', 'foreign town', 'home country', 'foreign country'), folded.
    sites: host, city, venue_town, judged. venues: location (folded), lat, lon, precision. regions: host, region (learned).
    All tables but the listings have one row a key. Nulls say nothing; a listing page without a host ends the list early.
    """
    rows = listings.withColumns({"host": F.nullif(U.bare_host(F.coalesce("via", F.lit(""))), F.lit("")), "place_key": fold(F.col("location"))})
    rows = rows.join(sites, "host", "left").join(regions, "host", "left")
    rows = rows.join(venues.select(F.col("location").alias("place_key"), F.col("lat").alias("v_lat"), F.col("lon").alias("v_lon"), "precision"), "place_key", "left")
    kinds = lambda text, name: named_kinds(rows.select("id", text.alias("text")), gazetteer).withColumnRenamed("kinds", name)
    said = F.concat_ws(" ", "title", "description")
    rows = rows.join(kinds(F.col("location"), "k_location"), "id", "left").join(kinds(F.coalesce("city", "venue_town"), "k_site"), "id", "left").join(kinds(F.concat_ws(" ", said, "location"), "k_text"), "id", "left")
    rows = with_language(rows.withColumn("said", said), "said", country)

    code = lambda c: F.when(F.trim(c) != "", F.when(F.lower(F.trim(c)).isin(country.code, *country.names), HOME).otherwise(ABROAD))
    any_word = lambda known: F.arrays_overlap(words(F.col("location")), listed(known))
    own = F.coalesce(F.when(_has("k_location", "home country"), HOME), F.when(_has("k_location", "foreign country"), ABROAD), F.when(_has("k_location", "town"), HOME),
                     F.when(_has("k_location", "foreign town") | any_word(country.foreign_place_words), ABROAD), F.when(_has("k_location", "village"), "village"))
    rows = rows.withColumns({"own": own, "lat": F.coalesce("lat", "v_lat"), "lon": F.coalesce("lon", "v_lon"), "precision": F.when(F.col("lat").isNotNull(), "page").otherwise(F.col("precision")), "away": F.coalesce(F.col("judged").isin("mixed", ABROAD), F.lit(False))})
    south, north, west, east = country.box
    inside = F.col("lat").between(south, north) & F.col("lon").between(west, east)
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    # Coordinates of a place that was looked up without any town are a guess if they lie inside.
    guess = known & inside & ~F.coalesce(F.col("precision").isin("page", "manual"), F.lit(False)) & ~_has("k_location", "town", "village", "foreign town")
    rows = rows.withColumns({"inside": inside, "known": known, "guess": guess})
    region, away, here = F.col("region"), F.col("away"), F.coalesce(F.col("host").endswith(country.suffix), F.lit(False))
    no_place, title, in_url = F.col("location").isNull(), F.lower(F.coalesce("title", F.lit(""))), country_in_url(F.col("via"), *country.in_urls)
    codes = "|".join(country.foreign_codes)
    learned_home = F.coalesce(region == HOME, F.lit(False))
    unnamed = ~_has("k_text", "town", "village", "home country")
    has_host = F.col("host").isNotNull()
    steps = {
        "village": F.when(F.col("own") == "village", F.when(region == ABROAD, ABROAD).otherwise(HOME)),
        "location": F.when(F.col("own").isin(HOME, ABROAD), F.col("own")),
        "page": code(F.col("page_country")),
        "coordinates": F.when(F.col("known") & ~F.col("guess"), F.when(F.col("inside"), HOME).otherwise(ABROAD)),
        "place words": F.when(any_word(country.place_words), HOME),
        "answer": code(F.col("country")),
        "title code": F.when(title.rlike(rf"\({country.code}\)"), HOME).when(title.rlike(rf"\(({codes})\b|\b({codes}) (mini)?tour\b"), ABROAD),
        "address": F.when((in_url == ABROAD) | ((in_url == HOME) & (no_place | here)), in_url),
        "site city": F.when(_place("k_site") == "village", HOME).otherwise(_place("k_site")),
        "domain": F.when(has_host & no_place & here & ~away, HOME),
        "text": F.when(has_host, F.when(F.col("language") == HOME, HOME).when((F.col("language") == "sister") & ~learned_home, ABROAD)
                       .when((F.col("language") == "world") & (away | (~here & ~learned_home)) & unnamed, ABROAD)),
        "guessed coordinates": F.when(F.col("guess"), HOME),
        "region": F.when(has_host & no_place & ~away & learned_home, HOME),
    }
    first = lambda names: F.coalesce(*(F.when(steps[s].isNotNull(), F.struct(F.lit(s).alias("step"), steps[s].alias("verdict"))) for s in names))
    out = rows.select("id", first(steps).alias("all"), first([s for s in steps if s != "region"]).alias("sure"))
    return out.select("id", F.col("all.verdict").alias("verdict"), F.col("all.step").alias("step"), F.col("sure.verdict").alias("strong"))
