"""Events in a page's structured data, walked as VARIANT values: no Python, broken scripts skipped.

Scripts are parsed to variants. Level by level arrays give their elements, and objects what stands under `@graph` and
`subEvent`; every object is a node. Nodes whose type ends in "Event" become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions.locations import zone_country

SCRIPT = r"(?is)<script[^>]*application/ld\+json[^>]*>(.*?)</script>"
#: Levels below a script that are walked; deeper ones are not data but accidents.
LEVELS = 10


def at(node: Column | str, *names: str, kind: str = "string") -> Column:
    """What stands under the names in a variant; null where it is of another kind."""
    path = "$" + "".join(f'["{n}"]' for n in names)
    return F.call_function("try_variant_get", F.col(node) if isinstance(node, str) else node, F.lit(path), F.lit(kind))


def is_kind(node: Column | str, kind: str) -> Column:
    return F.coalesce(F.call_function("schema_of_variant", F.col(node) if isinstance(node, str) else node).startswith(kind), F.lit(False))


def many(node: Column | str, *names: str) -> Column:
    """An array's elements, or the one value that stands there alone; no elements for none."""
    value = at(node, *names, kind="variant")
    alone = F.when(value.isNotNull() & ~F.call_function("is_variant_null", value), F.array(value))
    return F.coalesce(at(node, *names, kind="array<variant>"), alone, F.expr("CAST(array() AS array<variant>)"))


def nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and `v`, each object in the scripts of each page; a script that is no JSON has none. Pages are read once: a level's
    values are an array, from which the next one's follow."""
    scripts = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(SCRIPT), F.lit(1))).alias("script"))
    df = scripts.select(key, F.expr("try_parse_json(script)").alias("v")).where("v is not null").select(key, F.array("v").alias("level"), F.expr("CAST(array() AS array<variant>)").alias("found"))
    below = lambda x: F.when(is_kind(x, "ARRAY"), many(x)).when(is_kind(x, "OBJECT"), F.concat(many(x, "@graph"), many(x, "subEvent"))).otherwise(F.expr("CAST(array() AS array<variant>)"))
    for _ in range(LEVELS):
        df = df.select(key, F.flatten(F.transform("level", below)).alias("level"), F.concat("found", F.filter("level", lambda x: is_kind(x, "OBJECT"))).alias("found"))
    return df.select(key, F.explode("found").alias("v"))


def structured_events(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, title, start, end, place, description, url, types, lat, lon, country, online of the events in each page.

    The place is the first location that is not virtual: its name, and its address as text or street and town. Without any
    place an event with a location, or one that says so, is online. Coordinates count as numbers, also in quotes, but not both
    zero. The country is the address's, or else what the start's offset tells.
    """
    df = nodes(pages, key, html)
    types = F.coalesce(at("v", "@type", kind="array<string>"), F.array(at("v", "@type")))
    df = df.withColumn("types", F.filter(types, lambda t: t.isNotNull())).where(F.exists("types", lambda t: t.endswith("Event")))
    real = F.filter(many("v", "location"), lambda x: ~F.coalesce(at(x, "@type").contains("VirtualLocation"), F.lit(False)))
    df = df.withColumns({"l_n": F.size(many("v", "location")), "l": F.get(real, F.lit(0))})
    parts = F.array(at("l", "address", "streetAddress"), at("l", "address", "addressLocality"))
    said = lambda c: F.nullif(F.trim(c), F.lit(""))
    whole = F.when(is_kind(at("l", "address", kind="variant"), "STRING"), at("l", "address"))
    address = F.coalesce(said(whole), said(F.array_join(F.filter(F.transform(parts, said), lambda p: p.isNotNull()), ", ")))
    df = df.withColumns({"l_address": address, "l_name": said(at("l", "name")), "lat": at("l", "geo", "latitude", kind="double"), "lon": at("l", "geo", "longitude", kind="double")})
    online = F.col("l_address").isNull() & F.col("l_name").isNull() & ((F.col("l_n") > 0) | F.coalesce(at("v", "eventAttendanceMode").contains("OnlineEventAttendanceMode"), F.lit(False)))
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull() & ((F.col("lat") != 0) | (F.col("lon") != 0))
    land = F.coalesce(said(at("l", "address", "addressCountry", "name")), said(at("l", "address", "addressCountry", "@id")), F.when(is_kind(at("l", "address", "addressCountry", kind="variant"), "STRING"), said(at("l", "address", "addressCountry"))))
    start = at("v", "startDate")
    return df.select(
        key, said(at("v", "name")).alias("title"), start.alias("start"), at("v", "endDate").alias("end"), F.when(online, "Online").otherwise(said(F.concat_ws(", ", "l_name", "l_address"))).alias("place"),
        at("v", "description").alias("description"), F.coalesce(at("v", "url"), at("v", "URL")).alias("url"), "types", F.when(known, F.col("lat")).alias("lat"), F.when(known, F.col("lon")).alias("lon"), F.coalesce(land, zone_country(start)).alias("country"), online.alias("online"),
    )
