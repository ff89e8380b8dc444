"""Free-text places: venue, street, postcode and town, against a gazetteer that the caller gives.

The gazetteer is a table of (name, part_of): towns, and boroughs with the town they are part of. It is collected into one
dictionary that an Arrow function shares, so its size must be that of a country's list of places.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.functions.dates import fold

#: How an online event, and a street, is written.
ONLINE = re.compile(r"\b(online|on-line|zoom|webinar|livestream|ms teams|google meet)\b")
STREET = re.compile(r"(?i)^(?:ul\.|ulica|nám\.|námestie|street|str\.)?\s*[^\d,]+\s\d+[a-z]?(?:/\d+[a-z]?)?$|(?i:\b(?:ul\.|ulica|street)\b)")
POSTCODE = re.compile(r"\b(\d{3})\s?(\d{2})\b")
RESULT = "name string, street string, postcode string, city string, district string, online boolean, several array<string>"


def split(text: str | None, towns: dict[str, tuple[str, str | None]]) -> dict:
    """Fields of one location text. Several towns without a street give `several` and no city."""
    out: dict = dict.fromkeys(("name", "street", "postcode", "city", "district", "several"), None) | {"online": False}
    flat = fold(text or "")
    if ONLINE.search(flat) and not any(fold(p) in towns for p in re.split(r"[,|;]", text or "")):
        return out | {"online": True}
    rest, found = [], []
    for part in (p.strip() for p in re.split(r"\s*[,|;·•]\s*", text or "")):
        if m := POSTCODE.search(part):
            out["postcode"] = out["postcode"] or f"{m[1]} {m[2]}"
            part = (part[: m.start()] + part[m.end() :]).strip()
        if not part:
            continue
        known = towns.get(fold(part))
        if known and known[1]:
            out["district"] = out["district"] or known[0]
            found.append(known[1])
        elif known:
            found.append(known[0])
        elif not out["street"] and STREET.search(part):
            out["street"] = part
        else:
            rest.append(part)
    distinct = list(dict.fromkeys(found))
    if len(distinct) > 1 and not out["street"]:
        return out | {"several": distinct, "name": rest[0] if rest else None}
    if distinct:
        out["city"] = distinct[-1]
    else:  # a town inside the venue's name
        inside = [t for w, t in towns.items() for p in rest if re.search(rf"\b{re.escape(w)}\b", fold(p))]
        if inside:
            out["city"], out["district"] = (inside[0][1], inside[0][0]) if inside[0][1] else (inside[0][0], None)
    out["name"] = rest[0] if rest else None
    return out


def parser(gazetteer: DataFrame):
    """An Arrow function of a text column for this gazetteer; names that two places share are left out."""
    rows = gazetteer.select("name", "part_of").toPandas()
    names = rows["name"].map(fold)
    once = ~names.duplicated(keep=False)
    towns = {k: (n, p if isinstance(p, str) else None) for k, n, p in zip(names[once], rows["name"][once], rows["part_of"][once], strict=True)}

    @F.pandas_udf(RESULT)
    def read(texts: pd.Series) -> pd.DataFrame:
        known = {t: split(t, towns) for t in texts.dropna().unique()}
        nothing = split(None, towns)
        return pd.DataFrame([known.get(t, nothing) for t in texts], columns=["name", "street", "postcode", "city", "district", "online", "several"])

    return read


def venue_key(place: Column) -> Column:
    """Street (or name) and town, folded; null where there is no one place."""
    from harvestry.functions.text import fold as fold_column

    what = F.coalesce(place["street"], place["name"])
    town = fold_column(place["city"])
    return F.when(place["online"] | place["several"].isNotNull(), None).otherwise(F.concat_ws("|", F.when(what.isNull(), "city").otherwise(fold_column(what)), town))
