"""Written places: what stands beside a place in its field, and signs of a country in texts and addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestry.functions.text import clean, fold, let

#: Fixed values, folded: labels before a place, labels before a time, and words that stand for no place yet.
PLACE_LABELS = "miesto mesto adresa lokalita venue location place where".split()
TIME_LABELS = "termin datum kedy zaciatok when date starts".split()
NOT_YET = ("tba", "tbd", "n/a", "bude upresnene")
#: Marks between fields, and marks that are left around one.
BETWEEN, AROUND = r"[|·•]|\s[—–-]\s|\s,|//", " /—–-|·•,;:@."


def clean_location(c: Column) -> Column:
    """A place's fields joined by commas: no labels, no field that is a date, a time or a price, no marks around.

    A field that a time label opens goes as a whole. A word that stands for no place yet gives an empty text.
    """
    labels = "|".join([*PLACE_LABELS, *TIME_LABELS])
    known = {w: F.array(*map(F.lit, x)) for w, x in (("place", PLACE_LABELS), ("time", TIME_LABELS))}
    # A label opens a field of its own, wherever it stands: its letters are found in the folded text, which has as many.
    text = clean(c)
    opened = F.regexp_replace(text, rf"(?iu)(?<![\p{{L}}])(?=({labels.replace('i', '[ií]').replace('a', '[aá]')})\s*:)", "|")
    fields = F.transform(F.split(opened, BETWEEN), lambda f: F.trim(f))
    label = lambda f: fold(F.trim(F.element_at(F.split(f, ":"), 1)))
    fields = F.filter(fields, lambda f: ~(f.contains(":") & F.array_contains(known["time"], label(f))))
    fields = F.transform(fields, lambda f: F.when(f.contains(":") & F.array_contains(known["place"], label(f)), F.substring(f, F.instr(f, ":") + 1, F.length(f))).otherwise(f))
    # Dates, times and prices are words of their own; what is left of a field is its other words.
    said = lambda f: F.split(F.trim(F.regexp_replace(f, r"(\d\.)\s+(?=\d)", "$1")), r"\s+")
    moment = lambda w: w.rlike(r"^\d{1,2}\.(\d{1,2}\.(\d{4})?)?$|^\d{1,2}[:.]\d{2}$")
    priced = lambda f: F.regexp_replace(f, r"(?i)(^|\s)\d+([.,]\d+)?\s*(€|eur)(?=\s|$)", " ")
    fields = F.transform(fields, lambda f: F.array_join(F.filter(said(priced(f)), lambda w: ~moment(w)), " "))
    fields = F.filter(F.transform(fields, lambda f: F.btrim(f, F.lit(AROUND))), lambda f: f != "")
    return let(F.array_join(fields, ", "), lambda place: F.when(F.btrim(fold(place), F.lit(AROUND)).isin(*NOT_YET), "").otherwise(place))


def country_in_url(url: Column, home: list[str], away: list[str]) -> Column:
    """'home' or 'abroad' by the country or town whose name comes first in an address; null where none is named.

    Names are folded words; one counts where no letter stands beside it.
    """
    text = fold(url)

    def first(names: list[str]) -> Column:
        return F.nullif(F.regexp_instr(text, F.lit(rf"(?<![a-z])({'|'.join(names)})(?![a-z])")), F.lit(0))

    here, there = first(home), first(away)
    return F.when(here.isNull() & there.isNull(), None).when(there.isNull() | (here < there), "home").otherwise("abroad")


def zone_country(stamp: Column, least: int = 0, most: int = 2) -> Column:
    """'abroad' where a time stamp's zone is more hours from Greenwich than the country ever is; else null."""
    zone = F.regexp_extract(stamp, r"T[\d:.]+([+-]\d{2}):?\d{2}$", 1).try_cast("int")
    return F.when((zone < least) | (zone > most), "abroad")
