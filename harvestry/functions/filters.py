"""Classes of rows and addresses as column predicates, by tables of words."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from harvestry.functions import urls as U
from harvestry.functions.dates import WEEKDAY_OF
from harvestry.functions.text import clean, fold, let


@dataclass(frozen=True)
class Kind:
    """Folded words by which a title is of a kind: it is one of them and nothing else, it says one anywhere, or it opens with
    one (behind words that only describe) and, where `also` is given, says a word that begins like one of those."""

    alone: list[str] = field(default_factory=list)
    anywhere: list[str] = field(default_factory=list)
    opening: list[str] = field(default_factory=list)
    also: list[str] = field(default_factory=list)


#: Words that may stand before an opening word.
DESCRIBING = "planned planovany planovana planovane temporary docasna full uplna partial ciastocna".split()
#: Rows that are no public events. A caller may pass another table.
KINDS = {
    "refuse": Kind(opening=["vyvoz", "odvoz", "zvoz", "zber", "collection"], also=["odpad", "plast", "papier", "sklo", "bio", "waste"]),
    "called off": Kind(anywhere=["zrusene", "zrusena", "zruseny", "cancelled", "canceled"]),
    "day off": Kind(alone=["volno"]),
    "no supply": Kind(opening=["prerusenie", "odstavka", "vyluka", "outage"]),
    "closed road": Kind(opening=["uzavierka", "closure"]),
    "opening hours": Kind(opening=["uradne hodiny", "strankove hodiny", "ordinacne hodiny", "opening hours"]),
    "timetable": Kind(opening=["rozvrh", "timetable"]),
    "button": Kind(alone=["kupit listok", "kupit", "vstupenky", "viac", "viac info", "detail", "more", "more info", "read more", "buy tickets", "tickets"]),
    "weekday": Kind(alone=sorted(WEEKDAY_OF)),
}
#: Schemes of links that lead to no page, and endings of files.
NO_PAGES = "javascript mailto tel data sms callto".split()
FILES = "pdf jpg jpeg png gif webp svg bmp tif tiff heic doc docx xls xlsx ppt pptx odt rtf zip rar".split()


def _listed(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def is_kind(words: Column, kind: Kind) -> Column:
    """Whether a title of these words is of the kind."""
    said = F.array_join(words, " ")
    first = F.array_position(F.transform(words, lambda w: F.array_contains(_listed(DESCRIBING), w)), False)
    rest = F.concat(F.array_join(F.slice(words, F.greatest(first.cast("int"), F.lit(1)), F.greatest(F.size(words), F.lit(1))), " "), F.lit(" "))
    opens = F.exists(_listed(kind.opening), lambda o: rest.startswith(F.concat(o, F.lit(" "))))
    if kind.also:
        opens = opens & F.exists(words, lambda w: F.exists(_listed(kind.also), lambda a: w.startswith(a)))
    return F.array_contains(_listed(kind.alone), said) | F.arrays_overlap(words, _listed(kind.anywhere)) | opens


def not_an_event(title: Column, kinds: dict[str, Kind] = KINDS) -> Column:
    """Why a title is no public event, or null: the first kind that it is of."""
    words = F.filter(F.split(fold(clean(title)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return let(words, lambda w: F.coalesce(*(F.when(is_kind(w, kind), name) for name, kind in kinds.items())))


def event_url(url: Column, listing: Column) -> Column:
    """The address if it can be a listing's own page: no script or mail link, file, front page or the listing itself."""

    def own(u: Column) -> Column:
        scheme, path = F.lower(F.substring_index(u, ":", 1)), U.path(u)
        last = F.lower(F.element_at(F.split(path, "/"), -1))
        file = last.contains(".") & F.substring_index(last, ".", -1).isin(FILES)
        front = (path == "/") & (U.part(u, 5) == "")
        return F.when(~scheme.isin(NO_PAGES) & U.is_web(u) & ~file & ~front & ~U.url_key(u).eqNullSafe(U.url_key(listing)), u)

    return let(clean(url), own)


def server_trouble(status: Column, error: Column) -> Column:
    """Whether a server failed or sent away: by the status, or by the words of an error."""
    words = ("timeout", "refused", "reset", "dns", "tls")
    said = F.lower(error)
    return F.coalesce((status >= 500) | (status == 429), F.lit(False)) | F.coalesce(F.greatest(*(said.contains(w) for w in words)), F.lit(False))
