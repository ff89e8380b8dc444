"""Text functions as column expressions: folding, cleaning, title words and stems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with marks of the Latin alphabets that listings use, and their plain letters.
MARKED = "áàâäãåāąčćçďéèêëěęíìîïĺľłńňñóòôöõőŕřšśťúùûüůűýÿžźż"
PLAIN = "aaaaaaaacccdeeeeeeiiiilllnnnoooooorrsstuuuuuuyyzzz"
#: Grammar words and ticket notes that say nothing about which event a title names.
STOP_WORDS = """a i o u v vo na do od po pri pre s so z zo za k ku je sa si to aj ale alebo ako the of and in at on for with to by an
event podujatie vypredane pridane zrusene presunute novy termin""".split()


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used: plans of nested steps stay as long as they are written."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))


def fold(c: Column) -> Column:
    """Lower case without the marks of MARKED. (ł folds to l; other letters without a plain form stay.)"""
    return F.translate(F.lower(F.coalesce(c, F.lit(""))), MARKED, PLAIN)


def clean(c: Column) -> Column:
    """White space collapsed and trimmed; null gives an empty text."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


#: Marks that part what a title says; one that stands alone at a title's end parts nothing.
PARTING = "-–—|:,"


def _unglued(t: Column, n: int) -> Column:
    """Without a time of day of n characters behind a letter or a closing mark."""
    tail, before = F.right(t, F.lit(n)), F.substring(t, F.length(t) - n, F.lit(1))
    hour, minute = (F.element_at(F.split(tail, ":"), i).try_cast("int") for i in (1, -1))
    glued = (F.length(t) > n) & (F.instr(tail, ":") == n - 2) & hour.between(0, 23) & minute.between(0, 59) & (before.rlike(r"\p{L}") | before.isin(*")!?."))
    return F.when(F.coalesce(glued, F.lit(False)), F.substring(t, F.lit(1), F.length(t) - n)).otherwise(t)


def _unscored(parts: Column) -> Column:
    """Without a last part that is two numbers, unless a time stands before it."""
    numbers = F.transform(F.split(F.translate(F.element_at(parts, -1), ":–", "--"), "-"), lambda n: F.trim(n))
    scored = let(numbers, lambda x: (F.size(x) == 2) & F.forall(x, lambda n: F.length(n).between(1, 3) & n.try_cast("int").isNotNull()))
    ahead = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(1)))
    return F.array_join(F.when((F.size(parts) > 1) & scored & ~F.element_at(ahead, -1).rlike(r"\d:\d\d$"), ahead).otherwise(parts), " – ")


def _unmarked(said: Column) -> Column:
    """Words up to the last that is more than marks."""
    last = F.array_max(F.transform(said, lambda w, i: F.when(F.length(F.translate(w, PARTING, "")) > 0, i + 1)))
    return F.array_join(F.slice(said, 1, F.greatest(F.coalesce(last, F.lit(0)), F.lit(1))), " ")


def clean_title(c: Column) -> Column:
    """A title without a clock time glued to its last letter, a score after the teams, or separators left at its end."""
    t = let(let(clean(c), lambda t: _unglued(t, 5)), lambda t: _unglued(t, 4))
    return let(F.split(let(F.split(t, " – "), _unscored), " "), _unmarked)


def words(c: Column) -> Column:
    """Runs of letters and digits of the folded text."""
    return F.filter(F.split(fold(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def title_tokens(c: Column) -> Column:
    """Distinct words of two letters or more that are no stop words, days, months or years."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    kept = F.filter(words(c), lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w) & ~w.rlike(r"^(\d\d?|(19|20)\d\d)$"))
    return F.array_distinct(kept)


def stem(w: Column) -> Column:
    return F.when((F.length(w) > 5) & ~w.rlike(r"\d"), F.substring(w, 1, 5)).otherwise(w)


def title_stems(c: Column) -> Column:
    return F.array_distinct(F.transform(title_tokens(c), stem))


def junk_title(c: Column) -> Column:
    """A title that names nothing: empty, or digits and separators alone; a year alone may be a name."""
    digits = "0123456789"
    rest = lambda t: F.translate(t, digits + " ./:–-", "")
    numbers = lambda t: F.length(t) - F.length(F.translate(t, digits, ""))
    return let(clean(c), lambda t: (t == "") | ((rest(t) == "") & (numbers(t) > 0) & ~((numbers(t) == 4) & (F.length(t) == 4))))


def language_counts(c: Column, lexicons: dict[str, list[str]]) -> dict[str, Column]:
    """How many words of the text are in each lexicon, repeats counted."""
    found = words(c)

    def count(known: list[str]) -> Column:
        listed = F.array(*map(F.lit, known))
        return F.size(F.filter(found, lambda w: F.array_contains(listed, w)))

    return {name: count(known) for name, known in lexicons.items()}
