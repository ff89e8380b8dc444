"""Rules for tags, learned from verdicts: what a venue, a listing page or a title's word says of the tags of what has it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: For each kind of evidence the verdicts that a rule needs, and the share of them that must agree.
NEEDED = {"venue": (2, 0.8), "page": (3, 0.8), "word": (4, 0.9)}
#: Fixed value: titles that a key remembers. A remembered title counts once, any other each time it comes.
REMEMBERED = 100


def counted(verdicts: DataFrame, remembered: int = REMEMBERED) -> DataFrame:
    """The verdicts (kind, key, title, tags, at) that count: the first of each remembered title, and all of the others.

    A key remembers the titles that came first; `at` is a verdict's place in time and its own. Rows without a key or `at` go.
    Ranks are cut before the shuffle, so a key of very many titles sends `remembered` of them from each task.
    """
    on = ["kind", "key", "title"]
    rows = verdicts.where("key is not null and at is not null").withColumn("title", F.coalesce("title", F.lit("")))
    place = F.row_number().over(Window.partitionBy("kind", "key").orderBy("first", "title"))
    kept = rows.groupBy(*on).agg(F.min("at").alias("first")).withColumn("place", place).where(F.col("place") <= remembered).drop("place")
    return rows.join(kept, on, "left").where("first is null or at = first").drop("first")


def tag_rules(verdicts: DataFrame, remembered: int = REMEMBERED, needed: dict[str, tuple[int, float]] = NEEDED) -> DataFrame:
    """kind, key, tag, n (verdicts that count), c (those with the tag), active: enough verdicts, and enough of them agree.

    A verdict without tags counts in n only; a tag repeated in one counts once. Kinds that `needed` doesn't name have no active rule.
    """
    tags = F.array_distinct(F.coalesce("tags", F.array().cast("array<string>")))
    # The null beside each verdict's tags counts the verdict itself, so one grouping gives n and c.
    said = counted(verdicts, remembered).select("kind", "key", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.filter(tags, lambda t: t.isNotNull()))).alias("tag"))
    sums = said.groupBy("kind", "key", "tag").agg(F.count("*").alias("c"))
    n = F.max(F.when(F.col("tag").isNull(), F.col("c"))).over(Window.partitionBy("kind", "key"))
    enough = F.coalesce(*(F.when(F.col("kind") == k, (F.col("n") >= least) & (F.col("c") / F.col("n") >= share)) for k, (least, share) in needed.items()), F.lit(False))
    return sums.withColumn("n", n).where("tag is not null").select("kind", "key", "tag", "n", "c", enough.alias("active"))


def learned_tags(evidence: DataFrame, rules: DataFrame) -> DataFrame:
    """id and learned: the tags that active rules give to the evidence (id, kind, key). An id without any has no row."""
    met = evidence.join(rules.where("active").select("kind", "key", "tag"), ["kind", "key"])
    return met.groupBy("id").agg(F.sort_array(F.collect_set("tag")).alias("learned"))


def sourced_tags(guessed: Column, own: Column, learned: Column, answers: Column, live: Column, order: tuple[str, ...], screening: str, beside: tuple[str, ...]) -> Column:
    """Tags in the given order with their origin, array of (tag, origin); every argument but `live` is an array or null.

    Words and the sources' own data come first (rules), then learned rules, then an answer; each only where none came before.
    A screening that words guess yields to sources that say other things. A screening keeps only the tags `beside` it, but is none
    where the title is of a live show.
    """
    given = [F.coalesce(x, F.array().cast("array<string>")) for x in (guessed, own, learned, answers)]
    guessed, own, learned, answers = given
    words = F.when((F.size(own) > 0) & ~F.array_contains(own, screening), F.array_remove(guessed, screening)).otherwise(guessed)
    first = F.array_union(words, own)
    which = F.when(F.size(first) > 0, F.struct(first.alias("tags"), F.lit("rules").alias("origin"))).when(F.size(learned) > 0, F.struct(learned.alias("tags"), F.lit("learned").alias("origin")))
    which = which.otherwise(F.struct(answers.alias("tags"), F.lit("ai").alias("origin")))
    shown = F.array_contains(which["tags"], screening)
    left = (
        F.when(shown & F.coalesce(live, F.lit(False)), F.array_remove(which["tags"], screening))
        .when(shown, F.array_intersect(which["tags"], F.array(*map(F.lit, (screening, *beside))))).otherwise(which["tags"])
    )
    return F.transform(F.array_intersect(F.array(*map(F.lit, order)), left), lambda t: F.struct(t.alias("tag"), which["origin"].alias("origin")))
