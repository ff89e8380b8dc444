"""Greedy merging, best pairs first, with keys that keep groups apart, in rounds over whole tables.

Taken one after the other, a pair unites its two groups unless their keys forbid it. A group's best open pair is decided by
nothing but the two groups that it joins, so wherever both sides agree on it, it can be taken at once, and many such pairs
are in each round. Groups that have their best pair with one of the two follow them in the same round, as far as no other
pair of theirs, or of those that follow, comes before. Keys only gather, so pairs of groups that they keep apart are dropped as soon as that shows.
Rounds are joins and grouped minima over rows: neither a component nor a hub's pairs meet in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harvestry.sources.tables import keep


def greedy_groups(pairs: DataFrame, keys: DataFrame, rule: str) -> DataFrame:
    """(id, group) for each id that `pairs` (a, b, score) names; the group is its smallest id.

    Pairs go by falling score, then by a and b. `keys` holds (id, key); null keys count for nothing. By the rule "differ" no
    group has two different keys (two towns, say); by "share" none has one key of two ids (a site's own listings). Pairs of an
    id with itself, and a pair given again with a lower score, change nothing. A null score comes last.
    """
    low = F.coalesce(-F.col("score"), F.lit(float("inf")))
    edges = pairs.where("a <> b").select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), F.struct(low.alias("s"), F.col("a"), F.col("b")).alias("o"))
    edges = keep(edges.groupBy("x", "y").agg(F.min("o").alias("o")), "edges")
    members = edges.select(F.col("x").alias("id")).union(edges.select("y")).distinct().withColumn("at", F.col("id"))
    members = keep(members, "members")
    held = keep(keys.where("key is not null").join(members, "id").select("at", "key").distinct(), "keys")
    while True:
        edges = keep(apart(edges, held, rule), "edges")
        if edges.isEmpty():
            return groups_of(members)
        moves = keep(round_of(edges, held, rule), "moves")
        members = keep(moved(members, moves, "at"), "members")
        held = keep(moved(held, moves, "at").distinct(), "keys")
        edges = moved(moved(edges, moves, "x"), moves, "y").where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("o").alias("o"))


def groups_of(members: DataFrame) -> DataFrame:
    return members.join(members.groupBy("at").agg(F.min("id").alias("group")), "at").select("id", "group")


def moved(rows: DataFrame, moves: DataFrame, column: str) -> DataFrame:
    """`rows` with the groups in `column` replaced by those that they went into."""
    to = moves.select(F.col("gone").alias(column), "into")
    return rows.join(to, column, "left").withColumn(column, F.coalesce("into", column)).drop("into")


def summary(held: DataFrame, name: str) -> DataFrame:
    """Of each group: how many keys it has, and one of them."""
    return held.groupBy(F.col("at").alias(name)).agg(F.count("key").alias(f"n_{name}"), F.min("key").alias(f"key_{name}"))


def apart(edges: DataFrame, held: DataFrame, rule: str) -> DataFrame:
    """The pairs of groups that may still unite."""
    if rule == "differ":
        both = edges.join(summary(held, "x"), "x", "left").join(summary(held, "y"), "y", "left")
        one = (F.col("n_x") == 1) & (F.col("n_y") == 1) & (F.col("key_x") == F.col("key_y"))
        return both.where(F.col("n_x").isNull() | F.col("n_y").isNull() | one).select("x", "y", "o")
    of = lambda name: held.select(F.col("at").alias(name), "key")
    shared = edges.select("x", "y").join(of("x"), "x").join(of("y"), ["y", "key"]).select("x", "y").distinct()
    return edges.join(shared, ["x", "y"], "left_anti")


def round_of(edges: DataFrame, held: DataFrame, rule: str) -> DataFrame:
    """(gone, into): the groups that unite in this round, with the one that stays."""
    ways = edges.select(F.col("x").alias("u"), F.col("y").alias("v"), "o").union(edges.select("y", "x", "o"))
    best = ways.groupBy("u").agg(F.min("o").alias("best"))
    agreed = edges.join(best.select(F.col("u").alias("x"), F.col("best").alias("bx")), "x").where("o = bx").join(best.select(F.col("u").alias("y"), F.col("best").alias("by")), "y").where("o = by")
    agreed = keep(agreed.select("x", "y"), "agreed")
    core = agreed.select(F.col("x").alias("u"), F.col("x").alias("r")).union(agreed.select("y", "x"))
    # Every other group that has a pair with one of the two, by its first such pair.
    near = ways.join(core, "u").join(core.select(F.col("u").alias("v"), F.col("r").alias("own")), "v", "left").where("own is null or own <> r")
    near = near.groupBy("r", "v").agg(F.min("o").alias("o"), F.max(F.col("own").isNotNull()).alias("taken"))
    near = near.join(best.select(F.col("u").alias("v"), "best"), "v").join(summary(held, "v"), "v", "left")
    follows = (F.col("best") == F.col("o")) & ~F.col("taken") & (F.coalesce("n_v", F.lit(0)) <= 1)
    near = keep(near.select("r", "v", "o", F.col("key_v").alias("key"), follows.alias("follows")), "near")
    # A follower's own pairs are the united group's too: what comes behind the first of them waits for the next round.
    others = near.where("follows").select("r", F.col("v").alias("u")).join(ways, "u").join(core.select(F.col("u").alias("v"), F.col("r").alias("own")), "v", "left").where("own is null or own <> r").select("r", "o")
    bound = near.where("not follows").select("r", "o").union(others).groupBy("r").agg(F.min("o").alias("bound"))
    first = near.where("follows").join(bound, "r", "left").where("bound is null or o < bound").select("r", "v", "o", "key")
    own = held.select(F.col("at").alias("u"), "key").join(core, "u").select("r", "key").distinct()
    return agreed.select(F.col("y").alias("gone"), F.col("x").alias("into")).union(followers(first, own, rule).select(F.col("v").alias("gone"), F.col("r").alias("into")))


def followers(first: DataFrame, own: DataFrame, rule: str) -> DataFrame:
    """Those of the groups `first` (r, v, o, key) that unite with r, whose keys `own` are (r, key), when each comes in its order."""
    keyed, free = first.where("key is not null"), first.where("key is null").select("r", "v")
    if rule == "differ":
        said = own.select("r", F.struct(F.lit(0).alias("late"), F.lit(None).cast(first.schema["o"].dataType).alias("o"), "key").alias("k"))
        said = said.union(keyed.select("r", F.struct(F.lit(1).alias("late"), "o", "key").alias("k"))).groupBy("r").agg(F.min("k").alias("k"))
        return keyed.join(said, "r").where(F.col("key") == F.col("k.key")).select("r", "v").union(free)
    new: Column = F.min_by("v", "o").alias("v")
    return keyed.join(own, ["r", "key"], "left_anti").groupBy("r", "key").agg(new).select("r", "v").union(free)
