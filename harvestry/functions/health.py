"""Readings over time against the last good one: an ordered fold, since what is good depends on what was good before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Readings from which a drop tells, and what is left of them; titles from which sameness tells, and the shares of
#: different ones that are few and enough; the shares that were had and are lost.
MANY, LEFT, SOME, FEW_TITLES, OWN_TITLES, HAD, LOST = 6, 0.3, 5, 0.3, 0.6, 0.8, 0.3
SHARES = ("timed", "located", "linked")


def trouble(now: Column, good: Column) -> Column:
    """What is worse than it was, or null: none, fewer, same, or the share that is lost. Nothing is without a good reading."""
    had = F.coalesce(good["n"] > 0, F.lit(False))
    lost = [F.when((good[k] >= HAD) & (now[k] < LOST), k) for k in SHARES]
    worse = (
        F.when(now["n"] == 0, "none").when((good["n"] >= MANY) & (now["n"] < good["n"] * LEFT), "fewer")
        .when((now["n"] >= SOME) & (now["titles"] < FEW_TITLES) & (good["titles"] >= OWN_TITLES), "same").otherwise(F.coalesce(*lost))
    )
    return F.when(had, worse)


def against_last_good(readings: DataFrame, key: str, order: str, fields: list[str], judge: Callable[[Column, Column], Column] = trouble) -> DataFrame:
    """`readings` (key, order, fields) with `trouble`, by judge(reading, last good one), and `good`, the order of the latter.

    A reading without trouble and with something in it (`n`) is the good one of those that follow. A key's readings are one array
    in their order: they are as many as its days, not its rows. A key repeated on one day counts twice, in the order of the fields.
    """
    record = F.struct(order, *fields)
    kept = readings.select(key, record.alias("x"))
    kind = kept.schema["x"].dataType.simpleString()
    out = f"array<struct<x:{kind},trouble:string,good:{readings.schema[order].dataType.simpleString()}>>"

    def step(state: Column, x: Column) -> Column:
        why = judge(x, state["good"])
        line = F.struct(x.alias("x"), why.alias("trouble"), state["good"][order].alias("good"))
        return F.struct(F.when(why.isNull() & (x["n"] > 0), x).otherwise(state["good"]).alias("good"), F.concat(state["out"], F.array(line)).alias("out"))

    first = F.struct(F.lit(None).cast(kind).alias("good"), F.array().cast(out).alias("out"))
    folded = kept.groupBy(key).agg(F.sort_array(F.collect_list("x")).alias("h")).select(key, F.aggregate("h", first, step, lambda s: s["out"]).alias("out"))
    return folded.select(key, F.explode("out").alias("o")).select(key, "o.x.*", "o.trouble", "o.good")
