"""Step functions of counters: yields, bonuses, back-off, verdicts, estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Rounded, halves upwards also below zero."""
    return F.floor(c + 0.5)


def chao1(seen: Column, once: Column, twice: Column) -> Column:
    """Chao's estimate of how many there are, from how many were seen, once and twice."""
    once = once.cast("double")
    return F.when(twice > 0, seen + once * once / (2 * twice)).otherwise(seen + once * (once - 1) / 2)


def yield_score(visits: Column, with_events: Column, added: Column, new_rate: Column) -> Column:
    good = F.least(F.lit(7), half_up(1 + 6 * with_events / visits)) + (added > 0).cast("int")
    stale = (visits >= 5) & (new_rate < 0.1)
    return F.when(with_events == 0, -F.least(F.lit(6), 1 + F.floor(visits / 3))).when(stale, F.least(F.lit(1), good)).otherwise(good).cast("long")


def host_bonus(added: Column, with_events: Column, read: Column, new_rate: Column) -> Column:
    return (
        F.when(new_rate < 0.05, 0).when(added >= 10, 2).when((added > 0) | (with_events > 0), 1)
        .when(read >= 6, -F.least(F.lit(5), 1 + F.floor(read / 8))).otherwise(0).cast("long")
    )


def region_of(home: Column, abroad: Column) -> Column:
    """Verdict of tallies: null below three, else by the home share."""
    share = home / F.nullif(home + abroad, F.lit(0))
    return F.when(home + abroad < 3, None).when(share < 0.15, "abroad").when(share > 0.85, "home").otherwise("mixed")


def backoff_days(failures: Column) -> Column:
    """Days until a page that failed so often in a row is tried again."""
    return F.when(failures > 0, F.least(F.lit(30.0), F.pow(F.lit(2.0), failures - 1))).otherwise(30.0)


def ema(values: Column, keep: float) -> Column:
    """Exponential moving average of an ordered array from 0: keep * old + (1 - keep) * new."""
    return F.aggregate(values, F.lit(0.0), lambda a, x: a * keep + x * (1 - keep))
