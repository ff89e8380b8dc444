"""Learned tag rules against a fold over verdicts in their order, and the order of origins."""

import random

from pyspark.sql import functions as F

from harvestry.operators.learning import NEEDED, learned_tags, sourced_tags, tag_rules


def by_hand(rows, remembered):
    state = {}
    for kind, key, title, tags, at in sorted((r for r in rows if r[1] is not None and r[4] is not None), key=lambda r: r[4]):
        n, counts, titles = state.setdefault((kind, key), [0, {}, []])
        if (title or "") in titles:
            continue
        if len(titles) < remembered:
            titles.append(title or "")
        state[kind, key][0] += 1
        for t in set(tags or ()) - {None}:
            counts[t] = counts.get(t, 0) + 1
    return {(kind, key, t, n, c, kind in NEEDED and n >= NEEDED[kind][0] and c / n >= NEEDED[kind][1]) for (kind, key), (n, counts, _) in state.items() for t, c in counts.items()}


def test_rules_are_those_of_a_fold(spark):
    draw = random.Random(7)
    rows = [(draw.choice(["venue", "page", "word", "other"]), draw.choice(["a", "b", None]), draw.choice([None, "", *"tuvwxyz"]), draw.choice([None, [], ["p"], ["p"], ["p"], ["p", "q", "p"], [None, "q"]]), at) for at in range(300)]
    rows.append(("venue", "a", "t", ["p"], None))
    df = spark.createDataFrame(rows, "kind string, key string, title string, tags array<string>, at long")
    for remembered in (3, 100):
        assert {tuple(r) for r in tag_rules(df, remembered).collect()} == by_hand(rows, remembered)
    assert tag_rules(df.limit(0)).count() == 0


def test_learned_tags(spark):
    rules = spark.createDataFrame([("venue", "a", "p", True), ("venue", "a", "q", False), ("word", "w", "r", True)], "kind string, key string, tag string, active boolean")
    items = spark.createDataFrame([(1, "venue", "a"), (1, "word", "w"), (2, "venue", "w"), (3, "word", None)], "id long, kind string, key string")
    assert {r.id: r.learned for r in learned_tags(items, rules).collect()} == {1: ["p", "r"]}


def test_origins(spark):
    cases = [
        (["film"], ["play"], ["talk"], None, False, [("play", "rules")]), (["film", "play"], ["film"], None, None, False, [("film", "rules")]), (["film", "play"], None, None, None, True, [("play", "rules")]),
        ([], None, ["talk"], ["play"], None, [("talk", "learned")]), (None, None, None, ["fest", "film", "talk"], False, [("film", "ai"), ("fest", "ai")]), (None, None, None, None, None, []), (["unknown"], None, ["talk"], None, None, []),
    ]
    df = spark.createDataFrame([(i, *c[:5]) for i, c in enumerate(cases)], "i int, a array<string>, b array<string>, c array<string>, d array<string>, live boolean")
    out = df.select("i", sourced_tags(*map(F.col, ("a", "b", "c", "d", "live")), ("film", "play", "fest", "talk"), "film", ("fest",)).alias("x"))
    assert {r.i: [tuple(x) for x in r.x] for r in out.collect()} == {i: c[5] for i, c in enumerate(cases)}
