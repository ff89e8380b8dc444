"""Greedy merging in rounds against pairs taken one after the other."""

import pytest
from pyspark.sql import functions as F

from harvestry.operators.merging import greedy_groups
from harvestry.plans import resolution as R


def one_by_one(pairs, keys, rule):
    group = {i: frozenset([i]) for p in pairs for i in p[:2]}
    held = {i: {k for j, k in keys if j == i and k is not None} for i in group}

    def forbidden(x, y):
        kx, ky = (set().union(*(held[i] for i in g)) for g in (x, y))
        return bool(kx & ky) if rule == "share" else bool(kx and ky and len(kx | ky) > 1)

    for a, b, _ in sorted(pairs, key=lambda p: (p[2] is None, -(p[2] or 0), p[0], p[1])):
        x, y = group[a], group[b]
        if x != y and not forbidden(x, y):
            for i in x | y:
                group[i] = x | y
    return {i: min(g) for i, g in group.items()}


def check(spark, pairs, keys, rule):
    got = greedy_groups(spark.createDataFrame(pairs, "a long, b long, score double"), spark.createDataFrame(keys, "id long, key string"), rule)
    assert {r.id: r.group for r in got.collect()} == one_by_one(pairs, keys, rule)


@pytest.mark.parametrize("rule", ("differ", "share"))
def test_random_pairs(spark, rng, rule):
    for n, kinds in ((24, 4), (24, 3)):
        pairs = [(a, b, rng.choice((1.0, 0.9, 0.8, 0.5))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.12]
        check(spark, pairs, [(i, rng.choice([None, *"abcdefgh"[:kinds]])) for i in range(n)], rule)


@pytest.mark.parametrize("rule", ("differ", "share"))
def test_equal_titles_and_chains(spark, rule):
    copies = [(a, b, 1.0) for a in range(10) for b in range(a + 1, 10)]
    check(spark, copies, [(i, "abc"[i % 3]) for i in range(10)], rule)
    check(spark, [(i, i + 1, 1 - i / 100) for i in range(8)], [(i, None if i % 2 else "ab"[i % 4 // 2]) for i in range(9)], rule)


def test_odd_pairs(spark):
    pairs = [(1, 1, 1.0), (2, 1, 0.5), (1, 2, 0.9), (3, 2, None), (4, 5, 0.7)]
    check(spark, pairs, [(1, "x"), (1, None), (9, "y")], "differ")
    assert greedy_groups(spark.createDataFrame([], "a long, b long, score double"), spark.createDataFrame([], "id long, key string"), "share").count() == 0


def test_pairs_never_meet_in_a_task(spark):
    """A hub of very many pairs is joined and grouped, not gathered."""
    pairs = spark.range(1, 20_001).selectExpr("0 AS a", "id AS b", "1.0 AS score")
    out = greedy_groups(pairs, spark.range(0).selectExpr("id", "'' AS key"), "differ")
    assert out.select("group").distinct().count() == 1 and out.count() == 20_001


def copied_titles(rng, copies):
    words = [f"w{i}q" for i in range(9)]
    said = [" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(8)]
    return [(i, rng.choice(said)) for i in rng.sample(range(1000), copies)]


@pytest.mark.parametrize("rule", ("differ", "share"))
@pytest.mark.parametrize("raised", (False, True))
def test_classes_of_copies(spark, rng, rule, raised, monkeypatch):
    """Copies taken as classes are merged as all their pairs one after the other; also where other classes count as wholly alike."""
    if raised:
        compared = R.similar_classes
        monkeypatch.setattr(R, "similar_classes", lambda *a: compared(*a).withColumn("sim", F.when(F.col("sim") >= 0.55, 1.0).otherwise(F.col("sim"))))
    rows = copied_titles(rng, 45)
    keys = [(i, rng.choice([None, *"abc"])) for i, _ in rows]
    titles = spark.createDataFrame(rows, "id long, title string")
    pairs = [(r.a, r.b, round(r.sim, 6)) for r in R.similar_titles(titles, "id").collect()]
    start, left, held = R.first_groups(titles, "id", spark.createDataFrame(keys, "id long, key string"), rule)
    merged = {r.id: r.group for r in greedy_groups(left, held, rule).collect()}
    want = one_by_one(pairs, keys, rule)
    assert {r.id: merged.get(r.at, r.at) for r in start.collect()} == {i: want.get(i, i) for i, _ in rows}


def test_copies_make_no_pairs(spark):
    """Two thousand copies of a title are linked and merged without their two million pairs."""
    rows = spark.range(2000).selectExpr("id", "concat('Lantern night ', CASE WHEN id % 2 = 0 THEN 'brookton' ELSE 'millford' END, ' velvet') AS title")
    rows = rows.union(spark.range(2000, 2020).selectExpr("id", "concat('alone', id, ' x', id) AS title"))
    start, left, held = R.first_groups(rows, "id", rows.selectExpr("id", "id % 10 AS key"), "share")
    assert start.select("at").distinct().count() == 400 + 20
    assert left.count() == 200 * 200
    assert R.similar_classes(R.title_classes(rows, "id")[1]).count() == 1
