"""The vector index against all pairs."""

import numpy as np

from harvestry.llm import vectors
from harvestry.llm.graph import forest
from harvestry.llm.registry import queries


def brute(ids, x, labels, cosine=0.98):
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) and lab is not None for v, lab in zip(x, labels, strict=True)]
    n = len(ids)
    order = sorted(range(n), key=lambda i: ids[i])
    met = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            i, j = order[a], order[b]
            if i != j and ok[i] and ok[j] and labels[i] == labels[j] and len(x[i]) == len(x[j]):
                u, v = np.array(x[i], float), np.array(x[j], float)
                met[a, b] = u @ v / np.sqrt((u @ u) * (v @ v)) >= cosine
    label = forest(n, *np.nonzero(met))
    return sorted((ids[order[a]], int(met[a].sum()), ids[order[label[a]]]) for a in range(n))


def cloud(rng, n, d=16):
    g = np.random.default_rng(rng.randrange(1000))
    centres = g.normal(size=(n // 6, d))
    return [list(map(float, centres[i % len(centres)] + g.normal(size=d) * rng.choice([0.02, 0.05, 0.1]))) for i in range(n)]


def test_against_all_pairs(spark, rng, monkeypatch):
    x = cloud(rng, 240)
    x += [x[0]] * 5 + [[v * 3 for v in x[1]], None, [], [0.0] * 16, [float("nan")] * 16, [1.0] * 15 + [None], [1.0, 2.0], [2.0, 4.0]]
    labels = [i % 3 for i in range(240)] + [0] * 5 + [1, 0, 0, 0, 0, 0, 2, 2]
    ids = [(i * 37) % 997 for i in range(len(x))]
    want = brute(ids, x, labels)
    df = spark.createDataFrame([(i, v, lab, 1, "k") for i, v, lab in zip(ids, x, labels, strict=True)], "vec_id long, embedding array<double>, label int, n int, cell string")
    for part in (vectors.PART, 8):
        monkeypatch.setattr(vectors, "PART", part)
        got = vectors.near_duplicates(df).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_traversal_finds_pairs(rng):
    """Without a target recall every near pair's cells are visited; with it at least 0.999 of those at the threshold, either way."""
    g = np.random.default_rng(1)
    x = vectors.unit(g.normal(size=(3000, 64)))
    turn = g.normal(size=x.shape)
    turn -= (turn * x).sum(1)[:, None] * x
    y = x * 0.9801 + vectors.unit(turn) * (1 - 0.9801**2) ** 0.5
    for recall, least in ((None, 1.0), (vectors.RECALL, 0.999)):
        index = vectors.build(x, 0.98, recall)
        from_x, from_y = list(index.cells(x)), list(index.cells(y))
        assert np.mean([a[0] in b or b[0] in a for a, b in zip(from_x, from_y, strict=True)]) >= least
        p, a, q, b = index.borders(x[:50])
        for k in range(50):  # in order, and all that are in reach
            bounds = [a[k, i] ** 2 + b[k, j] ** 2 for i, j in from_x[k]]
            assert bounds == sorted(bounds) and len(bounds) == (a[k][:, None] ** 2 + b[k][None, :] ** 2 <= index.reach2).sum()


def test_the_grid_follows_the_rows():
    """As many rows to a cell from 50 thousand to 10 million, and as much found in the finer grid."""
    for rows in (50_000, 1_000_000, 10_000_000):
        assert 0.8 * vectors.CELL <= rows / vectors.grid(rows, vectors.SAMPLE) ** 2 <= vectors.CELL
    g = np.random.default_rng(3)
    x = vectors.unit(g.normal(size=(3000, 64)))
    turn = g.normal(size=x.shape)
    turn -= (turn * x).sum(1)[:, None] * x
    y = x * 0.9801 + vectors.unit(turn) * (1 - 0.9801**2) ** 0.5
    index = vectors.build(x, 0.98, vectors.RECALL, 1_000_000)
    assert len(index.first) > 100
    assert np.mean([a[0] in b or b[0] in a for a, b in zip(index.cells(x), index.cells(y), strict=True)]) >= 0.999


def test_recall_on_clouds(spark, rng):
    g = np.random.default_rng(2)
    centres = g.normal(size=(60, 64))
    x = [list(map(float, centres[i % 60] + g.normal(size=64) * 0.12)) for i in range(900)]
    want = brute(list(range(900)), x, [0] * 900)
    got = {r.vec_id: r for r in vectors.near_duplicates(spark.createDataFrame(list(zip(range(900), x, [0] * 900)), "vec_id long, embedding array<float>, label int")).collect()}
    links = sum(n for _, n, _ in want)
    assert links > 1000 and sum(got[i].n_links for i, _, _ in want) >= 0.999 * links


def test_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.near_duplicates(df).count() == 0
    df = spark.createDataFrame([(1, None, 1), (2, [0.0], None)], "vec_id long, embedding array<float>, label int")
    assert [(r.n_links, r.kept) for r in vectors.near_duplicates(df).collect()] == [(0, True)] * 2


def test_whole_table(spark, base):
    rows = spark.read.parquet(f"{base}/embeddings.parquet").collect()
    got = queries()["op7_embedding_dedup"](spark, base).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute([r.vec_id for r in rows], [r.embedding for r in rows], [r.label for r in rows])
