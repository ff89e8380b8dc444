"""Near-duplicate vectors through an inverted multi-index.

Unit vectors are cut into halves; each half has a codebook of its own, and the two form a grid of cells. Every vector is
in the cell of its two nearest centroids. A query visits cells in the order of a multi-sequence traversal, by growing
distance from its halves to the borders of the cells' regions, until the target recall: the reach beyond which no more
than 1 - RECALL of the pairs at the very threshold lie, whose difference points anywhere, and none of the pairs found by
brute force in the sample. A pair is found if either of its vectors visits the other's cell, and then counts for both.
Found candidates are verified in double precision.

The codebooks and the reach are fitted on at most `SAMPLE` vectors, chosen by a hash; the grid's size follows the number of
vectors, so that a cell holds as many at any size. Every distinct vector is indexed and every one is a query. Equal vectors are one entry with a weight. A recall of 1 against brute force is what the tests
measure; `recall=None` visits every cell in the reach of the threshold, which is exact and slower.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm.common import each_batch, keep, read_table, segments
from harvestry.llm.graph import connected_components, forest

COSINE, SAMPLE, RECALL = 0.98, 20_000, 0.9995
#: Sampled vectors that are compared with each other for the reach.
PAIRED = 4_000
#: Entries a part of a cell holds on average at most.
PART = 512
SLACK = 1e-4
#: Entries that a cell of the grid holds on average, and sampled vectors that a centroid needs.
CELL, LEAST = 64, 20


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1))[:, None]


def codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """Centroids by Lloyd's method from evenly spread rows."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.linspace(0, len(distinct) - 1, min(size, len(distinct))).astype(int)].copy()
    for _ in range(rounds):
        near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        counts = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return np.unique(c, axis=0)


def borders(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's own centroid, and its distances to the borders of all centroids' regions with that one's (0 for its own)."""
    squares = (c * c).sum(1)
    d = squares - 2 * x @ c.T  # less each row's own square, which differences do without
    own = d.argmin(1)
    apart = np.sqrt(np.maximum(squares[:, None] + squares - 2 * c @ c.T, 0))
    away = np.maximum((d - d[np.arange(len(x)), own][:, None]) / np.maximum(2 * apart[own], 1e-12), 0)
    away[np.arange(len(x)), own] = 0
    return own, away


@dataclass
class Index:
    """The codebooks of vectors of one length, and the squared reach of a query."""

    first: np.ndarray
    second: np.ndarray
    half: int
    reach2: float

    def borders(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return *borders(x[:, : self.half], self.first), *borders(x[:, self.half :], self.second)

    def cells(self, x: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        """The cells that each row visits, its own first."""
        p, a, q, b = self.borders(x)
        one, two = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        for k in range(len(x)):
            i, j = [p[k], *one[k][one[k] != p[k]]], [q[k], *two[k][two[k] != q[k]]]
            yield list(traverse((np.array(i), np.array(j)), (a[k][i], b[k][j]), self.reach2))


def grid(rows: int, sampled: int) -> int:
    """Centroids of a half, so that a cell of the grid holds about CELL of the rows, as far as the sample can tell them apart."""
    return int(np.clip(np.ceil((rows / CELL) ** 0.5), 1, max(1, sampled // LEAST)))


def build(x: np.ndarray, cosine: float, recall: float | None, rows: int | None = None) -> Index:
    """An index for `rows` unit vectors like the rows of x, which are as many unless told."""
    size, half = grid(rows or len(x), len(x)), x.shape[1] // 2
    index = Index(codebook(x[:, :half], size) if half else np.zeros((1, 0)), codebook(x[:, half:], size), half, 2 - 2 * cosine + SLACK)
    if recall is None or x.shape[1] < 8:
        return index
    some = x[:PAIRED]
    p, a, q, b = index.borders(some)
    rng = np.random.default_rng(0)
    turn = rng.normal(size=some.shape)
    turn -= (turn * some).sum(1)[:, None] * some
    p2, _, q2, _ = index.borders(some * cosine + unit(turn) * (1 - cosine * cosine) ** 0.5)
    rows = np.arange(len(some))
    needed = [np.quantile(a[rows, p2] ** 2 + b[rows, q2] ** 2, recall)]
    for i in range(0, len(some), 500):
        u, v = np.nonzero(some[i : i + 500] @ some.T >= cosine)
        needed.append((a[u + i, p[v]] ** 2 + b[u + i, q[v]] ** 2).max(initial=0))
    index.reach2 = min(index.reach2, float(max(needed)) + SLACK)
    return index


def traverse(order: tuple[np.ndarray, np.ndarray], away: tuple[np.ndarray, np.ndarray], radius2: float) -> Iterator[tuple[int, int]]:
    """Cells of the grid by growing bound, as far as the radius: the multi-sequence traversal of one query."""
    heap, seen = [(0.0, 0, 0)], {(0, 0)}
    while heap:
        bound, i, j = heappop(heap)
        if bound > radius2:
            return
        yield int(order[0][i]), int(order[1][j])
        for a, b in ((i + 1, j), (i, j + 1)):
            if a < len(order[0]) and b < len(order[1]) and (a, b) not in seen:
                seen.add((a, b))
                heappush(heap, (float(away[0][a] ** 2 + away[1][b] ** 2), a, b))


def linkable() -> Column:
    """Whether a row can link: a label, and a vector of finite numbers that are not all zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(F.col("label").isNotNull() & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, recall: float | None = RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of `vectors` (vec_id, embedding, label).

    Rows with a null label, and vectors that are null, empty, zero or hold null or non-finite numbers, link with
    nothing: 0 links, their own id, kept. So do vectors of different length. component_id is the smallest vec_id
    reachable. Rows that repeat a vec_id are rows of their own. Other columns are not read.
    """
    kind = "array<float>" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(F.col("embedding").cast(kind), lambda x: x + F.lit(0).cast(kind[6:-1])).alias("embedding"), "label")
    rows = rows.withColumns({"eid": F.xxhash64(F.lit(1), "label", "embedding"), "eid2": F.xxhash64(F.lit(2), "label", "embedding"), "ok": linkable()})
    rows = keep(rows, "vectors")
    known = rows.where("ok")
    # A vector is known by 128 bits of hashes; each distinct one then has a number of its own, which is written with it.
    groups = known.groupBy("eid", "eid2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("low"))
    groups = keep(groups.withColumns({"rank": F.xxhash64("eid", "eid2"), "gid": F.monotonically_increasing_id()}), "entries")
    chosen = groups.orderBy("rank", "gid").limit(sample).select("embedding").toArrow().column(0).to_pylist()
    pair = keep(_edges(groups, chosen, groups.count(), cosine, recall), "links")
    counts = pair.where("kind = 0").groupBy(F.col("a").alias("gid")).agg(F.sum("w").alias("more"))
    roots = connected_components(pair.where("kind = 1").select("a", "b"))
    rooted = groups.join(roots.withColumnRenamed("node", "gid"), "gid", "left").join(counts, "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    rooted = rooted.select("eid", "eid2", "root", "low", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("eid", "eid2", "n_links", "component_id")
    linked = known.select("vec_id", "eid", "eid2").join(named, ["eid", "eid2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _edges(groups: DataFrame, chosen: list[list[float]], rows: int, cosine: float, recall: float | None) -> DataFrame:
    """Rows (kind, a, b, w): kind 0 gives entry a's linked rows w found in one place, kind 1 links a spanning forest."""
    spark = groups.sparkSession
    schema = "kind int, a long, b long, w long"
    by_size: dict[int, list[list[float]]] = {}
    for v in chosen:
        by_size.setdefault(len(v), []).append(v)
    shared = spark.sparkContext.broadcast({n: build(unit(np.array(x, float)), cosine, recall, rows * len(x) // max(len(chosen), 1)) for n, x in by_size.items()})

    def visit(batch: pa.RecordBatch) -> pa.RecordBatch:
        gid = batch.column("gid").to_numpy()
        out: list[list[int]] = [[], [], []]
        vectors = batch.column("embedding").to_pylist()
        by_length: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_length.setdefault(len(v), []).append(i)
        for n, at in by_length.items():
            # For a length without a sampled vector there is one cell for all.
            found = shared.value[n].cells(unit(np.array([vectors[i] for i in at], float))) if n in shared.value else [[(-1, -1)]] * len(at)
            for i, cells in zip(at, found, strict=True):
                for k, (p, q) in enumerate(cells):  # the first is its own
                    out[0].append(i)
                    out[1].append(n << 40 | p + 1 << 20 | q + 1)
                    out[2].append(int(k > 0))
        return pa.RecordBatch.from_arrays([pa.array(gid[out[0]] if out[0] else [], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], ["gid", "cell", "query"])

    visits = keep(each_batch(groups.select("gid", "embedding"), visit, "gid long, cell long, query int").join(groups.select("gid", "label"), "gid"), "visits")
    # Cells that hold an entry and are visited by another; vectors join only after this, and cross one shuffle.
    sizes = visits.groupBy("label", "cell").agg(F.count("*").alias("count"), F.min("query").alias("first")).where("count > 1 and first = 0")
    parts = sizes.select("label", "cell", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    salted = visits.join(parts, ["label", "cell"]).withColumn("salt", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int"))
    units = salted.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).join(groups.select("gid", "n", "embedding"), "gid")
    units = units.select(F.xxhash64("label", "cell").alias("place"), F.col("label").cast("string").alias("label"), "cell", F.least("salt", "o").alias("p"), F.greatest("salt", "o").alias("q"), (F.col("salt") > F.col("o")).cast("int").alias("side"), "query", "gid", "n", "embedding")

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u in segments(batches, ["place", "p", "q", "label", "cell"]):
            own, side = u.column("query").to_numpy() == 0, u.column("side").to_numpy()
            if not own.any():
                continue
            gid, n = u.column("gid").to_numpy(), u.column("n").to_numpy()
            x = unit(np.array(u.column("embedding").to_pylist(), float))
            mine = np.flatnonzero(own)
            met = (x @ x[mine].T >= cosine) & (gid[:, None] != gid[mine][None, :])
            if u.column("p")[0] != u.column("q")[0]:
                met &= side[:, None] != side[mine][None, :]
            i, j = np.nonzero(met)
            if not len(i):
                continue
            # A visitor counts what it finds here; so does the one found, unless that one's own visit finds the pair too.
            j, guest = mine[j], ~own[i]
            if guest.any() and (index := shared.value.get(x.shape[1])):
                p, a, q, b = index.borders(x)
                alone = guest & (a[j, p[i]] ** 2 + b[j, q[i]] ** 2 > index.reach2)
                i, j = np.concatenate([i, j[alone]]), np.concatenate([j, i[alone]])
            w = np.bincount(i, n[j], minlength=len(gid)).astype(np.int64)
            label = forest(len(gid), i, j)
            tied, counted = np.flatnonzero(label != np.arange(len(gid))), np.flatnonzero(w)
            kind = np.concatenate([np.zeros(len(counted), np.int32), np.ones(len(tied), np.int32)])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(np.concatenate([gid[counted], gid[tied]])), pa.array(np.concatenate([gid[counted], gid[label[tied]]])), pa.array(np.concatenate([w[counted], np.zeros(len(tied), np.int64)]))], ["kind", "a", "b", "w"])

    keys = ["place", "p", "q", "label", "cell"]
    dealt = units.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    return dealt.mapInArrow(compare, schema)


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "embeddings"))
