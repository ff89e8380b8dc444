"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

A text's fingerprint has 64 bits; texts whose fingerprints differ in at most `radius` bits are linked. Each pair within
the radius is found exactly. Fingerprints are first dealt by pigeonhole: cut into m blocks, two of them within the radius
agree on all bits of some m - radius blocks, so each choice of such blocks gives a bucket key. Within a bucket,
fingerprints are sorted by population count and cut into tiles; a pair of tiles whose counts are further apart than the
radius is skipped, any other is compared by exclusive-or and bit counts. m follows the number of fingerprints, so that
the usual bucket stays small; it changes only the work, never the result. A bucket that is too large for one task is
salted into parts and compared part against part, each pair of parts on its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm.common import bounded_batches, each_batch, keep, read_table, segments, texts_of, tokens_of
from harvestry.llm.graph import connected_components, forest

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Fingerprints a part of a bucket holds on average at most; fingerprints in a tile.
PART, TILE = 512, 256


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits that are set in over half the XXH64 hashes of the word shingles; zero for a text without words."""
    words = tokens_of(text)
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    starts = np.zeros(len(words), np.int64)
    np.cumsum(np.fromiter(map(len, words), np.int64, len(words))[:-1] + 1, out=starts[1:])
    ends = np.append(starts[shingle:] - 1, len(joined)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts.tolist(), ends, strict=False)], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):  # the bits of a long text are counted in blocks
        part = hashes[at : at + 65_536]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and the signed 64-bit fingerprint of each row; null text counts as empty."""
    bounded_batches(docs.sparkSession)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.fromiter((fingerprint(t) for t in texts_of(batch.column(1))), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return each_batch(docs.select(F.col("doc_id").cast("long"), "text"), of, "doc_id long, fp long")


def masks(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the bucket keys for n fingerprints: all choices of m - radius of m blocks, m so that a bucket of
    evenly spread fingerprints holds about PART at most."""
    for m in range(radius + 1, 2 * radius + 4):
        edges = [round(64 * i / m) for i in range(m + 1)]
        blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(edges, edges[1:], strict=False)]
        kept = [sum(chosen) for chosen in combinations(blocks, m - radius)]
        if n >> min(x.bit_count() for x in kept) <= PART:
            break
    return kept


def close_pairs(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within the radius, between a and b or within a, tile by tile."""
    same = b is None
    sides = []
    for x in (a,) if same else (a, b):
        bits = np.bitwise_count(x)
        order = np.argsort(bits, kind="stable")
        sides.append([(order[i : i + TILE], x[order[i : i + TILE]], bits[order[i]], bits[order[min(i + TILE, len(x)) - 1]]) for i in range(0, len(x), TILE)])
    for i, (ids, x, low, high) in enumerate(sides[0]):
        for other, y, low_y, high_y in sides[0][i:] if same else sides[1]:
            if int(low_y) - int(high) > radius or int(low) - int(high_y) > radius:
                continue
            p, q = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
            yield ids[p], other[q]


def pairs_of_unit(unit: pa.Table, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of fingerprints within the radius, in a part (p = q) or between the two sides of a pair of parts."""
    if unit.column("p")[0] == unit.column("q")[0]:
        found, at = list(close_pairs(fp, None, radius)), (np.arange(len(fp)),) * 2
    else:
        side = unit.column("side").to_numpy()
        at = np.flatnonzero(side == 0), np.flatnonzero(side)
        found = list(close_pairs(fp[at[0]], fp[at[1]], radius))
    if not found:
        return np.zeros(0, int), np.zeros(0, int)
    return tuple(at[k][np.concatenate([x[k] for x in found])] for k in (0, 1))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `fp` as all pairs within the radius do.

    A compared pair of parts gives a spanning forest of its links, never all pairs.
    """
    keys = masks(prints.count(), radius)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    bands = prints.select(F.explode(F.array(*(F.struct(F.lit(i).alias("band"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"), "fp") for i, m in enumerate(keys)))).alias("x")).select("x.*")
    sizes = bands.groupBy("band", "key").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / PART).cast("int"))
    salted = bands.join(sizes, ["band", "key"]).withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in segments(batches, ["band", "key", "p", "q"]):
            fp = unit.column("fp").to_numpy().view(np.uint64)
            label = forest(len(fp), *pairs_of_unit(unit, fp, radius))
            tied = np.flatnonzero(label != np.arange(len(fp)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(fp[label[tied]].view(np.int64)), pa.array(fp[tied].view(np.int64))], ["a", "b"])

    return paired(salted, ["band", "key"], ["fp"]).mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row of `docs` (doc_id, text).

    Null text counts as empty; texts without words have fingerprint zero and link like any other. component_id is the
    smallest non-null doc_id reachable, null only where no id in the component is known. Rows that repeat a doc_id each
    keep their own fingerprint. Other columns are not read. An empty table gives no rows.
    """
    rows = keep(fingerprints(docs), "prints")
    prints = keep(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "fps")
    roots = connected_components(links(prints.select("fp"), radius))
    rooted = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Of similar_groups(): words of a shingle, the similarity that links, and the radius of its candidates. Two sets of shingles
#: with that similarity differ in 9.7 bits on average and in more than WIDE once in several hundred pairs.
WORDS, SIMILAR, WIDE = 5, 0.8, 18
#: Bands of minima and minima in a band: sets of that similarity meet in a band with a probability of 0.998.
BANDS, MINIMA = 12, 4
#: Shingles that a part of a loose group holds on average at most.
WHOLE = 1 << 18


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; one of all words where there are fewer, none without words."""
    of = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in tokens_of(text)), np.uint64)
    n = min(words, len(of))
    if not n:
        return of
    h = np.zeros(len(of) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ of[k : len(of) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return np.unique(h)


def sketch(hashes: np.ndarray) -> tuple[int, list[int]]:
    """The SimHash fingerprint of a set of hashes and the keys of its bands of minima."""
    if not len(hashes):
        return 0, [0] * BANDS
    odd = np.arange(1, BANDS * MINIMA + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95) | np.uint64(1)
    counts, low = np.zeros(64, np.int64), np.full(len(odd), 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 4096):  # a long text's are counted in blocks
        part = hashes[at : at + 4096]
        counts += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        turned = part[None, :] * odd[:, None]
        np.minimum(low, ((turned ^ turned >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)).min(1), out=low)
    fp = int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])
    return fp, [xxhash.xxh64_intdigest(low[k : k + MINIMA].tobytes(), k) for k in range(0, len(low), MINIMA)]


def similar(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect the sets as all pairs of at least this Jaccard similarity do."""
    m, sizes = len(sets), np.array([len(x) for x in sets])
    a, b = [np.zeros(0, int)], [np.zeros(0, int)]
    empty = np.flatnonzero(sizes == 0)
    a.append(empty[1:])
    b.append(empty[:1].repeat(max(len(empty) - 1, 0)))
    names, which = np.unique(np.concatenate(sets), return_inverse=True)
    of = np.repeat(np.arange(m), sizes)
    order = np.argsort(which, kind="stable")
    ends = np.searchsorted(which[order], np.arange(len(names) + 1))
    at = np.concatenate([[0], np.cumsum(sizes)])
    label = forest(m, a[1], b[1])
    for i in range(m):
        if not sizes[i] or (label == label[0]).all():
            continue
        own = which[at[i] : at[i + 1]]
        n = ends[own + 1] - ends[own]
        spots = np.repeat(ends[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        common = np.bincount(of[order[spots]], minlength=m)
        near = np.flatnonzero((common >= least * (sizes + sizes[i] - common) - 1e-9) & (common > 0) & (label != label[i]))
        if len(near):
            a.append(np.full(len(near), i))
            b.append(near)
            label[np.isin(label, label[near])] = label[i]
    return np.concatenate(a), np.concatenate(b)


def similar_groups(docs: DataFrame, similarity: float = SIMILAR, radius: int = WIDE) -> DataFrame:
    """doc_id and component_id for each row of `docs` (doc_id, text), doc_id being unique: the smallest doc_id that links of at
    least this Jaccard similarity of five-word shingles reach.

    Rows with equal sets of shingles are one set. Sets that share a band of minima are candidates if their SimHash
    fingerprints, compared tile by tile, are within the radius; candidates form loose groups, and inside a loose group all
    sets are compared exactly. So only bands and radius can lose a link (two in a thousand each at the similarity itself,
    fewer beyond it). Null text counts as empty; texts without words are one group. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(5)]
        for text in texts_of(batch.column(1)):
            hashes = shingles(text)
            fp, bands = sketch(hashes)
            known = xxhash.xxh3_128_digest(hashes.tobytes())
            for column, value in zip(out, (known[:8], known[8:], len(hashes), fp, bands), strict=True):
                column.append(value)
        signed = lambda x: np.array(x, np.uint64).view(np.int64)
        halves = [pa.array(np.frombuffer(b"".join(x), np.int64)) for x in out[:2]]
        bands = pa.FixedSizeListArray.from_arrays(pa.array(signed(out[4]).ravel()), BANDS).cast(pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), *halves, pa.array(out[2], pa.int64()), pa.array(signed(out[3])), bands], ["doc_id", "s1", "s2", "n", "fp", "bands"])

    rows = keep(each_batch(docs.select(F.col("doc_id").cast("long"), "text"), of, "doc_id long, s1 long, s2 long, n long, fp long, bands array<long>"), "sketches")
    sets = rows.groupBy("s1", "s2").agg(F.min("doc_id").alias("low"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands"))
    sets = keep(sets.withColumn("gid", F.monotonically_increasing_id()), "sets")

    bands = sets.select("gid", "fp", F.posexplode("bands").alias("band", "key"))
    sizes = bands.groupBy("band", "key").count().where("count > 1").withColumn("parts", F.ceil(F.col("count") / PART).cast("int"))
    salted = bands.join(sizes, ["band", "key"]).withColumn("salt", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int"))

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in segments(batches, ["band", "key", "p", "q"]):
            gid = unit.column("gid").to_numpy()
            label = forest(len(gid), *pairs_of_unit(unit, unit.column("fp").to_numpy().view(np.uint64), radius))
            tied = np.flatnonzero(label != np.arange(len(gid)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(gid[label[tied]]), pa.array(gid[tied])], ["a", "b"])

    loose = connected_components(keep(paired(salted, ["band", "key"], ["gid", "fp"]).mapInArrow(candidates, "a long, b long"), "candidates"))
    members = keep(loose.join(sets, loose.node == sets.gid).select("gid", "root", "low", "n"), "members")
    groups = members.groupBy("root").agg(F.ceil(F.sum("n") / WHOLE).cast("int").alias("parts"))
    spots = members.join(groups, "root").withColumn("parts", F.greatest("parts", F.lit(1))).withColumn("salt", F.pmod(F.xxhash64("gid"), F.col("parts")).cast("int"))

    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingles(t).tobytes() for t in texts_of(batch.column(1))], pa.binary())], ["low", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("low"), "text").join(members.select("low"), "low", "left_semi")
    spots = spots.join(each_batch(texts, whole, "low long, set binary"), "low")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in segments(batches, ["root", "p", "q"]):
            gid = unit.column("gid").to_numpy()
            a, b = similar([np.frombuffer(x, np.uint64) for column in unit.column("set").chunks for x in texts_of(column)], similarity)
            label = forest(len(gid), a, b)
            tied = np.flatnonzero(label != np.arange(len(gid)))
            if len(tied):
                yield pa.RecordBatch.from_arrays([pa.array(gid[label[tied]]), pa.array(gid[tied])], ["a", "b"])

    roots = connected_components(keep(paired(spots, ["root"], ["gid", "set"]).mapInArrow(verify, "a long, b long"), "links"))
    rooted = sets.join(roots.withColumnRenamed("node", "gid"), "gid", "left").withColumn("root", F.coalesce("root", "gid"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rows.select("doc_id", "s1", "s2").join(rooted.join(least, "root").select("s1", "s2", "component_id"), ["s1", "s2"]).select("doc_id", "component_id")


def paired(salted: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Rows dealt by (keys, p, q): each row of a part `salt` of `parts` to all pairs that the part is in; `side` is 1 in the second."""
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    units = salted.select(*keys, *columns, "salt", other.alias("o"))
    units = units.select(*keys, F.least("salt", "o").alias("p"), F.greatest("salt", "o").alias("q"), (F.col("salt") > F.col("o")).cast("int").alias("side"), *columns)
    n = int(salted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return units.repartition(n, *keys, "p", "q").sortWithinPartitions(*keys, "p", "q")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def brute_force(rows: list[tuple[int, str | None]], radius: int = RADIUS) -> dict[int, tuple[str, int]]:
    """The same by all pairs, for tests on small inputs."""
    prints = {i: fingerprint((t or "").encode()) for i, t in rows}
    root = {i: i for i in prints}

    def top(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(prints), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            x, y = sorted((top(i), top(j)))
            root[y] = x
    return {i: (f"{p:016x}", top(i)) for i, p in prints.items()}
