"""Document fingerprints from improbable features.

Every window of 64 bytes is a candidate feature. Its entropy, in a thousand steps, says how ordinary it is: a histogram over
all windows of all documents ranks the entropies, rarest first. In each run of 64 neighbouring windows the one of the lowest
rank gets a vote, and windows of at least 16 votes are the text's features. Their hashes set five bits each in Bloom
filters of 2048 bits; a filter takes 160 features, then the next one in the chain begins. Two filters are as like as their
common bits, beyond those that chance gives, are to the most that they could share; a fingerprint with fewer filters is as
like another as its filters' best matches are on average.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm.common import bounded_batches, read_table

WINDOW, VOTES, GRADES = 64, 16, 1000
BITS, HASHES, FEATURES = 2048, 5, 160
#: Windows of a lower entropy (one letter repeated, rulers) say nothing.
WEAK = 100
#: Bytes of texts that are worked on together, and windows of a longer text that are.
BLOCK, SLICE = 1 << 20, 1 << 20
#: Documents that share a range of doc_id, on average, and ranges at most (then they are longer; they stream in any length).
RANGE_ROWS, RANGES = 512, 100_000
LOWEST = -(1 << 63)

_n = np.arange(WINDOW + 1)
#: n log2 n in units of a grade's 1024th part.
TERM = np.rint(_n * np.log2(np.maximum(_n, 1)) * 1024 * GRADES / (WINDOW * np.log2(WINDOW))).astype(np.int64)
FULL = int(TERM[WINDOW])
ODD_WORDS = np.random.default_rng(11).integers(0, 1 << 63, WINDOW // 8, np.uint64) * np.uint64(2) + np.uint64(1)


def grades(data: np.ndarray) -> np.ndarray:
    """The entropy of each window of `data` (bytes), from 0 to GRADES.

    Sliding by a byte takes one letter out and one in, so only their counts matter: how often the letter that goes stands in its
    window, and the letter that comes in the bytes before it. Both follow from the places of each letter in order.
    """
    n = len(data)
    if n < WINDOW:
        return np.zeros(0, np.int16)
    order = np.argsort(data, kind="stable")
    keys = data[order].astype(np.int64) * (n + WINDOW) + order
    index = np.arange(n)
    after = np.searchsorted(keys, keys + WINDOW)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    ahead[order] = after - index
    behind[order] = index - np.cumsum(np.bincount(after, minlength=n + 1)[:n])
    gone, come = ahead[: n - WINDOW], behind[WINDOW:]
    change = TERM[gone - 1] - TERM[gone] + TERM[come + 1] - TERM[come]
    first = int(TERM[np.bincount(data[:WINDOW])].sum())
    sums = first + np.concatenate([[0], np.cumsum(change)])
    return ((FULL - sums) >> 10).astype(np.int16)


def blocks(texts: Sequence[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Numbers of texts, their bytes one after the other, and where each begins (and the end), about BLOCK bytes at a time."""
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append(i)
        size += len(text)
        if size >= BLOCK or i == len(texts) - 1:
            yield held, np.frombuffer(b"".join(texts[k] for k in held), np.uint8), np.concatenate([[0], np.cumsum([len(texts[k]) for k in held])])
            held, size = [], 0


def inside(n: int, starts: np.ndarray) -> np.ndarray:
    """Whether the window at each of n - WINDOW + 1 places lies inside one text."""
    ok = np.ones(n + 1, np.int8)
    for end in starts[1:]:
        ok[max(0, end - WINDOW + 1) : end] = 0
    return ok[: max(0, n - WINDOW + 1)].astype(bool)


def histogram(docs: DataFrame) -> np.ndarray:
    """How many windows of all texts have each grade."""
    bounded_batches(docs.sparkSession)

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(GRADES + 1, np.int64)
        for batch in batches:
            for _, data, starts in blocks([v.as_py() or b"" for v in batch.column(0).cast(pa.large_binary())]):
                ok = inside(len(data), starts)
                for i in range(0, len(ok), SLICE):
                    part = grades(data[i : i + SLICE + WINDOW - 1])
                    n += np.bincount(part[ok[i : i + SLICE]], minlength=GRADES + 1)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(n[seen])], ["grade", "n"])

    out = np.zeros(GRADES + 1, np.int64)
    for r in docs.select("text").mapInArrow(over, "grade int, n long").groupBy("grade").agg(F.sum("n").alias("n")).collect():
        out[r.grade] = r.n
    return out


def ranks(n: np.ndarray) -> np.ndarray:
    """The rank of each grade, rarest first and the lower grade first among equals; weak grades have the last rank of all."""
    rank = np.empty(GRADES + 1, np.int64)
    rank[np.argsort(n, kind="stable")] = np.arange(GRADES + 1)
    rank[:WEAK] = GRADES + 1
    return rank


def feature_places(data: np.ndarray, starts: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the features of a block's texts begin, in order. A long text goes in slices, so memory beyond its bytes is bounded."""
    ok = inside(len(data), starts)
    last, votes = GRADES + 1, np.zeros(len(ok), np.uint8)
    for i in range(0, len(ok), SLICE):
        here = ok[i : i + SLICE + WINDOW - 1]  # what the runs that begin in this slice reach
        low = (np.where(here, rank[grades(data[i : i + len(here) + WINDOW - 1])], last) << 40) + np.arange(len(here))
        wide = 1
        while wide < WINDOW:  # the least of twice as many neighbours each time
            low[:-wide] = np.minimum(low[:-wide], low[wide:])
            wide *= 2
        winner = low[:SLICE][here[:SLICE]]
        votes[i : i + len(here)] += np.bincount(winner[winner < last << 40] & ((1 << 40) - 1), minlength=len(here)).astype(np.uint8)
    return np.flatnonzero(votes >= VOTES)


def mixed(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of 64 bytes."""
    h = np.zeros(len(rows), np.uint64)
    for k, word in enumerate(np.ascontiguousarray(rows).view("<u8").T):
        h = (h ^ word) * ODD_WORDS[k]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def bloom(hashes: np.ndarray) -> np.ndarray:
    """The chained filters of a text's feature hashes, BITS // 64 words each; a feature counts where it stands first."""
    hashes = hashes[np.sort(np.unique(hashes, return_index=True)[1])]
    out = np.zeros((-(-len(hashes) // FEATURES), BITS), bool)
    row = np.arange(len(hashes)) // FEATURES
    for k in range(HASHES):
        out[row, (hashes >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
    return np.packbits(out, axis=1)


def fingerprints(texts: Sequence[bytes], rank: np.ndarray) -> list[np.ndarray]:
    """The filters of each text, as rows of bytes. A text without any feature is one feature as a whole; an empty one has no filter."""
    out: list[np.ndarray] = []
    for held, data, starts in blocks(texts):
        at = feature_places(data, starts, rank)
        hashes = mixed(data[at[:, None] + np.arange(WINDOW)]) if len(at) else np.zeros(0, np.uint64)
        cuts = np.searchsorted(at, starts)
        for k, i in enumerate(held):
            own = hashes[cuts[k] : cuts[k + 1]]
            if not len(own) and texts[i]:
                own = np.frombuffer(hashlib.sha256(texts[i]).digest()[:8], "<u8")
            out.append(bloom(own))
    return out


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """0 to 1: the mean, over the filters of the fingerprint with fewer, of the best match; 1 where the two are equal."""
    if x.shape == y.shape and (x == y).all():
        return 1.0
    if not len(x) or not len(y):
        return 0.0
    if len(x) > len(y):
        x, y = y, x
    x, y = x.view("<u8"), y.view("<u8")
    bits_x, bits_y = np.bitwise_count(x).sum(1), np.bitwise_count(y).sum(1)
    total = 0.0
    for one, bits in zip(x, bits_x.tolist(), strict=True):
        best = 0.0
        for k in range(0, len(y), 1024):
            common = np.bitwise_count(y[k : k + 1024] & one).sum(1)
            chance, most = bits * bits_y[k : k + 1024] / BITS, np.minimum(bits, bits_y[k : k + 1024])
            best = max(best, float(((common - chance) / np.maximum(most - chance, 1e-9)).max()))
        total += min(best, 1.0)
    return total / len(x)


def written(x: np.ndarray) -> str:
    """The filters in hexadecimal digits, one after the other."""
    return x.tobytes().hex()


def edited(text: str, following: str) -> str:
    """`text` with its last half (floor of its code points) replaced by as many of the first ones of `following`, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def dealt(docs: DataFrame) -> DataFrame:
    """doc_id, text, range, tail: all documents, dealt by ranges of doc_id and in order inside each; the first ones of a range
    stand at the end of the range before it too (of the first range, at the end of the last), marked as its tail.

    Only range bounds reach the driver: one id for RANGE_ROWS documents.
    """
    spark = docs.sparkSession
    ids = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("k"))
    n, lowest = ids.agg(F.count("*"), F.min("k")).first()
    parts = min(RANGES, max(1, -(-n // RANGE_ROWS)))
    shares = [i / parts for i in range(1, parts)]
    bounds = sorted(set(ids.agg(F.percentile_approx("k", shares, max(10_000, 10 * parts))).first()[0]) - {lowest}) if shares else []
    starts = np.array([LOWEST if lowest is None else lowest, *bounds], np.int64)
    shared = spark.sparkContext.broadcast(starts)

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = shared.value
        for batch in batches:
            key = batch.column(0).fill_null(LOWEST).to_numpy()
            of = np.searchsorted(starts, key, "right") - 1
            first = np.flatnonzero(starts[np.maximum(of, 0)] == key)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of.astype(np.int32)), pa.array(np.zeros(len(of), bool))], ["doc_id", "text", "range", "tail"])
            if len(first):
                again = batch.take(pa.array(first))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(((of[first] - 1) % len(starts)).astype(np.int32)), pa.array(np.ones(len(first), bool))], ["doc_id", "text", "range", "tail"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(over, "doc_id long, text string, range int, tail boolean")
    return rows.repartition("range").sortWithinPartitions("range", "tail", F.col("doc_id").asc_nulls_first(), F.coalesce("text", F.lit("")))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Documents stand in the order of doc_id, unknown ids first, then of their texts; the next one of the last is the first.
    So rows that repeat a doc_id follow each other, and of a single document the next one is itself. A null text is empty;
    an empty text has the empty fingerprint, like only to itself. Texts of under 64 bytes, and others without a feature, are
    one feature as a whole. Other columns are not read. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rank = docs.sparkSession.sparkContext.broadcast(ranks(histogram(docs)))
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def out(rows: list[tuple[int | None, str]], following: str) -> pa.RecordBatch:
        """The rows of some documents in order; `following` is the text after the last."""
        texts = [t for _, t in rows] + [following]
        changed = [edited(a, b).encode("utf-8", "replace") for a, b in zip(texts, texts[1:], strict=False)]
        prints = fingerprints([t.encode("utf-8", "replace") for t in texts], rank.value)
        altered = fingerprints(changed, rank.value)
        columns = [
            [i for i, _ in rows], [len(t) for _, t in rows], [hashlib.sha256(t).hexdigest() for t in changed], [written(p) for p in prints[:-1]], [written(p) for p in altered],
            [likeness(p, q) for p, q in zip(prints, altered, strict=False)], [likeness(p, q) for p, q in zip(prints, prints[1:], strict=False)],
        ]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        size, at = 0, None
        for batch in batches:
            for doc_id, value, of, tail in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if tail and at != of:
                    continue  # the tail has said what follows
                text = (value.as_py() or b"").decode("utf-8", "replace")
                if held and (tail or size >= BLOCK):
                    yield out(held, text)
                    held, size = [], 0
                at = None if tail else of
                if not tail:
                    held.append((doc_id, text))
                    size += len(text)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt(docs).mapInArrow(over, schema)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))
