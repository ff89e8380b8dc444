"""Toxicity: class-conditional Kneser-Ney models of toxic and ordinary text.

Each class has an interpolated Kneser-Ney model of three levels: pairs of words, words, and stems (a word's first
STEM bytes). All levels count by continuation, that is by distinct words before, so a passage that is copied a thousand
times counts once. The discounted mass of a word goes to its stem, shared among the stem's words alike in both classes;
a stem's goes to a level that both classes share, where a stem counts by the number of classes that have it. So an
expression that is rare in both classes scores alike in both, one that is frequent in one class alone scores far apart,
and an unseen form of a known stem scores as the stem does.

A text's features are length-normalised differences of the two log-likelihoods, over the whole text and over its most
toxic window (where a word that comes back counts once), and those of its two most toxic words; a logistic regression on labelled texts that the counts have not seen turns them into a score.

The models are fitted on a bounded sample of labelled rows: at most `SAMPLE[c]` documents of class c, chosen by a hash of
doc_id. Everything else reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestry.llm.common import bounded_batches, each_batch, fold_id, give_back, read_table, texts_of, tokens_of

#: Most documents of the ordinary and of the toxic class to fit on.
SAMPLE = {0: 3000, 1: 2000}
#: Bytes of a class's sampled texts.
BYTES = 64 << 20
FOLDS, DISCOUNT, WINDOW, STEM = 5, 0.75, 16, 5
#: Marks that may stand around a word.
MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: A pair's pooled count from which on it is kept; the mass of others goes to the word level.
KEEP = 3


@dataclass
class Model:
    """ids: word -> 1..; stems: stem -> the numbers after those, the last number being the start of a text; p: per class
    and number the word level; back: per class and word before the mass that pairs leave to it; keys, gain: the kept
    pairs before * size + word, sorted, and their discounted share per class; w: the weights."""

    ids: dict[bytes, int]
    stems: dict[bytes, int]
    p: np.ndarray
    back: np.ndarray
    keys: np.ndarray
    gain: np.ndarray
    w: np.ndarray

    def ratios(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number and log-likelihood ratio of each word of all texts in turn; the number of words of each text."""
        get, stem, size = self.ids.get, self.stems.get, self.p.shape[1]
        words = [words_of(t) for t in texts]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.fromiter((get(w) or stem(w[:STEM], 0) for line in words for w in line), np.int64, int(counts.sum()))
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        first = (np.cumsum(counts) - counts)[counts > 0]
        before[first] = size - 1
        keys = before * size + ids
        at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        found = np.flatnonzero(self.keys[at] == keys) if len(self.keys) else at[:0]
        logs = []
        for c in (0, 1):
            p = self.back[c][before] * self.p[c][ids]
            p[found] += self.gain[c][at[found]]
            logs.append(np.log(p))
        return ids, logs[1] - logs[0], counts

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: 1, the mean ratio over all words, the largest mean over WINDOW words (a shorter text: its sum over
        WINDOW), and the largest ratios of two different words (0 where there are none)."""
        ids, ratio, counts = self.ratios(texts)
        ends = np.cumsum(counts)
        out = np.zeros((len(texts), 5))
        out[:, 0] = 1
        total = np.concatenate([[0.0], np.cumsum(ratio)])
        out[:, 1] = (total[ends] - total[ends - counts]) / np.maximum(counts, 1)
        high = np.flatnonzero(ratio > 1)
        doc = np.searchsorted(ends, high, "right")
        key = doc * self.p.shape[1] + ids[high]
        order = np.lexsort((high, key))
        again = (np.diff(key[order], prepend=-1) == 0) & (np.diff(high[order], prepend=-WINDOW - 1) < WINDOW)
        ratio[high[order[again]]] = 0
        best = order[np.lexsort((-ratio[high[order]], key[order]))]
        best = best[np.diff(key[best], prepend=-1) != 0]
        best = best[np.lexsort((-ratio[high[best]], doc[best]))]
        rank = np.arange(len(best)) - np.searchsorted(doc[best], doc[best])
        for k in (0, 1):
            out[doc[best[rank == k]], 3 + k] = ratio[high[best[rank == k]]]
        sums = np.concatenate([[0.0], np.cumsum(ratio)])
        for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
            if b > a:
                windows = sums[a + WINDOW : b + 1] - sums[a : b + 1 - WINDOW] if b - a > WINDOW else sums[b : b + 1] - sums[a]
                out[i, 2] = windows.max() / WINDOW
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ self.w, -30, 30)))


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words without marks around them; a word of marks alone stays."""
    return [w.strip(MARKS) or w for w in tokens_of(text)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(rows: list[tuple[int, bytes, bool]]) -> Model | None:
    """A model from (class, text, whether it is for the logistic weights); None unless both classes are there twice."""
    held = [r for r in rows if r[2]]
    rest = [r for r in rows if not r[2]]
    if {r[0] for r in held} != {0, 1} or {r[0] for r in rest} != {0, 1}:
        return None
    ids: dict[bytes, int] = {}
    found: list[list[np.ndarray]] = [[], []]
    for c, text, _ in rest:
        line = np.fromiter((ids.setdefault(w, len(ids) + 1) for w in words_of(text)), np.int64)
        found[c].append(np.concatenate([[-1, -1], line]))
    names: dict[bytes, int] = {}
    of = np.fromiter((names.setdefault(w[:STEM], len(names)) for w in ids), np.int64, len(ids))
    words, size = len(ids) + 1, len(ids) + 2 + len(names)
    pairs, follow = [], np.zeros((2, words))
    for c in (0, 1):
        x = np.concatenate(found[c])
        real = x[2:] > 0
        a, h, w = x[:-2][real] + 1, x[1:-1][real], x[2:][real]
        keys, pair = np.unique(np.where(h < 0, size - 1, h) * size + w, return_inverse=True)
        n = np.bincount(np.unique(a * len(keys) + pair) % max(len(keys), 1), minlength=len(keys))  # by distinct words before the pair
        follow[c] = np.bincount(keys % size, minlength=words)  # by distinct words before the word
        pairs.append((keys, n))
    stemmed = np.stack([np.bincount(of, f[1:], minlength=len(names)) for f in follow])
    classes = (stemmed > 0).sum(0).astype(float)
    unseen = max(1.0, float((stemmed.sum(0) == 1).sum()))  # as many unseen stems as were seen once
    kinds = np.bincount(of, minlength=len(names)) + 1.0  # words of a stem, and one unseen
    p = np.empty((2, size))
    for c in (0, 1):
        total = follow[c].sum()
        level = np.maximum(stemmed[c] - DISCOUNT, 0) / total
        left = 1 - level.sum()
        level += left * classes / (classes.sum() + unseen)
        known = np.maximum(follow[c] - DISCOUNT, 0) / total
        left_words = 1 - known.sum()
        p[c, 1:words] = known[1:] + left_words * (level / kinds)[of]
        p[c, words:-1] = left_words * level / kinds
        p[c, [0, -1]] = left_words * left / (classes.sum() + unseen)
    keys = np.unique(np.concatenate([k for k, _ in pairs]))
    both = np.zeros((2, len(keys)))
    for c in (0, 1):
        both[c, np.searchsorted(keys, pairs[c][0])] = pairs[c][1]
    given = np.stack([np.bincount(keys // size, n, minlength=size) for n in both])
    kept = both.sum(0) >= KEEP
    keys, both = keys[kept], both[:, kept]
    back, gain = np.ones((2, size)), np.zeros_like(both)
    for c in (0, 1):
        before = keys // size
        gain[c] = np.maximum(both[c] - DISCOUNT, 0) / np.maximum(given[c][before], 1)
        back[c] -= np.bincount(before, gain[c], minlength=size)
    model = Model(ids, {s: words + i for s, i in names.items()}, p, np.maximum(back, 1e-9), keys, gain, np.zeros(5))
    model.w = logistic(model.features([r[1] for r in held]), np.array([r[0] for r in held], float))
    return model


def sample(docs: DataFrame, labels: DataFrame, most: dict[int, int] = SAMPLE, folds: int | None = FOLDS) -> list[tuple[int, bytes, bool]]:
    """At most `most[c]` labelled documents of each class as fit() takes them, outside fold 0 if there are folds.

    They are those of the smallest hashes of doc_id; of each class, every fourth document in that order is for the logistic
    weights, so that both parts hold a class that has two documents. Rows that repeat a doc_id go to one part. A
    class's texts have at most BYTES bytes together: those that come after do not take part.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    if folds:
        known = known.where(fold_id("doc_id", folds) != 0)
    rank: Column = F.xxhash64("doc_id")
    chosen = None
    for c, n in most.items():
        part = known.where(F.col("toxic") == c).orderBy(rank, "doc_id").limit(n)
        chosen = part if chosen is None else chosen.union(part)
    spark = docs.sparkSession
    picked = F.broadcast(spark.createDataFrame(chosen.dropDuplicates(["doc_id"]).toPandas(), "doc_id long, toxic int"))
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("of"))
    # First the sizes of the texts, then those texts that the bounds take; one that equal rows repeat is fetched once.
    sizes = named.join(picked, "doc_id").select("doc_id", "toxic", "of", F.octet_length("text").alias("size"))
    of_class = Window.partitionBy("toxic").orderBy(rank, "doc_id", "of")
    known_sizes = None
    for c, n in most.items():
        part = sizes.where(F.col("toxic") == c).orderBy(rank, "doc_id", "of").limit(n).withColumn("sum", F.sum(F.coalesce("size", F.lit(0))).over(of_class)).where(F.col("sum") <= BYTES)
        known_sizes = part if known_sizes is None else known_sizes.union(part)
    taken = F.broadcast(spark.createDataFrame(known_sizes.groupBy("doc_id", "of", "toxic").agg(F.count("*").alias("times")).toPandas(), "doc_id long, of long, toxic int, times long"))
    rows = named.join(taken, ["doc_id", "of"]).dropDuplicates(["doc_id", "of"]).orderBy(rank, "doc_id", "of").select("doc_id", "toxic", "text", "times")
    found = rows.toArrow()
    texts, times = list(texts_of(found.column("text").combine_chunks())), found.column("times").to_pylist()
    ids, classes = (np.repeat(found.column(c).to_numpy(), times) for c in ("doc_id", "toxic"))
    held = np.zeros(len(ids), bool)
    for c in most:
        of = np.flatnonzero(classes == c)
        held[of] = np.cumsum(np.diff(ids[of], prepend=ids[of][:1]) != 0) % 4 == 1
    return list(zip(classes.tolist(), [t for t, n in zip(texts, times, strict=True) for _ in range(n)], held.tolist(), strict=True))


def score_documents(docs: DataFrame, model: Model | None) -> DataFrame:
    """`doc_id`, `score` and `predicted` (1 from 0.5 on) for each row; empty or null text is scored as a text without words.

    Without a model (no labelled text of both classes) every score is 0.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    give_back()

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = shared.value
        scores = known.score(list(texts_of(batch.column(1)))) if known and batch.num_rows else np.zeros(batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return each_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), of, "doc_id long, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(sample(docs, read_table(spark, sf_dir, "labels")))
    return score_documents(docs, model).select("doc_id", (fold_id("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")
