"""What each filter of a set removes, in every order of applying them: a first-failure lookup.

A document's failures are a pattern of bits, one bit a filter. A table made once holds, for each pattern and each order of
the filters, the step at which a document with that pattern goes. Documents only index the table; np.bincount adds up, for
each part, order and step, how many documents of each label went there. Partial arrays are summed by Spark, so nothing but
counts crosses a shuffle after the patterns are known, and the texts are read once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm.common import bounded_batches, each_batch, keep, read_table

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS, LABELS = len(FILTERS), 4
#: Parts whose counts a task holds at once (23 kB each); beyond it hands them on and begins again.
HELD_PARTS = 1000
MARKS = re.compile(rb"[#$%&*|]")
CAPITALS = bytes(range(65, 91))


def step_table() -> np.ndarray:
    """For each of 32 patterns and 120 orders, the step (from 0) at which a document goes; 5 where none of its filters fails."""
    fails = (np.arange(1 << STEPS)[:, None] >> np.arange(STEPS)) & 1
    at = np.array([[FILTERS.index(f) for f in order] for order in ORDERS])
    seen = fails[:, at]
    return np.where(seen.any(2), seen.argmax(2), STEPS)


def own_failures(text: bytes) -> int:
    """The bits of the filters that look at one text: A few words, B few distinct words, C many capitals, D marks."""
    words = text.split()
    n, points = len(words), len(text) if text.isascii() else len(text.decode("utf-8", "replace"))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (n < 200) | (100 * len(set(words)) < 50 * n) << 1 | (100 * capitals > 3 * points) << 2 | bool(MARKS.search(text)) << 3


def patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, pattern, label (bit 0: good, bit 1: toxic), one row for each row of `docs`.

    Texts stay where they are read. Which text is the first of its kind is found over digests: the smallest doc_id of each,
    joined back by id and digest, so that a text with very many copies is a key of many values.
    """
    bounded_batches(docs.sparkSession)

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        own, digests = [], []
        for value in batch.column(2).cast(pa.large_binary()):
            text = value.as_py() or b""
            own.append(own_failures(text))
            digests.append(hashlib.sha256(text).digest())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "own", "digest"])

    small = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    rows = keep(each_batch(small, of, "doc_id long, part string, own int, digest binary"), "patterns")
    first = rows.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max(F.when(F.col("quality") == 1, 1).otherwise(0)) + F.max(F.when(F.col("toxic") == 1, 2).otherwise(0))).alias("label")
    )
    repeated = F.col("doc_id").isNotNull() & F.col("first").isNull()
    return rows.join(first, ["doc_id", "digest"], "left").join(marks, "doc_id", "left").select(
        "doc_id", "part", (F.col("own") + F.when(repeated, 1 << 4).otherwise(0)).alias("pattern"), F.coalesce("label", F.lit(0)).alias("label")
    )


Counts = dict[str, tuple[np.ndarray, np.ndarray]]
ARRAYS = "part string, removed array<long>, shown array<long>"
CELLS = len(ORDERS) * (STEPS + 1) * LABELS


def accumulated(rows: DataFrame, add: Callable[[Counts, pa.RecordBatch], None]) -> DataFrame:
    """One row for each part and task (more where a task sees very many parts), from what add() puts into a task's arrays."""

    def handed(parts: Counts) -> pa.RecordBatch:
        lists = [pa.array([x[k] for x in parts.values()], pa.list_(pa.int64())) for k in (0, 1)]
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.string()), *lists], ["part", "removed", "shown"])

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: Counts = {}
        for batch in batches:
            add(parts, batch)
            if len(parts) >= HELD_PARTS:
                yield handed(parts)
                parts = {}
        if parts:
            yield handed(parts)

    return rows.mapInArrow(over, ARRAYS)


def arrays_of(parts: Counts, part: str) -> tuple[np.ndarray, np.ndarray]:
    return parts.setdefault(part, (np.zeros(CELLS, np.int64), np.zeros(1 << STEPS, np.int64)))


def counted(rows: DataFrame) -> DataFrame:
    """part, removed (documents by order, step and label) and shown (documents by pattern), arrays."""
    table, order = step_table(), np.arange(len(ORDERS)) * ((STEPS + 1) * LABELS)

    def add(parts: Counts, batch: pa.RecordBatch) -> None:
        coded = batch.column(0).dictionary_encode()
        of, pattern, label = coded.indices.to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        for k, name in enumerate(coded.dictionary.to_pylist()):
            mine = of == k
            removed, shown = arrays_of(parts, name)
            removed += np.bincount((order + table[pattern[mine]] * LABELS + label[mine, None]).ravel(), minlength=CELLS)
            shown += np.bincount(pattern[mine], minlength=1 << STEPS)

    return accumulated(rows.select("part", "pattern", "label"), add)


def merged(partial: DataFrame) -> DataFrame:
    """The arrays of `partial` added up inside each task that reads them."""

    def add(parts: Counts, batch: pa.RecordBatch) -> None:
        for name, removed, shown in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            for held, more in zip(arrays_of(parts, name), (removed, shown), strict=True):
                held += more.values.to_numpy()

    return accumulated(partial, add)


def summed(partial: DataFrame, name: str) -> DataFrame:
    """The sum of the arrays `name` of each part, place by place: part, place, n. Sums are combined before the shuffle."""
    return partial.select("part", F.posexplode(name).alias("place", "n")).groupBy("part", "place").agg(F.sum("n").alias("n"))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order and step: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    A null text is empty; it fails A and, beside a smaller doc_id without text, E. A null lang and an empty one are the
    part ''. A row without doc_id has no smaller one beside it, and is none: it never fails E and makes no other row fail.
    Rows that repeat a doc_id count each for itself; equal texts of one doc_id are not copies of each other. Where labels
    repeat a doc_id, one row with 1 is enough. Other columns are not read. An empty table gives no rows.
    """
    partial = merged(keep(counted(patterns(docs, labels)), "audit"))
    per = (STEPS + 1) * LABELS
    filter_order = F.element_at(F.array(*map(F.lit, ORDERS)), F.col("order") + 1)
    cells = summed(partial, "removed").select("part", F.expr(f"div(place, {per})").cast("int").alias("order"), F.expr(f"div(place % {per}, {LABELS})").cast("int").alias("step0"), (F.col("place") % LABELS).alias("label"), "n")
    steps = cells.groupBy("part", "order", "step0").agg(
        F.sum("n").alias("removed"), F.sum(F.when(F.col("label").isin(1, 3), F.col("n")).otherwise(0)).alias("good_lost"), F.sum(F.when(F.col("label") >= 2, F.col("n")).otherwise(0)).alias("toxic_lost")
    )
    later = steps.groupBy("part", "order").agg(F.collect_list(F.struct("step0", "removed", "good_lost", "toxic_lost")).alias("s"))
    after = later.select("part", filter_order.alias("filter_order"), F.explode("s").alias("x"), "s").where(f"x.step0 < {STEPS}").select(
        "part", "filter_order", (F.col("x.step0") + 1).alias("step"), "x.removed", "x.good_lost", "x.toxic_lost",
        F.aggregate(F.filter("s", lambda y: y["step0"] > F.col("x.step0")), F.lit(0).cast("long"), lambda a, y: a + y["removed"]).alias("kept"),
        F.substring("filter_order", F.col("x.step0") + 1, F.lit(1)).alias("filter"),
    )
    bit = F.expr("shiftleft(1, f)")
    shown = summed(partial, "shown").select("part", F.col("place").alias("pattern"), "n", F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("f"))
    fails = shown.groupBy("part", F.substring(F.lit(FILTERS), F.col("f") + 1, F.lit(1)).alias("filter")).agg(
        F.sum(F.when(F.col("pattern").bitwiseAND(bit) != 0, F.col("n")).otherwise(0)).alias("fails"), F.sum(F.when(F.col("pattern") == bit, F.col("n")).otherwise(0)).alias("unique_fails")
    )
    shares = after.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return after.join(fails.join(shares, ["part", "filter"]), ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley"
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH word AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), doc AS (
  SELECT w.part, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
         100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
         w.doc_id > min(w.doc_id) OVER (PARTITION BY text) AS e, coalesce(l.good, 0) AS good, coalesce(l.bad, 0) AS bad
  FROM word w LEFT JOIN (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id) l ON w.doc_id = l.doc_id
), pattern AS (
  SELECT part, map {'A': a, 'B': b, 'C': c, 'D': d, 'E': coalesce(e, false)} AS fails, (a::INT + b::INT + c::INT + d::INT + coalesce(e, false)::INT) AS n_fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad
  FROM doc GROUP BY ALL
), letter AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT [a.f, b.f, c.f, d.f, e.f] AS fs FROM letter a, letter b, letter c, letter d, letter e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f
), applied AS (
  SELECT part, array_to_string(fs, '') AS filter_order, step, fs[step] AS f, n, good, bad, n_fails, fails[fs[step]] AS failing,
         len(list_filter(fs[1:step - 1], lambda x: fails[x])) > 0 AS gone
  FROM pattern, orders, (SELECT unnest(range(1, 6))::INT AS step)
), counted AS (
  SELECT part, filter_order, step, f, sum(CASE WHEN NOT gone AND NOT failing THEN n ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN NOT gone AND failing THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN gone AND failing THEN n ELSE 0 END)::BIGINT AS redundant, sum(CASE WHEN failing AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN NOT gone AND failing THEN good ELSE 0 END)::BIGINT AS good_lost, sum(CASE WHEN NOT gone AND failing THEN bad ELSE 0 END)::BIGINT AS toxic_lost
  FROM applied GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM counted
"""
