"""The corpus pipeline: toxicity, language, repeated lines, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each one's result as Parquet in the shared
folder and reads it again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm import langid, lines, packing, simhash, toxicity
from harvestry.llm.common import bounded_batches, each_batch, give_back, keep, read_table, texts_of

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_rows(docs: DataFrame, decide: Callable[[pa.Array], Sequence[bool]]) -> DataFrame:
    """The rows of `docs` whose own text decide() takes, from a batch's texts; doc_id plays no part."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    return each_batch(docs, lambda batch: batch.filter(pa.array(decide(batch.column(at)), pa.bool_())), docs.schema)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are scored as toxic go, each by its own text.

    The model learns from the labelled rows among `docs`, in all folds.
    """
    model = toxicity.fit(toxicity.sample(docs, read_table(spark, sf_dir, "labels"), folds=None))
    if model is None:
        return docs
    shared = spark.sparkContext.broadcast(model)
    del model
    give_back()
    return keep_rows(docs, lambda texts: shared.value.score(list(texts_of(texts))) < 0.5 if len(texts) else [])


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a determined language go: null texts and texts without a letter. Other rows keep their own `lang`.

    How sure a prediction is decides nothing. Without any known `lang` to fit on, texts with a letter stay.
    """
    model = langid.fit(langid.sample(docs, folds=None))
    if not model.families:
        return keep_rows(docs, lambda texts: [langid.has_letter(t.as_py() or "") for t in texts])
    shared = spark.sparkContext.broadcast(model)
    del model
    give_back()
    return keep_rows(docs, lambda texts: [shared.value.predict(t.as_py())[0] != langid.UNDETERMINED for t in texts])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one; n_chars follows the text. A document stays even where it loses all."""
    rest = [c for c in docs.columns if c not in ("text", "n_chars")]
    out = lines.dedup_lines(docs).withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept_text")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*(c for c in docs.columns if c in rest or c in ("text", "n_chars")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) one row stays: of the smallest doc_id,
    unknown ones last, the first row.

    Rows are told apart by a number that is written with them, so a null or repeated doc_id ties no two rows together.
    """
    rows = keep(docs.withColumn("row", F.monotonically_increasing_id()), "rows")
    linked = simhash.similar_groups(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    first = linked.join(rows.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(order).alias("first")).select("first.row")
    return rows.join(first, "row", "left_semi").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("packing", pack),
]

#: The toxicity and packing stages have no SQL; tests hold the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
