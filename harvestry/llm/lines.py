"""Line deduplication with DataFrame functions only.

Lines are normalised, exploded and hashed; a hash's documents are counted with partial sums before the shuffle, and
each document learns which positions to drop through a join that splits hot hashes. Texts cross the shuffle once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm.common import ASCII_SPACE, keep, read_table

MIN_CHARS, MIN_DOCS = 20, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without [\\x20\\x09-\\x0D] at both ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), UPPER, LOWER)


def decisions(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, the text's hash, and the positions `drop` of its lines that go, for texts that lose any.

    A key is known by its 128-bit MD5. The keys of enough documents are written before they are joined, so that the join
    reads both sides from a shuffle and a key with very many lines can be split.
    """
    keys = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), line_key)
    keyed = F.transform(keys, lambda k, i: F.struct(i.alias("pos"), k.alias("key")))
    lines = docs.select("doc_id", F.xxhash64("text").alias("of"), F.explode(F.filter(keyed, lambda x: F.length(x["key"]) >= min_chars)).alias("x")).select(
        F.unhex(F.md5(F.col("x.key").cast("binary"))).alias("h"), "doc_id", "of", F.col("x.pos").alias("pos")
    )
    counts = lines.select("h", "doc_id").distinct().groupBy("h").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
    common = keep(counts.where(F.col("n") >= min_docs).select("h", "last"), "lines")
    return lines.join(common, "h").where(~F.col("doc_id").eqNullSafe(F.col("last"))).groupBy("doc_id", "of").agg(F.collect_list("pos").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """`docs` with kept_text, n_lines and n_dropped added.

    Null or empty text is one empty line; a null doc_id never counts as a document of its own: such rows share one
    place, and a key keeps its lines in the largest known doc_id. Rows that repeat a doc_id are one document for the
    counts and lose or keep a key together. Columns of any other name pass through; one of an added name is replaced.
    """
    added = ("kept_text", "n_lines", "n_dropped")
    lines = F.split(F.coalesce("d.text", F.lit("")), "\n")
    n = F.size(lines)
    stay = F.array_except(F.sequence(F.lit(0), n - 1), F.coalesce("x.drop", F.array().cast("array<int>")))
    kept = F.transform(stay, lambda i: F.get(lines, i))
    return (
        docs.alias("d")
        .join(decisions(docs, min_chars, min_docs).alias("x"), F.col("d.doc_id").eqNullSafe(F.col("x.doc_id")) & (F.xxhash64("d.text") == F.col("x.of")), "left")
        .select(*(F.col(f"d.`{c}`") for c in docs.columns if c not in added), F.array_join(kept, "\n").alias("kept_text"), n.cast("long").alias("n_lines"), (n - F.size(stay)).cast("long").alias("n_dropped"))
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH line AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM line
), common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id IS DISTINCT FROM c.last AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
