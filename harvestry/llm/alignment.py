"""Alignment of two tokenizers' tokens by the places where both end.

Relational throughout, after the texts are encoded: tokens are exploded with their positions, windowed sums of their lengths give
their ends, an equal join on the ends finds the cuts, a running count of the cuts numbers the groups, and tokens of one
group are linked. What is aligned so are the distinct chunks of all texts (see chunks.py): tokens of a text are those of its
chunks, and both tokenizers end wherever a chunk does, so a text's groups are those of its chunks, one after the other. A word
that a million documents share is aligned once.

Documents are written in blocks of bounded size with a dictionary of the chunks in them. A join by chunk brings results to the
blocks' dictionaries, and a block's documents look up theirs, as arrays in the block's task: first the linked pairs, for the number
of documents that hold each, then all sums.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harvestry.llm.chunks import both, cuts
from harvestry.llm.common import bounded_batches, each_batch, give_back, keep, read_table
from harvestry.llm.contexts import packed, unpacked
from harvestry.sources.tables import discard

BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Bytes of texts that share a dictionary; one longer text has its own.
BLOCK = 16 << 20
#: Chunks whose lists a task builds side by side before it sorts the rest by key; documents in a row of a block.
HELD_CHUNKS, ROW_DOCS = 20_000, 512
SUMS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
PAIR_SHIFT = 32


def chunked(docs: DataFrame, files: tuple[str, str], size: int) -> DataFrame:
    """Two kinds of rows, by block: of its dictionary (local, chunk), and of its documents, some in a row (doc_ids, sizes, ids: packed, their chunks in order)."""
    bounded_batches(docs.sparkSession)
    schema = pa.schema([("block", pa.int64()), ("local", pa.int32()), ("chunk", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("ids", pa.binary())])

    def block(number: int, doc_ids: list[int | None], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        raw = b"".join(b" " + t if t else b"" for t in texts)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 if t else 0 for t in texts])])
        data = np.frombuffer(raw, np.uint8)
        begins = cuts(data, both(*files).together)
        begins[starts[:-1][np.diff(starts) > 0]] = True
        at = np.flatnonzero(begins)
        offsets = pa.py_buffer(np.append(at, len(raw)).astype(np.int64))
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, offsets, pa.py_buffer(raw)]).dictionary_encode()
        known, n = coded.dictionary, len(coded.dictionary)
        for i in range(0, n, 1 << 16):
            k = min(1 << 16, n - i)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), pa.array(np.arange(i, i + k, dtype=np.int32)), known.slice(i, k).cast(pa.binary()), pa.nulls(k, pa.list_(pa.int64())), pa.nulls(k, pa.list_(pa.int32())), pa.nulls(k, pa.binary())], schema=schema)
        ids = coded.indices.to_numpy().astype(np.uint32)
        lists, press = np.searchsorted(at, starts).astype(np.int32), zstandard.ZstdCompressor(level=1)
        for i in range(0, len(texts), ROW_DOCS):
            k = min(i + ROW_DOCS, len(texts))
            row = [number], [None], [None], [doc_ids[i:k]], [np.diff(lists[i : k + 1])], [packed([ids[lists[i] : lists[k]]], press)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, doc_ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                text = value.as_py() or b""
                if texts and held + len(text) > size:
                    yield from block(number, doc_ids, texts)
                    number, doc_ids, texts, held = number + 1, [], [], 0
                doc_ids.append(doc_id)
                texts.append(text)
                held += len(text)
        if texts:
            yield from block(number, doc_ids, texts)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(over, "block long, local int, chunk binary, doc_ids array<long>, sizes array<int>, ids binary")


def encoded(chunks: DataFrame, files: tuple[str, str]) -> DataFrame:
    """chunk, a and b (id and length of each token), whole (both give the chunk's bytes back)."""
    def tokens(lists: list[list[int]], length: np.ndarray) -> pa.Array:
        ids = np.fromiter(chain.from_iterable(lists), np.int32)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(ids), pa.array(length[ids])], ["id", "n"]))

    def of(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = both(*files)
        a, b, whole = known.encode(batch.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), tokens(a, known.a_length), tokens(b, known.b_length), pa.array(whole, pa.bool_())], ["chunk", "a", "b", "whole"])

    return each_batch(chunks.select("chunk"), of, "chunk binary, a array<struct<id:int,n:int>>, b array<struct<id:int,n:int>>, whole boolean")


def ends(tokens: DataFrame, side: str) -> DataFrame:
    """key, end and the id `side` of each token in the array column `side`."""
    exploded = tokens.select("key", F.posexplode(side).alias("at", "token"))
    return exploded.select("key", F.sum("token.n").over(Window.partitionBy("key").orderBy("at")).alias("end"), F.col("token.id").alias(side))


def aligned(tokens: DataFrame) -> DataFrame:
    """key, groups: array of (g, a, b), the ids of both sides in each group, in order; from key and token arrays a and b.

    A group ends where a token of each side does. Tokens that end after k such places are of the group k.
    """
    dealt = tokens.repartition("key")
    placed = ends(dealt, "a").join(ends(dealt, "b"), ["key", "end"], "full")
    before = Window.partitionBy("key").orderBy("end").rowsBetween(Window.unboundedPreceding, -1)
    cut = (F.col("a").isNotNull() & F.col("b").isNotNull()).cast("int")
    grouped = placed.withColumn("g", F.coalesce(F.sum(cut).over(before), F.lit(0)).cast("int")).groupBy("key", "g")

    def in_order(side: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col(side).isNotNull(), F.struct("end", F.col(side).alias("id"))))).getField("id").alias(side)

    return grouped.agg(in_order("a"), in_order("b")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("g", "a", "b"))).alias("groups"))


def links(groups: DataFrame) -> DataFrame:
    """key, a, b, n: how many linked occurrences of the ids a and b each key has, a row for each of its groups.

    Ids that come again in a group are counted first, so a group of very many tokens gives its few pairs of ids only.
    """
    of = groups.select("key", F.explode("groups").alias("x"))

    def times(side: str, one: Column) -> Column:
        return F.size(F.filter(F.col(f"x.{side}"), lambda y: y == one)).cast("long")

    left = of.select("key", "x", F.explode(F.array_distinct("x.a")).alias("a"))
    both_ = left.select("key", "x", "a", F.explode(F.array_distinct("x.b")).alias("b"))
    return both_.select("key", "a", "b", (times("a", F.col("a")) * times("b", F.col("b"))).alias("n"))


def pair_of(a: Column, b: Column) -> Column:
    return F.shiftleft(a.cast("long"), PAIR_SHIFT) + b


def written(groups: Column) -> Column:
    """Groups as text: `a1,a2|b1;a3|b2,b3`."""
    return F.array_join(F.transform(groups, lambda x: F.concat_ws("|", F.array_join(x["a"].cast("array<string>"), ","), F.array_join(x["b"].cast("array<string>"), ","))), ";")


def align(docs: DataFrame, byte_level: str | None = None, pieces: str | None = None, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (long), and groups, the text of its groups.

    Side a is a space and the text by a byte-level tokenizer, side b the text by a piece tokenizer, which adds the space. Texts
    that are null or empty, or that one of them doesn't give back byte by byte, have no tokens: zeros, an empty `groups`; their
    links count nowhere. Rows that repeat a doc_id, or have none, are documents of their own. Other columns are not read.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    # A key's rows stay where they are for joins that also compare the end, or the place in the dictionary.
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    # Each step is written, so its shuffles can go as soon as it is; lists of many keys are built without a sort in between.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    held = "spark.sql.objectHashAggregate.sortBased.fallbackThreshold"
    spark.conf.set(held, str(HELD_CHUNKS))
    files = (byte_level or public_tokenizers.path(BYTE_LEVEL), pieces or public_tokenizers.path(PIECES))
    rows = keep(chunked(docs, files, block), "chunks")
    known = rows.where("chunk is not null").select("block", "local", "chunk")
    texts = rows.where("ids is not null").select("block", "doc_ids", "sizes", "ids")
    tokens = keep(encoded(known.select("chunk").distinct(), files).withColumn("key", F.monotonically_increasing_id()), "tokens")
    groups = aligned(tokens.where("whole").select("key", "a", "b"))
    sizes = (*(F.size(F.flatten(f"groups.{side}")).cast("long").alias(f"n_{side}") for side in "ab"), F.size("groups").cast("long").alias("n_groups"))
    pairs = F.array_distinct(F.flatten(F.transform("groups", group_pairs)))
    own = keep(groups.join(tokens.select("key", "chunk"), "key").select("key", "chunk", "groups", pairs.alias("pairs"), *sizes), "groups")
    discard(tokens)

    counts = keep(in_blocks(texts, known.join(own.select("chunk", "pairs"), "chunk", "left").select("block", "local", "pairs"), pairs_held, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs")), "pairs")

    best = counts.groupBy(F.shiftright("pair", PAIR_SHIFT).alias("a")).agg(F.max("docs").alias("most"))
    rated = counts.withColumn("a", F.shiftright("pair", PAIR_SHIFT)).join(best, "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("long").alias("best"))
    linked = links(own).withColumn("pair", pair_of(F.col("a"), F.col("b")))
    sums = linked.join(rated, "pair", "left").groupBy("key").agg(
        F.sum("n").alias("n_links"), F.sum(F.col("n") * F.coalesce("best", F.lit(0))).alias("n_best"), F.sum(F.col("n") * F.coalesce("docs", F.lit(0))).alias("count_sum")
    )
    found = keep(own.select("key", "chunk", written(F.col("groups")).alias("said"), "n_a", "n_b", "n_groups").join(sums, "key").select("chunk", "said", *SUMS), "found")
    discard(own, counts)
    return in_blocks(texts, known.join(found, "chunk", "left").select("block", "local", "said", *SUMS), told, f"doc_id long, {', '.join(f'{c} long' for c in SUMS)}, groups string")


#: Of a block: its documents' ids, how many chunks each has, and these chunks' places in the dictionary; the dictionary in order.
Documents = Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]


def in_blocks(texts: DataFrame, entries: DataFrame, function: Callable[[Documents, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `function` gives of each block's documents and of its dictionary's entries (block, local and more); a block comes to one task."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = zstandard.ZstdDecompressor()
        for block in by_block(batches):
            of_texts = pc.is_null(block.column("local"))
            docs = zip(*block.filter(of_texts).select(["doc_ids", "sizes", "ids"]).columns, strict=True)
            entries = block.filter(pc.invert(of_texts)).sort_by("local")
            yield from function(((ids.values, sizes.values.to_numpy(), unpacked(x.as_py(), 1, unpress)[0].astype(np.int64)) for ids, sizes, x in docs), entries)
            del block, docs, entries
            give_back()

    # One whole number to sort by needs no comparisons of rows; a dictionary's order is made in the task.
    return texts.unionByName(entries, allowMissingColumns=True).repartition("block").sortWithinPartitions("block").mapInArrow(over, schema)


def by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, from batches sorted by it; a block's size is bounded when it is written."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        block = batch.column("block").to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)] if len(block) else []
        for low, high in zip(cut, cut[1:], strict=False):
            if held and block[low] != now:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            now = block[low]
            held.append(batch.slice(low, high - low))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.nulls(0, column.type)


def of_docs(sizes: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The sum of each document's values."""
    total, end = np.concatenate([[0], np.cumsum(values, dtype=np.int64)]), np.cumsum(sizes, dtype=np.int64)
    return total[end] - total[end - sizes]


def sorted_distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def pairs_held(docs: Documents, entries: pa.Table) -> Iterator[pa.RecordBatch]:
    """pair and docs, how many of a block's documents hold it; a document with a chunk that has no pairs at all (null) holds none."""
    lists = one_array(entries.column("pairs"))
    unknown, lengths = pc.is_null(lists).to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    pairs, place = np.unique(pc.list_flatten(lists).to_numpy(), return_inverse=True)
    n = np.zeros(len(pairs), np.int64)
    for _, sizes, ids in docs:
        fine = of_docs(sizes, unknown[ids]) == 0
        doc = np.repeat(np.arange(len(sizes)), sizes)
        use = fine[doc]
        # A document's distinct chunks, then their distinct pairs.
        key = sorted_distinct(doc[use] * max(len(lists), 1) + ids[use])
        doc, chunk = np.divmod(key, max(len(lists), 1))
        k = lengths[chunk]
        at = np.repeat(begins[chunk] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        key = sorted_distinct(np.repeat(doc, k) * max(len(pairs), 1) + place[at])
        n += np.bincount(key % max(len(pairs), 1), minlength=len(pairs))
    held = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[held], pa.int64()), pa.array(n[held])], ["pair", "docs"])


def told(docs: Documents, entries: pa.Table) -> Iterator[pa.RecordBatch]:
    """Each document's sums and the text of its groups; zeros and an empty one where a chunk has none (null)."""
    said = one_array(entries.column("said"))
    unknown = pc.is_null(said).to_numpy(zero_copy_only=False)
    sums = [pc.fill_null(one_array(entries.column(c)), 0).to_numpy() for c in SUMS]
    for doc_ids, sizes, ids in docs:
        fine = of_docs(sizes, unknown[ids]) == 0
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        groups = pc.fill_null(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), said.take(pa.array(ids))), ";"), "")
        yield pa.RecordBatch.from_arrays([doc_ids, *(pa.array(np.where(fine, of_docs(sizes, x[ids]), 0)) for x in sums), groups], ["doc_id", *SUMS, "groups"])


def group_pairs(x: Column) -> Column:
    """The pairs of ids that a group links."""
    return F.flatten(F.transform(F.array_distinct(x["a"]), lambda i: F.transform(F.array_distinct(x["b"]), lambda j: pair_of(i, j))))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = align(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", *SUMS, F.when(F.col("groups") != "", F.sha2(F.col("groups").cast("binary"), 256)).otherwise("").alias("groups_sha256"))
