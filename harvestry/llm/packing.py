"""Packing token ids into fixed sequences: concatenate and cut.

The first pass tokenises each document once and writes its ids (16 bits each, 32 for a larger vocabulary) with their offset
inside the written partition and that partition's number. The partitions' totals, one row each, give every partition's global offset by a
prefix sum. The second pass reads the ids back and cuts each document at the windows of its global position; a document
over a boundary gives one record on each side. Only the last sequence has padding.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.llm.common import bounded_batches, keep, read_table

WINDOW, END_ID = 2048, 1
#: The ranks of byte_bpe_50k.json, and the special token that file adds; ids equal those that the tokenizers library gives
#: for that file with add_special_tokens=False (tested), at six times its speed.
VOCABULARY, SPECIAL = "byte_bpe_50k.tiktoken", {"<|endoftext|>": 50256}


@lru_cache(1)
def encoder(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = SPECIAL if len(ranks) == min(SPECIAL.values()) else {}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def id_type(path: str) -> type:
    return np.uint16 if encoder(path).max_token_value < 1 << 16 else np.uint32


def encode(text: str, path: str) -> np.ndarray:
    """Ids of one text and the end id. A special token's string in a text is that token, as the library has it."""
    return np.array([*encoder(path).encode(text, allowed_special="all"), END_ID], id_type(path))


def tokenised(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (binary, of id_type()), n, part (of the written table), at (offset inside it)."""
    bounded_batches(docs.sparkSession)

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, lengths = [], np.zeros(batch.num_rows, np.int64)
            for i, text in enumerate(batch.column(1)):
                x = encode(text.as_py() or "", vocabulary)
                ids.append(x.tobytes())
                lengths[i] = len(x)
            starts = at + np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)[: len(lengths)]
            at += int(lengths.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(lengths), pa.array(np.full(len(ids), part, np.int32)), pa.array(starts)], ["doc_id", "ids", "n", "part", "at"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(over, "doc_id long, ids binary, n long, part int, at long")


def cut(batch: pa.RecordBatch, window: int, kind: type) -> pa.RecordBatch:
    """The pieces of a batch of documents (doc_id, ids, n, offset) at multiples of the window."""
    out: list[list] = [[] for _ in range(7)]
    ids_of, offsets = batch.column("ids"), batch.column("offset").to_numpy()
    doc_ids = batch.column("doc_id").to_pylist()
    for i, offset in enumerate(offsets.tolist()):
        ids = np.frombuffer(ids_of[i].as_py(), kind).astype("<u4")
        start, n = 0, len(ids)
        while start < n:
            sequence, inside = divmod(offset + start, window)
            length = min(n - start, window - inside)
            for column, value in zip(out, (doc_ids[i], start, length, zlib.crc32(ids[start : start + length].data), n, sequence, inside), strict=True):
                column.append(value)
            start += length
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text gives the end id alone. A null or repeated doc_id packs like any other row. Other columns are
    not read. An empty table gives no rows. The only thing the driver holds is one total per written partition.
    """
    spark = docs.sparkSession
    path = vocabulary or public_tokenizers.path(VOCABULARY)
    kind = id_type(path)
    rows = keep(tokenised(docs, path), "ids")
    totals = rows.groupBy("part").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(totals.column("part").to_numpy())
    parts, sums = totals.column("part").to_numpy()[order], totals.column("n").to_numpy()[order]
    starts = spark.sparkContext.broadcast((parts, np.cumsum(sums) - sums))

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, base = starts.value
        for batch in batches:
            at = base[np.searchsorted(known, batch.column("part").to_numpy())] + batch.column("at").to_numpy() if batch.num_rows else np.zeros(0, np.int64)
            yield cut(batch.append_column("offset", pa.array(at, pa.int64())), window, kind)

    return rows.mapInArrow(over, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
