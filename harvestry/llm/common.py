"""What the operators share: batch handling for Arrow functions, bounded groups, session limits."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harvestry.sources.tables import keep, read_table, shared_dir

__all__ = ["ASCII_SPACE", "bounded_batches", "each_batch", "fold_id", "give_back", "keep", "read_table", "segments", "shared_dir", "texts_of", "tokens_of", "words_of"]

#: [\x20\x09-\x0D]; bytes.split() without arguments splits at exactly these.
ASCII_SPACE = " \t\n\x0b\f\r"
#: Rows an Arrow batch holds at most, so that a batch of long texts fits a Python worker.
BATCH_ROWS = 512


def bounded_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch to `rows`; a lower setting of the session's stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def give_back(cycles: bool = True) -> None:
    """Return what Python has freed (a fit's tables) to the system, where its C library can; `cycles`: look for such garbage first."""
    if cycles:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def each_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            elif out is not None:
                yield out

    return df.mapInArrow(over, schema)


def texts_of(column: pa.Array) -> Iterator[bytes]:
    """Each text as UTF-8; null counts as empty. One text at a time is a Python object."""
    for value in column.cast(pa.large_binary()):
        yield value.as_py() or b""


def tokens_of(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    return text.lower().split()


def words_of(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of a batch of texts as tokens_of() gives them, in one array: the words, each word's row, words of each row."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    words = lists.flatten()
    rows = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
    said = pc.binary_length(words).to_numpy() > 0  # white space at an end gives an empty word
    return words.filter(pa.array(said)).cast(pa.large_binary()), rows[said], np.bincount(rows[said], minlength=len(lists))


def fold_id(column: str, folds: int):
    """crc32(id as text) mod folds; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def segments(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, from batches that are sorted by them.

    A run is held whole, so its size must be bounded by how the keys were made.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held:
            table = pa.concat_tables([*held, table])
        columns = [table.column(k).to_numpy() for k in keys]
        cut = np.zeros(table.num_rows - 1, bool)
        for c in columns:
            cut |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(cut) + 1])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            yield table.slice(a, b - a)
        held = [table.slice(starts[-1])]
    if held:
        yield held[0]
