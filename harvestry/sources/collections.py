"""Keyed collections on any file system that Spark reads: whole reads with a fallback, whole writes that appear at once,
keep-latest upserts, and landed pages as rows."""

from __future__ import annotations

import codecs
import uuid
import zlib

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harvestry.plans.sets import insert_missing, upsert

#: Charsets that a page's header or markup may name and the engine decodes; any other is read as UTF-8.
CHARSETS = ("US-ASCII", "ISO-8859-1", "UTF-8", "UTF-16BE", "UTF-16LE", "UTF-16")


def _place(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


#: Written versions that stay behind the current one, for readers that have begun with them.
STAY = 2


def _versions(spark: SparkSession, path: str, folder: str = "_finished") -> list[str]:
    """The names of a collection's finished versions, oldest first: each has a marker that was made after its rows.

    With `_numbers` the numbers that any writer has taken.
    """
    fs, where = _place(spark, f"{path}/{folder}")
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def read_collection(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The rows of the collection's newest version in the given schema; a collection that was never written has none."""
    known = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{path}/{known[-1]}") if known else spark.createDataFrame([], schema)


def write_collection(df: DataFrame, path: str) -> None:
    """Write the whole collection as its next version. A reader sees the version before or this one, never a part.

    A version counts from its marker on, a file that only one writer can make: of two writers of one version the second
    fails and its rows are never read. A crash leaves the version before. The last STAY versions stay readable.
    """
    spark = df.sparkSession
    known = _versions(spark, path)
    taken = _versions(spark, path, "_numbers")
    name = f"v{int(taken[-1][1:]) + 1 if taken else 0:012d}"
    rows = f"{path}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(rows)
    fs, number = _place(spark, f"{path}/_numbers/{name}")
    try:
        fs.create(number, False).close()
    except Py4JJavaError as e:
        raise RuntimeError(f"another writer has written {name} of {path}") from e
    fs.create(_place(spark, f"{path}/_finished/{rows.rpartition('/')[2]}")[1], False).close()
    for old in known[: -STAY if STAY else None]:
        fs.delete(_place(spark, f"{path}/_finished/{old}")[1], False)
        fs.delete(_place(spark, f"{path}/{old}")[1], True)


def collection_is_empty(spark: SparkSession, path: str, schema: StructType | str) -> bool:
    """Whether a collection has no row; at most one row is read."""
    return read_collection(spark, path, schema).isEmpty()


def merge_into(rows: DataFrame, path: str, keys: list[str], order: list[str], only_new: bool = False) -> None:
    """Upsert rows by key, the latest in `order` winning; `only_new` keeps what is there."""
    old = read_collection(rows.sparkSession, path, rows.schema)
    write_collection(insert_missing(old, rows, keys) if only_new else upsert(old, rows, keys, order), path)


def decode_html(body: Column, content_type: Column) -> Column:
    """Bytes of a page as text, by the charset of its header, else of its first four kilobytes of markup, else UTF-8."""
    pattern = r"(?i)charset\s*=\s*[\"']?([\w-]+)"
    head = F.decode(F.substring(body, 1, 4096), "ISO-8859-1")
    named = F.upper(F.coalesce(F.nullif(F.regexp_extract(content_type, pattern, 1), F.lit("")), F.regexp_extract(head, pattern, 1)))
    text = F.coalesce(*(F.when(named == c, F.decode(body, c)) for c in CHARSETS if c != "UTF-8"), F.decode(body, "UTF-8"))
    return text


#: The first two bytes of a gzip stream, and the last of a header without fields.
GZIP = b"\x1f\x8b"


def unpack_bounded(body: pd.Series, most: int) -> pd.Series:
    """Bytes, unpacked if they are gzip, and never more than `most` of them; a broken stream gives what came before the break."""

    def one(data: bytes | None) -> bytes | None:
        if data is None or data[:2] != GZIP:
            return data and data[:most]
        reader, out = zlib.decompressobj(zlib.MAX_WBITS | 16), b""
        try:
            out = reader.decompress(data, most)
        except zlib.error:
            pass
        return out

    return body.map(one, na_action="ignore")


def read_texts(spark: SparkSession, path: str, most: int = 3_000_000) -> DataFrame:
    """Files of a folder, plain or gzip by their first bytes, as UTF-8 text of at most `most` bytes: path, text. A letter that the bound cuts goes."""

    @F.pandas_udf("string")
    def unpack(body: pd.Series) -> pd.Series:
        return unpack_bounded(body, most).map(lambda b: codecs.getincrementaldecoder("utf-8")("replace").decode(b), na_action="ignore")

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", unpack("content").alias("text"))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as landed pages: path, bytes, text by their own markup's charset, and a hash of the visible text."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = decode_html(F.col("content"), F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style|noscript)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    return files.select("path", "length", text.alias("html"), F.sha1(F.trim(F.regexp_replace(bare, r"\s+", " ")).cast("binary")).alias("hash"))
