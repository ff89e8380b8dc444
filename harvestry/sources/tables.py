"""Reading the driver tables and keeping intermediate ones in shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The table `name` under `base`; the path may use any scheme that Spark can read."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none and runs on this machine alone (tests, local use) is a local folder made and set.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = known.get() if known.isDefined() else None
    if not path:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set: on {master} intermediate tables need a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="harvestry-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def keep(df: DataFrame, tag: str = "part") -> DataFrame:
    """Write `df` to the shared folder and read it back: a cut in the lineage that outlives executors.

    The files go when the session's file systems close.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/harvestry-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def discard(*kept: DataFrame) -> None:
    """Delete the files of tables that keep() gave, once nothing reads them any more: what follows is itself written."""
    for df in kept:
        spark = df.sparkSession
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
