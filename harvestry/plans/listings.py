"""The stand-in listing table: orders as dated listings with a town, a kind, a site and a title."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.plans.registry import Tables

#: The day that stands for today.
ASOF = "1998-06-01"

LISTINGS_SQL = """
listing AS (
  SELECT o_orderkey AS event_id, CAST(o_orderdate AS DATE) AS start_day,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) END AS end_day,
         o_orderpriority AS tag, n_name AS town, c_name || ' ' || c_mktsegment AS title, o_totalprice AS price, c_custkey AS site, c_mktsegment AS segment
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
)"""


def listings(t: Tables) -> DataFrame:
    """event_id, start_day, end_day (null for one day), tag, town, title, price, site, segment."""
    joined = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    start = F.col("o_orderdate").cast("date")
    return joined.select(
        F.col("o_orderkey").alias("event_id"), start.alias("start_day"),
        F.when(F.col("o_orderkey") % 3 == 0, F.date_add(start, (F.col("o_orderkey") % 5).cast("int"))).alias("end_day"),
        F.col("o_orderpriority").alias("tag"), F.col("n_name").alias("town"), F.concat_ws(" ", "c_name", "c_mktsegment").alias("title"),
        F.col("o_totalprice").alias("price"), F.col("c_custkey").alias("site"), F.col("c_mktsegment").alias("segment"),
    )


def last_day():
    return F.coalesce("end_day", "start_day")


def upcoming(df: DataFrame, asof: str = ASOF) -> DataFrame:
    """What has not ended before the day."""
    return df.where(last_day() >= F.lit(asof).cast("date"))
