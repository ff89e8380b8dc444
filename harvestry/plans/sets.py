"""Set operations, upserts and maintenance of keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from harvestry.plans.registry import Tables, query


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Per key the row that is last in `order`; of equal ones the new one. One shuffle over both."""
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order), F.desc("_new")))
    return rows.withColumn("_place", last).where("_place = 1").drop("_place", "_new")


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose key is not there; the first of each new key."""
    fresh = new.join(old.select(*keys).distinct(), keys, "left_anti")
    return old.unionByName(fresh.dropDuplicates(keys))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, base):
    e = Tables(spark, base).events.select("user_id", "event_id", "event_type", "ts")
    return upsert(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT c_custkey AS url, 'old' AS origin FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def insert_first(spark, base):
    t = Tables(spark, base)
    old = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("url"), F.lit("old").alias("origin"))
    return insert_missing(old, t.orders.select(F.col("o_custkey").alias("url"), F.lit("new").alias("origin")), ["url"])


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_by_key(spark, base):
    t = Tables(spark, base)
    gone = t.customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return t.orders.join(gone, "o_custkey", "left_anti").select("o_orderkey")


@query("""SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def clear_field(spark, base):
    """One JSON field, emptied where a predicate on the key holds."""
    k = F.get_json_object("props", "$.k").cast("long")
    return Tables(spark, base).events.select("event_id", F.when(F.col("user_id") % 3 != 0, k).alias("k"))


@query("SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) < 30 AND ts < TIMESTAMP '2024-01-15'")
def prune_scan(spark, base):
    k = F.get_json_object("props", "$.k").cast("long")
    return Tables(spark, base).events.where((k < 30) & (F.col("ts") < F.lit("2024-01-15").cast("timestamp_ntz"))).select("event_id")


@query("SELECT count(*) AS n, count(*) FILTER (WHERE value > 50) AS large, count(DISTINCT user_id) AS users, count(*) = 0 AS is_empty FROM events")
def table_counts(spark, base):
    return Tables(spark, base).events.agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("large"), F.countDistinct("user_id").alias("users"), (F.count("*") == 0).alias("is_empty"))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def union_distinct(spark, base):
    t = Tables(spark, base)
    return t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).union(t.customer.where("c_acctbal > 5000").select("c_custkey")).distinct()


@query("SELECT 'due' AS lane, c_custkey AS k FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'retired', s_suppkey FROM supplier WHERE s_acctbal < 0")
def union_all(spark, base):
    t = Tables(spark, base)
    due = t.customer.where("c_acctbal > 5000").select(F.lit("due").alias("lane"), F.col("c_custkey").alias("k"))
    return due.unionByName(t.supplier.where("s_acctbal < 0").select(F.lit("retired").alias("lane"), F.col("s_suppkey").alias("k")))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def intersect_keys(spark, base):
    o = Tables(spark, base).orders
    return o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("k")).intersect(o.where("o_orderstatus = 'F'").select("o_custkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def except_keys(spark, base):
    t = Tables(spark, base)
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.orders.select("o_custkey"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def keep_first(spark, base):
    """The first row of each key, by an order that is given."""
    first = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    return Tables(spark, base).events.withColumn("r", first).where("r = 1").select("user_id", "event_type", "event_id")


@query("""SELECT n_nationkey AS item, n_name AS name, r_name AS parent, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 9000) AS town,
 (SELECT array_to_string(list_sort(list(DISTINCT s_suppkey % 4)), ',') FROM supplier WHERE s_nationkey = n_nationkey) AS aka
FROM nation LEFT JOIN region ON n_regionkey = r_regionkey WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND s_acctbal > 9900)""")
def gazetteer_build(spark, base):
    """A graph pattern with an optional part, a NOT EXISTS, an EXISTS as a flag, and grouped distinct names."""
    t = Tables(spark, base)
    gone = t.supplier.where("s_acctbal > 9900").select(F.col("s_nationkey").alias("item")).distinct()
    rich = t.customer.where("c_acctbal > 9000").select(F.col("c_nationkey").alias("item"), F.lit(True).alias("rich")).distinct()
    aka = t.supplier.groupBy(F.col("s_nationkey").alias("item")).agg(F.array_join(F.sort_array(F.collect_set((F.col("s_suppkey") % 4).cast("string"))), ",").alias("aka"))
    rows = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select(F.col("n_nationkey").cast("long").alias("item"), F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    rows = rows.join(gone, "item", "left_anti").join(rich, "item", "left").join(aka, "item", "left")
    return rows.select("item", "name", "parent", F.coalesce("rich", F.lit(False)).alias("town"), "aka")
