"""What plans must look like: filters and columns reach the scan, and no nested-loop join over tables that grow."""

import re

import pytest

from harvestry import catalog
from harvestry.plans.spatial import near_spots


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pushdown(spark, base):
    p = plan(catalog.QUERIES["point_filter"](spark, base))
    assert "EqualTo(event_type,purchase)" in p and "GreaterThan(value,50.0)" in p
    assert re.search(r"ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string,value:double>", p)


def test_column_pruning(spark, base):
    assert "html" not in plan(catalog.QUERIES["url_identity"](spark, base))
    assert "l_extendedprice" not in plan(catalog.QUERIES["coverage"](spark, base))


@pytest.mark.parametrize("name", ["date_distance", "near_town", "title_pairs", "agrees", "unvisited_pages", "upsert_latest", "frontier_pick", "outside_outages"])
def test_no_nested_loops(spark, base, name):
    p = plan(catalog.QUERIES[name](spark, base))
    assert "CartesianProduct" not in p
    assert "NestedLoop" not in p


def test_top_lists(spark, base):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["frontier_view"](spark, base))
    assert "WindowGroupLimit" in plan(catalog.QUERIES["host_caps"](spark, base))


def test_no_sort_of_all_pairs(spark, base):
    """The smallest of very many distances is taken by hash: to sort them fills the disk."""
    assert "SortAggregate" not in plan(catalog.QUERIES["nearest_namesake"](spark, base))


def test_spots_are_measured_once(spark):
    """Listings on one spot share a distance; rounding and sines are not done for each."""
    a = spark.createDataFrame([(i, 48.0 + i % 2, 17.0) for i in range(50)], "id long, lat double, lon double")
    near = near_spots(a, spark.createDataFrame([(1, 48.01, 17.01), (2, 48.02, 17.0), (3, 60.0, 17.0)], "town long, t_lat double, t_lon double"), 25.0)
    assert sorted((r.lat, r.town) for r in near.collect()) == [(48.0, 1), (48.0, 2)]


def test_counts_need_no_pairs(spark, base):
    """Listings near a town are summed by spots: no join brings in the listings themselves."""
    p = plan(catalog.QUERIES["town_counts"](spark, base))
    joins = [line for line in p.splitlines() if "Join" in line]
    assert joins and not any(re.search(r"\bid#", line) for line in p.splitlines()) and "sum(n#" in p
