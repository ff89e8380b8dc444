"""Queries against their SQL on invented tables, the other tables being those of the smallest folder."""

import os
from functools import reduce
from operator import add

from harvestry import catalog
from harvestry.sources.tables import TABLES
from tests.sqlcheck import same_rows


def held(spark, base, folder, name, **tables):
    """The query's rows are its SQL's where `tables` stand in for those of the same names."""
    for t in TABLES:
        if t in tables:
            tables[t].write.parquet(f"{folder}/{t}.parquet")
        else:
            os.symlink(f"{base}/{t}.parquet", f"{folder}/{t}.parquet")
    same_rows(catalog.QUERIES[name](spark, str(folder)), catalog.ORACLES[name], str(folder))


def test_headings(spark, base, tmp_path):
    """References, white space and tags as the SQL takes them."""
    said = ["a &amp; b", "a &amp", "a &quot;b&quot; &lt;", " a\t\n b\x0b\x0c", " a 　", "a\x85", "", "&amp;amp;", "Dvořák 🎻"]
    html = [f"<title>x</title><h1>{s}</h1><h1>next</h1>" for s in said] + ["<h1 id='x'>a</h1>", "<h1>a<b>b</b></h1><h1>plain</h1>", "<H1>a</H1>", "no heading", "", None]
    held(spark, base, tmp_path, "page_text", pages=spark.createDataFrame([(i, None, h) for i, h in enumerate(html)], "page_id long, url string, html string"))


def test_sums_hang_on_no_order(spark, base, tmp_path, rng):
    """Values that add up to a half or to just less, by their order, count the same however the rows are stored."""
    added = lambda v: reduce(add, v)  # noqa: E731 (sum() mends what is lost)
    values = next(v for _ in range(100_000) if added(v := [rng.randrange(20_000) / 100 for _ in range(60)]) % 1 > 0.4999 and added(v) % 1 < 0.5 <= added(v[::-1]) % 1 < 0.5001)
    rows = [(i, 7, v) for i, v in enumerate(values)] + [(100 + i, 8 + i, 1.0) for i in range(5)]
    for k, stored in enumerate((rows, rows[::-1])):
        spark.createDataFrame(stored, "event_id long, user_id long, value double").coalesce(1).write.parquet(f"{tmp_path}/{k}/events.parquet")
        assert [tuple(r) for r in catalog.QUERIES["heavy_hosts"](spark, f"{tmp_path}/{k}").collect()] == [(7, int(added(values) + 0.5), 1)]
