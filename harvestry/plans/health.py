"""Whether readings are worse than they were: lineitems of a supplier as what was read from its site each month."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.functions import health as H
from harvestry.plans.registry import Tables, query

_SHARE = lambda what: f"floor(100.0 * count(CASE WHEN l_quantity > 15 AND {what} THEN 1 END) / greatest(count(CASE WHEN l_quantity > 15 THEN 1 END), 1) + 0.5) / 100"
#: A month's reading, by expressions that Spark and SQL read alike: rows, and shares of those with a time, a place, a link.
READ = {
    "n": "count(CASE WHEN l_quantity > 15 THEN 1 END)", "timed": _SHARE("l_linenumber < 5"), "located": _SHARE("l_returnflag <> 'N'"), "linked": _SHARE("l_returnflag = 'N'"),
    "titles": "1.0 * count(DISTINCT CASE WHEN l_quantity > 15 THEN l_linestatus END) / greatest(count(CASE WHEN l_quantity > 15 THEN 1 END), 1)",
}
_DOUBLES = ", ".join(f"CAST({e} AS {'BIGINT' if k == 'n' else 'DOUBLE'}) AS {k}" for k, e in READ.items())
_LOST = " ".join(f"WHEN g_{k} >= {H.HAD} AND r.{k} < {H.LOST} THEN '{k}'" for k in H.SHARES)
_WHY = f"""CASE WHEN coalesce(g_n, 0) = 0 THEN NULL WHEN r.n = 0 THEN 'none' WHEN g_n >= {H.MANY} AND r.n < g_n * {H.LEFT} THEN 'fewer' WHEN r.n >= {H.SOME} AND r.titles < {H.FEW_TITLES} AND g_titles >= {H.OWN_TITLES} THEN 'same' {_LOST} END"""


@query(f"""WITH RECURSIVE m AS (SELECT l_suppkey AS site, substr(CAST(CAST(l_shipdate AS DATE) AS VARCHAR), 1, 7) AS month, {_DOUBLES} FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY month) AS i FROM m),
f AS (SELECT site, 0::BIGINT AS i, NULL::VARCHAR AS month, NULL::VARCHAR AS why, NULL::VARCHAR AS good, NULL::BIGINT AS g_n, NULL::DOUBLE AS g_timed, NULL::DOUBLE AS g_located, NULL::DOUBLE AS g_linked, NULL::DOUBLE AS g_titles, NULL::VARCHAR AS g_month FROM r WHERE r.i = 1
 UNION ALL SELECT site, i, month, why, g_month, CASE WHEN ok THEN n ELSE g_n END, CASE WHEN ok THEN timed ELSE g_timed END, CASE WHEN ok THEN located ELSE g_located END, CASE WHEN ok THEN linked ELSE g_linked END, CASE WHEN ok THEN titles ELSE g_titles END, CASE WHEN ok THEN month ELSE g_month END
 FROM (SELECT *, why IS NULL AND n > 0 AS ok FROM (SELECT r.*, g_n, g_timed, g_located, g_linked, g_titles, g_month, {_WHY} AS why FROM f JOIN r ON r.site = f.site AND r.i = f.i + 1)))
SELECT site, month, why AS trouble, good FROM f WHERE i > 0""")
def reading_troubles(spark, base):
    """Each month's reading of a site against its last good one, and when that was."""
    rows = Tables(spark, base).lineitem.withColumns({"site": F.col("l_suppkey"), "month": F.substring(F.col("l_shipdate").cast("date").cast("string"), 1, 7)})
    read = rows.groupBy("site", "month").agg(*(F.expr(f"CAST({e} AS {'BIGINT' if k == 'n' else 'DOUBLE'})").alias(k) for k, e in READ.items()))
    return H.against_last_good(read, "site", "month", list(READ)).select("site", "month", "trouble", "good")
