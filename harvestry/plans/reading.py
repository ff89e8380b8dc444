"""Reading pages and rows: signals, gates, doubts, calendars, skeletons, repairs; far and endless dates."""

from __future__ import annotations

from datetime import UTC, date, datetime
from zoneinfo import ZoneInfo

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import StringType, StructField, StructType

from harvestry.functions import html as H
from harvestry.functions import reading as R
from harvestry.functions.dates import AHEAD, LONGEST_RUN, MONTH_OF, parse_column
from harvestry.functions.matching import names_town
from harvestry.functions.text import words
from harvestry.plans.matching import TOWNS
from harvestry.plans.registry import Tables, query

_M = "|".join(sorted(MONTH_OF, key=len, reverse=True))
_NOUNS = ["gal[eé]r", "m[uú]ze", "museum", "theatre"]


@query(f"""WITH b AS (SELECT doc_id, lower(strip_accents(coalesce(text, ''))) AS t, CASE WHEN doc_id % 7 = 0 THEN 'Article' WHEN doc_id % 7 = 1 THEN 'website' END AS kind FROM documents),
c AS (SELECT doc_id, len(regexp_extract_all(t, '\\b[0-9]{{1,2}}\\.\\s?[0-9]{{1,2}}\\.')) + len(regexp_extract_all(t, '\\b[0-9]{{1,2}}\\.\\s?({_M})')) AS dates, len(regexp_extract_all(t, '{R.EVENT_WORD}')) AS event_words, coalesce(lower(kind) LIKE '%article%', false) AS article FROM b)
SELECT *, dates >= {R.DATES} AND event_words >= {R.EVENT_WORDS} AND NOT article AS listing FROM c""")
def listing_signals(spark, base):
    """How much a text looks like a listing of events."""
    kind = F.when(F.col("doc_id") % 7 == 0, "Article").when(F.col("doc_id") % 7 == 1, "website")
    return Tables(spark, base).documents.select("doc_id", *(c.cast("long").alias(k) if k in ("dates", "event_words") else c.alias(k) for k, c in R.page_signals(F.col("text"), kind).items()))


#: Boolean columns of a page's state: each is drawn from a digit of a hash, so that every gate is met open and closed.
STATE = "available seed listed recipe broken trouble looks_listing calendar partial structured asked dead tpl_structured gave_up archive blind outside boring about_home".split()
_RARE = {"seed": 2, "listed": 6, "archive": 2, "blind": 2, "dead": 3, "gave_up": 3, "boring": 3, "tpl_structured": 4, "recipe": 5, "available": 15, "looks_listing": 12, "about_home": 12}
_DIGIT = lambda i: f"CAST('0x' || substr(md5('state' || o_orderkey), {i + 1}, 1) AS INT)"


@query(f"""WITH s AS (SELECT o_orderkey, {', '.join(f"{_DIGIT(i)} < {_RARE.get(n, 8)} AS {n}" for i, n in enumerate(STATE))}, {_DIGIT(20)} // 6 AS rows, {_DIGIT(21)} * 20 AS hours, CASE WHEN {_DIGIT(22)} < 3 THEN 'irrelevant' ELSE 'events' END AS kind, CASE WHEN {_DIGIT(23)} < 3 THEN 'abroad' WHEN {_DIGIT(23)} < 8 THEN 'home' END AS region FROM orders)
SELECT o_orderkey, CASE WHEN NOT available THEN 'reader' WHEN recipe AND NOT broken AND NOT trouble THEN 'recipe works' WHEN NOT (looks_listing OR seed OR listed OR calendar) THEN 'no listing' WHEN NOT (rows = 0 OR (partial AND structured) OR trouble) THEN 'rows are read'
 WHEN hours <= CASE WHEN trouble THEN 24 ELSE 168 END THEN 'too soon' WHEN NOT (seed OR listed) AND (asked OR dead) THEN 'template asked' WHEN tpl_structured AND NOT partial THEN 'template is structured' WHEN NOT seed AND NOT recipe AND gave_up THEN 'given up' WHEN archive THEN 'archive' WHEN blind THEN 'blind'
 WHEN kind = 'irrelevant' AND NOT (outside AND coalesce(region = 'home', false)) THEN 'irrelevant' WHEN coalesce(region = 'abroad', false) THEN 'abroad' WHEN NOT (seed OR listed) AND (boring OR NOT about_home) THEN 'nothing to do with it' END AS closed FROM s""")
def reading_gates(spark, base):
    """The gate that keeps a page from a model's reading, over page states drawn from a hash."""
    digit = lambda i: F.conv(F.substring(F.md5(F.concat(F.lit("state"), F.col("o_orderkey").cast("string")).cast("binary")), i + 1, 1), 16, 10).cast("int")
    region = F.when(digit(23) < 3, "abroad").when(digit(23) < 8, "home")
    state = Tables(spark, base).orders.select("o_orderkey", *((digit(i) < _RARE.get(n, 8)).alias(n) for i, n in enumerate(STATE)), F.floor(digit(20) / 6).alias("rows"), (digit(21) * 20).alias("hours"), F.when(digit(22) < 3, "irrelevant").otherwise("events").alias("kind"), region.alias("region"))
    return state.select("o_orderkey", R.closed_gate().alias("closed"))


@query(f"""WITH d AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 1000 AS INT) AS e FROM orders) SELECT o_orderkey, s > DATE '1997-01-01' + {AHEAD} AS too_far, e - s > {LONGEST_RUN} AS endless FROM d""")
def far_dates(spark, base):
    """Starts that are too far ahead of a day, and ends that stand for none."""
    start = F.col("o_orderdate").cast("date")
    end = F.date_add(start, (F.col("o_orderkey") % 1000).cast("int"))
    return Tables(spark, base).orders.select("o_orderkey", (start > F.date_add(F.lit("1997-01-01").cast("date"), AHEAD)).alias("too_far"), (F.datediff(end, start) > LONGEST_RUN).alias("endless"))


#: What is written about a day d, and the doubt, whether it is dateless, and whether it has times only.
WRITTEN = (
    ("'hall ' || o_custkey", "unread", False, False), ("d || ' 10:00 and 18:00'", "times", False, False), ("d || ' 00:00 to 23:59'", None, False, False), ("d || ', ' || d", "days", False, False),
    ("d || ', monday 10:00, friday 12:00'", "weekly", False, False), ("'tomorrow 19:30'", "relative", False, True), ("d || ' 19:30'", None, False, False), ("'concert on no day'", None, True, True),
)
_ORDER_DAY = "substr(CAST(o_orderdate AS STRING), 9, 2) || '. ' || substr(CAST(o_orderdate AS STRING), 6, 2) || '. ' || substr(CAST(o_orderdate AS STRING), 1, 4)"


def _written(k: int) -> str:
    return "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {'NULL' if w[k] is None else repr(w[k]) if isinstance(w[k], str) else str(w[k]).lower()}" for i, w in enumerate(WRITTEN)) + " END"


@query(f"SELECT o_orderkey, {_written(1)} AS doubt, {_written(2)} AS dateless, {_written(3)} AS times_only FROM orders")
def doubts(spark, base):
    """What the readings of texts about orders' days may have left out."""
    rows = Tables(spark, base).orders.selectExpr("o_orderkey", "o_custkey", f"{_ORDER_DAY} AS d").selectExpr("o_orderkey", "CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN {w[0]}" for i, w in enumerate(WRITTEN)) + " END AS text")
    # Read once each distinct text, in a projection of its own.
    texts = rows.select("text").distinct().withColumn("read", parse_column(F.col("text"), date(1998, 6, 1)))
    found = R.with_doubts(texts, "text", "read").select("text", "doubt", "dateless", "times_only")
    return rows.join(found, "text").select("o_orderkey", "doubt", "dateless", "times_only")


@udtf(returnType="title string, start string, end string, place string, href string")
class CalendarRows:
    """Rows of a calendar plugin's markup: items whose `data-time` has start and end as Unix seconds, in a zone's local time.

    A day from midnight to midnight has no times; an end at 23:59 means that day. Items that repeat, or have no start or
    title, are left out.
    """

    def eval(self, page: str, zone: str):
        seen = set()
        for item in H.parse(page or "").select(".eventon_list_event[data-time]"):
            try:
                begin, _, stop = item.attrs["data-time"].partition("-")
                at = [datetime.fromtimestamp(int(x), UTC).astimezone(ZoneInfo(zone)) if x else None for x in (begin, stop)]
            except (ValueError, OverflowError, OSError):
                continue
            title = next((t for n in item.select(".evcal_event_title") if (t := n.text())), None)
            if not title or not int(begin):
                continue
            first, last = at[0], at[1] if at[1] and at[1] > at[0] else None
            clock = lambda t: t.strftime("%H:%M")
            whole = clock(first) == "00:00" and (last is None or clock(last) in ("00:00", "23:59"))
            day = lambda t: t.strftime("%Y-%m-%d")
            start = day(first) if whole else f"{day(first)}T{clock(first)}"
            end = None
            if last and (day(last) != day(first) or not whole):
                end = day(last) if whole or clock(last) == "23:59" else f"{day(last)}T{clock(last)}"
            places = [next((n.text() for n in item.select(s)), "") for s in (".evo_location_name", ".evo_location_address")]
            place = ", ".join(dict.fromkeys(p for p in places if p)) or None
            link = next((n.attrs["href"] for n in item.select(".evo_event_schema a[href]")), None)
            if (row := (title, start, end, place, link)) not in seen:
                seen.add(row)
                yield row


#: Seconds of an order's item on a calendar page: an evening, whole days, one day until its last minute, or without an end.
_BEGIN = "(CAST(1925000000 / 86400 AS BIGINT) + o_orderkey % 700) * 86400 + CASE o_orderkey % 4 WHEN 0 THEN 61200 WHEN 3 THEN 61200 ELSE -7200 END"
_LENGTH = "CASE o_orderkey % 4 WHEN 0 THEN 5400 WHEN 1 THEN 3 * 86400 - 60 WHEN 2 THEN 86400 - 60 END"


@query(f"""WITH i AS (SELECT o_orderkey, o_custkey, o_orderkey % 4 AS k, make_timestamp(({_BEGIN.replace('CAST(1925000000 / 86400 AS BIGINT)', '22280')} + 7200) * 1000000) AS b FROM orders WHERE o_orderkey % 10 > 0)
SELECT DISTINCT o_custkey, 'Item ' || o_orderkey % 1000 AS title, CASE WHEN k IN (0, 3) THEN strftime(b, '%Y-%m-%dT%H:%M') ELSE strftime(b, '%Y-%m-%d') END AS start, CASE k WHEN 0 THEN strftime(b + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M') WHEN 1 THEN strftime(b + INTERVAL 2 DAY, '%Y-%m-%d') END AS "end",
 CASE WHEN k < 2 THEN 'Old Mill, Dock street ' || k END AS place, CASE WHEN k = 0 THEN '/e/' || o_orderkey % 1000 END AS href FROM i""")
def calendar_rows(spark, base):
    """Items of calendar pages, one page for each customer with an item for each order; some have no title."""
    spark.udtf.register("calendar_rows", CalendarRows)
    k = F.col("o_orderkey") % 4
    begin, length = F.expr(_BEGIN.replace("CAST(1925000000 / 86400 AS BIGINT)", "22280L")), F.expr(_LENGTH)
    number = (F.col("o_orderkey") % 1000).cast("string")
    title = F.when(F.col("o_orderkey") % 10 > 0, F.concat(F.lit("Item "), number)).otherwise("")
    place = F.when(k < 2, F.concat(F.lit('<em class="evo_location_name">Old Mill</em><em class="evo_location_address">Dock street '), k.cast("string"), F.lit("</em>"))).otherwise("")
    link = F.when(k == 0, F.concat(F.lit('<div class="evo_event_schema"><a href="/e/'), number, F.lit('">x</a></div>'))).otherwise("")
    item = F.concat(F.lit('<div class="eventon_list_event evo" data-time="'), begin.cast("string"), F.coalesce(F.concat(F.lit("-"), (begin + length).cast("string")), F.lit("")), F.lit('"><span class="evcal_event_title">'), title, F.lit("</span>"), place, link, F.lit("</div>"))
    pages = Tables(spark, base).orders.select("o_custkey", item.alias("item")).groupBy("o_custkey").agg(F.array_join(F.collect_list("item"), "").alias("html"))
    pages.createOrReplaceTempView("calendar_pages")
    return spark.sql("SELECT o_custkey, title, start, end, place, href FROM calendar_pages, LATERAL calendar_rows(html, 'Etc/GMT-2')")


@F.pandas_udf(StructType([StructField("skeleton", StringType()), StructField("said", StringType())]))
def shortened(pages: pd.Series) -> pd.DataFrame:
    """Skeleton and own text of each page, from one tree; equal pages of a batch are read once."""
    known = {p: H.shortened(p) for p in pages.dropna().unique()}
    return pd.DataFrame([known.get(p, (None, None)) for p in pages], columns=["skeleton", "said"])


@query("""WITH n AS (SELECT p_partkey, CAST(p_size AS INT) AS n FROM part) SELECT p_partkey, '<ul class="x">' || array_to_string(list_transform(range(1, 1 + CASE WHEN n > 10 THEN 8 ELSE n END), lambda i: '<li><a href="/' || i || '">Part ' || i || '</a></li>'), '') || CASE WHEN n > 10 THEN '<p>[' || (n - 8) || ' more]</p>' ELSE '' END || '</ul>' AS skeleton,
 trim(array_to_string(list_transform(range(1, 1 + n), lambda i: 'Part ' || i), ' ')) AS said FROM n""")
def page_skeletons(spark, base):
    """Pages with as many like rows as a part's size, shortened to a skeleton, and their own text."""
    item = lambda i: F.concat(F.lit('<li data-n="1"><a href="/'), i.cast("string"), F.lit('">Part '), i.cast("string"), F.lit("</a></li>"))
    items = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size")), item), "")
    page = F.concat(F.lit('<html><head><title>t</title></head><body><nav>menu</nav><div id="cookie-bar">ok?</div><ul class="x" style="y">'), items, F.lit("</ul><div> </div><script>1</script><footer>end</footer></body></html>"))
    return Tables(spark, base).part.select("p_partkey", shortened(page).alias("s")).select("p_partkey", "s.skeleton", "s.said")


#: A part's row as an older reading stored it: title, location, url; by the part's key.
STORED = {
    "id": "p_partkey",
    "title": "CASE p_partkey % 8 WHEN 0 THEN p_name || '20:30' WHEN 1 THEN p_name || ' — concert, 5.5.2031 20:30, Hall ' || p_brand || '.' WHEN 2 THEN 'Reds – Blues – 3:1' WHEN 3 THEN '5. 5. 2031' WHEN 4 THEN 'ZRUŠENÉ: ' || p_name WHEN 5 THEN p_name || ' -' WHEN 6 THEN NULL ELSE '1984' END",
    "location": "CASE p_partkey % 8 WHEN 0 THEN 'Miesto: Old Mill | Brookton' WHEN 1 THEN p_brand WHEN 2 THEN 'Arena' WHEN 5 THEN 'TBA' WHEN 7 THEN 'Stage ' || p_brand END",
    "url": "CASE p_partkey % 8 WHEN 0 THEN 'https://a.example/e/' || p_partkey WHEN 1 THEN 'https://a.example/list' WHEN 2 THEN 'mailto:x@a.example' WHEN 5 THEN 'https://a.example/e/' || p_partkey || '.pdf' ELSE 'https://a.example/e/' || p_partkey END",
    "via": "CASE WHEN p_partkey % 8 = 1 THEN 'https://www.a.example/list/' ELSE 'https://a.example/list' END",
}


@query("""SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 2 THEN 'Reds – Blues' WHEN 7 THEN '1984' ELSE p_name END AS title, CASE p_partkey % 8 WHEN 0 THEN 'Old Mill, Brookton' WHEN 1 THEN 'Hall ' || p_brand WHEN 2 THEN 'Arena' WHEN 7 THEN 'Stage ' || p_brand END AS location,
 CASE WHEN p_partkey % 8 IN (0, 7) THEN 'https://a.example/e/' || p_partkey END AS url FROM part WHERE p_partkey % 8 NOT IN (3, 4, 6)""")
def repaired_rows(spark, base):
    """Stored rows of an older reading, read again; those that are no events go."""
    return R.repaired(Tables(spark, base).part.selectExpr(*(f"{e} AS {c}" for c, e in STORED.items())))


@query("""SELECT n_nationkey, 'concert in with ' || lower(n_name) || ' and friends' AS said FROM nation""")
def described(spark, base):
    """Descriptions without the places that they name."""
    text = F.concat(F.lit("Concert in National History Museum with "), F.col("n_name"), F.lit(" and friends Galéria Old Mill"))
    return Tables(spark, base).nation.select("n_nationkey", R.without_named_places(text, _NOUNS).alias("said"))


@query(f"""WITH w AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Night in Brookton' WHEN 1 THEN 'Millfordian choir' WHEN 2 THEN 'Eastmere' ELSE 'Mill choir' END AS title FROM customer),
s AS (SELECT c_custkey, list_filter(regexp_split_to_array(lower(title), '[^a-z]+'), lambda x: NOT (x IN ({', '.join(map(repr, TOWNS))}) OR (length(x) > 4 AND x[1:4] IN ({', '.join(repr(t[:4]) for t in TOWNS)})))) AS rest FROM w) SELECT c_custkey, array_to_string(rest, ' ') AS rest, len(rest) = 0 AS only_town FROM s""")
def without_town_names(spark, base):
    """Titles without the words that name a town, in any of their forms."""
    k = F.col("c_custkey") % 4
    title = F.when(k == 0, "Night in Brookton").when(k == 1, "Millfordian choir").when(k == 2, "Eastmere").otherwise("Mill choir")
    rest = F.filter(words(title), lambda w: ~names_town(w, TOWNS))
    return Tables(spark, base).customer.select("c_custkey", F.array_join(rest, " ").alias("rest"), (F.size(rest) == 0).alias("only_town"))
