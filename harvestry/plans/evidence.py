"""Where listings are: orders as listings, nations and regions as places, suppliers as sites and learned regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.functions import evidence as E
from harvestry.plans.registry import Tables, query

#: Listings of orders: columns by expressions that Spark and SQL read alike. Titles, places and addresses say one thing or another
#: by the order's key, with the names of its customer's nation and region.
LISTED = {
    "id": "o_orderkey",
    "title": "CASE o_orderkey % 9 WHEN 0 THEN 'Bears (LD)' WHEN 1 THEN 'Bears - AV tour' WHEN 2 THEN 'Velo nera soŵ vasi' WHEN 3 THEN 'Join us for the day' WHEN 4 THEN 'Velo jera' WHEN 5 THEN NULL ELSE c_mktsegment END",
    "description": "CASE o_orderkey % 9 WHEN 2 THEN 'elo nera' WHEN 3 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'with the best of the town' ELSE 'with the best of ' || n_name END WHEN 4 THEN 'ela nero syř ela' END",
    "location": "CASE o_orderkey % 8 WHEN 1 THEN 'Hall, ' || n_name WHEN 2 THEN 'Hall, ' || r_name WHEN 3 THEN 'Club 9' WHEN 4 THEN 'Salo nameste' WHEN 5 THEN 'Stage of ' || c_name WHEN 6 THEN n_name || ' near ' || r_name WHEN 7 THEN 'Somewhere' END",
    "via": "CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 11 = 1 THEN 'no address' WHEN o_orderkey % 11 = 2 THEN 'https://b.example/arvia/lundia' WHEN o_orderkey % 11 = 3 THEN 'https://c.ld/lundia/list' ELSE 'https://www.s' || (c_custkey % 40) || CASE WHEN c_custkey % 40 < 20 THEN '.ld' ELSE '.example' END || '/list' END",
    "country": "CASE o_orderkey % 13 WHEN 0 THEN 'av' WHEN 1 THEN 'LD' WHEN 2 THEN ' ' END",
    "page_country": "CASE o_orderkey % 17 WHEN 0 THEN 'AV' WHEN 1 THEN 'lundia' END",
    "lat": "CASE o_orderkey % 19 WHEN 0 THEN CAST(47 AS DOUBLE) WHEN 1 THEN CAST(10 AS DOUBLE) END",
    "lon": "CASE WHEN o_orderkey % 19 < 2 THEN CAST(18 AS DOUBLE) END",
}
GAZETTEER = {"name": "name", "kind": "CASE k % 4 WHEN 0 THEN 'town' WHEN 1 THEN 'foreign town' WHEN 2 THEN 'village' ELSE 'town' END"}
_HOST = "'s' || (s_suppkey % 40) || CASE WHEN s_suppkey % 40 < 20 THEN '.ld' ELSE '.example' END"
SITES = {"host": "host", "city": "CASE WHEN k % 3 = 0 THEN town END", "venue_town": "CASE WHEN k % 3 = 1 THEN town END", "judged": "CASE k % 7 WHEN 0 THEN 'mixed' WHEN 1 THEN 'abroad' END"}
REGIONS = {"host": "host", "region": "CASE k % 5 WHEN 0 THEN 'abroad' WHEN 1 THEN 'home' WHEN 2 THEN 'home' END"}
VENUES = {"location": "'hall, ' || lower(n_name)", "lat": "CAST(40 + n_nationkey % 12 AS DOUBLE)", "lon": "CAST(10 + n_nationkey AS DOUBLE)", "precision": "CASE WHEN n_nationkey % 2 = 0 THEN 'venue' ELSE 'manual' END"}
#: The tables that those columns are of.
_FROM = {
    "listed": "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "sites": f"(SELECT {_HOST} AS host, min(s_suppkey) AS k, min(n_name) AS town FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)",
}
_COLUMNS = lambda columns: ", ".join(f"{e} AS {c}" for c, e in columns.items())
LISTED_SQL = f"(SELECT {_COLUMNS(LISTED)} FROM {_FROM['listed']})"
GAZETTEER_SQL = f"(SELECT {_COLUMNS(GAZETTEER)} FROM (SELECT lower(n_name) AS name, n_nationkey AS k FROM nation) UNION ALL SELECT lower(r_name), CASE r_regionkey % 3 WHEN 0 THEN 'home country' WHEN 1 THEN 'foreign country' ELSE 'foreign town' END FROM region)"
SITES_SQL = f"(SELECT {_COLUMNS(SITES)} FROM {_FROM['sites']})"
REGIONS_SQL = f"(SELECT {_COLUMNS(REGIONS)} FROM {_FROM['sites']})"
VENUES_SQL = f"(SELECT {_COLUMNS(VENUES)} FROM nation)"


def inputs(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Listings, places, sites, venues and learned regions, as country_evidence() takes them."""
    pick = lambda df, columns: df.selectExpr(*(f"{e} AS {c}" for c, e in columns.items()))
    lived = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    listed = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(lived, F.col("c_nationkey") == F.col("n_nationkey"))
    named = pick(t.nation.selectExpr("lower(n_name) AS name", "n_nationkey AS k"), GAZETTEER)
    named = named.union(t.region.selectExpr("lower(r_name)", "CASE r_regionkey % 3 WHEN 0 THEN 'home country' WHEN 1 THEN 'foreign country' ELSE 'foreign town' END"))
    hosts = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.expr(_HOST).alias("host")).agg(F.min("s_suppkey").alias("k"), F.min("n_name").alias("town"))
    return pick(listed, LISTED), named, pick(hosts, SITES), pick(t.nation, VENUES), pick(hosts, REGIONS)


#: An invented country.
LUNDIA = E.Country(
    code="ld", foreign_codes=["av", "bo"], suffix=".ld", in_urls=(["lundia", "brookton"], ["arvia", "bolia"]), box=(46.0, 49.0, 17.0, 20.0), place_words=["nameste", "ulico"], foreign_place_words=["strasse"],
    home=E.Language("nera elo soŵ vasi".split(), "ŵ"), sister=E.Language("nero ela syř".split(), "ř"), world=E.Language("the and of for with to in on at is are be us join".split()), names=["lundia"],
)

_COUNT = lambda known: f"len(list_filter(lw, lambda w: w IN ({', '.join(repr(w) for w in known)})))"
_LANGUAGE = f"""CASE WHEN hl + sl > 0 AND h >= 1 AND h + hl >= 2 AND h + hl >= 2 * s AND h + hl >= w / 2 THEN 'home' WHEN hl + sl > 0 AND s >= 2 AND s >= 2 * (h + hl) AND s + sl >= w / 2 THEN 'sister' WHEN w >= 4 AND w >= 4 * (h + s) THEN 'world' END"""


def _language_sql(rows: str, key: str, text: str) -> str:
    return f"""{rows}_w AS (SELECT {key}, lower(coalesce({text}, '')) AS lt, list_filter(regexp_split_to_array(lower(coalesce({text}, '')), '[^\\p{{L}}]+'), lambda w: w <> '') AS lw FROM {rows}),
{rows}_c AS (SELECT {key}, {_COUNT(LUNDIA.home.words)} AS h, {_COUNT(LUNDIA.sister.words)} AS s, {_COUNT(LUNDIA.world.words)} AS w, length(lt) - length(replace(lt, 'ŵ', '')) AS hl, length(lt) - length(replace(lt, 'ř', '')) AS sl FROM {rows}_w),
{rows}_l AS (SELECT {key}, {_LANGUAGE} AS language FROM {rows}_c)"""


_KINDS = lambda text, name: f"{name} AS (SELECT r.id, list_distinct(list(g.kind)) AS k FROM r JOIN gz g ON contains(' ' || array_to_string(list_filter(regexp_split_to_array(strip_accents(lower({text})), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), ' ') || ' ', ' ' || g.name || ' ') GROUP BY 1)"
EVIDENCE_SQL = f"""gz AS (SELECT * FROM {GAZETTEER_SQL}), l AS (SELECT *, nullif(regexp_replace(regexp_extract(lower(coalesce(via, '')), '^[a-z]+://([^/]+)', 1), '^www\\.', ''), '') AS host, concat_ws(' ', title, description) AS said FROM {LISTED_SQL}),
r AS (SELECT l.* EXCLUDE (lat, lon), city, venue_town, coalesce(judged IN ('mixed', 'abroad'), false) AS away, region, coalesce(l.lat, v.lat) AS lat, coalesce(l.lon, v.lon) AS lon, CASE WHEN l.lat IS NOT NULL THEN 'page' ELSE v.precision END AS how,
  coalesce(l.host LIKE '%.ld', false) AS here, location IS NULL AS nowhere, lower(coalesce(title, '')) AS t, list_filter(regexp_split_to_array(lower(coalesce(via, '')), '[^a-z]+'), lambda w: w IN ('lundia', 'brookton', 'arvia', 'bolia'))[1] AS named
  FROM l LEFT JOIN {SITES_SQL} s USING (host) LEFT JOIN {REGIONS_SQL} g USING (host) LEFT JOIN (SELECT location AS k, lat, lon, precision FROM {VENUES_SQL}) v ON v.k = lower(l.location)),
{_KINDS('location', 'kl')}, {_KINDS("coalesce(city, venue_town)", 'ks')}, {_KINDS("concat_ws(' ', said, location)", 'kt')}, {_language_sql('r', 'id', 'said')},
j AS (SELECT r.*, coalesce(kl.k, []) AS kl, coalesce(ks.k, []) AS ks, coalesce(kt.k, []) AS kt, language FROM r LEFT JOIN kl USING (id) LEFT JOIN ks USING (id) LEFT JOIN kt USING (id) JOIN r_l USING (id)),
o AS (SELECT *, lat BETWEEN 46 AND 49 AND lon BETWEEN 17 AND 20 AS inside, lat IS NOT NULL AND lon IS NOT NULL AS known, CASE WHEN list_contains(kl, 'home country') THEN 'home' WHEN list_contains(kl, 'foreign country') THEN 'abroad' WHEN list_contains(kl, 'town') THEN 'home' WHEN list_contains(kl, 'foreign town') THEN 'abroad' WHEN list_contains(kl, 'village') THEN 'village' END AS own,
  CASE WHEN list_contains(ks, 'home country') THEN 'home' WHEN list_contains(ks, 'foreign country') THEN 'abroad' WHEN list_contains(ks, 'town') THEN 'home' WHEN list_contains(ks, 'foreign town') THEN 'abroad' WHEN list_contains(ks, 'village') THEN 'home' END AS city_says FROM j),
q AS (SELECT *, coalesce(known AND inside AND coalesce(how, '') NOT IN ('page', 'manual') AND len(list_intersect(kl, ['town', 'village', 'foreign town'])) = 0, false) AS guess FROM o),
e AS (SELECT id, [
  CASE WHEN own = 'village' THEN CASE WHEN region = 'abroad' THEN 'abroad' ELSE 'home' END END, CASE WHEN own IN ('home', 'abroad') THEN own END, CASE WHEN trim(page_country) <> '' THEN CASE WHEN lower(trim(page_country)) IN ('ld', 'lundia') THEN 'home' ELSE 'abroad' END END,
  CASE WHEN known AND NOT guess THEN CASE WHEN inside THEN 'home' ELSE 'abroad' END END, CASE WHEN regexp_matches(lower(location), '\\b(nameste|ulico)\\b') THEN 'home' END, CASE WHEN trim(country) <> '' THEN CASE WHEN lower(trim(country)) IN ('ld', 'lundia') THEN 'home' ELSE 'abroad' END END,
  CASE WHEN contains(t, '(ld)') THEN 'home' WHEN regexp_matches(t, '\\((av|bo)\\b|\\b(av|bo) (mini)?tour\\b') THEN 'abroad' END, CASE WHEN named IN ('arvia', 'bolia') THEN 'abroad' WHEN named IS NOT NULL AND (nowhere OR here) THEN 'home' END, city_says,
  CASE WHEN host IS NOT NULL AND nowhere AND here AND NOT away THEN 'home' END,
  CASE WHEN host IS NULL THEN NULL WHEN language = 'home' THEN 'home' WHEN language = 'sister' AND coalesce(region, '') <> 'home' THEN 'abroad' WHEN language = 'world' AND (away OR (NOT here AND coalesce(region, '') <> 'home')) AND len(list_intersect(kt, ['town', 'village', 'home country'])) = 0 THEN 'abroad' END,
  CASE WHEN guess THEN 'home' END, CASE WHEN host IS NOT NULL AND nowhere AND NOT away AND region = 'home' THEN 'home' END] AS c,
  ['village', 'location', 'page', 'coordinates', 'place words', 'answer', 'title code', 'address', 'site city', 'domain', 'text', 'guessed coordinates', 'region'] AS s FROM q)"""


@query(f"WITH {EVIDENCE_SQL} SELECT id, list_filter(c, lambda x: x IS NOT NULL)[1] AS verdict, list_filter(s, lambda n, i: c[i] IS NOT NULL)[1] AS step, list_filter(c[1:12], lambda x: x IS NOT NULL)[1] AS strong FROM e")
def country_evidence(spark, base):
    """The whole cascade over orders as listings."""
    return E.country_evidence(*inputs(Tables(spark, base)), LUNDIA)


@query(f"WITH {EVIDENCE_SQL}, v AS (SELECT id, list_filter(c[1:12], lambda x: x IS NOT NULL)[1] AS strong FROM e) SELECT coalesce(l.host, '') AS host, count(*) FILTER (WHERE strong = 'home') AS home, count(*) FILTER (WHERE strong = 'abroad') AS abroad, count(*) FILTER (WHERE strong IS NULL) AS unknown FROM v JOIN l USING (id) GROUP BY 1")
def evidence_tallies(spark, base):
    """What each site's listings add to its learned region: only verdicts that do not rest on it."""
    host = F.coalesce(F.nullif(E.U.bare_host(F.coalesce("via", F.lit(""))), F.lit("")), F.lit("")).alias("host")
    rows = country_evidence(spark, base).join(inputs(Tables(spark, base))[0].select("id", host), "id")
    return rows.groupBy("host").agg(F.count_if(F.col("strong") == "home").alias("home"), F.count_if(F.col("strong") == "abroad").alias("abroad"), F.count_if(F.col("strong").isNull()).alias("unknown"))


@query(f"""WITH d AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'soŵ nera ' || substr(text, 1, 80) WHEN 1 THEN 'ela nero syř ' || substr(text, 1, 80) ELSE text END AS said FROM documents), {_language_sql('d', 'doc_id', 'said')} SELECT doc_id, language FROM d_l""")
def text_language(spark, base):
    """The language of documents; some begin with words of two invented languages."""
    k, head = F.col("doc_id") % 5, F.substring("text", 1, 80)
    said = F.when(k == 0, F.concat(F.lit("soŵ nera "), head)).when(k == 1, F.concat(F.lit("ela nero syř "), head)).otherwise(F.col("text"))
    return E.with_language(Tables(spark, base).documents.select("doc_id", said.alias("said")), "said", LUNDIA).select("doc_id", "language")
