"""Evidence cascades, verdict look-ups and keyword tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harvestry.operators import learning as L
from harvestry.plans.registry import Tables, query

#: Fixed order of tags in every result.
TAGS = ("cinema", "concert", "theatre", "exhibition", "festival", "kids", "sport", "workshop", "talk", "party", "market")
#: Tags that a screening keeps beside its own.
BESIDE = ("festival", "kids")
#: Words for the stand-in titles; a deployment gives its own rules.
RULES = {"concert": "promo|brushed", "theatre": "copper|brass", "exhibition": "steel|nickel", "festival": "large|economy", "kids": "small|medium", "market": "tin"}


@query("""SELECT o_orderkey, coalesce(CASE WHEN c_acctbal > 8000 THEN 'home' WHEN c_acctbal < -800 THEN 'abroad' END, CASE WHEN o_orderpriority = '1-URGENT' THEN 'home' END,
 CASE WHEN n_regionkey = 3 THEN 'abroad' END, CASE WHEN o_orderkey % 7 = 0 THEN 'home' WHEN o_orderkey % 7 = 1 THEN 'abroad' END) AS verdict,
 CASE WHEN c_acctbal > 8000 OR c_acctbal < -800 THEN 1 WHEN o_orderpriority = '1-URGENT' THEN 2 WHEN n_regionkey = 3 THEN 3 WHEN o_orderkey % 7 < 2 THEN 4 END AS step
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def evidence_cascade(spark, base):
    """The first step that says something decides; the step is kept as provenance."""
    t = Tables(spark, base)
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    bal = F.col("c_acctbal")
    steps = [
        F.when(bal > 8000, "home").when(bal < -800, "abroad"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "home"),
        F.when(F.col("n_regionkey") == 3, "abroad"),
        F.when(F.col("o_orderkey") % 7 == 0, "home").when(F.col("o_orderkey") % 7 == 1, "abroad"),
    ]
    which = F.coalesce(*(F.when(s.isNotNull(), i) for i, s in enumerate(steps, 1)))
    return rows.select("o_orderkey", F.coalesce(*steps).alias("verdict"), which.alias("step"))


@query("""WITH f AS (SELECT l_partkey AS fine, l_suppkey % 50 AS c, l_suppkey % 5 AS h, l_orderkey, l_linenumber FROM lineitem),
 vf AS (SELECT fine, CASE WHEN count(*) >= 25 THEN sum(l_linenumber) END AS v FROM f GROUP BY 1), vc AS (SELECT c, CASE WHEN count(*) >= 1250 THEN sum(l_linenumber) END AS v FROM f GROUP BY 1), vh AS (SELECT h, sum(l_linenumber) AS v FROM f GROUP BY 1)
SELECT l_orderkey, l_linenumber, CAST(coalesce(vf.v, vc.v, vh.v) AS BIGINT) AS verdict FROM f LEFT JOIN vf USING (fine) LEFT JOIN vc USING (c) LEFT JOIN vh USING (h)""")
def region_at(spark, base):
    """The finest level with enough visits decides: exact template, coarse template, host."""
    f = Tables(spark, base).lineitem.select(F.col("l_partkey").alias("fine"), (F.col("l_suppkey") % 50).alias("c"), (F.col("l_suppkey") % 5).alias("h"), "l_orderkey", "l_linenumber")
    total = F.sum("l_linenumber")
    enough = lambda n: F.when(F.count("*") >= n, total)
    out = f.join(f.groupBy("fine").agg(enough(25).alias("vf")), "fine", "left").join(f.groupBy("c").agg(enough(1250).alias("vc")), "c", "left").join(f.groupBy("h").agg(total.alias("vh")), "h", "left")
    return out.select("l_orderkey", "l_linenumber", F.coalesce("vf", "vc", "vh").alias("verdict"))


def tag_array(text, rules: dict[str, str] = RULES):
    """The tags whose words occur, in the fixed order."""
    return F.filter(F.array(*(F.when(text.rlike(rules[t]), t) for t in TAGS if t in rules)), lambda x: x.isNotNull())


def _tags_sql(rules: dict[str, str] = RULES) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(lower(p_type || ' ' || p_name), '{rules[t]}') THEN '{t}' END" for t in TAGS if t in rules) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT p_partkey, {_tags_sql()} AS tags FROM part")
def keyword_tags(spark, base):
    return Tables(spark, base).part.select("p_partkey", tag_array(F.lower(F.concat_ws(" ", "p_type", "p_name"))).alias("tags"))


#: Parts as listings: each third has a verdict of its own, which follows the title's first word but for some.
VERDICTS_SQL = f"""v AS (SELECT p_partkey AS id, p_name || ' ' || (p_partkey % 40) AS title, p_brand || ' ' || split_part(p_name, ' ', 1) AS venue, CAST(p_size AS VARCHAR) AS page,
  list_distinct(list_filter(string_split(p_name, ' '), lambda w: len(w) >= 4)) AS words, CASE WHEN p_partkey % 3 <> 0 THEN NULL WHEN p_partkey % 23 = 0 THEN ['talk'] WHEN p_partkey % 31 = 0 THEN []
  ELSE [CASE len(split_part(p_name, ' ', 1)) % 3 WHEN 0 THEN 'market' WHEN 1 THEN 'kids' ELSE 'cinema' END] END AS tags FROM part),
e AS (SELECT id, 'venue' AS kind, venue AS key, title, tags FROM v UNION ALL SELECT id, 'page', page, title, tags FROM v UNION ALL SELECT id, 'word', unnest(words), title, tags FROM v),
t AS (SELECT kind, key, title, min(id) AS first FROM e WHERE tags IS NOT NULL GROUP BY ALL), l AS (SELECT *, row_number() OVER (PARTITION BY kind, key ORDER BY first, title) AS place FROM t),
c AS (SELECT e.* FROM e LEFT JOIN l ON e.kind = l.kind AND e.key = l.key AND e.title = l.title AND place <= {L.REMEMBERED} WHERE e.tags IS NOT NULL AND (l.first IS NULL OR e.id = l.first)),
n AS (SELECT kind, key, count(*) AS n FROM c GROUP BY ALL), k AS (SELECT kind, key, tag, count(*) AS c FROM (SELECT kind, key, unnest(tags) AS tag FROM c) GROUP BY ALL),
r AS (SELECT kind, key, tag, n, c, CASE kind {" ".join(f"WHEN '{k}' THEN n >= {least} AND c / n >= {share}" for k, (least, share) in L.NEEDED.items())} END AS active FROM k JOIN n USING (kind, key))"""


def verdicts(t: Tables) -> DataFrame:
    """id, title, tags (null without a verdict), and each listing's evidence as (kind, key)."""
    k, word = F.col("p_partkey"), F.split_part("p_name", F.lit(" "), F.lit(1))
    said = F.get(F.array(*map(F.lit, ("market", "kids", "cinema"))), F.length(word) % 3)
    tags = F.when(k % 3 != 0, None).when(k % 23 == 0, F.array(F.lit("talk"))).when(k % 31 == 0, F.array().cast("array<string>")).otherwise(F.array(said))
    words = F.array_distinct(F.filter(F.split("p_name", " "), lambda w: F.length(w) >= 4))
    known = F.concat(
        F.array(F.struct(F.lit("venue").alias("kind"), F.concat_ws(" ", "p_brand", word).alias("key")), F.struct(F.lit("page").alias("kind"), F.col("p_size").cast("string").alias("key"))),
        F.transform(words, lambda w: F.struct(F.lit("word").alias("kind"), w.alias("key"))),
    )
    return t.part.select(k.alias("id"), F.concat_ws(" ", "p_name", (k % 40).cast("string")).alias("title"), tags.alias("tags"), F.inline(known))


def rules_of(each: DataFrame) -> DataFrame:
    return L.tag_rules(each.where("tags is not null").withColumn("at", F.col("id")))


@query(f"WITH {VERDICTS_SQL} SELECT kind, key, tag, n, c, active FROM r")
def tag_rules(spark, base):
    """What venues, listing pages and words of titles say of tags, and whether enough verdicts agree."""
    return rules_of(verdicts(Tables(spark, base)))


@query(f"WITH {VERDICTS_SQL} SELECT kind, count(*) AS rules, count(*) FILTER (WHERE active) AS active FROM r GROUP BY 1")
def active_rules(spark, base):
    return rules_of(verdicts(Tables(spark, base))).groupBy("kind").agg(F.count("*").alias("rules"), F.count_if("active").alias("active"))


_ORDER = "[" + ", ".join(f"'{t}'" for t in TAGS) + "]"


@query(f"""WITH {VERDICTS_SQL}, g AS (SELECT e.id, list(DISTINCT r.tag) AS learned FROM e JOIN r USING (kind, key) WHERE r.active GROUP BY 1),
 p AS (SELECT p_partkey, p_size % 4 = 3 AS live, list_concat(CASE WHEN p_partkey % 4 = 0 THEN {_tags_sql()} ELSE [] END, CASE WHEN p_size % 5 = 0 THEN ['cinema'] ELSE [] END) AS guessed, CASE p_partkey % 10 WHEN 1 THEN ['sport'] WHEN 2 THEN ['cinema', 'festival'] ELSE [] END AS own FROM part),
 f AS (SELECT p_partkey, live, list_concat(CASE WHEN len(own) > 0 AND NOT list_contains(own, 'cinema') THEN list_filter(guessed, lambda x: x <> 'cinema') ELSE guessed END, own) AS rules, coalesce(learned, []) AS learned, coalesce(tags, []) AS answers FROM p JOIN v ON p_partkey = v.id LEFT JOIN g ON p_partkey = g.id),
 w AS (SELECT p_partkey, live, CASE WHEN len(rules) > 0 THEN rules WHEN len(learned) > 0 THEN learned ELSE answers END AS tags, CASE WHEN len(rules) > 0 THEN 'rules' WHEN len(learned) > 0 THEN 'learned' ELSE 'ai' END AS origin FROM f)
SELECT p_partkey, list_filter({_ORDER}, lambda x: list_contains(tags, x) AND CASE WHEN NOT list_contains(tags, 'cinema') THEN true WHEN live THEN x <> 'cinema' ELSE list_contains(['cinema', {", ".join(f"'{x}'" for x in BESIDE)}], x) END) AS tags, origin FROM w""")
def tag_provenance(spark, base):
    """A listing's tags and where they come from: its words and its sources' own data, else learned rules, else an answer."""
    t = Tables(spark, base)
    each = verdicts(t)
    learned = L.learned_tags(each.select("id", "kind", "key"), rules_of(each))
    answers = each.where("kind = 'venue'").select("id", F.col("tags").alias("answers"))
    k, none = F.col("p_partkey"), F.array().cast("array<string>")
    words = F.when(k % 4 == 0, tag_array(F.lower(F.concat_ws(" ", "p_type", "p_name")))).otherwise(none)
    guessed = F.concat(words, F.when(F.col("p_size") % 5 == 0, F.array(F.lit("cinema"))).otherwise(none))
    own = F.when(k % 10 == 1, F.array(F.lit("sport"))).when(k % 10 == 2, F.array(F.lit("cinema"), F.lit("festival")))
    rows = t.part.select(k.alias("id"), guessed.alias("guessed"), own.alias("own"), (F.col("p_size") % 4 == 3).alias("live")).join(answers, "id").join(learned, "id", "left")
    found = L.sourced_tags(*map(F.col, ("guessed", "own", "learned", "answers", "live")), TAGS, "cinema", BESIDE)
    origin = F.when(F.size(F.concat(F.coalesce("own", none), "guessed")) > 0, "rules").when(F.size(F.coalesce("learned", none)) > 0, "learned").otherwise("ai")
    return rows.select(F.col("id").alias("p_partkey"), F.transform(found, lambda x: x["tag"]).alias("tags"), origin.alias("origin"))


@query(f"WITH t AS (SELECT unnest({_tags_sql()}) AS tag FROM part) SELECT tag, count(*) AS n FROM t GROUP BY 1")
def tag_counts(spark, base):
    return Tables(spark, base).part.select(F.explode(tag_array(F.lower(F.concat_ws(" ", "p_type", "p_name")))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
