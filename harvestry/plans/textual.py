"""Queries over texts: folding, cleaning, titles, language by word lists, junk."""

from __future__ import annotations

from pyspark.sql import functions as F

from harvestry.functions import text as X
from harvestry.plans.registry import Tables, query

#: Small words of three languages for counting, as a caller's parameter would give them.
LEXICONS = {"en": "the and of for with to in on at is are be this that".split(), "de": "der die das und zu von mit ist nicht auf".split(), "fr": "le la les des et un une dans pour que".split()}
STOP_SQL = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
WORDS_SQL = "list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def _count(words: list[str]) -> str:
    return f"CAST(len(list_filter(w, lambda x: x IN ({', '.join(repr(x) for x in words)}))) AS BIGINT)"


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents")
def fold_text(spark, base):
    return Tables(spark, base).documents.select("doc_id", F.md5(X.fold(F.col("text")).cast("binary")).alias("folded"))


@query(r"SELECT doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS cleaned FROM documents")
def clean_text(spark, base):
    return Tables(spark, base).documents.select("doc_id", F.md5(X.clean(F.col("text")).cast("binary")).alias("cleaned"))


@query(f"""WITH t AS (SELECT p_partkey, list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP_SQL}) AND NOT regexp_full_match(w, '[0-9][0-9]?|(19|20)[0-9][0-9]'))) AS w FROM part)
SELECT p_partkey, list_sort(w) AS tokens, list_sort(list_distinct(list_transform(w, lambda x: CASE WHEN length(x) > 5 AND NOT regexp_matches(x, '[0-9]') THEN x[1:5] ELSE x END))) AS stems FROM t""")
def title_words(spark, base):
    name = F.col("p_name")
    return Tables(spark, base).part.select("p_partkey", F.sort_array(X.title_tokens(name)).alias("tokens"), F.sort_array(X.title_stems(name)).alias("stems"))


@query(f"""WITH d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), c AS (SELECT doc_id, {_count(LEXICONS['en'])} AS en, {_count(LEXICONS['de'])} AS de, {_count(LEXICONS['fr'])} AS fr FROM d)
SELECT doc_id, en, de, fr, CASE WHEN en >= 4 AND en >= 2 * (de + fr) THEN 'en' WHEN de >= 4 AND de >= 2 * (en + fr) THEN 'de' WHEN fr >= 4 AND fr >= 2 * (en + de) THEN 'fr' END AS lang FROM c""")
def language_by_words(spark, base):
    """Counts per word list, and the language whose words are enough and clearly more than the others'."""
    c = X.language_counts(F.col("text"), LEXICONS)
    rows = Tables(spark, base).documents.select("doc_id", *(v.cast("long").alias(k) for k, v in c.items()))
    clear = lambda a, *rest: (F.col(a) >= 4) & (F.col(a) >= 2 * sum((F.col(r) for r in rest[1:]), F.col(rest[0])))
    return rows.withColumn("lang", F.when(clear("en", "de", "fr"), "en").when(clear("de", "en", "fr"), "de").when(clear("fr", "en", "de"), "fr"))


@query(r"""WITH x AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Film night' || (o_orderkey % 24) || ':30' WHEN 1 THEN CAST(o_orderkey % 40 AS VARCHAR) || '. 5.' WHEN 2 THEN '1970' WHEN 3 THEN 'A – B – 36 - 67' ELSE 'Slavia   -  ' END AS raw FROM orders),
c AS (SELECT o_orderkey, raw, trim(regexp_replace(raw, '\s+', ' ', 'g')) AS t FROM x)
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'Film night' WHEN 3 THEN 'A – B' WHEN 4 THEN 'Slavia' ELSE t END AS title, o_orderkey % 5 = 1 AS junk FROM c""")
def clean_titles(spark, base):
    """Rendered titles, cleaned: a glued time, a score and a left separator go; a bare date is junk, a bare year is not."""
    k = F.col("o_orderkey")
    raw = (
        F.when(k % 5 == 0, F.concat(F.lit("Film night"), (k % 24).cast("string"), F.lit(":30"))).when(k % 5 == 1, F.concat((k % 40).cast("string"), F.lit(". 5.")))
        .when(k % 5 == 2, "1970").when(k % 5 == 3, "A – B – 36 - 67").otherwise("Slavia   -  ")
    )
    return Tables(spark, base).orders.select("o_orderkey", X.clean_title(raw).alias("title"), X.junk_title(raw).alias("junk"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[0-9]{1,2}:[0-9]{2}')) AS times, len(regexp_extract_all(text, '(?i)event|program|festival|ticket')) AS event_words,
 regexp_matches(text, '(?i)licen[sc]e') AS licensed FROM documents""")
def page_signals(spark, base):
    text = F.col("text")
    return Tables(spark, base).documents.select("doc_id", F.regexp_count(text, F.lit("[0-9]{1,2}:[0-9]{2}")).cast("long").alias("times"), F.regexp_count(text, F.lit("(?i)event|program|festival|ticket")).cast("long").alias("event_words"), text.rlike("(?i)licen[sc]e").alias("licensed"))


@query("""WITH y AS (SELECT doc_id, list_transform(regexp_extract_all(text, '(^|[^0-9])((19|20)[0-9]{2})([^0-9]|$)', 2), lambda v: CAST(v AS INT)) AS ys FROM documents)
SELECT doc_id, len(list_filter(ys, lambda v: v < 2024)) > 0 AND len(list_filter(ys, lambda v: v >= 2024)) = 0 AS past, len(ys) > 0 AND len(list_filter(ys, lambda v: v <= 2025)) = 0 AS far FROM y""")
def dated_texts(spark, base):
    """Texts with only past years, and those with only years far ahead of 2024."""
    years = F.transform(F.regexp_extract_all("text", F.lit("(^|[^0-9])((19|20)[0-9]{2})([^0-9]|$)"), F.lit(2)), lambda y: y.cast("int"))
    past = F.exists(years, lambda y: y < 2024) & ~F.exists(years, lambda y: y >= 2024)
    return Tables(spark, base).documents.select("doc_id", past.alias("past"), ((F.size(years) > 0) & F.forall(years, lambda y: y > 2025)).alias("far"))


@query("SELECT doc_id, sha1(text) AS hash FROM documents")
def content_hash(spark, base):
    return Tables(spark, base).documents.select("doc_id", F.sha1(F.col("text").cast("binary")).alias("hash"))


@query("""SELECT p_partkey, substr(sha1(regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') || '|' || strftime(DATE '1998-01-01' + CAST(p_partkey % 300 AS INT), '%Y-%m-%d')), 1, 16) AS event_id FROM part""")
def event_ids(spark, base):
    """The first 16 hex digits of a hash of the folded title and the day."""
    day = F.date_add(F.lit("1998-01-01").cast("date"), (F.col("p_partkey") % 300).cast("int")).cast("string")
    title = F.regexp_replace(X.fold(F.col("p_name")), "[^a-z0-9]", "")
    return Tables(spark, base).part.select("p_partkey", F.substring(F.sha1(F.concat(title, F.lit("|"), day).cast("binary")), 1, 16).alias("event_id"))
