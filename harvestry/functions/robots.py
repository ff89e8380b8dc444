"""What robots files allow: groups of agents, and the longest rule that a path begins with."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Characters of a path that rules are looked up by; longer rules are tested against the path itself.
LOOKED_UP = 256


def robots_groups(files: DataFrame) -> DataFrame:
    """host, agent (lower case), path, allow of each rule in files (host, text); a group without a rule has one that allows ''.

    Agent lines that follow each other begin one group together. Comments, blank lines and other lines say nothing; a rule before
    any agent is no one's. An empty Disallow allows everything.
    """
    lines = files.select("host", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("at", "line"))
    said = F.trim(F.regexp_replace("line", "#.*", ""))
    lines = lines.select("host", "at", F.lower(F.trim(F.substring_index(said, ":", 1))).alias("key"), F.trim(F.substring(said, F.instr(said, ":") + 1, F.length(said))).alias("value"))
    lines = lines.where(F.col("key").isin("user-agent", "allow", "disallow"))
    by = Window.partitionBy("host").orderBy("at")  # a file's lines; files are small by their purpose
    agent = F.col("key") == "user-agent"
    opens = agent & ~F.coalesce(F.lag(agent).over(by), F.lit(False))
    lines = lines.withColumn("group", F.sum(opens.cast("int")).over(by)).where("group > 0")
    agents = lines.where(agent).select("host", "group", F.lower("value").alias("agent")).distinct()
    rules = lines.where(~agent).select("host", "group", F.when(F.col("value") == "", "").otherwise(F.col("value")).alias("path"), ((F.col("key") == "allow") | (F.col("value") == "")).alias("allow"))
    return agents.join(rules, ["host", "group"], "left").select("host", "agent", F.coalesce("path", F.lit("")).alias("path"), F.coalesce("allow", F.lit(True)).alias("allow")).distinct()


def allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """`urls` (host, path and others) with `allowed`, by the rules of robots_groups().

    An agent that a host names has its own rules, any other those of `*`. Of the rules that a path begins with the longest
    decides, and of two equal ones the one that allows; without any the path is allowed. Rules meet paths by an equal join on
    host and beginning, so a host with very many rules or pages is no product of both.
    """
    agent = agent.lower()
    mine = rules.where(F.col("agent").isin(agent, "*"))
    named = mine.where(F.col("agent") == agent).select("host").distinct().withColumn("named", F.lit(True))
    mine = mine.join(named, "host", "left").where((F.col("agent") == agent) | F.col("named").isNull())
    mine = mine.groupBy("host", "path").agg(F.bool_or("allow").alias("allow")).withColumn("begin", F.substring("path", 1, LOOKED_UP))
    paths = urls.select("host", "path").distinct()
    begins = F.transform(F.sequence(F.lit(0), F.least(F.length("path"), F.lit(LOOKED_UP))), lambda n: F.substring(F.col("path"), F.lit(1), n))
    met = paths.select("host", F.col("path").alias("of"), F.explode(begins).alias("begin")).join(mine, ["host", "begin"]).where(F.col("of").startswith(F.col("path")))
    best = met.groupBy("host", F.col("of").alias("path")).agg(F.max_by("allow", F.length("path")).alias("allowed"))
    return urls.join(best, ["host", "path"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(True)))
