"""robots.txt: rules of the wildcard group, and which paths they forbid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storeloom.functions.text import trim_spaces


def unsupported(pattern: Column) -> Column:
    """Whether a pattern is no prefix: a star before its end, or a dollar at it."""
    return pattern.rlike(r"\*(?s:.)") | pattern.endswith("$")


def parse(files: DataFrame) -> DataFrame:
    """Rows (host, text) to rules (host, line, kind, pattern); kind is disallow, allow, unsupported or sitemap.

    A run of user-agent lines opens a group, whatever blank or sitemap lines stand in it; any other
    directive ends the run. Whether a rule is in a wildcard group is a question
    about the last run before it: the runs are numbered by a running count, and a
    maximum within a run tells whether it names the wildcard. A text that is a null has no rules.
    """
    lines = files.select("host", F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw"))
    text = trim_spaces(F.regexp_replace("raw", r"#.*\z", ""))
    pairs = lines.withColumn("t", text).where(F.instr("t", ":") > 1)
    at = F.instr("t", F.lit(":"))
    pairs = pairs.select("host", "line", F.lower(trim_spaces(F.substring("t", F.lit(1), at - 1))).alias("key"), trim_spaces(F.substring("t", at + 1, F.length("t"))).alias("value"))
    site = pairs.where("key = 'sitemap' and value <> ''").select("host", "line", F.lit("sitemap").alias("kind"), F.col("value").alias("pattern"))
    rules = pairs.where("key <> 'sitemap'")
    order = Window.partitionBy("host").orderBy("line")
    agent = F.col("key") == "user-agent"
    opens = agent & ~F.coalesce(F.lag("key").over(order) == "user-agent", F.lit(False))
    rules = rules.withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(order))
    rules = rules.withColumn("wild", F.max(agent & (F.col("value") == "*")).over(Window.partitionBy("host", "group")))
    hard = unsupported(F.col("value"))
    kind = F.when(F.col("key") == "disallow", F.when(hard, "unsupported").otherwise("disallow")).when((F.col("key") == "allow") & ~hard, "allow")
    kept = rules.where("group > 0 and wild and value <> ''").withColumn("kind", kind).where("kind is not null")
    return kept.select("host", "line", "kind", F.col("value").alias("pattern")).unionByName(site)


def literal(pattern: Column) -> Column:
    return F.substring_index(pattern, "*", 1)


def disallowed(paths: DataFrame, rules: DataFrame, strict: bool = False) -> DataFrame:
    """Rows (host, path) with disallowed: the longest matching rule wins, allow at equal length.

    Rules are matched by prefix within a host. ``strict`` also lets ``/x$`` forbid ``/x`` itself.
    Hosts with many rules are joined by host, never every path with every rule.
    """
    usable = rules.where(F.col("kind").isin("disallow", "allow", "unsupported")).withColumn("prefix", literal(F.col("pattern")))
    if strict:
        usable = usable.withColumn("prefix", F.regexp_replace("prefix", r"\$\z", ""))
    hits = paths.select("host", "path").distinct().join(usable, "host").where(F.expr("startswith(path, prefix)"))
    deny = F.max(F.when(F.col("kind") != "allow", F.length("pattern")))
    allow = F.max(F.when(F.col("kind") == "allow", F.length("pattern")))
    verdict = hits.groupBy("host", "path").agg((F.coalesce(deny, F.lit(0)) > F.coalesce(allow, F.lit(0))).alias("disallowed"))
    return paths.join(verdict, ["host", "path"], "left").withColumn("disallowed", F.coalesce("disallowed", F.lit(False)))
