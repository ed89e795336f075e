"""robots.txt: parsing, and which rule decides for an address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rules(files: DataFrame, host: str = "host", text: str = "text") -> DataFrame:
    """(host, path, allow) of the groups that name `*`. User-agent lines in a row share a group; rules before any are for all."""
    lines = files.select(host, F.posexplode(F.split(text, r"\R")).alias("pos", "line"))
    bare = F.trim(F.regexp_replace("line", "#.*$", ""))
    lines = lines.select(host, "pos", F.lower(F.trim(F.regexp_extract(bare, r"^([^:]*):", 1))).alias("k"), F.trim(F.regexp_extract(bare, r"^[^:]*:(.*)$", 1)).alias("v"))
    lines = lines.where(F.col("k").isin("user-agent", "allow", "disallow"))
    w = W.partitionBy(host).orderBy("pos")
    lines = lines.withColumn("starts", (F.col("k") == "user-agent") & (F.coalesce(F.lag("k").over(w), F.lit("")) != "user-agent"))
    lines = lines.withColumn("g", F.sum(F.col("starts").cast("int")).over(w))
    ours = F.max((F.col("k") == "user-agent") & (F.col("v") == "*")).over(W.partitionBy(host, "g"))
    return lines.withColumn("ours", ours | (F.col("g") == 0)).where(F.col("ours") & (F.col("k") != "user-agent") & (F.col("v") != "")).select(host, F.col("v").alias("path"), (F.col("k") == "allow").alias("allow"))


def path_pattern(rule: Column) -> Column:
    """A rule's path as a pattern: `*` is any run, a last `$` anchors."""
    anchored = rule.endswith("$")
    body = F.when(anchored, F.substring(rule, F.lit(1), F.length(rule) - 1)).otherwise(rule)
    quoted = F.regexp_replace(body, r"([\\.+?^$(){}|\[\]])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(anchored, "$").otherwise(""))


def url_target(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return F.concat(F.when(path == "", "/").otherwise(path), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def literal(rule: Column) -> Column:
    """What a rule's matches begin with: its path up to the first `*`, or without a last `$`."""
    return F.regexp_replace(F.substring_index(rule, "*", 1), r"\$$", "")


def decided(urls: DataFrame, rule_table: DataFrame, key: list[str], host: list[str] | None = None) -> DataFrame:
    """urls (key, url[, host]) -> with allowed. The longest matching rule wins, allow wins ties, no rule allows.

    Rules are found by an equi-join of what they begin with, and host columns if there are any: an address has a row for each
    length of such beginnings (as many as there are different ones), not for each rule. Patterns are tried only on rules
    that are more than their beginning.
    """
    r = rule_table.select(*(host or []), literal(F.col("path")).alias("__start"), path_pattern(F.col("path")).alias("__p"), F.length("path").alias("__len"), F.col("allow").alias("__allow"), F.col("path").rlike(r"\*|\$$").alias("__open"))
    lengths = sorted(x[0] for x in r.select(F.length("__start")).distinct().collect())  # not more than the longest rule has characters
    u = urls.withColumn("__target", url_target(F.col("url")))
    short = F.filter(F.array(*map(F.lit, lengths)).cast("array<int>"), lambda n: n <= F.length("__target"))
    u = u.select(*dict.fromkeys([*key, *(host or [])]), "__target", F.explode_outer(short).alias("__n"))
    u = u.withColumn("__start", F.substring("__target", F.lit(1), F.col("__n")))
    m = u.join(r, [*(host or []), "__start"], "left")
    hit = F.col("__allow").isNotNull() & (~F.col("__open") | F.expr("__target RLIKE __p"))
    best = F.max_by(F.when(hit, F.col("__allow")), F.when(hit, F.struct("__len", "__allow")))
    return m.groupBy(*key).agg(F.coalesce(best, F.lit(True)).alias("allowed"))
