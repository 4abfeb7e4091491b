"""URL rules by a sort-merge range join on canonical keys.

A rule is a host and a path prefix; it fits its host and all subdomains. A canonical key is the host's
labels reversed, then the path, so that a rule's prefix is an interval of sorted keys. A subdomain adds
labels between host and path, so a url has one key for each suffix of its host, and a rule fits exactly if
one of these keys lies in its interval. Intervals of prefixes are nested or apart. A sweep over rules and
keys in sorted order therefore needs a stack of the open rules only: the running sum of starts and ends is
its height, and the last rule started at that height is its top. Both are window functions, the second within one
height, so rules may be nested as deeply as they like. Keys are compared as UTF-8, where no byte is 0xFF: a prefix with
that byte after it ends its interval.

The sweep runs apart for each rule host and salt: rules are copied to every salt of their host, so that a
host with most of all urls is swept in many tasks. A host has a salt for SWEPT urls, or for COPIES of its rules if that is more, by
its counted urls. Only suffixes that are some rule's host are swept.

The longest rule (host and path together) wins, the least by code point among equals, block among rules
that are the same. Null urls and those without `://` have empty host and path and fit no rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import storage

ALLOW, BLOCK = "allow", "block"
#: Broadcast what is a row a rule host up to so many rules.
MAX_BROADCAST = 100_000
#: Urls of a host that one sweep takes, and at least so many for each rule that is copied to it.
SWEPT, COPIES = 2_000, 16


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, prefix, rule, verdict) from (verdict, host, path)."""
    return spark.createDataFrame([(h.lower(), p, h + p, v) for v, h, p in rules], "rule_host string, prefix string, rule string, rule_verdict string")


def split_url(url) -> tuple:
    """Columns host and path of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def judge(urls: DataFrame, rules: DataFrame, default: str = ALLOW, swept: int = SWEPT) -> DataFrame:
    """(id, host, path, rule, verdict) of rows (id, url); rule is null and the verdict the default where none fits.

    Ids may repeat or be null: each row is judged by itself. rules as from rule_table; without rules all get the default.
    """
    host, path = split_url(F.col("url"))
    rows = storage.checkpointed(urls.select("id", "url").select("id", host.alias("host"), path.alias("path")))
    # equal (host, path) are judged once, however many rows have them
    asked = rows.where("host <> ''").select("host", "path").distinct()
    rules = rules.groupBy("rule_host", "prefix").agg(F.min("rule").alias("rule"), F.max("rule_verdict").alias("rule_verdict"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keys = asked.select("host", "path", F.explode(suffixes).alias("at")).join(rules.select(F.col("rule_host").alias("at")).distinct(), "at", "left_semi")
    keys = storage.checkpointed(keys)
    # a row a rule host
    load = keys.groupBy("at").agg(F.count("*").alias("urls")).join(rules.groupBy(F.col("rule_host").alias("at")).agg(F.count("*").alias("rules")), "at")
    load = load.select("at", F.ceil(F.col("urls") / F.greatest(F.lit(swept), COPIES * F.col("rules"))).alias("salts"))
    spread = F.broadcast(load) if rules.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST else load
    # within one host the canonical keys differ in the path alone
    none, bytes_ = F.lit(None).cast("string"), lambda c: F.encode(c, "UTF-8")
    point = keys.join(spread, "at").select("at", F.pmod(F.xxhash64("host", "path"), F.col("salts")).alias("salt"), bytes_(F.col("path")).alias("key"), F.lit(2).alias("kind"), F.lit(0).alias("order"), "host", "path", none.alias("rule"), none.alias("rule_verdict"))
    copied = rules.withColumnRenamed("rule_host", "at").join(load, "at").select("at", "prefix", "rule", "rule_verdict", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    start = copied.select("at", "salt", bytes_(F.col("prefix")).alias("key"), F.lit(1).alias("kind"), F.length("prefix").alias("order"), none.alias("host"), none.alias("path"), "rule", "rule_verdict")
    end = copied.select("at", "salt", F.concat(bytes_(F.col("prefix")), F.unhex(F.lit("FF"))).alias("key"), F.lit(0).alias("kind"), (-F.length("prefix")).alias("order"), none.alias("host"), none.alias("path"), none.alias("rule"), none.alias("rule_verdict"))
    events = point.unionByName(start).unionByName(end)
    sweep = Window.partitionBy("at", "salt").orderBy("key", "kind", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == 1, 1).when(F.col("kind") == 0, -1).otherwise(0)
    events = events.withColumn("height", F.sum(step).over(sweep)).where("kind > 0 AND height > 0")
    level = Window.partitionBy("at", "salt", "height").orderBy("key", "kind", "order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = F.last(F.when(F.col("kind") == 1, F.struct("rule", "rule_verdict")), ignorenulls=True).over(level)
    swept_ = events.withColumn("top", top).where("kind = 2")
    best = swept_.select("host", "path", "top").groupBy("host", "path").agg(F.min(F.struct((-F.length("top.rule")).alias("k"), F.col("top.rule").alias("rule"), F.col("top.rule_verdict").alias("verdict"))).alias("best"))
    best = storage.checkpointed(best.select("host", "path", "best.rule", "best.verdict"))
    return rows.join(best, ["host", "path"], "left").select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
