"""URL filters: host-suffix and path-prefix expressions, an equi-join on short digest prefixes, then full digests and precedence."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT = 8  #: hex digits of a digest that the first join compares
MOST_BROADCAST = 200_000  #: rules up to which the rule table is broadcast; beyond, urls and rules are shuffled
SALTS = 16  #: parts into which an expression's urls are dealt when rules are shuffled


def host_of(url: Column) -> Column:
    """What stands after the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty for null or no `://`."""
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    host = F.translate(F.regexp_extract(after, r"(?s)^[^/?#]*", 0), string.ascii_uppercase, string.ascii_lowercase)
    return F.when(F.contains(url, F.lit("://")), host).otherwise("")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty for null or no `://`."""
    rest = F.substring_index(url, "://", 1)
    after = F.substring(url, F.length(rest) + 4, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(after, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_parts(rules: DataFrame) -> DataFrame:
    """rule (host and path in one, as in `example.com/de/`) and action, as rule, action, rule_host and rule_path."""
    host = F.substring_index("rule", "/", 1)
    return rules.select("rule", "action", host.alias("rule_host"), F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("rule_path"))


def expressions(host: Column, path: Column, lengths: list[int]) -> Column:
    """Each suffix of whole host labels with each prefix of the path that is as long as some rule's path."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    fitting = F.filter(F.array(*(F.lit(n) for n in lengths)), lambda n: n <= F.length(path))
    prefixes = F.transform(fitting, lambda n: F.substring(path, F.lit(1), n))
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, F.lit("\n"), p)))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict: a row for each row of `pages`.

    A rule fits its host and all subdomains if the url's path starts with the rule's. The longest fitting rule wins: more
    of the host first, then more of the path; of one rule with two actions, `block`. Urls without a rule get `default`;
    null urls and those without `://` have an empty host and path, which no rule fits; urls may be of any length. Repeated pages and null ids stay; other columns don't matter; an empty table gives none.
    Each host and path is judged once, however many pages have it.
    """
    rules = rule_parts(rules.where("rule is not null")).groupBy("rule", "rule_host", "rule_path").agg(F.max(F.col("action") == "block").alias("blocks"))
    # lengths of rule paths: no more of them than a url is long
    told = rules.agg(F.count("*"), F.collect_set(F.length("rule_path"))).first()
    few = told[0] <= MOST_BROADCAST
    digest = F.sha2(F.concat("rule_host", F.lit("\n"), "rule_path"), 256)
    rules = rules.select("rule", "blocks", F.length("rule_host").alias("rule_host_length"), digest.alias("rule_digest"), F.substring(digest, 1, SHORT).alias("short"))

    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    places = split.select("host", "path").where("host <> ''").distinct()
    asked = places.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), sorted(told[1]))).alias("expression"))
    asked = asked.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    if few:
        met = asked.join(F.broadcast(rules), "short")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = asked.withColumn("salt", F.pmod(F.xxhash64("host", "path"), F.lit(SALTS)).cast("int")).join(salted, ["short", "salt"])
    fits = met.where("digest = rule_digest")
    best = fits.groupBy("host", "path").agg(F.max(F.struct("rule_host_length", F.length("rule").alias("n"), "blocks", "rule")).alias("best"))
    verdict = F.when(F.col("best").isNull(), default).when(F.col("best.blocks"), "block").otherwise("allow")
    # a popular url, or the many without a host, would all go to one task: rows are dealt by salt, urls without a host by row
    salted = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("page_id", F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    judged = split.where("host <> ''").withColumn("salt", salt).join(salted, ["host", "path", "salt"], "left")
    out = ["page_id", "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict")]
    none = split.where("host = ''").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    return judged.select(*out).unionByName(none)
