"""URL filters: host-suffix and path-prefix rules found by hash-prefix joins.

Each URL is expanded into the host suffixes of as many labels as some rule
has, each joined with the path prefixes of the lengths that rules have. The
expressions meet the rules in an equi-join on the first bytes of their
SHA-256 digest only; of what meets, full digests confirm, and the longest
confirmed rule decides.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower

#: Hexadecimal digits of a digest that the join compares.
PREFIX_DIGITS = 8
#: Rules up to this many are broadcast; beyond it both sides are shuffled.
BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str


#: The rules of the query.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def host_of(url: Column) -> Column:
    """Text between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _rules_table(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [(r.action, r.host, r.path) for r in rules]
    made = spark.createDataFrame(rows, "action string, host string, path string")
    # Of equal expressions a block outranks an allow.
    made = made.groupBy("host", "path").agg(F.max("action").alias("action"))
    digest = F.sha2(F.concat_ws("\n", "host", "path"), 256)
    return made.select(
        F.concat("host", "path").alias("rule"),
        "action",
        (F.length("host") + F.length("path")).alias("size"),
        digest.alias("rule_digest"),
        F.substring(digest, 1, PREFIX_DIGITS).alias("rule_prefix"),
    )


def expressions(host: Column, path: Column, label_counts: list[int], path_lengths: list[int]) -> Column:
    """All ``host suffix`` + newline + ``path prefix`` texts that a rule with so many labels and such a path could equal."""
    labels = F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1
    suffixes = F.array_compact(F.array(*[F.when(labels >= n, F.substring_index(host, ".", -n)) for n in label_counts]))
    lengths = F.filter(F.array(*map(F.lit, path_lengths)), lambda n: n <= F.length(path))
    return F.flatten(
        F.transform(suffixes, lambda s: F.transform(lengths, lambda n: F.concat_ws("\n", s, F.substring(path, F.lit(1), n))))
    )


def url_verdicts(pages: DataFrame, rules: tuple[Rule, ...] = RULES, default: str = "allow") -> DataFrame:
    """Every page's host, path, deciding rule and verdict.

    A rule fits its host and all subdomains if the page's path starts with
    the rule's path; the longest fitting rule wins, and of equally long ones
    (equal expressions) a block. Pages that no rule fits get ``default`` and
    a null rule. A null url, or one without ``://``, has an empty host and
    path. Rows are judged once per different url, so a url that many rows
    share costs one expansion, and costs grow in proportion to a url's length;
    repeated rows and null ids are kept, an empty table gives an empty one.
    Only ``page_id`` and ``url`` are read, so other columns may have any name.
    """
    spark = pages.sparkSession
    named = pages.select("page_id", F.col("url").alias("u"))
    if not rules:
        return named.select(
            "page_id", host_of(F.col("u")).alias("host"), path_of(F.col("u")).alias("path"),
            F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"),
        )
    listed = _rules_table(spark, rules)
    if len(rules) <= BROADCAST_RULES:
        listed = F.broadcast(listed)
    lengths = sorted({len(r.path) for r in rules})
    counts = sorted({r.host.count(".") + 1 for r in rules})
    parts = named.where("u IS NOT NULL").select("u").distinct().select("u", host_of(F.col("u")).alias("h"), path_of(F.col("u")).alias("p"))
    wide = parts.select("u", F.explode(expressions(F.col("h"), F.col("p"), counts, lengths)).alias("e"))
    wide = wide.select("u", F.sha2("e", 256).alias("digest")).withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    met = wide.join(listed, F.col("prefix") == F.col("rule_prefix"))
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.struct("size", "rule", "action"))
    best = met.groupBy("u").agg(F.max(confirmed).alias("best"))
    return named.join(best, "u", "left").select(
        "page_id",
        host_of(F.col("u")).alias("host"),
        path_of(F.col("u")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )


ORACLE = r"""
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(action, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
         ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
)
SELECT page_id, host, path,
       (SELECT rhost || rpath FROM rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        ORDER BY length(rhost || rpath) DESC, rhost || rpath DESC LIMIT 1) AS rule,
       coalesce((SELECT action FROM rules
        WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
        ORDER BY length(rhost || rpath) DESC, rhost || rpath DESC LIMIT 1), 'allow') AS verdict
FROM parts
"""
