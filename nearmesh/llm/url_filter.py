"""Rule-based URL filter over host-suffix and path-prefix expressions (DataFrame functions only).

A rule (host, path, verdict) fits its host and every subdomain of it when the
URL's path starts with the rule's path. Every distinct (host, path) of the input
is expanded into the expressions that some rule could equal: only the pairs
(number of host labels, path length) that occur among the rules are made, by a join
on the number of labels, so a URL of any length yields at most one expression per
such shape. Rules of more than MAX_LABELS labels (above what a host name may have)
or paths above MAX_PATH characters are an error. Expressions and
rules meet in an equi-join on the first eight hex digits of the SHA-256; the full
digests confirm, and the longest rule wins.

Scale: the expansion runs on distinct (host, path) pairs, which are aggregated
map-side first; the verdicts go back to the rows by an equi-join whose hot keys
(one host with a third of the rows) adaptive execution can split. Rules are a
table; Catalyst broadcasts it when its measured size allows.

Defined cases: a null URL, or one without "://", has empty host and path; a rule
with a null host, path or verdict is ignored; of equal rules with different
verdicts, block wins; repeated rows are judged each; an empty table gives an
empty result; columns of the input that clash with result columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearmesh.llm.common import ascii_lower

#: A host name has at most 253 characters.
MAX_LABELS, MAX_PATH = 128, 65_536
RULE_SCHEMA = "host string, path string, verdict string"


def host_and_path(url):
    """(host, path) columns of a URL column."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return (
        F.coalesce(ascii_lower(host), F.lit("")),
        F.coalesce(F.regexp_extract(tail, "^[^?#]*", 0), F.lit("")),
    )


def _digest(host, path):
    return F.sha2(F.concat(host, F.lit("\u0000"), path).cast("binary"), 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """Rules with shape, digest, hash prefix and the rank that orders them."""
    rules = rules.select(
        ascii_lower(F.col("host")).alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")
    ).where("r_host is not null and r_path is not null and r_verdict is not null")
    one = rules.groupBy("r_host", "r_path").agg(F.min(F.struct((F.col("r_verdict") != "block").alias("no"), "r_verdict")).alias("v"))
    digest, n = _digest(F.col("r_host"), F.col("r_path")), F.size(F.split("r_host", "[.]"))
    return one.select(
        F.concat("r_host", "r_path").alias("rule"),
        F.col("v.r_verdict").alias("verdict"),
        F.when((n <= MAX_LABELS) & (F.length("r_path") <= MAX_PATH), n).otherwise(F.raise_error(F.lit("a rule's host or path is too long")).cast("int")).alias("labels"),
        F.length("r_path").alias("plen"),
        digest.alias("digest"),
        F.substring(digest, 1, 8).alias("prefix"),
        (F.length("r_host") + F.length("r_path")).alias("rank"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row per input row: key, host, path, rule (null if none fits), verdict."""
    host, path = host_and_path(F.col(url))
    rows = pages.select(F.col(key).alias("k"), host.alias("host"), path.alias("path"))
    ready = prepare_rules(rules)
    # Shapes: the path lengths of the rules per number of host labels, one row for each number.
    shapes = ready.groupBy("labels").agg(F.collect_set("plen").alias("plens"))
    found = (
        rows.select("host", "path").distinct()
        .withColumn("labels", F.explode(F.sequence(F.lit(1), F.least(F.size(F.split("host", "[.]")), F.lit(MAX_LABELS)))))
        .join(F.broadcast(shapes), "labels")  # at most MAX_LABELS rows of MAX_PATH lengths
        .withColumn("plen", F.explode(F.filter("plens", lambda n: n <= F.length("path"))))
        .select(
            "host", "path",
            _digest(F.expr("substring_index(host, '.', -labels)"), F.expr("substring(path, 1, plen)")).alias("digest"),
        )
        .withColumn("prefix", F.substring("digest", 1, 8))
    )
    best = (
        found.join(ready.select("prefix", F.col("digest").alias("full"), "rank", "rule", "verdict"), "prefix")
        .where("digest = full")
        .groupBy("host", "path")
        .agg(F.max(F.struct("rank", "rule", "verdict")).alias("best"))
        .withColumnsRenamed({"host": "b_host", "path": "b_path"})
    )
    out = rows.join(best, (rows["host"] == best["b_host"]) & (rows["path"] == best["b_path"]), "left")
    return out.select(
        F.col("k").alias(key), "host", "path",
        F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


#: Fixed rules of the contract: host, path, verdict.
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    rows = ", ".join("('%s', '%s', '%s')" % r for r in rules)
    return spark.sql(f"select * from values {rows} as t(host, path, verdict)")


ORACLE = r"""
WITH rules(r_host, r_path, r_verdict) AS (VALUES
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
u AS (SELECT row_number() OVER () AS rid, page_id,
  CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
h AS (SELECT rid, page_id, rest, regexp_extract(rest, '^[^/?#]*', 0) AS raw FROM u),
p AS (SELECT rid, page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*', 0) AS path FROM h),
m AS (SELECT p.*, r_host || r_path AS rule, r_verdict,
  row_number() OVER (PARTITION BY rid ORDER BY length(r_host) + length(r_path) DESC NULLS LAST) AS rn
  FROM p LEFT JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
SELECT page_id, host, path, rule, coalesce(r_verdict, 'allow') AS verdict FROM m WHERE rn = 1
"""
