"""URL filters: rules for hosts with all subdomains and path prefixes, found by hash.

A URL's expressions are its host suffixes crossed with its path prefixes, for those label numbers and path lengths that
rules have. They meet the rules in an equi-join on four bytes of SHA-256; the full digest confirms, and the
longest rule wins. Everything runs as DataFrame expressions; the html is never read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PREFIX_DIGITS = 8
DEFAULT = "allow"
#: (host, path, verdict): the contract's rules.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Distinct (labels of the host, characters of the path) that a rule table may have: each is one expression per URL.
MOST_SHAPES = 4_096


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty if it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def rule_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "host string, path string, verdict string")


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """(page_id, url, host, path, rule, verdict) per row of ``pages``.

    ``rules``: host, path, verdict; a rule fits its host and all subdomains if the path starts with its path. The longest rule (host and
    path) wins, the longer host among equals, and ``block`` among equal rules. No fitting rule: rule null, verdict allow. Null url or one without ``://``:
    empty host and path. Repeated rows are each returned; other columns are not carried. Rules with a null host or path fit nothing.
    """
    known = (rules.where(F.col("host").isNotNull() & F.col("path").isNotNull())
             .groupBy(F.translate("host", UPPER, LOWER).alias("rule_host"), F.col("path").alias("rule_path")).agg(F.max("verdict").alias("rule_verdict")))
    shapes = (known.select(F.size(F.split("rule_host", "[.]")).alias("labels"), F.length("rule_path").alias("chars")).distinct()
              .limit(MOST_SHAPES + 1).collect())
    if len(shapes) > MOST_SHAPES:
        raise ValueError(f"more than {MOST_SHAPES} kinds of rules")
    full = digest(F.col("rule_host"), F.col("rule_path"))
    known = known.select("*", full.alias("rule_digest"), F.substring(full, 1, PREFIX_DIGITS).alias("short"))

    host, path = parts(F.col("url"))
    split = (pages.groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("times"))  # repeated rows are judged once
             .select("page_id", "url", "times", host.alias("host"), path.alias("path")))
    labels = F.size(F.split("host", "[.]"))
    made = [F.when((labels >= n) & (F.length("path") >= k), digest(F.substring_index("host", ".", -n), F.substring("path", 1, k)))
            for n, k in sorted((r["labels"], r["chars"]) for r in shapes)]
    asked = split.select("*", F.explode_outer(F.filter(F.array(*made), lambda x: x.isNotNull()) if made else F.lit(None).cast("array<string>")).alias("digest"))
    met = (asked.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS)).join(known, "short", "left")
           .withColumn("hit", F.col("digest") == F.col("rule_digest")))
    rank = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"))
    best = F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_verdict"), F.when(F.col("hit"), rank))
    judged = met.groupBy("page_id", "url", "host", "path", "times").agg(best.alias("best"))
    return (judged.select("page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(DEFAULT)).alias("verdict"),
                          F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))).alias("copy")).drop("copy"))


ORACLE = f"""
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES {", ".join(repr(x) for x in RULES)}),
t AS (SELECT page_id, url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, url, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, coalesce(rest, '') AS rest FROM t),
p AS (SELECT row_number() OVER () AS n, page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
m AS (SELECT n, max_by((rule_host || rule_path, rule_verdict), length(rule_host || rule_path) * 1000 + length(rule_host)) AS best
  FROM p, r WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY n)
SELECT page_id, host, path, best[1] AS rule, coalesce(best[2], 'allow') AS verdict FROM p LEFT JOIN m USING (n)"""
