"""URL filters: host-suffix and path-prefix expressions, joined with rules on short hash prefixes.

Each distinct URL is expanded into the expressions (host suffix, path prefix) that a rule of the
given rule set could have: suffixes of as many labels as some rule, and of these the prefixes of as
many characters as some rule of so many labels. The shapes of the rules are a table, joined by
label count. Expressions and rules meet on the first eight hex digits of their SHA-256; the full
digest confirms a match, and the longest rule wins (ties: the longer host, then block).

Defined cases: a null URL or one without `://` has an empty host and path and fits no rule unless a
rule has an empty host; repeated URLs are judged once and every row comes back; a rule whose host
or path is null is ignored; an empty rule table leaves the default verdict; extra columns of pages
stay out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_DIGITS = 8
DEFAULT_VERDICT = "allow"
#: The rules of the registered query (host, path, verdict).
RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.coalesce(lower_ascii(host), F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def n_labels(host: Column) -> Column:
    return F.when(host == "", 0).otherwise(F.size(F.split(host, r"\.")))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule (host and path of the winning rule, else null), verdict."""
    rules = rules.where("host is not null and path is not null")
    # one row a label count, with the path lengths of its rules: at most as many rows as the deepest rule has
    # labels, of at most as many numbers as the longest path has characters
    shapes = rules.groupBy(n_labels(F.col("host")).alias("shape_labels")).agg(F.collect_set(F.length("path")).alias("lengths"))
    ruled = rules.select(
        digest(F.col("host"), F.col("path")).alias("rule_digest"),
        F.concat("host", "path").alias("rule"),
        F.struct((F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), (F.col("verdict") == "block").alias("blocks"), F.concat("host", "path").alias("rule"), "verdict").alias("rank"),
    ).withColumn("prefix", F.left("rule_digest", F.lit(PREFIX_DIGITS)))
    host, path = host_and_path(F.col("url"))
    urls = pages.select("url").distinct().where("url is not null").select("url", host.alias("host"), path.alias("path"))
    # label counts meet the shapes first, so only suffixes that a rule can have are made
    counts = urls.select("url", "host", "path", F.explode(F.sequence(F.lit(0), n_labels(F.col("host")))).alias("shape_labels"))
    suffixed = counts.join(F.broadcast(shapes), "shape_labels").withColumn("suffix", F.call_function("substring_index", F.col("host"), F.lit("."), -F.col("shape_labels")))
    fitting = F.filter("lengths", lambda k: k <= F.length("path"))
    expressions = F.transform(fitting, lambda k: digest(F.col("suffix"), F.left(F.col("path"), k)))
    expanded = suffixed.select("url", F.explode(expressions).alias("url_digest")).withColumn("prefix", F.left("url_digest", F.lit(PREFIX_DIGITS)))
    won = (
        expanded.join(ruled, "prefix").where("url_digest = rule_digest")
        .groupBy("url").agg(F.max("rank").alias("best")).select(F.col("url").alias("judged_url"), "best.rule", "best.verdict")
    )
    return pages.select("page_id", "url").join(won, F.col("url") == F.col("judged_url"), "left").select(
        "page_id", host.alias("host"), path.alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )


ORACLE = r"""
WITH p AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
)
SELECT page_id, host, path,
  CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
       WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
  CASE WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'allow'
       WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'block'
       WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'block'
       WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'allow'
       WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM q
"""
