"""URL rules by hashed host-suffix and path-prefix expressions, DataFrame functions only.

A URL is expanded into the expressions that rules could be written as: suffixes of its host
with as many labels as some rule has, each with the path prefixes as long as some rule's
path. Expressions meet the rules in an equi-join on the first four bytes of SHA-256; the full
digest then confirms, and precedence picks one rule. Work is done once per distinct
(host, path), so a hot URL costs one expansion.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genolith.llm.common import LOWER, UPPER, Scratch, ascii_lower, read

#: The rules of the query: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
PREFIX_HEX = 8


def url_parts(url) -> tuple:
    """(host, path) columns; both empty for a null URL or one without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    tail = F.substring(rest, F.length(raw) + 1, F.greatest(F.length(rest), F.lit(1)))
    empty = F.lit("")
    return F.coalesce(ascii_lower(raw), empty), F.coalesce(F.regexp_extract(tail, r"^[^?#]*", 0), empty)


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules with digests; a rule given twice or with both verdicts stays once, as block."""
    df = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    df = df.where("verdict IS NOT NULL AND host <> '' AND path IS NOT NULL").withColumn("host", ascii_lower(F.col("host")))
    df = df.groupBy("host", "path").agg(F.max(F.col("verdict") == "block").alias("block"))
    digest = F.sha2(F.concat("host", "path"), 256)
    return df.select("host", "path", F.when(F.col("block"), "block").otherwise("allow").alias("verdict"), digest.alias("digest"), F.substring(digest, 1, PREFIX_HEX).alias("prefix"))


def filter_urls(pages: DataFrame, rules: DataFrame, scratch: Scratch, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per input row: key, host, path, rule (host + path of the winning rule, or null),
    verdict (the rule's, else ``default``).

    The longest host + path wins, then the longer host, then block. Null or malformed URLs get
    empty host and path and the default. Repeated rows and keys are kept as they are; other
    columns of the input are ignored. The shapes of the rules (label counts, path lengths) are
    read first: at most as many small integers as hosts have labels and paths have lengths.
    """
    labels = F.size(F.split("host", r"\."))
    shapes = rules.select(labels.alias("k"), F.length("path").alias("n")).distinct().collect()
    host, path = url_parts(F.col(url))
    rows = pages.select(F.col(key).alias("page_id"), host.alias("host"), path.alias("path"))
    if not shapes:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    suffixes = F.array(*[F.struct(F.lit(r["k"]).alias("k"), F.lit(r["n"]).alias("n")) for r in shapes])
    distinct = rows.where("host <> ''").select("host", "path").distinct()
    expressions = (
        distinct.select("host", "path", labels.alias("labels"), F.explode(suffixes).alias("shape"))
        .where("shape.k <= labels AND shape.n <= length(path)")
        .select("host", "path", F.expr("substring_index(host, '.', -shape.k)").alias("h"), F.expr("substring(path, 1, shape.n)").alias("p"))
        .withColumn("digest", F.sha2(F.concat("h", "p"), 256))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    )
    r = rules.select("prefix", F.col("digest").alias("rule_digest"), F.col("host").alias("rule_host"), F.col("path").alias("rule_path"), F.col("verdict").alias("rule_verdict"))
    fits = expressions.join(r, "prefix").where("digest = rule_digest AND h = rule_host AND p = rule_path")
    order = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("rule_verdict") == "block")
    won = fits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), F.col("rule_verdict").alias("verdict")), order).alias("won"))
    won = scratch.keep(won.select("host", "path", "won.rule", F.col("won.verdict").alias("said")), "won")
    return rows.join(won, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("said", F.lit(default)).alias("verdict"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against RULES."""
    return filter_urls(read(spark, sf_dir, "pages", "page_id", "url"), rule_table(spark, RULES), Scratch(spark, "op8"))


ORACLE = f"""
WITH rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
a AS (SELECT page_id, CASE WHEN url IS NULL OR position('://' IN url) = 0 THEN '' ELSE substr(url, position('://' IN url) + 3) END AS rest FROM pages),
b AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (SELECT page_id, translate(raw, '{UPPER}', '{LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT c.page_id, c.host, c.path, r.host || r.path AS rule, r.verdict, row_number() OVER (PARTITION BY c.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS rn
      FROM c LEFT JOIN rules r ON (c.host = r.host OR ends_with(c.host, '.' || r.host)) AND starts_with(c.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM d WHERE rn = 1
"""
