"""URL verdicts from host-suffix and path-prefix expressions that are looked up by short hash prefixes.

Every URL is expanded into expressions `host suffix + path prefix`: suffixes begin at a label, prefixes end at a slash (or
are empty). A rule has one expression: its host and its path up to the last slash. Expressions and rules meet in an equi
join on the first bytes of their SHA-256; a hit counts after the full digest agrees and the path begins with the rule's
whole path. Of the rules that fit, the longest decides.

DataFrame functions only. Work is done once per distinct (host, path), so a URL that fills a third of the table costs one
lookup, and only `host` and `path` are shuffled. Expressions go no deeper than the deepest rule, which loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.base import small_side, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The rules of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and for a text without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, folder: Column) -> Column:
    # a host never holds a slash and a folder begins where the host ends, so the parts are kept apart by a line end
    return F.unhex(F.sha2(F.concat(host, F.lit("\n"), folder).cast("binary"), 256))


def _slashes(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/")))


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def rule_index(rules: DataFrame, prefix_bytes: int = 4) -> DataFrame:
    """`rules(host, path, verdict)` with the digest of each rule's expression and its short prefix.

    Null hosts and paths count as empty, hosts are lower-cased, rules without a verdict are left out. Of rules with one
    host and path, a blocking one holds.
    """
    host = F.translate(F.coalesce("host", F.lit("")), UPPER, LOWER)
    path = F.coalesce("path", F.lit(""))
    clean = rules.filter("verdict IS NOT NULL").select(host.alias("rule_host"), path.alias("rule_path"), "verdict")
    clean = clean.groupBy("rule_host", "rule_path").agg(F.max_by("verdict", F.col("verdict") == "block").alias("verdict"))
    folder = F.expr("substring(rule_path, 1, length(rule_path) - length(substring_index(rule_path, '/', -1)))")
    digest = _digest(F.col("rule_host"), folder)
    return clean.withColumn("digest", digest).withColumn("short", F.substring(F.col("digest"), 1, prefix_bytes))


def _expressions(urls: DataFrame, labels: int, slashes: int, prefix_bytes: int) -> DataFrame:
    """A row per distinct (host, path) and expression, as digest and short prefix."""
    host_parts = F.explode(F.sequence(F.lit(1), F.least(_labels(F.col("host")), F.lit(labels))))
    path_parts = F.explode(F.sequence(F.lit(0), F.least(_slashes(F.col("path")), F.lit(slashes))))
    out = urls.withColumn("suffix", host_parts).withColumn("depth", path_parts)
    suffix = F.expr("substring_index(host, '.', -suffix)")
    folder = F.when(F.col("depth") == 0, "").otherwise(F.concat(F.expr("substring_index(path, '/', depth)"), F.lit("/")))
    out = out.withColumn("digest", _digest(suffix, folder)).drop("suffix", "depth")
    return out.withColumn("short", F.substring(F.col("digest"), 1, prefix_bytes))


def url_verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix_bytes: int = 4) -> DataFrame:
    """One row per row of `pages`: id, host, path, rule (host and path, null if none fits), verdict.

    `rules(host, path, verdict)`: a rule fits its host and all subdomains if the path begins with the rule's. The longest
    rule (host and path together) wins, then the one with the longer host, then `block`. Without a fitting rule the
    verdict is `default`. A null URL, or one without `://`, has an empty host and path. Repeated rows and null ids keep
    their rows; other columns are ignored; without rules every page has the default, without pages the result is empty.
    A shorter `prefix_bytes` only means more hits that the full digest refutes.
    """
    host, path = host_and_path(F.col(url_col).cast("string"))
    parsed = pages.select(F.col(id_col).alias("page"), host.alias("host"), path.alias("path"))
    index = rule_index(rules, prefix_bytes)
    deepest = index.agg(F.max(_labels(F.col("rule_host"))), F.max(_slashes(F.col("rule_path")))).first()
    labels, slashes = deepest[0] or 1, deepest[1] or 0
    asked = _expressions(parsed.select("host", "path").distinct(), labels, slashes, prefix_bytes)
    hits = asked.join(small_side(index).withColumnRenamed("digest", "rule_digest"), "short")
    fits = hits.filter((F.col("digest") == F.col("rule_digest")) & F.col("path").startswith(F.col("rule_path")))
    order = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("verdict") == "block", "rule_host", "rule_path")
    decided = fits.groupBy("host", "path").agg(F.max_by(F.struct("rule_host", "rule_path", "verdict"), order).alias("won"))
    rule = F.concat("won.rule_host", "won.rule_path")
    out = parsed.join(decided, ["host", "path"], "left")
    return out.select(F.col("page").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce("won.verdict", F.lit(default)).alias("verdict"))


def op12_url_filters(spark, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(str(r) for r in RULES) + " AS r(host, path, verdict)")
    return url_verdicts(table(spark, sf_dir, "pages"), rules)


OP12_SQL = r"""
WITH r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(rule_host, rule_path, verdict)),
u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
d AS (SELECT DISTINCT host, path FROM p),
w AS (SELECT host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
  FROM d JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path)
SELECT page_id, p.host, p.path, w.rule, coalesce(w.verdict, 'allow') AS verdict FROM p LEFT JOIN w ON p.host = w.host AND p.path = w.path
"""
