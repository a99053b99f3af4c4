"""URL rules matched by hashed host-suffix and path-prefix expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Verdict of a URL that no rule fits.
DEFAULT = "allow"
#: Hexadecimal digits of the joined digest prefix.
SHORT = 8


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(verdict, host, path) rows as a table of literals, whose size the planner knows."""
    values = {f"v{i}_{j}": x for i, r in enumerate(rules) for j, x in enumerate(r)}
    lines = ", ".join(f"(:v{i}_0, :v{i}_1, :v{i}_2)" for i in range(len(rules))) or "(cast(null as string), cast(null as string), cast(null as string))"
    table = spark.sql(f"SELECT * FROM VALUES {lines} AS rules(verdict, host, path)", args=values or None)
    return table if rules else table.where("false")


def url_parts(url: str = "url") -> tuple[str, str]:
    """SQL for the host (A-Z lower-cased) and the path of a URL column; both empty without ``://``."""
    rest = f"substring(`{url}`, locate('://', `{url}`) + 3)"
    has = f"coalesce(locate('://', `{url}`), 0) > 0"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    host = f"case when {has} then translate(regexp_extract({rest}, '^[^/?#]*', 0), '{upper}', '{lower}') else '' end"
    path = f"case when {has} then regexp_extract({rest}, '^[^/?#]*([^?#]*)', 1) else '' end"
    return host, path


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, short: int = SHORT) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages`` (page_id, url).

    Each URL is expanded into host suffixes, of as many labels as
    rules have, joined with path prefixes as long as the rules' paths; the
    first ``short`` digits of the forms' digests are joined with those of the rules,
    and whole digests confirm what meets.  The longest rule wins, of rules of one length that with
    the longer host, then ``block``.  The sets of label counts and
    path lengths come from the rules, so no URL is cut short.  The rule
    table is broadcast only if its size lets Spark do so; a row's forms are
    summed by the row, before the shuffle, so no URL is a key, however often it occurs.

    A null url, or one without ``://``, has an empty host and path and takes
    the default verdict; repeated rows are judged each; an empty table gives
    no rows; an empty rule table gives the default for all.  Other
    columns are not read.
    """
    shapes = rules.agg(F.sort_array(F.collect_set(F.size(F.split("host", r"\.")))).alias("labels"), F.sort_array(F.collect_set(F.length("path"))).alias("lengths")).first()
    host, path = url_parts()
    rows = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", F.expr(host).alias("host"), F.expr(path).alias("path"), F.monotonically_increasing_id().alias("row"))
    labels = ", ".join(map(str, shapes["labels"] or [])) or "cast(null as int)"
    lengths = ", ".join(map(str, shapes["lengths"] or [])) or "cast(null as int)"
    suffix = "array_join(slice(parts, size(parts) - n + 1, n), '.')"
    every = f"flatten(transform(filter(array({labels}), n -> n <= size(parts)), n -> transform(filter(array({lengths}), m -> m <= length(path)), m -> {suffix} || substring(path, 1, m))))"
    forms = rows.withColumn("parts", F.split("host", r"\.")).select("page_id", "host", "path", "row", F.explode_outer(F.expr(every)).alias("form"))
    hashed = forms.withColumn("digest", F.sha2("form", 256)).withColumn("short", F.substring("digest", 1, short)).drop("form")
    listed = rules.select("verdict", F.concat("host", "path").alias("rule"), F.length("host").alias("host_length")).withColumn("rule_digest", F.sha2("rule", 256)).withColumn("rule_short", F.substring("rule_digest", 1, short))
    met = hashed.join(listed, F.col("short") == F.col("rule_short"), "left")
    # Not a filter: the planner would make the whole digest a key of the join.
    fits = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule").alias("l"), "host_length", F.col("verdict").alias("verdict"), "rule"))
    judged = met.groupBy("row").agg(*[F.first(c).alias(c) for c in ("page_id", "host", "path")], F.max(fits).alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


ORACLE = """
WITH p AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
t(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path,
       (SELECT arg_max(t.h || t.p, length(t.h || t.p)) FROM t WHERE (q.host = t.h OR suffix(q.host, '.' || t.h)) AND starts_with(q.path, t.p)) AS rule,
       coalesce((SELECT arg_max(t.verdict, length(t.h || t.p)) FROM t WHERE (q.host = t.h OR suffix(q.host, '.' || t.h)) AND starts_with(q.path, t.p)), 'allow') AS verdict
FROM q
"""
