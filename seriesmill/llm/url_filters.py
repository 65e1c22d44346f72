"""URL filters as a sort-merge range join, with DataFrame functions only.

A host is turned round label by label (`net.example.www.`), so that a rule's host and all its subdomains are one interval of keys; within a rule's host, the urls whose path starts with the rule's are one interval of paths. Intervals of prefixes are nested or apart. So one sorted sweep over keys and interval starts finds, for each key, the last start before it; the rules open there are that start and those around it which have not ended (the stack that each start carries, from which the ended ones are dropped). A sweep over hosts gives the open hosts of each url, and a second one, over paths within them, the open rules.

Both sweeps are dealt out by ranges of keys between splitters, a sample of at most `SPLITTERS` starts; each range begins with a start, so it needs nothing of the one before. Keys between two starts are further dealt out by a hash into as many shares as the session has shuffle partitions, with the starts copied to each, so that a hot host or an interval with most of the urls is the work of all tasks. The rules may be many; they are never collected, and the starts are made once and written.

Of the rules that fit, the longest (host and path together) wins; of equally long ones that with the longer host, then the first in order; of one host and path with both actions, allow. A url without a fitting rule gets `default`. A null url, or one without `://`, has an empty host and path, which no rule fits. A rule with a null or empty host fits nothing; a null path counts as empty. Repeated rows of pages give repeated results, repeated rules count once. Empty tables give empty results, or all urls the default. Only the named columns are read, so further columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, materialize

SPLITTERS = 256


def url_host(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    return F.when(host != "", F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _starts(rules: DataFrame, group: list[str], key: str, prefixes: Column, value: str) -> DataFrame:
    """For each distinct (group, key) of the rules: the array `open` of the values of all keys of the group that are prefixes of it, itself included."""
    own = rules.select(*group, key, value).distinct()
    around = own.select(*group, F.col(key).alias("inner"), F.explode(prefixes).alias(key)).distinct()
    return around.join(own, [*group, key]).groupBy(*group, "inner").agg(F.collect_set(value).alias("open")).withColumnRenamed("inner", key)


def _sweep(points: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """The points with the array `open` of the last start at or before them in the order of key; null where there is none."""
    sample = starts.select(key).orderBy(F.xxhash64(key)).limit(SPLITTERS)
    splitters = F.broadcast(sample.agg(F.sort_array(F.collect_list(key)).alias("splitters")))
    columns = [c for c in points.columns if c != key]
    shares = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64(*points.columns), F.lit(shares)).cast("int")
    shared = points.select(*points.columns, salt.alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast(starts.schema["open"].dataType).alias("open"))
    copied = starts.select(*[F.lit(None).cast(points.schema[c].dataType).alias(c) for c in columns], key, F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("salt"), F.lit(0).alias("kind"), "open")
    both = shared.unionByName(copied).join(splitters).withColumn("range", F.size(F.filter("splitters", lambda s: s <= F.col(key)))).drop("splitters")
    order = Window.partitionBy("range", "salt").orderBy(key, "kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("open", F.last("open", ignorenulls=True).over(order)).where("kind = 1").drop("kind", "salt", "range")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """Rows (id, host, path, rule, verdict); rules has columns host, path and action (allow or block)."""
    url = F.col(url_column)
    urls = pages.select(F.col(id_column).alias("id"), url_host(url).alias("host"), url_path(url).alias("path"))
    known = rules.select(lower_ascii(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "action").where("rule_host != ''")
    known = known.groupBy("rule_host", "rule_path").agg(F.min("action").alias("action")).withColumn("key", reversed_host(F.col("rule_host")))

    labels = F.split("rule_host", r"\.")
    outer = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: reversed_host(F.array_join(F.slice(labels, -k, k), ".")))
    hosts = known.select("rule_host", "key").distinct()
    around = hosts.select(F.col("key").alias("inner"), F.explode(outer).alias("key")).join(hosts.select("key"), "key")
    host_starts = materialize(around.groupBy("inner").agg(F.collect_set("key").alias("open")).withColumnRenamed("inner", "key"), "host-starts")
    swept = _sweep(urls.withColumn("key", F.coalesce(reversed_host(F.col("host")), F.lit(""))), host_starts, "key")
    swept = swept.withColumn("open", F.filter(F.coalesce("open", F.array().cast("array<string>")), lambda start: F.startswith("key", start)))
    none = F.size("open") == 0
    unmatched = swept.where(none).select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    path_prefixes = F.transform(F.sequence(F.lit(0), F.length("rule_path")), lambda k: F.substring("rule_path", F.lit(1), k))
    rule = known.select("key", "rule_path", F.struct(F.concat("rule_host", "rule_path").alias("rule"), "rule_host", "rule_path", "action").alias("value"))
    path_starts = _starts(rule, ["key"], "rule_path", path_prefixes, "value")
    path_starts = materialize(path_starts.select(F.concat("key", F.lit("\0"), "rule_path").alias("place"), "open"), "path-starts")
    points = swept.where(~none).select("id", "host", "path", F.size("open").alias("depth"), F.explode("open").alias("node"))
    points = points.select("id", "host", "path", "depth", F.concat("node", F.lit("\0"), "path").alias("place"), "node")
    found = _sweep(points, path_starts, "place")
    # The last start may belong to a node before this one; its rules do not fit then.
    fits = F.filter(F.coalesce("open", F.array().cast(path_starts.schema["open"].dataType)), lambda r: (reversed_host(r.rule_host) == F.col("node")) & F.startswith("path", r.rule_path))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r.rule).alias("length"), F.length(r.rule_host).alias("host_length"), r.rule.alias("rule"), r.action.alias("action"))))
    judged = found.withColumn("best", best)
    # Repeated rows of one page and url meet here and are dealt out again.
    one = judged.groupBy("id", "host", "path").agg(F.max("best").alias("best"), (F.count("*") / F.first("depth")).cast("int").alias("times"))
    one = one.withColumn("again", F.explode(F.array_repeat(F.lit(1), F.col("times"))))
    matched = one.select("id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
    return unmatched.union(matched)


ORACLE_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN url LIKE '%://%' THEN regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM pages),
r(rule_host, rule_path, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
n AS (SELECT *, row_number() OVER () AS k FROM u),
m AS (SELECT k, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(action, length(rule_host || rule_path)) AS action
  FROM n JOIN r ON (host = rule_host OR suffix(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM n LEFT JOIN m USING (k)
"""
