"""URL rules by a sort-merge range join of reversed-host keys, in DataFrame operations only.

A rule (host, path) fits its host and all subdomains where the URL's path begins with the rule's.
The key of a host suffix is its labels in reverse, each closed by U+0001, then U+0002 and the path; so
a rule fits a URL exactly if, for the URL's host cut to the rule's number of labels, the rule's key is
a prefix of the URL's key: each rule is an interval of keys, and intervals are nested or disjoint.

1. Distinct (host, path) pairs get one key for each number of labels that some rule has.
2. The URLs' keys and the rules' keys are sorted into ranges together, so that each rule is in one
   range and equal keys may spread over several; the ranges are written down. A running window over
   each range carries the last rule opened with the stack of rules that it is nested in; what was
   opened before a range and still holds at its first key, is looked up by that key's prefixes. Of
   the stack, rules that the key has left (no longer prefixes) are popped; the top is the tightest.
3. The longest rule over a URL's keys gives the verdict, which is joined back to the pages.

Defined results: a null URL or one without ``://`` has an empty host and path and gets the default;
rules that differ in nothing but the verdict block; rows with a null id or repeated rows each get
their verdict; an empty table gives an empty result; without rules all URLs get the default; columns
other than id and url aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def key_of(host: Column, labels: Column, path: Column) -> Column:
    """The key of the host's last ``labels`` labels and the path."""
    parts = F.split(host, r"\.")
    last = F.slice(parts, F.size(parts) - labels + 1, labels)
    return F.concat(F.array_join(F.transform(F.reverse(last), lambda x: F.concat(x, F.lit("\x01"))), ""), F.lit("\x02"), path)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """rules: (verdict, host, path)."""
    if not rules:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("verdict", "host", "path")))
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h.lower()).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (or null), verdict, for every page; ``rules`` has verdict, host and path."""
    n_labels = F.size(F.split("host", r"\."))
    opened = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' > 'allow'
    opened = opened.select("verdict", "host", "path", n_labels.alias("labels")).withColumn("key", key_of(F.col("host"), F.col("labels"), F.col("path")))
    entry = F.struct("key", F.concat("host", "path").alias("rule"), "verdict")

    def stacks(keys: DataFrame, name: str) -> DataFrame:
        """(name, stack): the rules whose keys are prefixes of ``key``, itself included, outermost first."""
        heads = keys.select(name, F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))).alias("key"))
        return heads.join(opened, "key").groupBy(name).agg(F.sort_array(F.collect_list(entry)).alias("stack"))

    levels = [r.labels for r in opened.select("labels").distinct().collect()]  # numbers of labels that rules have: a few small integers
    host, path = host_and_path(F.col(url_col))
    judged = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    if not levels:
        return judged.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    urls = judged.select("host", "path").distinct()
    keyed = urls.withColumn("labels", F.explode(F.filter(F.lit(sorted(levels)).cast("array<int>"), lambda k: k <= n_labels)))
    keyed = keyed.select(key_of(F.col("host"), F.col("labels"), F.col("path")).alias("key"), F.lit(1).alias("turn"), "host", "path")
    opening = stacks(opened.select(F.col("key").alias("inner"), "key"), "inner").select(F.col("inner").alias("key"), F.lit(0).alias("turn"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), "stack")
    merged = opening.unionByName(keyed, allowMissingColumns=True)
    ranged = cut(merged.repartitionByRange(partitions(pages.sparkSession), "key", "turn", "host", "path").withColumn("part", F.spark_partition_id()))
    before = stacks(ranged.groupBy("part").agg(F.min("key").alias("key")), "part").withColumnRenamed("stack", "before")  # a row for each range
    sweep = W.partitionBy("part").orderBy("key", "turn").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = ranged.withColumn("last", F.last("stack", ignorenulls=True).over(sweep)).where("turn = 1").join(before, "part", "left")
    open_now = F.filter(F.coalesce("last", "before"), lambda s: F.col("key").startswith(s["key"]))
    fits = swept.select("host", "path", F.try_element_at(open_now, F.lit(-1)).alias("top")).where("top is not null")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length("top.rule").alias("n"), F.col("top.rule").alias("rule"), F.col("top.verdict").alias("verdict"))).alias("best"))
    return judged.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
