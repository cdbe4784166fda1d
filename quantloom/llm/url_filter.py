"""URL rules by a sort-merge range join.

A host is written with its labels reversed (``net.example.blog.``), so that a rule's host and all its
subdomains are one interval of keys, and rules' intervals are nested or disjoint. Distinct hosts and
rules are range-partitioned (by the number of hosts) and sorted; a sweep carries the last rule host that started, whose stack
of enclosing rules holds every rule that can cover the current host. The stack is joined back to
the pages, whose paths pick the longest rule. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantloom.llm.common import join_hubs, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hosts of a key range, the most ranges of the sweep, and hosts that the driver samples for each of them.
RANGE_HOSTS, RANGES, SAMPLE = 100_000, 1024, 32


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    part = lambda k: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (action, host, path)."""
    if not rules:
        return spark.range(0).select(*(F.lit("").alias(c) for c in ("action", "host", "path")))
    rows = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(r, ("action", "host", "path"), strict=True))) for r in rules))
    return spark.range(1).select(F.explode(rows).alias("r")).select("r.*")


def _stacks(rules: DataFrame) -> DataFrame:
    """start (a rule host's key), stack: the rules of that host and of all hosts around it."""
    rules = rules.select("action", "host", "path").distinct().select(host_key(F.col("host")).alias("at"), F.struct(F.char_length(F.concat("host", "path")).alias("n"), F.char_length("host").alias("h"), "action", "host", "path").alias("rule"))
    starts = rules.select(F.col("at").alias("start")).distinct()
    labels = F.slice(F.split("start", r"\."), 1, F.size(F.split("start", r"\.")) - 1)
    around = starts.withColumn("label", labels).select("start", F.explode(F.transform(F.sequence(F.lit(1), F.size("label")), lambda k: F.concat(F.array_join(F.slice("label", F.lit(1), k), "."), F.lit(".")))).alias("at"))
    return around.join(rules, "at").groupBy("start").agg(F.collect_list("rule").alias("stack"))


def _active(hosts: DataFrame, stacks: DataFrame) -> DataFrame:
    """host, stack for each host that a rule covers: the sweep."""
    ranges = min(RANGES, max(8, hosts.count() // RANGE_HOSTS))
    keyed = hosts.select("host", host_key(F.col("host")).alias("key"))
    sample = sorted(r["key"].encode("utf-8", "surrogatepass") for r in keyed.orderBy(F.xxhash64("host")).limit(SAMPLE * ranges).collect())
    cuts = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []
    edges = [F.lit(c.decode("utf-8", "surrogatepass")) for c in cuts]
    part = F.size(F.filter(F.array(*edges), lambda c: c <= F.col("key"))) if edges else F.lit(0)
    begins = stacks.select(F.col("start").alias("key"), F.col("start"))
    events = keyed.select("key", "host", F.lit(None).cast("string").alias("start")).unionByName(begins.select("key", F.lit(None).cast("string").alias("host"), "start")).withColumn("part", part)
    sweep = Window.partitionBy("part").orderBy("key", F.col("start").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = events.withColumn("open", F.last("start", True).over(sweep)).where("host is not null")
    # what is open where a range begins: the last rule of the ranges before it (a row for each range)
    last = begins.withColumn("part", part).groupBy("part").agg(F.max("start").alias("last"))
    parts = hosts.sparkSession.range(len(edges) + 1).select(F.col("id").cast("int").alias("part"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.join(last, "part", "left").select("part", F.max("last").over(ahead).alias("before"))
    opened = swept.join(F.broadcast(carried), "part", "left").select("host", "key", F.coalesce("open", "before").alias("start")).where("start is not null")
    return opened.join(stacks, "start").select("host", F.filter("stack", lambda r: F.col("key").startswith(host_key(r["host"]))).alias("stack")).where(F.size("stack") > 0)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for each page.

    ``rules`` has action, host and path: a rule fits its host and all subdomains if the path starts
    with the rule's; of those that fit, the longest (host and path) wins, then the longer host, then
    ``block``. Urls that no rule fits get ``default`` and a null rule. Null urls and those without
    ``://`` have empty host and path. Repeated rules count once, repeated pages and those of null
    page_id are judged like any others, tables may be empty, other columns are not looked at.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = materialize(rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")), "hosts")
    active = materialize(hosts.join(_active(hosts.select("host"), _stacks(rules)), "host", "left"), "active")
    fits = F.filter("stack", lambda r: F.col("path").startswith(r["path"]))
    return (
        join_hubs(rows, active, ["host"])
        .withColumn("r", F.array_max(fits))
        .select("page_id", "host", "path", F.concat("r.host", "r.path").alias("rule"), F.coalesce("r.action", F.lit(default)).alias("verdict"))
    )
