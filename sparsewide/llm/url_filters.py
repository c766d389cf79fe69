"""URL filters: sort-merge range join of hosts with nested host rules (DataFrame functions only).

The canonical key of a host is its labels in reverse, each followed by a dot: `a.example.com` is `com.example.a.`. The hosts that a rule covers (its own and all
subdomains) are the keys that start with the rule's key, so each rule host is one interval [key, key with '/' for the last dot). Such intervals nest or are
disjoint. The sorted sequence of their ends carries the stack of rules active from there on; the sweep merges it with the sorted host keys and hands each host the
latest stack (`last` over an ordered window, a streaming merge). A URL's rule is the longest one on its host's stack whose path starts the URL's path.

The sweep runs over distinct hosts, so a host that holds a third of all rows is one row of it. It is cut into ranges by the first two labels: an interval of two
labels or more lies in one range and goes there alone; the stack that is open where a range begins holds only rules of one label, which are joined by it. A
range with over `range_hosts` hosts is dealt to several lanes, and only its rules are copied to each. Stacks go back to the URLs by a join on the host, broadcast if
there are at most `broadcast_hosts` hosts with a rule (counted), and else left to the adaptive split of skewed keys.

Defined cases: null URL or no `://`: host and path empty, no rule, the default verdict. Repeated rows stay. Two rules with one host and path: block wins. Equal
lengths: the greater rule text. Null rule hosts or paths fit nothing. Very long URLs are judged whole. Other columns are ignored, whatever their names. Empty inputs
give empty results or the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, removed, written

RULE_SCHEMA = "host string, path string, action string"
RANGE_HOSTS, BROADCAST_HOSTS = 1_000_000, 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty for null or where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def first_labels(key: Column, n: int) -> Column:
    return F.substring_index(key, ".", n)


def interval_ends(rules: DataFrame) -> DataFrame:
    """(key, stack): the rules active for host keys from `key` up to the next row's key."""
    rules = rules.select(F.col("host").alias("h"), F.col("path").alias("p"), F.col("action").alias("a")).dropna()
    nodes = rules.groupBy(host_key(lower_ascii(F.col("h"))).alias("key")).agg(
        F.collect_set(F.struct(F.col("p").alias("path"), F.concat("h", "p").alias("rule"), F.col("a").alias("action"))).alias("own")
    )
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    # the enclosing intervals of a node are the nodes at the prefixes of its key: an equi-join, no range test
    up = nodes.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))).alias("above"))
    chain = up.join(nodes.select(F.col("key").alias("above"), "own"), "above").groupBy("key").agg(
        F.flatten(F.collect_list("own")).alias("inside"),
        F.flatten(F.collect_list(F.when(F.col("above") != F.col("key"), F.col("own")))).alias("outside"),
    )
    end = F.expr("concat(substring(key, 1, length(key) - 1), '/')")
    return chain.select("key", F.col("inside").alias("stack")).unionByName(chain.select(end.alias("key"), F.col("outside").alias("stack")))


def active_rules(hosts: DataFrame, rules: DataFrame, *, range_hosts: int = RANGE_HOSTS) -> DataFrame:
    """hosts (key) -> (key, active): the rules that fit the host, for hosts that have any."""
    node = F.regexp_replace("key", "/$", ".")
    ends = interval_ends(rules).withColumns({"range": first_labels(node, 2), "labels": F.length(node) - F.length(F.replace(node, F.lit("."), F.lit("")))})
    deep = ends.filter("labels > 1")
    hosts = hosts.select("key", first_labels(F.col("key"), 2).alias("range"))
    large = hosts.groupBy("range").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > range_hosts).select("range", F.expr(f"1 + n div {range_hosts}").alias("lanes"))
    large = F.broadcast(large)  # no more rows than hosts / range_hosts
    lanes = F.coalesce("lanes", F.lit(1))
    row = hosts.join(large, "range", "left").select("range", F.pmod(F.xxhash64("key"), lanes).alias("lane"), "key", F.lit(1).alias("kind"))
    cut = deep.join(large, "range", "left").select("range", F.explode(F.sequence(F.lit(0).cast("long"), (lanes - 1).cast("long"))).alias("lane"), "key", F.lit(0).alias("kind"), "stack")
    sweep = Window.partitionBy("range", "lane").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = row.unionByName(cut, allowMissingColumns=True).withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).filter("kind = 1")
    # what is open where a range begins: rules of one label (their end keys are ends of the label, too)
    top = ends.filter(~F.col("key").endswith("/") & (F.col("labels") == 1)).select(F.col("key").alias("label"), F.col("stack").alias("open"))
    both = swept.withColumn("label", F.concat(first_labels(F.col("key"), 1), F.lit("."))).join(top, "label", "left")
    none = F.expr("array()").cast(ends.schema["stack"].dataType)
    # a stack of the range has the rules of one label already, where it isn't empty
    active = F.array_distinct(F.concat(F.coalesce("stack", none), F.coalesce("open", none)))
    return both.select("key", active.alias("active")).filter(F.size("active") > 0)


def judge(
    pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", range_hosts: int = RANGE_HOSTS, broadcast_hosts: int = BROADCAST_HOSTS,
) -> DataFrame:
    """One row per input row: id, host, path, rule (null where none fits), verdict."""
    host, path = url_parts(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    known = written(active_rules(urls.select("key").distinct(), rules, range_hosts=range_hosts), "hosts")
    both = urls.join(F.broadcast(known) if known.count() <= broadcast_hosts else known, "key", "left")
    fits = F.filter("active", lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), r["rule"].alias("rule"), r["action"].alias("action"))))
    return both.withColumn("best", best).select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict")
    )
