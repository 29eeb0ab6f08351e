"""URL rules by a sort-merge range join, in DataFrame operations alone.

A host is turned round by labels (``www.example.com`` -> ``com.example.www.``), so a rule's host with all its subdomains
is an interval of keys that start with the rule's. Intervals of rules are nested or apart: the rules that are active at a
key are those on the stack of the last rule at or before it that the key starts with. Rules and urls, sorted together by
key, are swept twice: by host, which gives each url its own rule hosts, at most one a label; then, for each of these, by
path within the rules of that host. The longest match (longest host, then longest path) decides.

The sweep is dealt out by sampled ranges of (key, hash of the url), so a host with a third of all urls lies in many
ranges; a range starts with the stack that is active where the one before it ends. The stacks of a rule are its own
prefixes, however many rules there are. Nothing is collected, and nothing is broadcast by hand.

Defined results: null urls and those without ``://`` have empty host and path and fit no rule; a rule is a host, ``/``
and the rest of its path; of rules with equal host and path a block wins over an allow; repeated rows are kept; a url or
path of any length is compared whole; with no rules the default verdict holds; extra columns of pages are ignored; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import save

def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): what stands after the first ``://`` up to ``/ ? #``; from there up to ``? #``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return lower_ascii(host), path


def canonical(host: Column) -> Column:
    """Labels from the last to the first, each with a dot after it; a lone character above dot ends the interval."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def sweep(rows: DataFrame, borders: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with ``stack``: that of the last border at or before their ``keys``; null before the first one.

    borders: (keys, stack), one for each key. Sorted with the rows, and dealt out by ranges that end within a key if
    very many rows have it.
    """
    salt = F.xxhash64(*rows.columns)
    tagged = rows.withColumns({"__row": F.lit(1), "__salt": salt}).unionByName(borders.withColumns({"__row": F.lit(0), "__salt": F.lit(-(1 << 63)).cast("long")}), allowMissingColumns=True)
    ranged = save(tagged.repartitionByRange(*keys, "__row", "__salt").withColumn("__part", F.spark_partition_id()), "sweep")
    ends = ranged.groupBy("__part").agg(F.max_by("stack", F.when(F.col("__row") == 0, F.struct(*keys))).alias("__end"))  # one row a range
    carried = ends.select("__part", F.last("__end", ignorenulls=True).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)).alias("__carried"))
    order = Window.partitionBy("__part").orderBy(*keys, "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = ranged.withColumn("__own", F.last("stack", ignorenulls=True).over(order)).where("__row = 1").join(carried, "__part", "left")
    return swept.select(*rows.columns, F.coalesce("__own", "__carried").alias("stack"))


def parsed(rules: DataFrame) -> DataFrame:
    """(r_host, r_path, verdict): one row for each host and path."""
    cut = rules.select(F.substring_index("rule", "/", 1).alias("h"), "rule", "verdict").select(lower_ascii(F.col("h")).alias("r_host"), F.expr("substring(rule, length(h) + 1)").alias("r_path"), "verdict")
    return cut.groupBy("r_host", "r_path").agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"


def host_borders(one: DataFrame) -> DataFrame:
    """(at, stack): the rule hosts as keys, with those of their parent domains and their own."""
    hosts = one.select("r_host").distinct().withColumn("at", canonical(F.col("r_host")))
    labels = F.split("r_host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    chain = hosts.select("at", F.explode(above).alias("parent")).join(hosts.select(F.col("r_host").alias("parent"), F.struct(F.col("r_host").alias("host"), F.col("at").alias("key")).alias("entry")), "parent")
    return chain.groupBy("at").agg(F.collect_list("entry").alias("stack"))


def path_borders(one: DataFrame) -> DataFrame:
    """(r_host, path, stack): of every rule's path the rules of its host whose paths start it."""
    starts = F.transform(F.sequence(F.lit(0), F.length("r_path")), lambda i: F.substring("r_path", F.lit(1), i))
    shorter = one.select("r_host", F.col("r_path").alias("path"), F.explode(starts).alias("r_path"))
    entry = F.struct(F.length("r_path").alias("p_len"), "r_path", "verdict", "r_host")
    return shorter.join(one, ["r_host", "r_path"]).groupBy("r_host", "path").agg(F.collect_list(entry).alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) for every row; ``rules`` has (rule ``host/path``, verdict allow or block)."""
    host, path = split_url(F.coalesce(F.col(url), F.lit("")))
    one = parsed(rules)
    rows = pages.select(F.col(key).alias("id"), host.alias("host"), path.alias("path")).withColumn("at", canonical(F.col("host")))
    fits = F.transform(F.filter("stack", lambda r: F.col("at").startswith(r["key"])), lambda r: r["host"])
    hosted = save(sweep(rows, host_borders(one), ["at"]).select("id", "host", "path", F.monotonically_increasing_id().alias("row"), F.coalesce(fits, F.array()).alias("hosts")), "hosted")
    asked = hosted.select("row", "path", F.explode("hosts").alias("r_host"))
    # a stack of another host's rules is that of a host whose paths all come later
    met = F.filter("stack", lambda r: (r["r_host"] == F.col("r_host")) & F.col("path").startswith(r["r_path"]))
    found = sweep(asked, path_borders(one), ["r_host", "path"]).select("row", F.explode(met).alias("r"))
    best = found.groupBy("row").agg(F.max(F.struct(F.length("r.r_host").alias("h_len"), "r.p_len", "r.verdict", "r.r_host", "r.r_path")).alias("best"))
    return hosted.join(best, "row", "left").select(F.col("id").alias(key), "host", "path", F.concat("best.r_host", "best.r_path").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
