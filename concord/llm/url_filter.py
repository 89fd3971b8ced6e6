"""URL rules by a sort-merge range join: a sorted sweep that keeps a stack of active nested rules.

A rule (host, path) fits its host and all subdomains where the url's path starts with the rule's. Both
parts are prefixes of canonical keys, the path of itself and the host of its labels in reverse order
(``com.example.``), so each is an interval of keys, and intervals of one kind are nested or apart. Two
sweeps follow each other: the path keys of the urls are swept over the intervals of the distinct rule
paths, which leaves each url the whole stack of paths that fit; then (path, reversed host) keys are swept
over the rules, which leaves the innermost host for each fitting path. The longest rule wins.

A sweep sorts urls, interval starts and interval ends together into ranges of keys. A start carries the stack as
it is inside its interval, an end the stack that its enclosing interval leaves, so the last start or end before a
url tells its stack. What is active where a range begins is the last start or end of the ranges before it: one
row for each range. No rule is copied, equal keys are dealt to ranges by a hash of the url, so no host can crowd
one task, and the plan does not depend on the depth of nesting. All of it is native expressions.

Defined results: a null url, or one without ``://``, has an empty host and path and no rule; without a
fitting rule the verdict is ``default``; rules with an empty host fit nothing; of fitting rules of equal
length that with the longer host wins; repeated rules count once, a block before an allow; repeated pages
are judged each; an empty table gives no rows, and without rules every verdict is ``default``; a very long url is
judged whole; other columns may have any name and type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from concord.llm.common import picked
from concord.session import durable

RULE_SCHEMA = "host string, path string, action string"
#: The rules of the registered query.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """``www.example.com`` as ``com.example.www.``: subdomains become longer keys."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def _below(prefix: Column) -> Column:
    """An upper end of all keys that begin with ``prefix``: no UTF-8 text has a byte FF."""
    return F.concat(prefix.cast("binary"), F.unhex(F.lit("FF")))


def stacks(intervals: DataFrame, key: str, payload: str) -> DataFrame:
    """The key and ``stack`` of each of the unique prefixes ``key``: its payload and those of all that enclose it, outermost first.

    Every beginning of a key is looked up among the keys, so the work is the length of the rules.
    """
    keys = intervals.select(F.col(key).alias("__k"), F.col(payload).alias("__load"))
    begins = keys.select("__k", F.explode(F.sequence(F.lit(0), F.length("__k"))).alias("__n")).select("__k", "__n", F.expr("substr(__k, 1, __n)").alias("__p"))
    found = begins.join(keys.select(F.col("__k").alias("__p"), "__load"), "__p").groupBy("__k").agg(F.array_sort(F.collect_list(F.struct("__n", "__load"))).alias("__x"))
    return found.select(F.col("__k").alias(key), F.transform("__x", lambda x: x["__load"]).alias("stack"))


def sweep(points: DataFrame, intervals: DataFrame, point_key: str, interval_key: str, payload: str, stack: str, ranges: int, mix: Column) -> DataFrame:
    """``points`` with the array ``stack``: the payloads of all intervals around each, outermost first.

    ``intervals`` are unique key prefixes; ``mix`` parts points of equal keys.
    """
    nested = stacks(intervals, interval_key, payload)
    kind = nested.schema["stack"].dataType
    prefix, active = F.col(interval_key), F.col("stack")
    nobody = F.lit(None).cast(T.StructType(points.schema.fields)).alias("__point")
    now = lambda column: F.struct(column.alias("stack")).alias("__now")
    events = [
        points.select(F.col(point_key).cast("binary").alias("__at"), F.lit(1).alias("__order"), mix.cast("long").alias("__mix"), F.lit(None).cast(T.StructType([T.StructField("stack", kind)])).alias("__now"), F.struct(*points.columns).alias("__point")),
        nested.select(prefix.cast("binary").alias("__at"), F.lit(0).alias("__order"), F.lit(0).cast("long").alias("__mix"), now(active), nobody),
        nested.select(_below(prefix).alias("__at"), F.lit(2).alias("__order"), F.lit(0).cast("long").alias("__mix"), now(F.slice(active, 1, F.greatest(F.size(active) - 1, F.lit(0)))), nobody),
    ]
    merged = events[0].unionByName(events[1]).unionByName(events[2])
    # written once: the ranges of a second evaluation could be others
    dealt = durable(merged.repartitionByRange(ranges, "__at", "__order", "__mix").withColumn("__range", F.spark_partition_id()))
    last = dealt.where("__now is not null").groupBy("__range").agg(F.max_by("__now", F.struct("__at", "__order")).alias("__last"))
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    every = dealt.sparkSession.range(ranges).select(F.col("id").cast("int").alias("__range"))
    carried = every.join(last, "__range", "left").select("__range", F.last("__last", ignorenulls=True).over(before).alias("__open"))  # a row for each range
    so_far = Window.partitionBy("__range").orderBy("__at", "__order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.withColumn("__now", F.last("__now", ignorenulls=True).over(so_far)).where("__point is not null")
    swept = swept.join(F.broadcast(carried), "__range")
    inside = F.coalesce(F.col("__now.stack"), F.col("__open.stack"), F.array().cast(kind))
    return swept.select("__point.*", inside.alias(stack))


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", ranges: int | None = None) -> DataFrame:
    """page_id, host, path, rule and verdict for every row of ``pages`` (page_id, url)."""
    spark = pages.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    clean = rules.select(F.translate(F.coalesce("host", F.lit("")), _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action").where("host <> ''")
    clean = clean.groupBy("host", "path").agg(F.max("action").alias("action"))  # block sorts behind allow
    clean = clean.withColumn("rule", F.concat("host", "path"))
    # equal rows are judged once and come out as often as they came in
    urls = picked(pages, "page_id", "url").select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).groupBy("page_id", "host", "path").agg(F.count("*").alias("copies"))
    urls = urls.withColumn("mix", F.xxhash64("page_id", "host", "path"))

    fitting = sweep(urls, clean.select(F.col("path").alias("rule_path")).distinct(), "path", "rule_path", "rule_path", "paths", ranges, F.col("mix"))
    # a url without any fitting path stays as one row with a null path
    asked = fitting.select("*", F.explode_outer("paths").alias("rule_path")).drop("paths")
    key = F.concat(F.hex(F.encode("rule_path", "utf-8")), F.lit("|"), reversed_host(F.col("host")))
    asked = asked.withColumn("key", F.coalesce(key, F.lit("")))
    rule_keys = clean.select(F.concat(F.hex(F.encode("path", "utf-8")), F.lit("|"), reversed_host(F.col("host"))).alias("range_key"), F.struct(F.length("rule").alias("size"), F.length("host").alias("host_size"), "rule", "action").alias("load"))
    found = sweep(asked, rule_keys, "key", "range_key", "load", "hosts", ranges, F.xxhash64("mix", "rule_path"))
    best = F.max(F.try_element_at("hosts", F.lit(-1)))
    judged = found.groupBy("page_id", "host", "path", "copies").agg(best.alias("best")).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    """Rules as a table, of literals."""
    if not rules:
        return spark.range(0).select(*[F.lit(None).cast("string").alias(n) for n in ("host", "path", "action")])
    rows = F.array(*[F.struct(F.lit(h).cast("string").alias("host"), F.lit(p).cast("string").alias("path"), F.lit(a).alias("action")) for h, p, a in rules])
    return spark.range(1).select(F.inline(rows))
