"""Progress of a running copy: rates, remaining time, hot tables and whether it is safe to switch over.

Samples are rows of (db, ts, src_rows, dst_rows, src_tables map). Windows are by database, over samples,
of which there are few for each database.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STABLE_CYCLES = 2


def _by_time():
    return Window.partitionBy("db").orderBy("ts")


def rates(samples: DataFrame) -> DataFrame:
    """db, ts, rate (rows a second), eta_s, pct against the sample before."""
    w = _by_time()
    seconds = F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(w)
    rate = (F.col("dst_rows") - F.lag("dst_rows").over(w)) / F.when(seconds > 0, seconds)
    left = F.greatest(F.col("src_rows") - F.col("dst_rows"), F.lit(0))
    return samples.select("db", "ts", rate.alias("rate"), F.when(rate > 0, left / rate).alias("eta_s"), F.when(F.col("src_rows") > 0, F.floor(F.col("dst_rows") * 100 / F.col("src_rows"))).otherwise(100).cast("long").alias("pct"))


def _grown(samples: DataFrame) -> DataFrame:
    """``samples`` with ``grew`` (the total or any table grew) and ``hot`` (any table of the map grew)."""
    w = _by_time()
    before = F.lag("src_tables").over(w)
    step = F.col("src_rows") - F.lag("src_rows").over(w)
    marked = samples.withColumn("__before", before).withColumn("__step", step)
    tables = F.coalesce(F.map_entries("src_tables"), F.array().cast("array<struct<key:string,value:bigint>>"))
    hot = F.coalesce(F.exists(tables, lambda e: e["value"] > F.coalesce(F.col("__before")[e["key"]], e["value"])), F.lit(False))
    marked = marked.withColumn("hot", F.col("__before").isNotNull() & hot)
    return marked.withColumn("grew", F.coalesce(F.col("__step") > 0, F.lit(False)) | F.col("hot"))


def stable_cycles(samples: DataFrame) -> DataFrame:
    """db, ts, stable: samples in a row since the source last grew; a growing sample is 0, the first counts 1."""
    w = _by_time()
    islands = _grown(samples).withColumn("__island", F.sum(F.col("grew").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = F.row_number().over(Window.partitionBy("db", "__island").orderBy("ts")) - F.when(F.col("__island") > 0, 1).otherwise(0)
    return islands.select("db", "ts", run.cast("long").alias("stable"))


def verdicts(samples: DataFrame) -> DataFrame:
    """db, ts, verdict: NOT SAFE while a table grows, SAFE once level and stable, converging while only level."""
    marked = _grown(samples).join(stable_cycles(samples), ["db", "ts"])
    level = F.col("dst_rows") >= F.col("src_rows")
    verdict = F.when(F.col("hot"), "NOT SAFE").when(level & (F.col("src_rows") > 0) & (F.col("stable") >= STABLE_CYCLES), "SAFE").when(level, "converging").otherwise("")
    return marked.select("db", "ts", verdict.alias("verdict"))


def hot_tables(samples: DataFrame) -> DataFrame:
    """db, ts, table, added: tables of the source that grew since the sample before."""
    each = samples.select("db", "ts", F.explode("src_tables").alias("table", "n"))
    added = F.col("n") - F.lag("n").over(Window.partitionBy("db", "table").orderBy("ts"))
    return each.withColumn("added", added).where("added > 0").select("db", "ts", "table", "added")


def tick_rates(ticks: DataFrame) -> DataFrame:
    """tick, n, running, change over a series of (tick, n)."""
    w = Window.partitionBy("series").orderBy("tick")
    return ticks.select("series", "tick", "n", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("running"), (F.col("n") - F.lag("n").over(w)).alias("change"))


def newest(events: DataFrame, per_group: int = 15, total: int = 12) -> DataFrame:
    """The newest events, at most ``per_group`` of each hop and ``total`` in all."""
    w = Window.partitionBy("hop").orderBy(F.desc("ts"), F.desc("event"))
    return events.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= per_group).drop("__k").orderBy(F.desc("ts"), "hop", F.desc("event")).limit(total)


def latest_state(points: DataFrame, **match: str) -> DataFrame:
    """The newest restore point that matches all given attributes, such as hop, db or tag."""
    for name, value in match.items():
        points = points.where(F.col(name) == value)
    return points.orderBy(F.desc("ts")).limit(1)


def heal_or_persist(results: DataFrame) -> DataFrame:
    """check, scope, cycle, change: how each check moved since the cycle before."""
    before = F.lag("status").over(Window.partitionBy("check", "scope").orderBy("cycle"))
    bad = lambda c: ~c.isin("ok", "skip")
    change = F.when(before.isNull(), "first").when(bad(before) & bad(F.col("status")), "persists").when(bad(before), "healed").when(bad(F.col("status")), "broke").otherwise("clean")
    return results.select("check", "scope", "cycle", change.alias("change"))


def eta(elapsed_s: float, done: int, total: int) -> float:
    """Seconds left at the pace so far (plain Python, for progress lines)."""
    return elapsed_s / done * (total - done) if done else 0.0
