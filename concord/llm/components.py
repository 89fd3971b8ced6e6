"""Connected components of a graph held as a table of edges.

Large-star and small-star rounds (Kiveris et al., 2014) rewrite the edges until each node points at the
smallest node of its component. Every round is two shuffles of the edge table; nothing but the edge count
and a checksum reaches the driver, and each round is cut by a checkpoint. The edges of a node that has very
many are not shuffled to one task: such nodes are few, by arithmetic, and are looked up by broadcast.

A round is written in as many files as its edges need, however many partitions a shuffle has: the last rounds
have few edges, and a file for each of many empty partitions would cost more than they do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import HOT_ROWS, joined
from concord.session import durable


#: A task writes about so many edges of a round.
TASK_EDGES = 100_000


def _star(edges: DataFrame, large: bool, total: int, hot_edges: int) -> DataFrame:
    """One star round over ``total`` undirected edges (u, v)."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if large else both.where("v < u")
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
    linked = joined(seen.where("v > u") if large else seen, least, "u", "n", 2 * total, hot_edges)
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    if not large:
        moved = moved.unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60, hot_edges: int = HOT_ROWS) -> DataFrame:
    """node, root for every node of ``edges`` (columns u, v of one orderable type); root is the least node reachable.

    Loops and repeated edges are allowed and change nothing; no edges give an empty table.
    """
    current = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    for _ in range(max_rounds):
        now = current.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
        if now["n"] == 0 or (now["n"], now["h"]) == before:
            break
        before = (now["n"], now["h"])
        # a star round never has more edges than it was given, but for one to each node's least
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-now["n"] // TASK_EDGES))
        current = durable(_star(_star(current, True, now["n"], hot_edges), False, now["n"], hot_edges).coalesce(tasks))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def least_ids(nodes: DataFrame, roots: DataFrame, salts: int = 32) -> DataFrame:
    """node, component_id for every row of ``nodes`` (node, least): the smallest ``least`` of its component.

    ``roots`` are those of ``connected_components``; a node that it lacks is a component of its own. Members are
    salted, as one component may hold many of them.
    """
    found = durable(nodes.join(roots, "node", "left"))
    linked = found.where("root is not null")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    several = linked.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(salts)).cast("int")).join(named, ["root", "salt"]).select("node", "component_id")
    return found.where("root is null").select("node", F.col("least").alias("component_id")).unionByName(several)
