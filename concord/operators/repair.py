"""Repair plans, their application and their exact undo, as set algebra on immutable versions.

A repair never changes the table it reads: it yields a new version of the target, and the pre-image of
every key it touches is kept so that the old version can be restored row for row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions import dialects
from concord.operators.diff import differences, matched
from concord.session import durable

SOURCE_WINS, KEEP_TARGET = "source-wins", "keep-target"
#: A keyed sync tool is trusted with single-column keys and this many of them at most.
SYNC_TOOL_KEYS = 1000


@dataclass
class RowRepair:
    """``repaired`` is the new target; ``touched`` the keys with their kinds; ``preimage`` the old rows of those keys."""

    repaired: DataFrame
    touched: DataFrame
    preimage: DataFrame


def repair_rows(src: DataFrame, dst: DataFrame, key: Sequence[str], policy: str = SOURCE_WINS, columns: Sequence[str] | None = None) -> RowRepair:
    """Copy missing and changed rows from the source, delete extra ones; keep-target leaves changed rows alone.

    The differing keys are written once; the new target, the touched keys and the pre-image all read them.
    Null is a key like any other, and all rows of a repeated key are replaced together.
    """
    found = durable(differences(src, dst, key, columns))
    touched = found.where("kind <> 'changed'") if policy == KEEP_TARGET else found
    copied = matched(src, touched.where("kind <> 'extra'"), key, "left_semi")
    kept = matched(dst, touched, key, "left_anti")
    return RowRepair(kept.unionByName(copied.select(*dst.columns)), touched, matched(dst, touched, key, "left_semi"))


def restore(after: DataFrame, repair: RowRepair, key: Sequence[str]) -> DataFrame:
    """The target as it was before the repair: touched keys go, their old rows come back."""
    return matched(after, repair.touched, key, "left_anti").unionByName(repair.preimage)


def row_plan(differing: DataFrame, key: Sequence[str], policy: str = SOURCE_WINS) -> DataFrame:
    """kind, operation, n: what a repair would do, without doing it.

    ``differing`` has a row for each key, or the counts of ``diff.paired``, which are added up.
    """
    operation = F.when(F.col("kind") == "missing", "insert").when(F.col("kind") == "extra", "delete").when(F.lit(policy == KEEP_TARGET), "keep").otherwise("replace")
    n = F.sum("__n") if "__n" in differing.columns else F.count("*")
    return differing.groupBy("kind").agg(n.alias("n")).withColumn("operation", operation)


def sync_tool_fits(key: Sequence[str], n_keys: int) -> bool:
    """Whether a keyed sync tool may do the work: one key column and 1 to 1000 keys."""
    return len(key) == 1 and 1 <= n_keys <= SYNC_TOOL_KEYS


def sequence_repair(src: DataFrame, dst: DataFrame, maxima: DataFrame, engine: str = "postgres") -> DataFrame:
    """table, target_value, undo_value, undo_called, action for each counter.

    postgres: up to the larger of the source's value and the target's largest key; refused if an owned
    counter's target already holds keys beyond the source. mysql: only raised. Others: set to the source.
    ``undo_called`` is false for a counter that has given no number yet.
    """
    j = src.select("table", F.col("last_value").alias("s"), F.coalesce("owned", F.lit(False)).alias("owned")).join(dst.select("table", F.col("last_value").alias("d"), F.coalesce("is_called", F.lit(True)).alias("called")), "table").join(maxima, "table", "left")
    high = F.coalesce("high", F.lit(0))
    if engine == "postgres":
        target = F.greatest("s", high)
        action = F.when(F.col("owned") & (high > F.col("s")), "refused").when((target == 0) | (F.col("called") & (target == F.col("d"))), "none").otherwise("set")
    elif engine == "mysql":
        target = F.greatest("s", high + 1)
        action = F.when(target > F.col("d"), "set").otherwise("none")
    else:
        target = F.col("s")
        action = F.when(F.col("called") & (F.col("s") == F.col("d")), "none").otherwise("set")
    return j.select("table", target.cast("long").alias("target_value"), F.col("d").cast("long").alias("undo_value"), F.col("called").alias("undo_called"), action.alias("action"))


def sequence_actions(plan: DataFrame, engine: str = "postgres") -> list[dict]:
    """The repair actions of a counter plan in the engine's own statements, each with its exact undo; refused ones as notes.

    A plan has a row for each counter of a catalog, so it is read whole.
    """
    actions = []
    for r in plan.where("action in ('set', 'refused')").orderBy("table").collect():
        if r["action"] == "refused":
            actions.append({"scope": r["table"], "kind": "sequences", "statements": [], "undo": [], "note": f"REFUSED: the target's largest key {r['target_value']} is beyond the source"})
            continue
        do = dialects.counter_statements(engine, r["table"], r["target_value"])
        undo = dialects.counter_statements(engine, r["table"], r["undo_value"], r["undo_called"])
        actions.append({"scope": r["table"], "kind": "sequences", "statements": do, "undo": undo, "note": f"{r['undo_value']} -> {r['target_value']}"})
    return actions


def schema_actions(missing: list[tuple[str, str, str | T.DataType]], engine: str = "postgres") -> list[dict]:
    """Statements that add columns (table, column, type), with their reverse. A type is the catalog's own text, or Spark's."""
    actions = []
    for table, column, kind in missing:
        do, undo = dialects.add_column(engine, table, column, kind)
        actions.append({"scope": f"{table}.{column}", "kind": "schema", "statements": [do], "undo": [undo], "note": ""})
    return actions


def login_plan(difference: DataFrame) -> DataFrame:
    """login, step: what to do about each differing login; secrets are never part of a plan."""
    return difference.select("login", F.when(F.col("kind") == "missing", "create").when(F.col("kind") == "password", "set password").when(F.col("kind") == "roles", "grant roles").otherwise("review").alias("step"))


def validation_plan(constraints: DataFrame, violations: DataFrame) -> DataFrame:
    """constraint, n, step: constraints that hold for all rows can be validated, largest tables first."""
    j = constraints.join(violations, "constraint")
    return j.select("constraint", "size", "n", F.when(F.col("n") == 0, "validate").otherwise("fix rows").alias("step")).orderBy(F.desc("size"), "constraint")
