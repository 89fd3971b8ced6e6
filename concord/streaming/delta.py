"""Incremental verification and replay of change logs.

The cursor is the stream's own checkpoint: a micro-batch whose touched keys differ raises, so the batch is
read again at the next start until both sides agree. Batch forms of every step work without a stream.
"""

from __future__ import annotations

import shutil
from collections.abc import Callable, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions.text import lsn_number
from concord.model import result
from concord.operators.diff import matched, restricted
from concord.session import remove

#: ``table name: OPERATION: column[type]:value ...`` with quoted or bare values.
_CHANGE = r"^table (\S+): (INSERT|UPDATE|DELETE):"


class Unclean(RuntimeError):
    """Touched keys differ between the two sides; the cursor stays where it was."""


def _value_pattern(column: str) -> str:
    return rf"(?:^| ){column}\[[^\]]*\]:(?:'((?:[^']|'')*)'|(\S+))"


def column_value(line: Column, column: str) -> Column:
    """The value of one column in a change line, quotes undone; null where it is absent."""
    body = F.regexp_replace(line, _CHANGE, "")
    quoted, bare = F.regexp_extract(body, _value_pattern(column), 1), F.regexp_extract(body, _value_pattern(column), 2)
    return F.when(~body.rlike(_value_pattern(column)), None).when(bare != "", bare).otherwise(F.replace(quoted, F.lit("''"), F.lit("'")))


def parse_changes(lines: DataFrame, keys: dict[str, Sequence[str]]) -> DataFrame:
    """lsn, table, op, key of every change line (lsn, line); key is null for tables without one, transaction marks go."""
    base = lines.select("lsn", F.regexp_extract("line", _CHANGE, 1).alias("table"), F.regexp_extract("line", _CHANGE, 2).alias("op"), "line").where("op <> ''")
    key = F.lit(None).cast("string")
    for table, columns in keys.items():
        if columns:
            key = F.when(F.col("table") == table, F.concat_ws("\t", *[column_value(F.col("line"), c) for c in columns])).otherwise(key)
    return base.select("lsn", "table", "op", key.alias("key"))


def row_event_keys(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """The key columns of row images (``before`` and ``after`` structs): an update that moves a key touches both."""
    images = events.select(F.explode(F.array_compact(F.array("before", "after"))).alias("x"))
    return images.select(*[F.col(f"x.{k}").alias(k) for k in key]).distinct()


def document_events(lines: DataFrame) -> DataFrame:
    """id, op, token of a document store's change events, one JSON text a line; other operations are left out."""
    get = lambda path: F.get_json_object("line", path)
    ident = F.coalesce(get("$.documentKey._id.$oid"), get("$.documentKey._id"))
    found = lines.select(ident.alias("id"), get("$.operationType").alias("op"), get("$._id._data").alias("token"))
    return found.where(F.col("op").isin("insert", "update", "replace", "delete"))


def history_kept(oldest: str, cursor: str) -> bool:
    """Whether a log still reaches back to the cursor; if not, only a whole comparison can tell (plain Python)."""
    place = lambda lsn: tuple(int(x, 16) for x in lsn.split("/"))
    return place(oldest) <= place(cursor)


#: Changes that one window of a verification takes; the rest waits for the next one.
WINDOW = 20_000


def window(changes: DataFrame, limit: int = WINDOW) -> tuple[DataFrame, bool]:
    """The first ``limit`` changes by log position (a parameter of the window, not a cut: the cursor moves no further), and whether more wait."""
    ordered = changes.orderBy(lsn_number(F.col("lsn")))
    return ordered.limit(limit), changes.limit(limit + 1).count() > limit


def unsupported(spark: SparkSession, engine: str, scope: str) -> DataFrame:
    """The result of a verification of changes on an engine that keeps no log of them."""
    return result(spark, "delta", scope, "error", f"{engine} keeps no log of changes; compare whole", "", "run check --only data")


def touched_keys(changes: DataFrame) -> DataFrame:
    """table, key: each changed key once."""
    return changes.where("key is not null").select("table", "key").distinct()


def keyless_changes(changes: DataFrame) -> DataFrame:
    """table: changed tables without a key, which need a whole comparison."""
    return changes.where("key is null").select("table").distinct()


def last_position(changes: DataFrame) -> DataFrame:
    return changes.agg(F.max_by("lsn", lsn_number(F.col("lsn"))).alias("lsn"))


def last_events(changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last event of each key. Ordering columns must be unique for a key, such as (lsn, seq)."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return changes.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def apply_changes(target: DataFrame, changes: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The target after replaying ``changes`` (op and all target columns): the last event of a key wins."""
    last = last_events(changes, key, order)
    kept = matched(target, last, key, "left_anti")
    return kept.unionByName(last.where("op <> 'DELETE'").select(*target.columns))


def verify_touched(src: DataFrame, dst: DataFrame, keys: DataFrame, key: Sequence[str], pairs: bool = False) -> DataFrame:
    """The key columns and kind of touched keys that differ, or of their ``pairs``."""
    return restricted(src, dst, keys, key, pairs=pairs).where("kind <> 'same'")


def batch_verifier(read_src: Callable[[], DataFrame], read_dst: Callable[[], DataFrame], key: Sequence[str], report: str | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that raises ``Unclean`` unless the batch's keys agree on both sides.

    Evidence goes to ``report``/<batch id>, overwritten when the batch is replayed.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        bad = verify_touched(read_src(), read_dst(), batch, key)
        counts = {r["kind"]: r["n"] for r in bad.groupBy("kind").agg(F.count("*").alias("n")).collect()}
        if counts:
            if report:
                bad.write.mode("overwrite").json(f"{report}/{batch_id}")
            raise Unclean(" ".join(f"{k}={counts.get(k, 0)}" for k in ("missing", "extra", "changed")))

    return run


def start_verification(changes: DataFrame, verifier: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None):
    """Start the verification stream over a streaming DataFrame of changes; without ``interval`` it ends when it has read all."""
    writer = changes.writeStream.foreachBatch(verifier).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def verification_cycle(changes: DataFrame, verifier: Callable[[DataFrame, int], None], checkpoint: str) -> tuple[bool, str]:
    """One cycle: whether all touched keys agree and the cursor has moved, else what differs."""
    query = start_verification(changes, verifier, checkpoint)
    try:
        query.awaitTermination()
    except Exception as error:  # the stream wraps what the batch raised
        text = str(error)
        if "Unclean" not in text:
            raise
        found = [x for x in text.replace("\n", " ").split() if x.split("=")[0] in ("missing", "extra", "changed") and "=" in x]
        return False, " ".join(found[:3])
    return True, "clean"


def start_apply(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Replay a change stream in micro-batches; ``apply`` must overwrite what an earlier try of the batch has written."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def teardown(checkpoint: str, spark: SparkSession | None = None) -> None:
    """Forget the cursor of a stream, on any file system where a session is given."""
    if spark is None:
        shutil.rmtree(Path(checkpoint), ignore_errors=True)
    else:
        remove(spark, checkpoint)


def fence_passed(applied: DataFrame, position: str) -> DataFrame:
    """side, passed: whether each side's applied position has reached the fence."""
    return applied.select("side", (lsn_number(F.col("lsn")) >= lsn_number(F.lit(position))).alias("passed"))


def settled(first: DataFrame, second: DataFrame, key: Sequence[str]) -> DataFrame:
    """Differences of the second look that the first one had too: what was only in flight is gone."""
    return matched(second, first, key, "left_semi")


def versions_changed(versions: DataFrame, cursor: int) -> DataFrame:
    """table, n of changes after a version cursor, for stores that number changes instead of logging keys."""
    return versions.where(F.col("version") > cursor).groupBy("table").agg(F.count("*").alias("n"))
