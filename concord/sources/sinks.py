"""Where results go: evidence, key files, summaries, metrics, reports, restore points and copied tables."""

from __future__ import annotations

import html
import json
import time
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.model import RESULT_SCHEMA, Pair
from concord.session import remove

#: Order of checks in reports.
CHECK_ORDER = ("schema", "objects", "params", "counts", "autoinc", "data", "deep")
@dataclass(frozen=True)
class Mover:
    """A bulk tool: the programs that it needs here, if any, and the kinds of pairs that it serves."""

    serves: tuple[str, ...]
    programs: tuple[str, ...] = ()


#: Bulk tools; "builtin" serves all.
MOVERS = {
    "pgdump": Mover(("postgres",), ("pg_dump", "pg_restore")),
    "mydumper": Mover(("mysql",), ("mydumper", "myloader")),
    "pgloader": Mover(("hetero",), ("pgloader",)),
    "mongodump": Mover(("mongodb",), ("mongodump", "mongorestore")),
    "debezium": Mover(("postgres", "mysql", "hetero")),
}


def write_evidence(df: DataFrame, root: str, pair: str, database: str, check: str) -> str:
    path = f"{root}/{pair}/{database}/{check}"
    df.write.mode("overwrite").json(path)
    return path


def write_keys(differing: DataFrame, root: str, table: str) -> None:
    """Differing keys by table and kind. Partitions of a table that is clean now are removed, those of other tables stay."""
    rows = differing.withColumn("table", F.lit(table))
    session = df_session(rows)
    for kind in ("missing", "extra", "changed"):
        part = rows.where(F.col("kind") == kind).drop("kind", "table")
        path = f"{root}/table={table}/kind={kind}"
        if part.isEmpty():
            delete(session, path)
        else:
            part.write.mode("overwrite").parquet(path)


def df_session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a path through the cluster's file system."""
    return remove(spark, path)


def _path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


class Lock:
    """A file that one command holds at a time, on any file system that creates files atomically."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def __enter__(self) -> Lock:
        target, system = _path(self.spark, self.path)
        if not system.createNewFile(target):
            raise RuntimeError(f"another command holds {self.path}; remove it if that command is gone")
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def merged_summary(old: DataFrame, new: DataFrame) -> DataFrame:
    """Results of this run, and those of checks that it has not run again."""
    rerun = new.select("check").distinct()
    return old.join(rerun, "check", "left_anti").select(*RESULT_SCHEMA.names).unionByName(new)


def status_matrix(results: DataFrame) -> DataFrame:
    """db, check, status: the worst status of each check by database (the first word of the scope)."""
    rank = F.create_map(*[F.lit(x) for p in {"ok": 0, "skip": 1, "diff": 2, "error": 3}.items() for x in p])
    name = F.create_map(*[F.lit(x) for p in {0: "ok", 1: "skip", 2: "diff", 3: "error"}.items() for x in p])
    db = F.element_at(F.split("scope", " "), 1)
    return results.groupBy(db.alias("db"), "check").agg(F.max(F.element_at(rank, F.col("status"))).alias("r")).select("db", "check", F.element_at(name, F.col("r")).alias("status"))


def pass_total(results: DataFrame) -> DataFrame:
    """n_pass, n_total, all_clean."""
    return results.agg(F.count_if(F.col("status").isin("ok", "skip")).alias("n_pass"), F.count("*").alias("n_total")).withColumn("all_clean", F.col("n_pass") == F.col("n_total"))


def exit_status(results: DataFrame) -> int:
    """1 if any result is neither ok nor skipped."""
    return int(not results.where(~F.col("status").isin("ok", "skip")).isEmpty())


def metrics(results: DataFrame, pair: str) -> DataFrame:
    """line: one gauge for each check and scope in the text format of metric scrapers."""
    value = F.when(F.col("status").isin("ok", "skip"), 1).otherwise(0)
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return results.select(F.format_string('concord_check_ok{pair="%s",check="%s",scope="%s"} %d', *map(escaped, (F.lit(pair), F.col("check"), F.col("scope"))), value).alias("line"))


def html_report(results: DataFrame, title: str) -> str:
    """A page with one row for each result; results are a few hundred rows by nature."""
    rows = sorted(results.collect(), key=lambda r: (CHECK_ORDER.index(r["check"]) if r["check"] in CHECK_ORDER else len(CHECK_ORDER), r["scope"]))
    cells = "".join(f'<tr class="{r["status"]}">' + "".join(f"<td>{html.escape(str(r[c] or ''))}</td>" for c in ("check", "scope", "status", "detail", "fix_hint")) + "</tr>" for r in rows)
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><table>{cells}</table>"


def changelog(spark: SparkSession, path: str, **entry) -> None:
    """Append one line to a change log."""
    row = [(json.dumps(entry | {"ts": time.time()}, sort_keys=True),)]
    spark.createDataFrame(row, "value string").write.mode("append").text(path)


def settings_report(difference: DataFrame, path: str) -> None:
    difference.write.mode("overwrite").json(path)


class StateStore:
    """Restore points as versioned folders of any file system Spark reaches: local, s3a and others."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def save(self, hop: str, database: str, tables: dict[str, DataFrame], tag: str = "") -> str:
        """Write the tables, then the mark that makes the point valid."""
        stamp = f"{time.time_ns():020d}"
        point = f"{self.root}/{hop}/{stamp}"
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{point}/{name}")
        meta = [(hop, database, tag, stamp, sorted(tables))]
        self.spark.createDataFrame(meta, "hop string, db string, tag string, ts string, tables array<string>").coalesce(1).write.mode("overwrite").json(f"{point}/_meta")
        return point

    def points(self, hop: str) -> DataFrame:
        """Valid restore points of a hop, newest first."""
        schema = "hop string, db string, tag string, ts string, tables array<string>"
        if not exists(self.spark, f"{self.root}/{hop}"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(f"{self.root}/{hop}/*/_meta").orderBy(F.desc("ts"))

    def table(self, hop: str, stamp: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{hop}/{stamp}/{name}")


class MoveCheckpoint:
    """How far each table of a move has come: {table: {"last": key, "done": bool}}, written whole after each chunk.

    With a session the state is a file of any file system that Spark reaches, else a local one.
    """

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = path, spark
        self.state = json.loads(self._read() or "{}")

    def _read(self) -> str:
        if self.spark is None:
            return Path(self.path).read_text() if Path(self.path).exists() else ""
        target, system = _path(self.spark, self.path)
        if not system.exists(target):
            return ""
        stream = system.open(target)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def save(self, table: str, last: int | None, done: bool) -> None:
        self.state[table] = {"last": last, "done": done}
        text = json.dumps(self.state)
        if self.spark is None:
            part = Path(self.path).with_suffix(".part")
            part.write_text(text)
            part.replace(self.path)
            return
        target, system = _path(self.spark, self.path)
        stream = system.create(target, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


def move_plan(pair: Pair, checkpoint: MoveCheckpoint) -> list[tuple[str, str]]:
    """(table, todo | resume | done) for every table to copy."""
    states = {t: checkpoint.state.get(t) for t in pair.kept_tables()}
    return [(t, "todo" if s is None else "done" if s["done"] else "resume") for t, s in states.items()]


def move_table(src: DataFrame, key: str, path: str, checkpoint: MoveCheckpoint, table: str, chunk: int, after_chunk: Callable[[int], None] | None = None) -> int:
    """Copy ``src`` by ranges of an integer key to ``path``; a range that was begun before is written anew.

    Returns the number of ranges copied now. Ranges are (last, next], each in a folder of its own.
    """
    bounds = src.agg(F.min(key), F.max(key)).first()
    if bounds[0] is None:
        src.write.mode("overwrite").parquet(f"{path}/range=empty")
        checkpoint.save(table, None, True)
        return 0
    last = (checkpoint.state.get(table) or {}).get("last")
    last = bounds[0] - 1 if last is None else last
    copied = 0
    while last < bounds[1]:
        end = min(last + chunk, bounds[1])
        src.where((F.col(key) > last) & (F.col(key) <= end)).write.mode("overwrite").parquet(f"{path}/range={last + 1}")
        last, copied = end, copied + 1
        checkpoint.save(table, last, False)
        if after_chunk:
            after_chunk(copied)
    checkpoint.save(table, last, True)
    return copied


def copy_table(src: DataFrame, path: str) -> None:
    """A whole table without an integer key, in one write."""
    src.write.mode("overwrite").parquet(path)


def write_jdbc(df: DataFrame, end, url: str, table: str, batch: int = 5000) -> None:
    """Append rows to a table of a live engine in batches; null and '' are two values to the driver."""
    df.write.format("jdbc").option("url", url).option("dbtable", table).option("user", end.user).option("password", end.password).option("batchsize", batch).mode("append").save()


def move_into(src: DataFrame, key: str, end, url: str, table: str, checkpoint: MoveCheckpoint, chunk: int, clear: Callable[[int, int], None], write: Callable[..., None] = write_jdbc) -> int:
    """Copy ``src`` by ranges of an integer key into a live table. Returns the number of ranges copied now.

    ``clear(last, end)`` deletes the target's rows with last < key <= end before a range is written, so a range
    that was begun before is not doubled.
    """
    bounds = src.agg(F.min(key), F.max(key)).first()
    last = (checkpoint.state.get(table) or {}).get("last")
    last = (bounds[0] or 0) - 1 if last is None else last
    copied = 0
    while bounds[0] is not None and last < bounds[1]:
        to = min(last + chunk, bounds[1])
        clear(last, to)
        write(src.where((F.col(key) > last) & (F.col(key) <= to)), end, url, table)
        last, copied = to, copied + 1
        checkpoint.save(table, last, False)
    checkpoint.save(table, last, True)
    return copied


def pick_mover(engine: str, has: Callable[[str], bool], table: str = "") -> str:
    """The bulk tool for whole databases where it is installed; single tables go through the builtin copy."""
    if table:
        return "builtin"
    fit = [via for via, mover in MOVERS.items() if mover.programs and engine in mover.serves and all(map(has, mover.programs))]
    return fit[0] if fit else "builtin"


def mover_supported(engine: str, via: str) -> bool:
    return via not in MOVERS or engine in MOVERS[via].serves


def comparison_json(counts: DataFrame, objects: DataFrame) -> DataFrame:
    """value: a database's comparison as one JSON text of counts and objects."""
    a = counts.agg(F.collect_list(F.struct(*counts.columns)).alias("counts")).withColumn("one", F.lit(1))
    b = objects.agg(F.collect_list(F.struct(*objects.columns)).alias("objects")).withColumn("one", F.lit(1))
    return a.join(b, "one").select(F.to_json(F.struct("counts", "objects")).alias("value"))


def migration_files(actions: list[dict], root: str, version: int, label: str) -> tuple[Path, Path]:
    """A versioned migration and its undo as SQL files."""
    folder = Path(root)
    folder.mkdir(parents=True, exist_ok=True)
    forward, backward = folder / f"V{version}__{label}.sql", folder / f"U{version}__{label}.sql"
    forward.write_text("".join(f"{s};\n" for a in actions for s in a["statements"]))
    backward.write_text("".join(f"{s};\n" for a in reversed(actions) for s in a["undo"]))
    return forward, backward


def connector_config(pair: Pair, database: str, tables: list[str]) -> dict:
    """Settings of an external change-capture connector for a pair; secrets stay references."""
    kind = {"postgres": "io.debezium.connector.postgresql.PostgresConnector", "mysql": "io.debezium.connector.mysql.MySqlConnector"}[pair.options.get("source_engine", pair.engine)]
    source = {"connector.class": kind, "database.hostname": pair.source.host, "database.port": str(pair.source.port), "database.user": pair.source.user, "database.password": "${env:SOURCE_PASSWORD}", "database.dbname": database, "topic.prefix": pair.name, "table.include.list": ",".join(tables)}
    sink = {"connector.class": "io.debezium.connector.jdbc.JdbcSinkConnector", "connection.username": pair.target.user, "connection.password": "${env:TARGET_PASSWORD}", "insert.mode": "upsert", "delete.enabled": "true", "primary.key.mode": "record_key"}
    return {"source": {"name": f"{pair.name}-source", "config": source}, "sink": {"name": f"{pair.name}-sink", "config": sink}}
