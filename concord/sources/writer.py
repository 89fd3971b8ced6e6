"""Changes to a live target: staged by tasks, applied in one transaction, undone from a journal in the target.

The rows of a change are staged first: each task writes a file of its own, and only the files of tasks that ended
well are named by the write's commit; an aborted write removes them all. Nothing has touched the target then. The
engine applies the staged files itself, in one transaction over all tables: it notes the rows that a change
touches in journal tables, deletes them, children before parents, and inserts the new ones, parents first. So the
target is either as it was or whole. Undo puts the noted rows back, the same way, and drops the journal.
"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterator, Sequence
from contextlib import closing
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from concord.functions.dialects import Dialect, dialect
from concord.operators.diff import differences, matched
from concord.sources.retry import retried

#: What a staged row does: takes the rows of its key away, and with ``put`` is there itself.
TAKE, PUT = "take", "put"
JOURNAL = "concord_undo"
#: Equality that holds for nulls, too.
_SAME = {"sqlite": "{0} is {1}", "duckdb": "{0} is not distinct from {1}", "postgres": "{0} is not distinct from {1}", "mysql": "{0} <=> {1}"}


@dataclass
class Staged(WriterCommitMessage):
    path: str
    rows: int


class StagingSource(DataSource):
    """``df.write.format("staging")`` with option ``path``, a folder that tasks and driver share: a SQLite file for each task, and a list of those that count."""

    @classmethod
    def name(cls) -> str:
        return "staging"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return StagingWriter(self.options["path"], [f.name for f in schema])


class StagingWriter(DataSourceWriter):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names = path, names

    def write(self, iterator: Iterator) -> Staged:
        """One task's rows in a file of its own; a task that is tried again takes another name."""
        os.makedirs(self.path, exist_ok=True)
        path, n = f"{self.path}/{uuid.uuid4().hex}.db", 0
        with closing(sqlite3.connect(path)) as db, db:
            db.execute(f"create table rows ({', '.join(dialect('sqlite').column(x) for x in self.names)})")
            marks = ", ".join("?" * len(self.names))
            for row in iterator:
                db.execute(f"insert into rows values ({marks})", tuple(row))
                n += 1
        return Staged(path, n)

    def commit(self, messages: list[Staged | None]) -> None:
        """The files of the tasks that ended well, by a list that appears at once."""
        text = "".join(f"{m.path}\n" for m in messages if m is not None and m.rows)
        with open(f"{self.path}/.files.part", "w") as f:
            f.write(text)
        os.replace(f"{self.path}/.files.part", f"{self.path}/files")

    def abort(self, messages: list[Staged | None]) -> None:
        for m in messages:
            if m is not None and os.path.exists(m.path):
                os.remove(m.path)


def stage(rows: DataFrame, path: str) -> list[str]:
    """Write rows as staged files; only a write that has ended well has any."""
    rows.sparkSession.dataSource.register(StagingSource)
    os.makedirs(path, exist_ok=True)
    rows.write.format("staging").option("path", path).mode("append").save()
    with open(f"{path}/files") as f:
        return f.read().split()


def changes(src: DataFrame, dst: DataFrame, key: Sequence[str], policy: str = "source-wins") -> DataFrame:
    """``__do`` and the target's columns: what makes the target's rows the source's, for keys that differ."""
    found = differences(src, dst, key)
    if policy == "keep-target":
        found = found.where("kind <> 'changed'")
    keys = found.select(*[F.col(f"`{k}`") for k in key])
    gone = keys.select(F.lit(TAKE).alias("__do"), *[F.col(f"`{c}`") if c in key else F.lit(None).cast(dst.schema[c].dataType).alias(c) for c in dst.columns])
    put = matched(src, found.where("kind <> 'extra'"), key, "left_semi").select(F.lit(PUT).alias("__do"), *[F.col(f"`{c}`").cast(dst.schema[c].dataType).alias(c) for c in dst.columns])
    return gone.unionByName(put)


def parents_first(tables: Sequence[str], foreign: dict[str, Sequence[str]]) -> list[str]:
    """Tables in an order in which each follows those that it refers to; those of a circle as they come."""
    out: list[str] = []

    def visit(table: str, above: tuple[str, ...]) -> None:
        for parent in foreign.get(table, ()):
            if parent in tables and parent not in above and parent not in out:
                visit(parent, (*above, table))
        if table not in out:
            out.append(table)

    for table in tables:
        visit(table, (table,))
    return out


@dataclass(frozen=True)
class Change:
    """A table's staged change: its columns, its key, and where the engine finds the staged rows."""

    table: str
    columns: tuple[str, ...]
    key: tuple[str, ...]
    staged: str


def _of_keys(own: Dialect, key: Sequence[str], left: str, right: str) -> str:
    return " and ".join(_SAME[own.name].format(f"{left}.{own.column(k)}", f"{right}.{own.column(k)}") for k in key)


def journal(tag: str, table: str) -> tuple[str, str]:
    """The names of the journal's tables: the rows that were, and the keys that were touched."""
    plain = table.replace(".", "_")
    return f"{JOURNAL}_{tag}_rows_{plain}", f"{JOURNAL}_{tag}_keys_{plain}"


def apply_statements(own: Dialect, tag: str, ordered: Sequence[Change]) -> list[str]:
    """What one transaction does: the journal of all tables, then deletions from the last table on, then insertions from the first."""
    q, out = own.column, []
    for c in ordered:
        (rows, keys), table = journal(tag, c.table), own.name_of(c.table)
        out += [
            f"CREATE TABLE {q(rows)} AS SELECT t.* FROM {table} t WHERE EXISTS (SELECT 1 FROM {c.staged} s WHERE {_of_keys(own, c.key, 's', 't')})",
            f"CREATE TABLE {q(keys)} AS SELECT DISTINCT {', '.join(map(q, c.key))} FROM {c.staged}",
        ]
    out += [f"DELETE FROM {own.name_of(c.table)} WHERE EXISTS (SELECT 1 FROM {q(journal(tag, c.table)[1])} s WHERE {_of_keys(own, c.key, 's', own.name_of(c.table))})" for c in reversed(ordered)]
    names = lambda c: ", ".join(map(q, c.columns))
    return out + [f"INSERT INTO {own.name_of(c.table)} ({names(c)}) SELECT {names(c)} FROM {c.staged} WHERE {q('__do')} = '{PUT}'" for c in ordered]


def undo_statements(own: Dialect, tag: str, ordered: Sequence[Change]) -> list[str]:
    """What one transaction does to undo a change: touched keys go, the rows that were come back, the journal is dropped."""
    q, tables = own.column, [(c, *journal(tag, c.table)) for c in ordered]
    out = [f"DELETE FROM {own.name_of(c.table)} WHERE EXISTS (SELECT 1 FROM {q(keys)} s WHERE {_of_keys(own, c.key, 's', own.name_of(c.table))})" for c, _, keys in reversed(tables)]
    names = lambda c: ", ".join(map(q, c.columns))
    out += [f"INSERT INTO {own.name_of(c.table)} ({names(c)}) SELECT {names(c)} FROM {q(rows)}" for c, rows, _ in tables]
    return out + [f"DROP TABLE {q(name)}" for _, *names_ in tables for name in names_]


class SQLiteTarget:
    """A SQLite file that changes are applied to."""

    own = dialect("sqlite")

    def __init__(self, path: str):
        self.path = path

    def run(self, statements: Sequence[str], attached: Sequence[str] = ()) -> None:
        """All statements in one transaction, or none; references are looked at when it ends."""
        with closing(sqlite3.connect(self.path, isolation_level=None)) as db:
            for i, path in enumerate(attached):
                db.execute(f"attach ? as staged{i}", (path,))
            db.execute("pragma foreign_keys = on")
            db.execute("begin immediate")
            try:
                db.execute("pragma defer_foreign_keys = on")
                for statement in statements:
                    db.execute(statement)
                db.execute("commit")
            except BaseException:
                db.execute("rollback")
                raise

    def columns(self, table: str) -> tuple[str, ...]:
        with closing(sqlite3.connect(self.path)) as db:
            return tuple(r[1] for r in db.execute(f"pragma table_info({self.own.column(table)})"))

    def tags(self) -> list[str]:
        """The changes that can be undone, the newest last."""
        start = f"{JOURNAL}_"
        with closing(sqlite3.connect(self.path)) as db:
            names = [r[0] for r in db.execute("select name from sqlite_master where substr(name, 1, ?) = ? order by rowid", (len(start), start))]
        return list(dict.fromkeys(n[len(start) :].split("_")[0] for n in names))

    def journalled(self, tag: str) -> list[str]:
        """The tables that a change has touched."""
        start = f"{JOURNAL}_{tag}_keys_"
        with closing(sqlite3.connect(self.path)) as db:
            return [r[0][len(start) :] for r in db.execute("select name from sqlite_master where substr(name, 1, ?) = ? order by rowid", (len(start), start))]


def gathered(parts: dict[str, list[str]], path: str) -> dict[str, str]:
    """The staged files of several tables as tables of one file, by name; a transaction then attaches that one alone."""
    names = {}
    with closing(sqlite3.connect(path, isolation_level=None)) as db:
        for i, (table, files) in enumerate((t, f) for t, f in parts.items() if f):
            names[table] = f"rows{i}"
            for k, file in enumerate(files):
                db.execute("attach ? as part", (file,))
                db.execute(f"create table rows{i} as select * from part.rows" if not k else f"insert into rows{i} select * from part.rows")
                db.execute("detach part")
    return names


def apply(target: SQLiteTarget, wanted: dict[str, tuple[DataFrame, Sequence[str]]], foreign: dict[str, Sequence[str]], folder: str, tag: str = "") -> str:
    """Apply the rows of ``changes`` of each table (rows, key) in one transaction; the tag that undoes it.

    ``folder`` is shared by the tasks, the driver and the target's file.
    """
    tag = tag or uuid.uuid4().hex[:12]
    staged = {table: stage(rows, f"{folder}/{tag}/{table}") for table, (rows, _) in wanted.items()}
    names = gathered(staged, f"{folder}/{tag}/all.db")
    ordered = [Change(t, tuple(c for c in wanted[t][0].columns if c != "__do"), tuple(wanted[t][1]), f"staged0.{names[t]}") for t in parents_first(list(wanted), foreign) if t in names]
    if ordered:
        retried(lambda: target.run(apply_statements(target.own, tag, ordered), [f"{folder}/{tag}/all.db"]))
    return tag


def undo(target: SQLiteTarget, tag: str, keys: dict[str, Sequence[str]], foreign: dict[str, Sequence[str]]) -> list[str]:
    """Undo a change by its tag, in one transaction; the tables that it had touched."""
    touched = target.journalled(tag)
    if touched:
        target.run(undo_statements(target.own, tag, [Change(t, target.columns(t), tuple(keys[t]), "") for t in parents_first(touched, foreign)]))
    return touched
