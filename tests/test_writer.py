"""Changes to a live target: whole or not at all, and undone exactly."""

import json
import sqlite3

import pytest

from concord import cli
from concord.functions import dialects
from concord.model import Endpoint, Pair
from concord.sources import readers, writer


def dump(path):
    with sqlite3.connect(path) as db:
        return {t: sorted(db.execute(f"select * from {t}"), key=str) for (t,) in db.execute("select name from sqlite_master where type = 'table' order by name") if not t.startswith("sqlite_")}


@pytest.fixture
def files(tmp_path):
    """A source, and a target with a child table whose parents are partly missing, changed or too many."""
    paths = [str(tmp_path / n) for n in ("a.db", "b.db")]
    for i, path in enumerate(paths):
        with sqlite3.connect(path) as db:
            db.executescript("create table parent (id integer primary key, name text); create table child (a integer, b integer, v real, parent integer references parent(id), primary key (a, b)) without rowid;")
            db.executemany("insert into parent values (?, ?)", [(k, f"p{k}" if not i or k % 7 else None) for k in range(1, 40) if not i or k % 5])
            db.executemany("insert into child values (?, ?, ?, ?)", [(k, k % 3, k / 8, k) for k in range(1, 40) if not i or k % 5])
            if i:
                db.execute("insert into parent values (100, 'extra')")
                db.execute("insert into child values (100, 1, 1.5, 100)")
    return paths


def bound(spark, paths):
    return readers.bind(spark, Pair("lite", "sqlite", Endpoint(options={"path": paths[0]}), Endpoint(options={"path": paths[1]})))


def wanted(pair):
    return {t: (writer.changes(pair.table("src", t), pair.table("dst", t), list(pair.meta[t].key)), list(pair.meta[t].key)) for t in ("child", "parent")}


def test_applied_and_undone_exactly(spark, files, tmp_path):
    pair, target, before = bound(spark, files), writer.SQLiteTarget(files[1]), dump(files[1])
    foreign = {t: [p for _, p, _ in m.foreign] for t, m in pair.meta.items()}
    tag = writer.apply(target, wanted(pair), foreign, str(tmp_path / "staging"))
    after = dump(files[1])
    assert {t: after[t] for t in ("parent", "child")} == dump(files[0])
    assert target.tags() == [tag] and sorted(target.journalled(tag)) == ["child", "parent"]
    assert sorted(writer.undo(target, tag, {t: m.key for t, m in pair.meta.items()}, foreign)) == ["child", "parent"]
    assert dump(files[1]) == before


def test_a_failure_in_the_transaction_leaves_the_target(spark, files, tmp_path):
    pair, target, before = bound(spark, files), writer.SQLiteTarget(files[1]), dump(files[1])
    only_child = {"child": wanted(pair)["child"]}  # whose parents are missing: the references fail at the end
    with pytest.raises(sqlite3.IntegrityError):
        writer.apply(target, only_child, {}, str(tmp_path / "staging"))
    assert dump(files[1]) == before


def test_a_killed_task_leaves_the_target(spark, files, tmp_path):
    pair, target, before = bound(spark, files), writer.SQLiteTarget(files[1]), dump(files[1])
    rows, key = wanted(pair)["parent"]

    def dies(batches):
        import os

        for batch in batches:
            yield batch
            os._exit(1)

    broken = rows.mapInArrow(dies, rows.schema)
    with pytest.raises(Exception):
        writer.apply(target, {"parent": (broken, key)}, {}, str(tmp_path / "staging"))
    assert dump(files[1]) == before


def test_staged_files_of_an_aborted_write_are_gone(tmp_path):
    w = writer.StagingWriter(str(tmp_path / "s"), ["a", "b"])
    done = [w.write(iter([(1, "x"), (2, None)])), w.write(iter([]))]
    w.commit(done)
    assert (tmp_path / "s" / "files").read_text() == done[0].path + "\n"
    w.abort([*done, None])
    assert not list((tmp_path / "s").glob("*.db"))


def test_parents_come_first():
    assert writer.parents_first(["c", "b", "a"], {"c": ["b"], "b": ["a"], "a": ["a"]}) == ["a", "b", "c"]
    assert sorted(writer.parents_first(["x", "y"], {"x": ["y"], "y": ["x"]})) == ["x", "y"]


def test_statements_of_other_engines():
    change = writer.Change("s.t", ("id", "v"), ("id",), '"stage"')
    sql = writer.apply_statements(dialects.POSTGRES, "t1", [change])
    assert sql[2] == 'DELETE FROM "s"."t" WHERE EXISTS (SELECT 1 FROM "concord_undo_t1_keys_s_t" s WHERE s."id" is not distinct from "s"."t"."id")'
    assert "<=>" in writer.undo_statements(dialects.MYSQL, "t1", [change])[0]


def test_commands_change_and_roll_back_the_target(spark, files, tmp_path, capsys):
    config = tmp_path / "hops.json"
    config.write_text(json.dumps({"hops": {"lite": {"engine": "sqlite", "source": {"path": files[0]}, "target": {"path": files[1]}}}}))
    run = lambda *args: (cli.main(["--config", str(config), "--reports", str(tmp_path / "r"), *args]), capsys.readouterr().out)
    before = dump(files[1])
    code, said = run("sync", "lite", "--kind", "rows")
    assert code == 0 and "parent: " in said and dump(files[1]) == before  # a plan only
    code, said = run("sync", "lite", "--kind", "rows", "--go", "--tag", "one")
    assert code == 0 and "rollback --tag one" in said
    assert run("check", "lite", "--only", "data")[0] == 0
    assert run("rollback", "lite", "--tag", "one", "--go")[0] == 0 and dump(files[1]) == before
    assert run("move", "lite", "--go", "--tag", "two")[0] == 0
    moved, source = dump(files[1]), dump(files[0])
    assert set(source["parent"]) <= set(moved["parent"]) and set(source["child"]) <= set(moved["child"])
    assert run("rollback", "lite", "--go")[0] == 0 and dump(files[1]) == before
