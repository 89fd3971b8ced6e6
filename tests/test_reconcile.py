"""The golden loop and the edges of the reconciliation operators, on small rows."""

import sqlite3

import pytest
from pyspark.sql import functions as F

from concord.functions.canon import row_hash
from concord.model import Endpoint, Pair, TableMeta, excluded, load_pairs
from concord.operators import catalog, diff, drift, fingerprint, repair, watch
from concord.plans import checks
from concord.sources import readers, sinks
from concord.streaming import delta


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_exclusion_matches_endings_and_wildcards():
    assert excluded(["orders"], "app", "public", "orders")
    assert excluded(["public.ord*"], "app", "public", "orders")
    assert excluded(["app.*"], "app", "public", "orders")
    assert not excluded(["public"], "app", "public", "orders")
    assert not excluded(["rders"], "", "orders")


def test_row_text_cannot_be_forged(spark):
    df = spark.createDataFrame([("a#b", "c"), ("a", "b#c"), ("~null~", None), (None, "~null~")], "x string, y string")
    assert df.select(row_hash(df)).distinct().count() == 4
    assert df.select(row_hash(df, mode="hash")).distinct().count() < 4


def test_xor_is_blind_to_paired_rows_and_sum_is_not(spark):
    a, b = (spark.createDataFrame([(x,), (x,)], "v string") for x in "ab")
    assert fingerprint.xor_fingerprint(a).first()["md5_xor"] == fingerprint.xor_fingerprint(b).first()["md5_xor"] == 0
    assert fingerprint.table_fingerprint(a).first() != fingerprint.table_fingerprint(b).first()


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, v string")
    full = spark.createDataFrame([(1, "x")], "id long, v string")
    assert tuple(fingerprint.table_fingerprint(empty).first()) == (0, "0")
    assert tuple(diff.summary(empty, full, ["id"]).first()) == (0, 1, 0, 0)
    assert tuple(diff.multiset_difference(empty, empty).first()) == (0, 0)
    assert repair.repair_rows(full, empty, ["id"]).repaired.count() == 1


def test_null_keys_and_values(spark):
    a = spark.createDataFrame([(None, "x"), (1, None)], "id long, v string")
    b = spark.createDataFrame([(None, "x"), (1, "")], "id long, v string")
    assert rows(diff.classified(a, b, ["id"])) == [(1, "changed"), (None, "same")]


def test_extra_keys_beyond_the_source_are_found(spark):
    a, b = spark.range(10), spark.range(15)
    assert diff.differences(a, b, ["id"]).count() == 5
    assert rows(fingerprint.differing_chunks(a, b, "id", 10)) == [(1, 0, 5)]


def test_detect_repair_undo(spark):
    src = spark.range(500).select("id", (F.col("id") % 7).alias("v"))
    dst = src.where("id not in (3, 5)").withColumn("v", F.when(F.col("id") == 9, 99).otherwise(F.col("v"))).union(spark.createDataFrame([(901, 1)], "id long, v long"))
    assert tuple(diff.summary(src, dst, ["id"]).first())[:3] == (2, 1, 1)
    done = repair.repair_rows(src, dst, ["id"])
    assert diff.differences(src, done.repaired, ["id"]).isEmpty()
    assert diff.multiset_difference(repair.restore(done.repaired, done, ["id"]), dst).first() == (0, 0)
    kept = repair.repair_rows(src, dst, ["id"], repair.KEEP_TARGET).repaired
    assert rows(diff.differences(src, kept, ["id"])) == [(9, "changed")]


def test_sync_tool_guard():
    assert repair.sync_tool_fits(["id"], 1000)
    assert not repair.sync_tool_fits(["id"], 1001) and not repair.sync_tool_fits(["id"], 0) and not repair.sync_tool_fits(["a", "b"], 5)


def test_eight_hours(spark):
    src = spark.createDataFrame([(i, 25_200 + i) for i in range(6)], "id long, s long").select("id", F.timestamp_seconds("s").alias("ts"))
    dst = src.select("id", (F.col("ts") + F.expr("interval 8 hours")).alias("ts"))
    found = drift.time_shift(src, dst, ["id"], "ts").first()
    assert found["uniform"] and found["mean_s"] == 28800


def test_cutover(spark):
    schema = "db string, ts long, src_rows long, dst_rows long, src_tables map<string,long>"
    df = spark.createDataFrame([("a", 0, 10, 10, {"t": 10}), ("a", 1, 22, 22, {"t": 22}), ("a", 2, 22, 22, {"t": 22}), ("a", 3, 22, 22, {"t": 22})], schema)
    assert [r["verdict"] for r in watch.verdicts(df).orderBy("ts").collect()] == ["converging", "NOT SAFE", "converging", "SAFE"]
    assert rows(watch.hot_tables(df)) == [("a", 1, "t", 12)]


def test_change_log(spark):
    lines = spark.createDataFrame([("0/1A", "BEGIN 123"), ("0/1B", "table public.orders: UPDATE: id[bigint]:5 note[text]:'a b''c' amount[numeric]:1.50"), ("0/1F", "COMMIT 123")], "lsn string, line string")
    assert rows(delta.parse_changes(lines, {"public.orders": ["id"]})) == [("0/1B", "public.orders", "UPDATE", "5")]
    assert delta.parse_changes(lines, {"public.orders": ["note"]}).first()["key"] == "a b'c"


def test_cursor_moves_only_when_clean(spark, tmp_path):
    src, dst, log = str(tmp_path / "src"), str(tmp_path / "dst"), str(tmp_path / "log")
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "new")], "id long, v string").write.parquet(src)
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "old")], "id long, v string").write.parquet(dst)
    spark.createDataFrame([(3,), (1,)], "id long").write.parquet(log)
    changes = lambda: spark.readStream.schema("id long").parquet(log)
    verifier = delta.batch_verifier(lambda: spark.read.parquet(src), lambda: spark.read.parquet(dst), ["id"], str(tmp_path / "evidence"))
    cursor = str(tmp_path / "cursor")
    assert delta.verification_cycle(changes(), verifier, cursor) == (False, "missing=0 extra=0 changed=1")
    assert delta.verification_cycle(changes(), verifier, cursor)[0] is False
    spark.createDataFrame([(1, "a"), (2, "b"), (3, "new")], "id long, v string").write.mode("overwrite").parquet(dst)
    assert delta.verification_cycle(changes(), verifier, cursor) == (True, "clean")
    seen = []
    delta.start_verification(changes(), lambda batch, _: seen.append(batch.count()), cursor).awaitTermination()
    assert seen == []
    delta.teardown(cursor)
    assert delta.verification_cycle(changes(), verifier, cursor) == (True, "clean")


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute("create table t (id integer primary key autoincrement, v text, x real)")
        db.executemany("insert into t (v, x) values (?, ?)", [("a", 1.5), (None, None), ("", 2.0)])
    df = readers.read_sqlite(spark, Endpoint(options={"path": path}), "", "t")
    assert rows(df) == [(1, "a", 1.5), (2, None, None), (3, "", 2.0)]
    assert readers.sqlite_tables(path) == ["t"] and readers.sqlite_counters(path) == {"t": 3}
    with sqlite3.connect(path) as db:
        db.execute("create table e (id integer)")
    assert readers.read_sqlite(spark, Endpoint(options={"path": path}), "", "e").count() == 0


def test_check_of_a_pair_of_folders(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(100).select("id", F.lit("x").alias("v")).write.parquet(f"{a}/t.parquet")
    spark.range(99).select("id", F.when(F.col("id") == 7, "y").otherwise("x").alias("v")).write.parquet(f"{b}/t.parquet")
    pair = readers.bind(spark, Pair("p", "parquet", Endpoint(options={"path": a}), Endpoint(options={"path": b}), meta={"t": TableMeta(key=("id",))}))
    found = {r["check"]: r for r in checks.check(spark, pair).collect()}
    assert found["counts"]["status"] == "diff" and found["objects"]["status"] == "skip" and found["data"]["detail"] == "missing=1 extra=0 changed=1 columns=v" and found["schema"]["status"] == "ok"
    assert sinks.exit_status(checks.check(spark, pair)) == 1
    with pytest.raises(ValueError):
        Pair("q", "parquet").validate()


def test_csv_keeps_null_and_empty_apart(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,v\n1,""\n2,\\N\n3,x\n')
    df = readers.read_files(spark, Endpoint(options={"path": str(tmp_path)}), "", "t", "csv")
    assert rows(df.select("id", "v")) == [("1", ""), ("2", None), ("3", "x")]


def test_move_resumes(spark, tmp_path):
    src, out = spark.range(100), str(tmp_path / "out")
    done = sinks.MoveCheckpoint(str(tmp_path / "move.json"))

    def stop(n):
        if n == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        sinks.move_table(src, "id", out, done, "t", 30, stop)
    assert sinks.MoveCheckpoint(str(tmp_path / "move.json")).state["t"] == {"last": 59, "done": False}
    assert sinks.move_table(src, "id", out, sinks.MoveCheckpoint(str(tmp_path / "move.json")), "t", 30) == 2
    assert rows(spark.read.parquet(out).select("id")) == [(i,) for i in sorted(range(100), key=lambda i: str((i,)))]


def test_restore_points(spark, tmp_path):
    store = sinks.StateStore(spark, str(tmp_path))
    assert store.points("h").count() == 0
    store.save("h", "d", {"t": spark.range(3)}, "one")
    store.save("h", "d", {"t": spark.range(5)}, "two")
    newest = store.points("h").first()
    assert newest["tag"] == "two" and store.table("h", newest["ts"], "t").count() == 5


def test_movers():
    everything, nothing = (lambda p: True), (lambda p: False)
    assert [sinks.pick_mover(e, everything) for e in ("postgres", "mysql", "hetero", "mongodb", "redis")] == ["pgdump", "mydumper", "pgloader", "mongodump", "builtin"]
    assert sinks.pick_mover("postgres", everything, "x.y") == sinks.pick_mover("postgres", nothing) == "builtin"
    assert sinks.mover_supported("hetero", "debezium") and not sinks.mover_supported("mongodb", "debezium") and sinks.mover_supported("postgres", "builtin")


def test_configuration(tmp_path, monkeypatch):
    monkeypatch.setenv("SECRET_X", "s3")
    monkeypatch.setenv("CONCORD_EXCLUDE", "tmp_*")
    (tmp_path / "h.json").write_text('{"hops": {"a": {"engine": "postgres", "source": {"host": "s", "password": "env:SECRET_X"}, "target": {"host": "t", "port": 7}, "db_map": {"x": "y"}}}}')
    pair = load_pairs(str(tmp_path / "h.json"))["a"]
    assert pair.source.password == "s3" and pair.source.port == 5432 and pair.target.port == 7
    assert pair.target_db("x") == "y" and pair.side_db("src", "x") == "x" and pair.excluded("d", "tmp_1")


def test_command_line(spark, tmp_path, capsys):
    from concord import cli

    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.range(50).write.parquet(f"{a}/t.parquet")
    spark.range(40).write.parquet(f"{b}/t.parquet")
    config = tmp_path / "h.json"
    config.write_text(f'{{"hops": {{"p": {{"engine": "parquet", "source": {{"path": "{a}"}}, "target": {{"path": "{b}"}}, "options": {{"key": {{"t": ["id"]}}}}}}}}}}')
    base = ["--config", str(config), "--reports", str(tmp_path / "r")]
    assert cli.main([*base, "check", "p"]) == 1
    assert cli.main([*base, "check", "p", "--only", "schema", "--drill"]) == 1  # the other checks' results stay
    assert spark.read.parquet(str(tmp_path / "r/p/keys/table=t/kind=missing")).count() == 10
    assert cli.main([*base, "sample-diff", "p"]) == 1 and cli.main([*base, "sync", "p", "--kind", "schema"]) == 0 and cli.main([*base, "users", "p"]) == 1
    assert cli.main([*base, "check", "p", "--consistent", "--resume"]) == 1 and cli.main([*base, "monitor", "p", "--cycles", "2", "--interval", "0"]) == 1
    assert cli.main([*base, "sync", "p", "--go", "--tag", "one"]) == 0
    assert spark.read.parquet(str(tmp_path / "r/p/repaired/t")).count() == 50
    assert cli.main([*base, "rollback", "p", "--go"]) == 0
    assert spark.read.parquet(str(tmp_path / "r/p/restored/t")).count() == 40
    assert cli.main([*base, "move", "p", "--go", "--chunk", "20"]) == 0
    assert spark.read.parquet(str(tmp_path / "r/p/moved/t")).count() == 50
    assert cli.main([*base, "report", "p", "--metrics"]) == 0 and cli.main([*base, "history", "p"]) == 0 and cli.main([*base, "watch", "p"]) == 0 and cli.main([*base, "doctor"]) == 0 and cli.main([*base, "advise", "live"]) == 0
    assert "insert 10" in capsys.readouterr().out


def test_key_files_replace_stale_ones(spark, tmp_path):
    schema = "id long, kind string"
    sinks.write_keys(spark.createDataFrame([(1, "missing"), (2, "extra")], schema), str(tmp_path), "t")
    sinks.write_keys(spark.createDataFrame([(3, "extra")], schema), str(tmp_path), "t")
    assert rows(spark.read.parquet(str(tmp_path)).select("id", "kind")) == [(3, "extra")]


def test_critical_settings_decide(spark):
    schema = "name string, value string"
    src, dst = spark.createDataFrame([("timezone", "UTC"), ("x", "1")], schema), spark.createDataFrame([("timezone", "UTC"), ("x", "2")], schema)
    assert catalog.settings_status(catalog.settings_difference(src, dst, catalog.CRITICAL_SETTINGS["postgres"])).first()["status"] == "ok"
    assert catalog.settings_status(catalog.settings_difference(src, dst.withColumn("value", F.lit("3")), catalog.CRITICAL_SETTINGS["postgres"])).first()["status"] == "diff"
    assert len(catalog.CRITICAL_SETTINGS["postgres"]) == 21 and len(catalog.CRITICAL_SETTINGS["mysql"]) == 18 and not catalog.CRITICAL_SETTINGS["mssql"]


def test_dashboard(spark, tmp_path):
    from concord import dashboard
    from concord.model import result

    result(spark, "counts", "app", "ok", "a<b").write.json(str(tmp_path / "p/summary"))
    get = lambda path: dashboard.page(spark, str(tmp_path), ["p", "q"], path)
    assert "/report/p" in get("/")[2] and "/report/q" not in get("/")[2]
    assert '"all_clean": true' in get("/api/data")[2] and get("/metrics")[2].endswith("} 1\n")
    assert "a&lt;b" in get("/report/p")[2] and get("/report/q")[0] == 404
    held = dashboard.server(spark, str(tmp_path), ["p"], 0)
    assert held.server_address[0] == "127.0.0.1"
    held.server_close()


def test_lost_history_is_noticed():
    assert delta.history_kept("0/10", "0/1F") and delta.history_kept("0/FF", "1/0") and not delta.history_kept("1/0", "0/FF")


def test_the_names_pair_covers_every_customer(spark, sf_dir):
    from concord.fixtures import pair

    names, customers = pair(spark, sf_dir, "names"), pair(spark, sf_dir, "customer").count()
    assert names.count() == names.select("id").distinct().count() == 2 * customers
    for collation in (None, "UTF8_LCASE"):
        assert drift.collapsing(names, "name", collation).agg(F.sum("n")).first()[0] == 2 * customers


def test_names_that_collide_when_case_is_ignored(spark):
    names = ("BUILDING", "MACHINERY", "BUILDING", "HOUSEHOLD", "FURNITURE")
    df = spark.createDataFrame([*enumerate(names), *[(100 + i, n.lower()) for i, n in enumerate(names)], (200, "only"), (201, None), (202, None)], "id long, name string")
    assert rows(drift.collapsing(df, "name")) == [("building", 4), ("furniture", 2), ("household", 2), ("machinery", 2)]
