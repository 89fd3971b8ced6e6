"""A check must never call two sides equal that are not: repeated and null keys, exact doubles, forged texts, unread pairs."""

import duckdb
import pytest
from pyspark.sql import functions as F

from concord.functions.canon import key_text, row_hash
from concord.functions.ddl import convert
from concord.model import Endpoint, Pair, TableMeta, secret
from concord.operators import diff, drift, fingerprint, repair, stores
from concord.plans import checks
from concord.sources import catalogs, readers, sinks

KV = "id long, v string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def pair_of(spark, sides, **meta):
    """A pair held in memory, under a key for each table."""
    return Pair("p", "parquet", Endpoint(host="a"), Endpoint(host="b"), tables=tuple(sides), meta={t: TableMeta(key=("id",), **meta) for t in sides}, read=lambda side, t: sides[t][side == "dst"])


def test_repeated_keys_are_not_settled(spark):
    src, dst = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], KV), spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], KV)
    assert rows(diff.classified(src, dst, ["id"])) == [(1, "changed"), (2, "changed")]
    found = {r["check"]: r for r in checks.check(spark, pair_of(spark, {"t": (src, dst)}), ("counts", "data")).collect()}
    assert found["counts"]["status"] == "ok" and found["data"]["status"] == "diff"


def test_many_null_keys_are_one_key(spark):
    src, dst = (spark.createDataFrame([(None, v)] * 300, KV) for v in "ab")
    assert rows(diff.classified(src, dst, ["id"])) == [(None, "changed")]
    assert rows(diff.column_drift(src, dst, ["id"])) == [("v", 1)]
    done = repair.repair_rows(src, dst, ["id"])
    assert diff.multiset_difference(done.repaired, src).first() == (0, 0)
    assert diff.multiset_difference(repair.restore(done.repaired, done, ["id"]), dst).first() == (0, 0)


def test_doubles_are_exact_unless_rounded(spark):
    side = lambda x: spark.createDataFrame([(1, x)], "id long, x double")
    for a, b in ((1e-7, 3e-7), (5.0, 5.0000001), (0.1 + 0.2, 0.3)):
        assert diff.summary(side(a), side(b), ["id"]).first()["changed"] == 1
        assert diff.summary(side(a), side(b), ["id"], scale=6).first()["same"] == 1
    assert side(0.0).select(row_hash(side(0.0))).first() == side(-0.0).select(row_hash(side(-0.0))).first()


def test_sample_compare_joins_typed_keys(spark):
    src, dst = spark.createDataFrame([("", "x")], "id string, v string"), spark.createDataFrame([(None, "y")], "id string, v string")
    assert diff.sample_compare(src, dst, ["id"]).count() == 0
    keys = spark.createDataFrame([("a\tb", "c"), ("a", "b\tc"), (None, ""), ("", None), ("\\N", "")], "x string, y string")
    assert keys.select(key_text(keys, ["x", "y"])).distinct().count() == 5


def test_texts_of_logs_and_entries_cannot_be_forged(spark):
    log = lambda k, v: stores.log_tail(spark.createDataFrame([("t", 0, 1, k, v)], "topic string, part int, off long, key string, v string")).first()["digest"]
    assert log("k|v", "x") != log("k", "v|x") and log(None, "x") != log("~", "x")
    entry = "key string, type string, str string, hash map<string,string>, items array<string>, scores map<string,double>"
    kinds = lambda a, b: rows(stores.entries_difference(spark.createDataFrame([a], entry), spark.createDataFrame([b], entry)))
    assert kinds(("s", "set", None, None, ["a,b"], None), ("s", "set", None, None, ["a", "b"], None)) == [("s", "changed")]
    assert kinds(("h", "hash", None, {"a": "1,b=2"}, None, None), ("h", "hash", None, {"a": "1", "b": "2"}, None, None)) == [("h", "changed")]


def test_documents_that_are_no_json(spark):
    docs = lambda *x: spark.createDataFrame(list(x), "id long, doc string")
    assert rows(stores.documents_difference(docs((1, "{broken"), (2, "{broken")), docs((1, "{broken"), (2, "{other")))) == [(2, "changed")]
    assert rows(stores.documents_difference(docs((1, None)), docs())) == [(1, "missing")]
    assert rows(stores.documents_difference(docs((1, '{"a": 1, "b": 2}')), docs((1, '{"b":2,"a":1}')))) == []


def test_binary_checksum_sees_where_a_null_is(spark):
    a, b = (spark.createDataFrame([r], "x int, y int") for r in ((1, None), (None, 1)))
    assert fingerprint.binary_checksum(a).first() != fingerprint.binary_checksum(b).first()


def test_metric_labels_are_escaped(spark):
    from concord.model import result

    assert sinks.metrics(result(spark, "data", 'a"b\\c\nd', "ok", ""), "p").first()["line"] == 'concord_check_ok{pair="p",check="data",scope="a\\"b\\\\c\\nd"} 1'


def test_a_pair_without_tables_is_an_error(spark, tmp_path):
    ends = [Endpoint(options={"path": str(tmp_path / x)}) for x in "ab"]
    found = checks.check(spark, readers.bind(spark, Pair("p", "parquet", *ends)))
    assert found.where("status = 'error'").count() == 1 and sinks.exit_status(found) == 1
    with pytest.raises(ValueError):
        readers.list_tables(spark, Endpoint(host="h"), "kafka")


def test_a_dropped_column_or_table_is_a_difference(spark, tmp_path):
    spark.range(5).select("id", F.lit(1).alias("v")).write.parquet(str(tmp_path / "a/t.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "a/gone.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "b/t.parquet"))
    spark.range(5).write.parquet(str(tmp_path / "b/new.parquet"))
    pair = readers.bind(spark, Pair("p", "parquet", *[Endpoint(options={"path": str(tmp_path / x)}) for x in "ab"], meta={"t": TableMeta(key=("id",))}))
    found = {(r["check"], r["scope"]): r["status"] for r in checks.check(spark, pair, ("data",)).collect()}
    assert found["data", "t"] == found["schema", "gone"] == found["schema", "new"] == "diff"


def test_a_locked_pair_is_refused(spark, tmp_path):
    with sinks.Lock(spark, str(tmp_path / "lock")):
        with pytest.raises(RuntimeError), sinks.Lock(spark, str(tmp_path / "lock")):
            pass
    with sinks.Lock(spark, str(tmp_path / "lock")):
        pass


def test_move_state_on_any_file_system(spark, tmp_path):
    state = sinks.MoveCheckpoint(str(tmp_path / "m.json"), spark)
    state.save("t", 5, False)
    assert sinks.MoveCheckpoint(str(tmp_path / "m.json"), spark).state == sinks.MoveCheckpoint(str(tmp_path / "m.json")).state == {"t": {"last": 5, "done": False}}


def test_catalog_queries_over_information_schema(spark):
    db = duckdb.connect()
    db.execute("create table orders (id int primary key, code varchar unique, v int); create table pairs (a int, b int, primary key (b, a)); create table plain (x int); create view w as select * from orders")
    read = lambda end, database, sql: spark.createDataFrame(db.sql(sql).df().astype(str)) if db.sql(sql).fetchall() else spark.createDataFrame([], "name string")
    assert catalogs.table_names(read, Endpoint(), "", "postgres") == ["main.orders", "main.pairs", "main.plain"]
    found = catalogs.table_meta(read, Endpoint(), "", "postgres")
    assert found["main.orders"].key == ("id",) and found["main.orders"].unique == (("code",),) and set(found["main.pairs"].key) == {"a", "b"} and "main.plain" not in found
    columns = catalogs.facts(spark, read, Endpoint(), "", "postgres", "columns")
    assert columns.where("table_name = 'main.orders'").count() == 3
    assert catalogs.facts(spark, read, Endpoint(), "", "mysql", "extensions") is None


def test_live_tables_are_read_in_ranges(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(readers, "read_query", lambda s, end, d, kind, sql: spark.createDataFrame([(5, 4_000_004)], "low long, high long"))
    monkeypatch.setattr(readers, "read_jdbc", lambda s, end, d, t, kind, key=None, bounds=None, n=1: seen.update(key=key, bounds=bounds, n=n))
    readers.read_by_key(spark, Endpoint(), "d", "t", "postgres", ("id",), 1_000_000, 4)
    assert seen == {"key": "id", "bounds": (5, 4_000_005), "n": 4}
    readers.read_by_key(spark, Endpoint(), "d", "t", "postgres", ("a", "b"), 1_000_000, 4)
    assert seen["key"] is None


def test_sqlite_pair_with_its_catalog(spark, tmp_path):
    import sqlite3

    for name, counter in (("a", 9), ("b", 2)):
        with sqlite3.connect(tmp_path / f"{name}.db") as db:
            db.execute("create table p (id integer primary key autoincrement, v text)")
            db.execute("create table c (id integer primary key, p integer references p(id))")
            db.executemany("insert into p (v) values (?)", [("x",)] * 3)
            db.execute("insert into c values (1, ?)", (1 if name == "a" else 77,))
            db.execute("update sqlite_sequence set seq = ?", (counter,))
    pair = readers.bind(spark, Pair("p", "sqlite", *[Endpoint(options={"path": str(tmp_path / f"{x}.db")}) for x in "ab"]))
    assert pair.meta["p"].key == ("id",) and pair.meta["c"].foreign == ((("p",), "p", ("id",)),)
    found = {(r["check"], r["scope"]): r["status"] for r in checks.check(spark, pair).collect()}
    assert found["deep", "c fk"] == "diff" and found["data", "c"] == "diff" and found["data", "p"] == "ok"
    assert found["autoinc", "p"] == "diff" and found["objects", "p table"] == "ok" and found["params", "p"] == "ok"


def test_the_deep_suite_runs_in_a_check(spark):
    src = spark.range(40).select("id", F.timestamp_seconds(F.col("id") * 10).alias("at"), (F.col("id") * 1.5).alias("x"), F.concat(F.lit("N"), F.col("id")).alias("name"), F.col("id").cast("decimal(12,4)").alias("price"), (F.col("id") * 2).alias("twice"))
    dst = src.select("id", (F.col("at") + F.expr("interval 7 hours")).alias("at"), (F.col("x") * (1 + 1e-6)).alias("x"), "name", F.col("price").cast("decimal(12,2)").alias("price"), F.when(F.col("id") == 3, 0).otherwise(F.col("twice")).alias("twice"))
    dst = dst.union(dst.where("id = 5")).union(dst.where("id = 39").withColumn("id", F.lit(99).cast("long")))
    meta = {"checks": {"small": "id < 50"}, "generated": {"twice": "id * 2"}, "partition_column": "id", "partition_bounds": ((0, 90),), "unique": (("name",),)}
    clean = {r["scope"] for r in checks.check(spark, pair_of(spark, {"t": (src, src)}, **meta), ("deep",)).collect() if r["status"] != "ok"}
    assert clean == set()
    found = {r["scope"] for r in checks.check(spark, pair_of(spark, {"t": (src, dst)}, **meta), ("deep",)).collect() if r["status"] == "diff"}
    assert found == {"t duplicates", "t narrowing", "t boundary", "t checks", "t generated", "t partitions"}
    found = {r["scope"] for r in checks.check(spark, pair_of(spark, {"t": (src, dst.where("id < 40").dropDuplicates(["id"]))}), ("deep",)).collect() if r["status"] == "diff"}
    assert found == {"t narrowing", "t timeshift", "t float"}


def test_repeated_keys_of_a_hot_key_do_not_pair_up(spark):
    many = spark.range(3000).select(F.lit(1).alias("id"), F.lit("x").alias("v"))
    assert drift.repeated_keys(many, ["id"]) == 1
    assert diff.summary(many, many, ["id"]).first() == (0, 0, 0, 1)


def test_secret_of_a_vault(monkeypatch):
    import io
    import urllib.request

    monkeypatch.setenv("VAULT_ADDR", "http://vault")
    asked = []
    monkeypatch.setattr(urllib.request, "urlopen", lambda r, timeout: (asked.append(r.full_url), io.BytesIO(b'{"data": {"data": {"password": "s"}}}'))[1])
    assert secret("vault:secret/data/db#password") == "s" and asked == ["http://vault/v1/secret/data/db"]


def test_definitions_of_the_other_dialect():
    assert convert("create table t (a mediumint unsigned, b bigint unsigned auto_increment, c bit(1) default '0', d varbinary(16), e set('x'), key (a))") == "CREATE TABLE t (a integer, b bigint GENERATED BY DEFAULT AS IDENTITY, c boolean default false, d bytea, e text);\nCREATE INDEX ON t (a)"
    assert "numeric(20, 0)" in convert("create table t (b bigint unsigned)") and "CHECK" not in convert("create table t (b int)")
    assert convert("create table t (v varchar(10) comment 'a, b) c' not null) engine=x comment='; y'") == "CREATE TABLE t (v varchar(10) not null)"
    assert convert("create table t (f float, g double precision, n datetime(3) not null default current_timestamp(3) on update current_timestamp(3))") == "CREATE TABLE t (f real, g double precision, n timestamp(3) not null default current_timestamp(3))"


def test_commands_of_movers_and_replication(monkeypatch, tmp_path):
    from concord.sources import tools

    ends = [Endpoint(h, 5432, "u", "p4ss", {}) for h in "ab"]
    pair = Pair("p", "postgres", *ends, db_map={"x": "y"})
    dump, restore = tools.move_commands(pair, "x", "pgdump")
    assert dump[0] == "pg_dump" and dump[-1] == "x" and "--dbname=y" in restore
    texts = [str(tools.move_commands(pair, "x", v)) for v in ("pgdump", "mydumper", "pgloader", "mongodump")] + [str(tools.replication_statements(pair, "x"))]
    assert not any("p4ss" in x for x in texts)
    with pytest.raises(ValueError):
        tools.move_commands(pair, "x", "builtin")
    program = tmp_path / "pg_dump"
    program.write_text("")
    program.chmod(0o755)
    monkeypatch.setenv("CONCORD_TOOLS", str(tmp_path))
    assert tools.inventory("postgres")["pg_dump"] == str(program) and set(tools.inventory()) > {"mydumper"}


def test_a_move_into_a_live_table_clears_what_it_writes(spark, tmp_path):
    live: dict[int, int] = {3: 0}
    state = sinks.MoveCheckpoint(str(tmp_path / "m.json"))
    clear = lambda last, to: [live.pop(k) for k in list(live) if last < k <= to]
    write = lambda df, end, url, table: [live.__setitem__(r["id"], 1) for r in df.collect()]
    assert sinks.move_into(spark.range(10), "id", None, "", "t", state, 4, clear, write) == 3
    assert live == dict.fromkeys(range(10), 1) and state.state["t"]["done"]


def test_windows_of_changes(spark):
    from concord.streaming import delta

    changes = spark.createDataFrame([(f"0/{i:X}", "t", "INSERT", str(i)) for i in range(30)], "lsn string, table string, op string, key string")
    first, more = delta.window(changes, 20)
    assert more and {r["key"] for r in first.collect()} == {str(i) for i in range(20)} and not delta.window(changes, 30)[1]
    assert delta.unsupported(spark, "redis", "db0").first()["status"] == "error"


def test_lines_that_a_pair_ignores(spark):
    from concord.functions.text import ignored

    lines = spark.createDataFrame([("-- comment",), ("OWNER TO x",), ("a int",)], "line string")
    assert rows(lines.where(~ignored(F.col("line"), ["^--", "# not this: a int", "OWNER"]))) == [("a int",)]


def test_catalogs_of_an_export(spark, tmp_path):
    for side, kind in (("a", "varchar"), ("b", "text")):
        spark.range(3).write.parquet(str(tmp_path / side / "t.parquet"))
        facts = [("t", "c", kind, "YES", None, 100 if side == "a" else 50, None, None)]
        spark.createDataFrame(facts, "table_name string, column_name string, type string, is_nullable string, column_default string, char_length long, num_precision long, num_scale long").write.option("ignoreNullFields", "false").json(str(tmp_path / side / "_catalog/columns.json"))
        spark.createDataFrame([("app", "t", "SELECT")] if side == "a" else [("ro", "t", "SELECT")], "grantee string, object string, privilege string").write.json(str(tmp_path / side / "_catalog/grants.json"))
    pair = readers.bind(spark, Pair("p", "parquet", *[Endpoint(options={"path": str(tmp_path / x)}) for x in "ab"], meta={"t": TableMeta(key=("id",))}))
    found = {r["scope"]: r["detail"] for r in checks.check(spark, pair, ("deep",)).collect() if r["status"] == "diff"}
    assert found == {"p narrowing": "t.c: char 100 -> 50", "p columns": "t.c type: varchar -> text", "p grants": "app: 1 permissions missing"}
