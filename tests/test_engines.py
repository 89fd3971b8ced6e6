"""Nested values, types that meet, dialects and statements of several engines."""

import random
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions import dialects
from concord.functions.canon import row_hash, text_of
from concord.model import Endpoint, Pair, TableMeta
from concord.operators import align, catalog, diff, drift, fingerprint, repair
from concord.plans import checks
from concord.sources import catalogs, pushdown, readers


def same(spark, a, b, kind_a, kind_b=None):
    """Whether two values of a column hash alike."""
    left, right = spark.createDataFrame([(a,)], f"v {kind_a}"), spark.createDataFrame([(b,)], f"v {kind_b or kind_a}")
    return left.select(row_hash(left)).first() == right.select(row_hash(right)).first()


def check_pair(spark, src, dst, engine="parquet", key=("id",), name="t"):
    two = Pair("p", engine, Endpoint(host="a"), Endpoint(host="b"), tables=(name,), meta={name: TableMeta(key=key)}, read=lambda side, _: src if side == "src" else dst)
    return {r["check"]: (r["status"], r["detail"]) for r in checks.check(spark, two, ("schema", "counts", "data")).collect()}


# ---- nested values


def test_times_in_arrays_keep_their_microseconds(spark):
    t = lambda s: f"array(timestamp'2020-01-01 00:00:00.{s}')"
    src, dst = (spark.sql(f"select 1 as id, {t(s)} as v") for s in ("000001", "000002"))
    assert check_pair(spark, src, dst)["data"][0] == "diff"
    assert check_pair(spark, src, src)["data"][0] == "ok"
    deep, deeper = (spark.sql(f"select 1 as id, named_struct('a', map('k', {t(s)})) as v") for s in ("000001", "000002"))
    assert check_pair(spark, deep, deeper)["data"][0] == "diff"


def test_maps_have_no_order_and_arrays_have(spark):
    assert same(spark, {"a": 1, "b": 2}, {"b": 2, "a": 1}, "map<string,int>")
    assert not same(spark, {"a": 1, "b": 2}, {"a": 2, "b": 1}, "map<string,int>")
    assert not same(spark, [1, 2], [2, 1], "array<int>")
    assert not same(spark, {"a": None}, {}, "map<string,int>")


def test_nested_texts_cannot_be_forged(spark):
    assert not same(spark, ["1"], '["1"]', "array<string>", "string")
    assert not same(spark, ["1"], "[1:1]", "array<string>", "string")
    assert not same(spark, ["a", "b"], ["a1:b"], "array<string>")
    assert not same(spark, [None], ["~"], "array<string>")
    assert not same(spark, [], None, "array<string>")
    assert not same(spark, ({"x": 1},), ({"y": 1},), "struct<m:map<string,int>>")
    assert not same(spark, (1, None), (None, 1), "struct<a:int,b:int>")


def test_columns_of_nested_types_drift_by_column(spark):
    src = spark.createDataFrame([(1, ["1"], "x")], "id int, v array<string>, w string")
    dst = spark.createDataFrame([(1, "[1:1]", "x")], "id int, v string, w string")
    assert [r["column"] for r in diff.column_drift(src, dst, ["id"]).collect()] == ["v"]


def test_variants(spark):
    one, other = (spark.sql(f"select parse_json('{x}') as v") for x in ('{"b": 1, "a": [1, 2]}', '{"a": [1,2], "b": 1}'))
    text = lambda df: df.select(text_of(F.col("v"), df.schema["v"].dataType)).first()[0]
    assert text(one) == text(other)


# ---- two engines


@pytest.mark.parametrize(
    ("a", "b", "meeting"),
    [
        ("int", "bigint", "bigint"), ("boolean", "tinyint", "bigint"), ("decimal(10,2)", "decimal(12,4)", "decimal(12,4)"), ("int", "decimal(5,2)", "decimal(12,2)"), ("decimal(10,2)", "double", "double"),
        ("float", "double", "float"), ("date", "timestamp", "timestamp"), ("array<int>", "array<bigint>", "array<bigint>"), ("map<string,int>", "map<string,double>", "map<string,double>"), ("decimal(38,0)", "decimal(10,5)", "decimal(38,0)"),
    ],
)
def test_types_meet(a, b, meeting):
    kind = lambda x: T._parse_datatype_string(x)
    assert align.meet(kind(a), kind(b)).simpleString() == align.meet(kind(b), kind(a)).simpleString() == meeting


def test_a_pair_of_two_engines_is_equal(spark):
    src = spark.sql("select 1 as id, cast(0.10 as decimal(10,2)) as price, true as flag, date'2020-01-02' as day, '17' as n, array(1, 2) as parts, named_struct('a', 1) as rec union all select 2, null, false, null, null, null, null")
    dst = spark.sql("select 1 as ID, cast(0.1 as double) as Price, cast(1 as tinyint) as flag, timestamp'2020-01-02 00:00:00' as day, 17 as n, array(1L, 2L) as parts, '{\"a\":1}' as rec union all select 2, null, cast(0 as tinyint), null, null, null, null")
    found = check_pair(spark, src, dst, "hetero")
    assert {k: v[0] for k, v in found.items()} == {"schema": "ok", "counts": "ok", "data": "ok"}, found


@pytest.mark.parametrize("change", ["cast(0.11 as double) as price", "cast(0 as tinyint) as flag", "timestamp'2020-01-02 00:00:01' as day", "'17x' as n"])
def test_a_pair_of_two_engines_differs(spark, change):
    src = spark.sql("select 1 as id, cast(0.10 as decimal(10,2)) as price, true as flag, date'2020-01-02' as day, 17 as n")
    same = {"price": "cast(0.1 as double) as price", "flag": "cast(1 as tinyint) as flag", "day": "timestamp'2020-01-02' as day", "n": "'17' as n"}
    name = change.split(" as ")[-1]
    dst = spark.sql("select 1 as id, " + ", ".join((same | {name: change}).values()))
    assert check_pair(spark, src, dst, "hetero")["data"] == ("diff", f"missing=0 extra=0 changed=1 columns={name}")


def test_names_resolve():
    assert align.resolve(["public.orders", "sales.items", "B"], ["orders", "dbo.Sales.items", "b", "c"]) == {"public.orders": "orders", "B": "b"}
    assert align.resolve(["orders", "public.orders"], ["dbo.orders"]) == {}  # which of the two is not known
    assert align.matches(["id", "Name", "x", "X"], ["ID", "name", "x"]) == {"x": "x", "id": "ID", "Name": "name"}


def test_columns_with_dots_and_in_another_case(spark):
    src = spark.createDataFrame([(1, "a", 2)], "`the.id` int, `b.c` string, N int")
    dst = spark.createDataFrame([(1, "b", 2)], "`the.id` int, `b.c` string, n int")
    found = check_pair(spark, src, dst, key=("the.id",))
    assert found["data"] == ("diff", "missing=0 extra=0 changed=1 columns=b.c")
    assert found["schema"][0] == "diff"
    assert check_pair(spark, src, src, key=("the.id",))["data"][0] == "ok"


# ---- statements


def test_counter_statements_by_engine():
    s = dialects.counter_statements
    assert s("postgres", "public.s", 9) == ["SELECT setval('\"public\".\"s\"', 9, true)"]
    assert s("postgres", "public.s", 1, False) == ["SELECT setval('\"public\".\"s\"', 1, false)"]
    assert s("mysql", "t", 9) == ["ALTER TABLE `t` AUTO_INCREMENT = 9"]
    assert s("mssql", "dbo.t", 9) == ["DBCC CHECKIDENT ('[dbo].[t]', RESEED, 9)"]


def test_counter_plan_is_undone_exactly_on_sqlite(spark, tmp_path):
    with sqlite3.connect(tmp_path / "t.db") as db:
        db.executescript("create table a (id integer primary key autoincrement); create table b (id integer primary key autoincrement); insert into a values (5); delete from a;")
        before = sorted(db.execute("select * from sqlite_sequence"))
        counters = "table string, last_value long, increment long, is_called boolean, owned boolean"
        src = spark.createDataFrame([("a", 40, 1, True, True), ("b", 7, 1, True, True)], counters)
        dst = spark.createDataFrame([("a", 5, 1, True, True), ("b", 0, 1, False, True)], counters)
        actions = repair.sequence_actions(repair.sequence_repair(src, dst, spark.createDataFrame([], "table string, high long"), "sqlite"), "sqlite")
        for action in actions:
            for statement in action["statements"]:
                db.execute(statement)
        assert sorted(db.execute("select * from sqlite_sequence")) == [("a", 40), ("b", 7)]
        for action in reversed(actions):
            for statement in action["undo"]:
                db.execute(statement)
        assert sorted(db.execute("select * from sqlite_sequence")) == before


def test_refused_counters_are_said(spark):
    counters = "table string, last_value long, increment long, is_called boolean, owned boolean"
    src, dst = (spark.createDataFrame([("a", v, 1, True, True)], counters) for v in (10, 3))
    plan = repair.sequence_repair(src, dst, spark.createDataFrame([("a", 99)], "table string, high long"))
    assert [(a["statements"], a["note"][:7]) for a in repair.sequence_actions(plan)] == [([], "REFUSED")]


def test_columns_are_added_in_the_engines_own_types():
    names = {e: dialects.add_column(e, "s.t", 'odd"name', T.StringType())[0] for e in ("postgres", "mysql", "mssql", "sqlite")}
    assert names == {"postgres": 'ALTER TABLE "s"."t" ADD COLUMN "odd""name" text', "mysql": "ALTER TABLE `s`.`t` ADD COLUMN `odd\"name` longtext", "mssql": 'ALTER TABLE [s].[t] ADD [odd"name] nvarchar(max)', "sqlite": 'ALTER TABLE "s"."t" ADD COLUMN "odd""name" TEXT'}
    assert dialects.add_column("postgres", "t", "at", T.TimestampType()) == ('ALTER TABLE "t" ADD COLUMN "at" timestamptz', 'ALTER TABLE "t" DROP COLUMN "at"')
    assert dialects.add_column("postgres", "t", "c", "varchar(20)")[0].endswith('"c" varchar(20)')
    assert dialects.dialect("mysql").type_of(T.DecimalType(10, 2)) == "decimal(10,2)"


# ---- partitions by interval join


def test_stranded_rows_of_many_ranges(spark):
    rng = random.Random(2)
    bounds = [(k, k + rng.randint(0, 12)) for k in rng.sample(range(0, 200_000), 10_000)]
    df = spark.range(-50, 200_100)
    held = set()
    for low, high in bounds:
        held.update(range(low, high))
    found = drift.stranded(df, "id", bounds)
    assert {r["id"] for r in found.collect()} == set(range(-50, 200_100)) - held
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_stranded_dates_texts_and_nulls(spark):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-10')) as d union all select null")
    assert [str(r["d"]) for r in drift.stranded(days, "d", [("2024-01-02", "2024-01-05"), ("2024-01-04", "2024-01-10")]).orderBy("d").collect()] == ["None", "2024-01-01", "2024-01-10"]
    names = spark.createDataFrame([("a",), ("m",), (None,)], "n string")
    assert [r["n"] for r in drift.stranded(names, "n", [("a", "c")]).orderBy("n").collect()] == [None, "m"]
    assert drift.stranded(names, "n", []).count() == 3


# ---- fingerprints by the engine itself


def test_doubles_read_alike_in_duckdb(spark):
    rng = random.Random(4)
    values = [0.0, -0.0, 1.0, -1.5, 1e7, 9999999.0, 12345678.9, 1e-3, 9.99e-4, 1e21, 1.5e300, -2.5e-9, 100.0, float("nan"), float("inf"), float("-inf")]
    values += [rng.uniform(-1, 1) * 10 ** rng.randint(-12, 14) for _ in range(400)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double")
    want = {r[0]: r[1] for r in df.select("id", text_of(F.col("v"), T.DoubleType())).collect()}
    db = duckdb.connect()
    db.sql("create table t (id int, v double)")
    db.executemany("insert into t values (?, ?)", [(i, v) for i, v in enumerate(values)])
    got = dict(db.sql(f"select id, {dialects.DUCKDB.text('v', T.DoubleType())} from t").fetchall())
    assert {i: (want[i], got[i]) for i in want if want[i] != got[i]} == {}


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@pytest.fixture(scope="module")
def orders_db(tmp_path_factory):
    """Two SQLite files of orders: the second lacks a row, has one more and two changed ones, all close together."""
    folder = tmp_path_factory.mktemp("db")
    rows = duckdb.sql(f"select {', '.join(ORDERS)} from '/root/testdata/sf0.01/orders.parquet'").fetchall()
    paths = [str(folder / n) for n in ("a.db", "b.db")]
    for path in paths:
        with sqlite3.connect(path) as db:
            db.execute("create table orders (o_orderkey integer primary key, o_custkey integer, o_orderstatus text, o_totalprice real, o_orderpriority text)")
            db.executemany("insert into orders values (?, ?, ?, ?, ?)", rows)
            db.execute("create table plain (k integer primary key, v text) without rowid")
            db.executemany("insert into plain values (?, ?)", [(i, f"v{i}") for i in range(50)])
    keys = sorted(r[0] for r in rows)
    mid = keys[len(keys) // 2 : len(keys) // 2 + 4]
    with sqlite3.connect(paths[1]) as db:
        db.execute("delete from orders where o_orderkey = ?", (mid[0],))
        db.execute("update orders set o_totalprice = o_totalprice + 1 where o_orderkey in (?, ?)", mid[1:3])
        db.execute("insert into orders values (?, 1, 'O', 1.5, null)", (keys[-1] + 7,))
    return paths, mid, keys


def _sqlite_pair(spark, paths, **options):
    return readers.bind(spark, Pair("lite", "sqlite", Endpoint(options={"path": paths[0]}), Endpoint(options={"path": paths[1]}), options=options))


def test_sqlite_sums_itself_as_spark_does(spark, orders_db):
    paths, _, _ = orders_db
    bound = _sqlite_pair(spark, paths)
    side = bound.push("src", "orders", "o_orderkey")
    frame = pushdown.FrameSide(bound.table("src", "orders"), "o_orderkey")
    assert side.expressible() and side.bounds() == frame.bounds()
    assert side.fingerprints(1000, -5, None) == frame.fingerprints(1000, -5, None)
    assert side.fingerprints(64, 0, [(0, 640), (1280, 1344)]) == frame.fingerprints(64, 0, [(0, 640), (1280, 1344)])


def test_descent_reads_near_the_damage(spark, orders_db):
    paths, mid, keys = orders_db
    bound = _sqlite_pair(spark, paths)
    sides = [bound.push(s, "orders", "o_orderkey") for s in ("src", "dst")]
    found = pushdown.descend(*sides, leaf_rows=50)
    assert found.rows_to_read <= 4 * 50 and found.levels > 2
    kinds = {r["o_orderkey"]: r["kind"] for r in pushdown.differences(*sides, "o_orderkey", leaf_rows=50).collect()}
    want = diff.differences(bound.table("src", "orders"), bound.table("dst", "orders"), ["o_orderkey"])
    assert kinds == {r["o_orderkey"]: r["kind"] for r in want.collect()} == {mid[0]: "missing", mid[1]: "changed", mid[2]: "changed", keys[-1] + 7: "extra"}
    few = pushdown.descend(*sides, leaf_rows=5, max_ranges=1)  # stops early, with wider ranges
    assert few.rows_to_read >= found.rows_to_read or len(few.ranges) <= 2


def test_check_of_sqlite_files_reads_damaged_ranges_only(spark, orders_db):
    paths, _, _ = orders_db
    bound = _sqlite_pair(spark, paths)
    found = {(r["check"], r["scope"]): (r["status"], r["detail"]) for r in checks.check(spark, bound, ("counts", "data")).collect()}
    status, detail = found["data", "orders"]
    assert status == "diff" and detail.startswith("missing=1 extra=1 changed=2 columns=o_totalprice (of 15000 rows, ")
    assert int(detail.split(" rows, ")[1].split(" ")[0]) < 6000
    assert found["counts", "orders"][0] == "ok" and found["data", "plain"][0] == found["counts", "plain"][0] == "ok"


def test_descent_over_nulls_repeats_and_nothing(spark):
    side = lambda rows: pushdown.FrameSide(spark.createDataFrame(rows, "k long, v string"), "k")
    rows = [(i % 700, f"v{i}") for i in range(2000)] + [(None, "n"), (-5, "m")]
    equal = pushdown.descend(side(rows), side(rows[::-1]))
    assert equal.equal and equal.rows_to_read == 0 and equal.n == (2002, 2002)
    other = [*rows[:-2], (None, "N"), (-5, "m"), (10_000, "x")]
    kinds = {r["k"]: r["kind"] for r in pushdown.differences(side(rows), side(other), "k", leaf_rows=10).collect()}
    assert {k: v for k, v in kinds.items() if v != "same"} == {None: "changed", 10_000: "extra"}
    assert pushdown.descend(side([]), side([])).equal
    assert not pushdown.descend(side([(1, "a")]), side([])).equal


def test_ranges_are_joined_and_grouped():
    assert pushdown.joined([(0, 4), (4, 8), (9, 10)]) == [(0, 8), (9, 10)]
    assert pushdown.grouped([(0, 1), (2, 3), (10, 11), (12, 13)], 2) == [(0, 3), (10, 13)]


def test_fingerprint_statements_of_other_engines():
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("na me", T.StringType()), T.StructField("at", T.TimestampType()), T.StructField("d", T.DecimalType(10, 2))])
    for engine in ("postgres", "mysql"):
        sql = pushdown.fingerprint_sql(dialects.dialect(engine), "s.t", schema, "id", 1000, 5, [(5, 10)])
        assert dialects.dialect(engine).column("na me") in sql and "group by chunk" in sql
    assert "[id]" in pushdown.fingerprint_sql(dialects.MSSQL, "t", T.StructType([schema["id"], schema["at"], schema["d"]]), "id", 1000)
    with pytest.raises(dialects.NotExpressible):
        dialects.MSSQL.row_md5(schema)  # whose texts are hashed in another encoding
    with pytest.raises(dialects.NotExpressible):
        dialects.MYSQL.row_md5(T.StructType([T.StructField("x", T.DoubleType())]))


def test_sqlite_columns_that_hold_other_values(spark, tmp_path):
    with sqlite3.connect(tmp_path / "m.db") as db:
        db.executescript("create table m (id integer primary key, a integer, b real, c text); insert into m values (1, 'x', 2, 'y'), (2, 5, 2.5, null);")
    df = readers.read_sqlite(spark, Endpoint(options={"path": str(tmp_path / "m.db")}), "", "m")
    assert dict(df.dtypes) == {"id": "bigint", "a": "string", "b": "double", "c": "string"}
    assert sorted(map(tuple, df.collect())) == [(1, "x", 2.0, "y"), (2, "5", 2.5, None)]


def test_doubles_in_the_canonical_form(spark):
    rng = random.Random(9)
    values = [0.0, -0.0, 1e7, 1e-3, 9.99e-4, 1.7976931348623157e308, 100.0, -123456.75] + [rng.uniform(-1, 1) * 10 ** rng.randint(-9, 14) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(text_of(F.col("v"), T.DoubleType())).collect()] == [pushdown.java_double(v) for v in values]


# ---- live catalogs


def test_facts_of_a_live_catalog(spark):
    """The standard's own views, as DuckDB has them, give keys, references, rules and generated columns."""
    db = duckdb.connect()
    db.sql("create table parent (a int, b int, name text unique, primary key (a, b))")
    db.sql('create table child (id int primary key, a int, b int, "q t" int check ("q t" > 0), g int generated always as ("q t" * 2), foreign key (a, b) references parent (a, b))')

    def read(end, database, sql):
        found = db.sql(sql)
        rows = [tuple(None if v is None else str(v) for v in r) for r in found.fetchall()]
        return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in found.columns))

    meta = catalogs.table_meta(read, Endpoint(), "", "duckdb")
    assert meta["child"].key == ("id",) and meta["child"].foreign == ((("a", "b"), "parent", ("a", "b")),)
    assert list(meta["child"].checks.values()) == ["((`q t` > 0))"] and meta["child"].generated == {"g": "CAST((`q t` * 2) AS INTEGER)"}
    assert meta["parent"].key == ("a", "b") and meta["parent"].unique == (("name",),)
    dst = spark.createDataFrame([(1, 1, 1, 5, 10), (2, 9, 9, -1, -2), (3, 1, 1, 4, 7)], "id int, a int, b int, `q t` int, g int")
    parents = spark.createDataFrame([(1, 1, "x")], "a int, b int, name string")
    two = Pair("p", "duckdb", Endpoint(host="a"), Endpoint(host="b"), tables=("child",), meta=meta, read=lambda side, t: dst if t == "child" else parents)
    found = {r["scope"]: r["detail"] for r in checks.check(spark, two, ("deep",)).collect()}
    assert found["child fk"] == "a,b: 1 rows without a row in parent" and found["child generated"].startswith("g: 1 ") and found["child checks"].endswith(": 1 rows break it")


def test_ranges_and_rules_as_catalogs_print_them():
    ranges = catalogs.partition_ranges
    assert ranges(["FOR VALUES FROM ('2024-01-01') TO ('2024-02-01')", "DEFAULT", "FOR VALUES FROM (MINVALUE) TO ('2024-01-01')"]) == (("2024-01-01", "2024-02-01"), ("0001-01-01", "2024-01-01"))
    assert ranges(["100", "200", "MAXVALUE"]) == ((-(1 << 62), 100), (100, 200), (200, 1 << 62))
    assert catalogs.portable("CHECK (((price)::numeric > (0)::numeric(10,2)))") == "(((price) > (0)))"
    assert catalogs.portable("((status)::text = 'x'::character varying)") == "((status) = 'x')"
    assert {"objects", "foreign", "checks", "generated", "partitions"} <= set(catalogs.QUERIES["postgres"])


def test_rules_that_spark_cannot_read_are_left_out(spark):
    df = spark.range(3)
    assert drift.evaluable(df, "id > 1") and not drift.evaluable(df, "no_such_function(id)") and not drift.evaluable(df, "id >") and not drift.evaluable(df, "other = 1")


def test_all_databases_of_a_pair_in_one_run(spark, tmp_path, capsys):
    import json

    from concord import cli

    for side, last in (("a", 10), ("b", 9)):
        spark.range(10).coalesce(1).write.parquet(str(tmp_path / side / "one" / "t.parquet"))
        spark.range(last).coalesce(1).write.parquet(str(tmp_path / side / "two" / "t.parquet"))
    config = tmp_path / "hops.json"
    config.write_text(json.dumps({"hops": {"p": {"engine": "parquet", "databases": ["one", "two"], "source": {"path": str(tmp_path / "a")}, "target": {"path": str(tmp_path / "b")}, "options": {"key": {"t": ["id"]}}}}}))
    run = lambda *args: (cli.main(["--config", str(config), "--reports", str(tmp_path / "r"), "check", "p", "--only", "data", *args]), capsys.readouterr().out)
    code, said = run("--drill")
    assert code == 1 and "data\tone t\tok" in said and "data\ttwo t\tdiff\tmissing=1 extra=0 changed=0" in said
    assert (tmp_path / "r" / "p" / "keys" / "table=two.t").exists() and (tmp_path / "r" / "p" / "two").exists()
    assert run("--resume")[0] == 1 and run("--db", "one")[0] == 0


def test_grants_are_quoted(spark):
    missing = spark.createDataFrame([("app'; drop", 'public.od"d', "SELECT")], "grantee string, object string, privilege string")
    assert catalog.grant_statements(missing).first()["statement"] == 'GRANT SELECT ON "public"."od""d" TO "app\'; drop";'
    assert catalog.grant_statements(missing, "mssql").first()["undo"] == 'REVOKE SELECT ON [public].[od"d] FROM [app\'; drop];'
    account = spark.createDataFrame([("'app'@'%'", "db.t", "SELECT")], "grantee string, object string, privilege string")
    assert catalog.grant_statements(account, "mysql").first()["statement"] == "GRANT SELECT ON `db`.`t` TO 'app'@'%';"


def test_ordered_digests_of_deeper_trees(spark, monkeypatch):
    a, b = spark.range(5000).repartition(7), spark.range(5000).repartition(3)
    flat = fingerprint.ordered_fingerprint(a).first()
    monkeypatch.setattr(fingerprint, "LEAF_ROWS", 1 / 32)  # as if the table were very large
    deep = fingerprint.ordered_fingerprint(a).first()
    assert deep["n"] == 5000 and deep == fingerprint.ordered_fingerprint(b).first() and deep["digest"] != flat["digest"]
    assert deep != fingerprint.ordered_fingerprint(spark.range(1, 5001)).first()
