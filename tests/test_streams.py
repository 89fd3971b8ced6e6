"""The change-log source and the recheck of suspect keys."""

import pytest
from pyspark.sql import functions as F

from concord.streaming import delta, recheck, source
from concord.streaming.source import ChangeLogReader, ChangeLogSource, LostHistory, position, write_segment


def lsn(n):
    return f"{n >> 32:X}/{n & 0xFFFFFFFF:X}"


def change(n, key=None):
    return lsn(n), f"table public.orders: UPDATE: o_orderkey[bigint]:{n if key is None else key} note[text]:'x'"


def read_all(spark, folder, checkpoint, **options):
    """One run of the stream: what each batch took."""
    spark.dataSource.register(ChangeLogSource)
    batches = []
    reader = spark.readStream.format("changelog").option("path", folder).option("checkpoint", checkpoint)
    for k, v in options.items():
        reader = reader.option(k, v)
    query = reader.load().writeStream.foreachBatch(lambda df, i: batches.append(sorted(r["lsn"] for r in df.collect()))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return batches


def test_positions_are_offsets_and_restarts_go_on(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    write_segment(folder, 0, 10, [change(n) for n in range(1, 11)])
    write_segment(folder, 10, 20, [change(n) for n in range(11, 21)])
    assert sorted(sum(read_all(spark, folder, checkpoint), [])) == sorted(lsn(n) for n in range(1, 21))
    write_segment(folder, 20, 25, [change(n) for n in range(21, 26)])
    assert sum(read_all(spark, folder, checkpoint), []) == sorted(lsn(n) for n in range(21, 26))
    assert read_all(spark, folder, checkpoint) == []


def test_a_limit_counts_from_where_the_stream_was(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    write_segment(folder, 0, 1 << 33, [change(n) for n in (3, 5, 9, 1 << 32, (1 << 32) + 7)])
    write_segment(folder, 1 << 33, (1 << 33) + 2, [change((1 << 33) + 1)])
    runs = [sum(read_all(spark, folder, checkpoint, limit=2), []) for _ in range(4)]
    assert runs == [[lsn(3), lsn(5)], sorted([lsn(9), lsn(1 << 32)]), sorted([lsn((1 << 32) + 7), lsn((1 << 33) + 1)]), []]


def test_lost_history_is_an_error(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    first = write_segment(folder, 0, 10, [change(4)])
    read_all(spark, folder, checkpoint)
    write_segment(folder, 15, 20, [change(16)])
    (tmp_path / "log" / first.split("/")[-1]).unlink()
    with pytest.raises(Exception, match="compare whole"):
        read_all(spark, folder, checkpoint)
    write_segment(folder, 0, 12, [change(4)])
    with pytest.raises(LostHistory, match="gap"):
        ChangeLogReader({"path": folder, "start": "0/2"}).latestOffset()


def test_starts(tmp_path):
    folder = str(tmp_path / "log")
    write_segment(folder, 7, 20, [change(16)])
    assert [ChangeLogReader({"path": folder, "start": s}).initialOffset()["at"] for s in ("earliest", "latest", "0/A")] == [7, 20, 10]
    assert ChangeLogReader({"path": str(tmp_path / "none")}).latestOffset() == {"at": 0}
    assert position("1/A0") == (1 << 32) + 160


def test_the_stream_feeds_the_parser(spark, tmp_path):
    folder, checkpoint = str(tmp_path / "log"), str(tmp_path / "cp")
    write_segment(folder, 0, 10, [(lsn(1), "BEGIN 1"), change(2, 77), change(3, 78), (lsn(4), "COMMIT 1")])
    spark.dataSource.register(ChangeLogSource)
    lines = spark.readStream.format("changelog").option("path", folder).load()
    out = []
    parsed = delta.parse_changes(lines, {"public.orders": ["o_orderkey"]})
    parsed.writeStream.foreachBatch(lambda df, i: out.extend(map(tuple, df.select("table", "op", "key").collect()))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted(out) == [("public.orders", "UPDATE", "77"), ("public.orders", "UPDATE", "78")]


def test_suspects_wait_for_both_sides(spark, tmp_path):
    """Keys in flight heal, true differences persist, and neither is judged before both sides have passed the fence."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    drop = lambda name, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / name))
    stream = lambda name, schema: spark.readStream.schema(schema).json(str(tmp_path / name))
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_totalprice")
    keys = [r[0] for r in orders.orderBy("o_orderkey").limit(3).collect()]
    target = {"df": orders.withColumn("o_totalprice", F.when(F.col("o_orderkey").isin(keys), 0.0).otherwise(F.col("o_totalprice")))}
    drop("suspects", [(str(k), 100) for k in keys[:2]] + [(str(keys[2]), 300)], "key string, fence long")
    for side in ("src", "dst"):
        drop(side, [(50,)], "position long")
    judged = []
    due = recheck.due(stream("suspects", "key string, fence long"), [stream(side, "position long") for side in ("src", "dst")])
    settle = recheck.settle(lambda: orders, lambda: target["df"], "o_orderkey", lambda df, i: judged.extend(map(tuple, df.collect())))
    query = due.writeStream.foreachBatch(settle).option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    try:
        query.processAllAvailable()
        drop("src", [(200,)], "position long")
        query.processAllAvailable()
        assert judged == []  # the target has not passed the fence
        # the change of the first key arrives on the target, then it passes the fence
        target["df"] = orders.withColumn("o_totalprice", F.when(F.col("o_orderkey").isin(keys[1:]), 0.0).otherwise(F.col("o_totalprice")))
        drop("dst", [(200,)], "position long")
        query.processAllAvailable()
        assert sorted(judged) == [(keys[0], 100, "healed"), (keys[1], 100, "changed")]
        for side in ("src", "dst"):
            drop(side, [(301,)], "position long")
        query.processAllAvailable()
        assert (keys[2], 300, "changed") in judged and len(judged) == 3
    finally:
        query.stop()


def test_watch_follows_a_log_of_orders(spark, tmp_path, capsys):
    import json

    from concord import cli

    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet").select("o_orderkey", "o_totalprice")
    keys = [r[0] for r in orders.orderBy("o_orderkey").limit(6).collect()]
    for side in ("a", "b"):
        orders.coalesce(1).write.parquet(str(tmp_path / side / "orders.parquet"))
    config = tmp_path / "hops.json"
    config.write_text(json.dumps({"hops": {"p": {"engine": "parquet", "source": {"path": str(tmp_path / "a")}, "target": {"path": str(tmp_path / "b")}, "options": {"key": {"orders": ["o_orderkey"]}}}}}))
    line = lambda n, key: (lsn(n), f"table orders: UPDATE: o_orderkey[bigint]:{key} o_totalprice[double]:1.5")
    log = str(tmp_path / "log")
    write_segment(log, 0, 3, [line(i + 1, k) for i, k in enumerate(keys[:3])])
    run = lambda: (cli.main(["--config", str(config), "--reports", str(tmp_path / "reports"), "watch", "p", "--follow", "--table", "orders", "--changes", log]), capsys.readouterr().out)
    assert run() == (0, "0\torders\tclean\n")
    orders.withColumn("o_totalprice", F.when(F.col("o_orderkey") == keys[4], -1.0).otherwise(F.col("o_totalprice"))).coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "b" / "orders.parquet"))
    write_segment(log, 3, 6, [line(i + 4, k) for i, k in enumerate(keys[3:])])
    assert run() == (1, "0\torders\tmissing=0 extra=0 changed=1\n")
    assert run()[0] == 1  # the cursor has stayed
    orders.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "b" / "orders.parquet"))
    assert run() == (0, "0\torders\tclean\n")
    for f in (tmp_path / "log").iterdir():
        f.unlink()
    write_segment(log, 9, 12, [line(10, keys[0])])
    code, said = run()
    assert code == 2 and "history lost" in said
