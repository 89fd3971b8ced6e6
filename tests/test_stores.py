"""Checks of documents, entries and logs by their own rules; faults that pass."""

import json

import pytest

from concord.model import Endpoint, Pair
from concord.operators import stores
from concord.plans import checks
from concord.sources import readers
from concord.sources.retry import passes, retried


def results(pair, spark, only=("counts", "data", "deep")):
    return {(r["check"], r["scope"]): (r["status"], r["detail"]) for r in checks.check(spark, pair, only).collect()}


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))


def bound(spark, tmp_path, engine, **options):
    return readers.bind(spark, Pair("p", engine, Endpoint(options={"path": str(tmp_path / "a")}), Endpoint(options={"path": str(tmp_path / "b")}), options=options))


def test_documents(spark, tmp_path):
    docs = [{"_id": {"$oid": f"x{i}"}, "n": i, "sub": {"a": [1, 2.5], "dotted.name": "s"}} for i in range(30)]
    lines(tmp_path / "a" / "people.jsonl", docs)
    same = [dict(reversed(d.items())) for d in docs]  # the order of fields is none
    lines(tmp_path / "b" / "people.jsonl", same)
    found = results(bound(spark, tmp_path, "mongodb"), spark)
    assert {v[0] for v in found.values()} == {"ok"}
    changed = [*same[2:], {**docs[1], "n": "1"}, {"_id": "new", "n": 1}, {"_id": "new", "n": 1}]
    lines(tmp_path / "b" / "people.jsonl", changed)
    found = results(bound(spark, tmp_path, "mongodb"), spark)
    assert found["data", "people"] == ("diff", "missing=1 extra=1 changed=1")
    assert found["counts", "people"] == ("diff", "src=30 dst=31")
    assert found["deep", "people duplicates"][1].startswith("1 identities") and ("deep", "people types") in found


def test_entries(spark, tmp_path):
    entry = lambda k, kind, ttl=-1, **v: {"key": k, "type": kind, "str": None, "hash": None, "items": None, "scores": None, "ttl": ttl, "bytes": 1} | v
    lines(tmp_path / "a" / "db0.jsonl", [entry("a", "string", str="1"), entry("b", "set", items=["x", "y"]), entry("c", "string", 600_000, str="v"), entry("d", "string", str="v")])
    lines(tmp_path / "b" / "db0.jsonl", [entry("a", "string", str="1"), entry("b", "set", items=["y", "x"]), entry("c", "string", str="v"), entry("d", "list", items=["v"])])
    found = results(bound(spark, tmp_path, "redis"), spark)
    assert found["data", "db0"] == ("diff", "missing=0 extra=0 changed=0 type=1")
    assert found["deep", "db0 lifetimes"] == ("diff", "1 lost")


def test_logs(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("event_type as topic", "cast(user_id % 2 as int) as part", "row_number() over (partition by event_type, user_id % 2 order by event_id) - 1L as off", "event_id as key", "props as v")
    for side in ("a", "b"):
        events.coalesce(1).write.parquet(str(tmp_path / side / "log.parquet"))
    log = lambda: bound(spark, tmp_path, "kafka", tables=["log"])
    assert {v[0] for v in results(log(), spark).values()} == {"ok"}
    one = events.first()
    events.selectExpr("topic", "part", "off", "key", f"case when key = {one['key']} then 'other' else v end as v").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "b" / "log.parquet"))
    found = results(log(), spark)
    assert found["counts", "log"][0] == "ok"
    in_tail = stores.log_tail(events).count() and events.where(f"topic = '{one['topic']}' and part = {one['part']}").count() - one["off"] <= stores.TAIL
    assert found["data", "log"][0] == ("diff" if in_tail else "ok")


def test_shapes():
    assert stores.shape_paths("OBJECT<a: ARRAY<OBJECT<`x.y`: BIGINT>>, b: DECIMAL(3,1), c: VOID, d: OBJECT<>>") == [("$", "object"), ("$.a", "array"), ("$.a[*]", "object"), ("$.a[*]['x.y']", "int"), ("$.b", "double"), ("$.c", "null"), ("$.d", "object")]
    assert stores.shape_paths("BIGINT") == [("$", "int")] and stores.shape_paths("NONE") == [("$", "none")]


def test_types_merge(spark):
    df = spark.createDataFrame([("a", "int", 1), ("a", "double", 2), ("b", "null", 1), ("b", "string", 1), ("c", "int", 1), ("c", "string", 5), ("d", "null", 3)], "path string, type string, n long")
    assert {r["path"]: (r["type"], r["n"]) for r in stores.merged_types(df).collect()} == {"a": ("double", 3), "b": ("string", 2), "c": ("mixed", 6), "d": ("null", 3)}


def test_faults_that_pass_are_tried_again():
    tries, waits = [], []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("wrapped") from ConnectionResetError("x")
        return 7

    assert retried(flaky, 3, waits.append) == 7 and len(waits) == 2 and waits[1] > waits[0] * 0.9
    with pytest.raises(ValueError):
        retried(lambda: (_ for _ in ()).throw(ValueError("syntax error")), 3, waits.append)
    assert len(waits) == 2 and not passes(ValueError("no such table")) and passes(RuntimeError("SQLITE: database is locked"))
    with pytest.raises(TimeoutError):
        retried(lambda: (_ for _ in ()).throw(TimeoutError()), 1, waits.append)
    assert len(waits) == 3
