"""Random tables: what the operators say must agree with plain Python."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from concord.operators import diff, fingerprint, repair
from concord.streaming import delta

SLOW = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SCHEMA = "id long, v string, x double"
values = st.tuples(st.one_of(st.none(), st.sampled_from(["", "a", "b", "~", "1:a"])), st.one_of(st.none(), st.sampled_from([0.0, 1.5, -2.25, 1e9])))
tables = st.dictionaries(st.integers(0, 12), values, max_size=10)
bags = st.lists(st.tuples(st.integers(0, 2), *[st.sampled_from(["a", None])], st.sampled_from([1.0, None])), max_size=12)


def df(spark, rows):
    return spark.createDataFrame([(k, *v) for k, v in rows.items()] if isinstance(rows, dict) else rows, SCHEMA)


@SLOW
@given(tables, tables)
def test_keyed_difference_and_repair(spark, a, b):
    src, dst = df(spark, a), df(spark, b)
    expected = {k: "missing" if k not in b else "extra" if k not in a else "changed" if a[k] != b[k] else "same" for k in {*a, *b}}
    assert {r["id"]: r["kind"] for r in diff.classified(src, dst, ["id"]).collect()} == expected
    done = repair.repair_rows(src, dst, ["id"])
    plain = lambda x: {r["id"]: (r["v"], r["x"]) for r in x.collect()}
    assert plain(done.repaired) == a
    assert plain(repair.restore(done.repaired, done, ["id"])) == b


@SLOW
@given(bags, bags)
def test_multisets(spark, a, b):
    left, right = Counter(a), Counter(b)
    found = diff.multiset_difference(df(spark, a), df(spark, b)).first()
    assert (found["only_in_src"], found["only_in_dst"]) == ((left - right).total(), (right - left).total())
    same = left == right
    for make in (fingerprint.table_fingerprint, fingerprint.ordered_fingerprint):
        assert (make(df(spark, a)).first() == make(df(spark, b)).first()) == same


@SLOW
@given(tables, st.lists(st.tuples(st.sampled_from(["INSERT", "UPDATE", "DELETE"]), st.integers(0, 12), values), max_size=10))
def test_replay(spark, start, events):
    state = dict(start)
    for op, key, value in events:
        if op == "DELETE":
            state.pop(key, None)
        else:
            state[key] = value
    log = spark.createDataFrame([(k, *v, op, i) for i, (op, k, v) in enumerate(events)], SCHEMA + ", op string, lsn long")
    after = delta.apply_changes(df(spark, start), log, ["id"], ["lsn"])
    assert {r["id"]: (r["v"], r["x"]) for r in after.collect()} == state


def test_sums_do_not_depend_on_partitions(spark):
    t = spark.range(1000).select("id", F.md5(F.col("id").cast("string").cast("binary")).alias("v"))
    assert len({fingerprint.table_fingerprint(t.repartition(n)).first() for n in (1, 3, 16)}) == 1
    assert len({fingerprint.ordered_fingerprint(t.repartition(n)).first() for n in (1, 3, 16)}) == 1
