"""Reconciliation by sketches, and minimal keys."""

import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from concord.operators import diff, keys, sketch


def kinds(df, key):
    return sorted((tuple(r[k] for k in key), r["kind"]) for r in df.collect())


@pytest.mark.parametrize(("third", "changes"), [(64, 30), (8, 30), (64, 0)])
def test_reconciles_or_falls_back(spark, third, changes):
    rng = random.Random(third + changes)
    rows = [(i, f"v{i}", i / 7) for i in range(3000)]
    other = list(rows)
    for i in rng.sample(range(3000), changes):
        other[i] = (i, f"w{i}", i / 7)
    other = [r for i, r in enumerate(other) if not changes or i % 611] + [(10_000 + i, None, None) for i in range(changes // 10)]
    src, dst = (spark.createDataFrame(x, "id long, v string, x double") for x in (rows, other))
    cells = sketch.subtracted(sketch.table_of(src, ["id"], None, third), sketch.table_of(dst, ["id"], None, third)).collect()
    found = sketch.peeled({r["cell"]: (r["n"], r["k"], r["v"], r["c"]) for r in cells}, third)
    assert (found is None) == (third == 8)
    want = kinds(diff.differences(src, dst, ["id"]), ["id"])
    assert kinds(sketch.reconcile(src, dst, ["id"], third=third), ["id"]) == want and len(want) == (0 if not changes else len(want))


def test_the_check_is_sparks(spark):
    rows = [(0, 0), (1, -1), (-(1 << 63), (1 << 63) - 1), (12345678901, -98765)]
    got = spark.createDataFrame(rows, "k long, v long").select(F.xxhash64("k", "v")).collect()
    assert [r[0] for r in got] == [sketch.check_of(k, v) for k, v in rows]


def test_repeated_rows_and_composite_keys(spark):
    src = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "b", 2), (None, "c", 3)], "i int, s string, v int")
    dst = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 4)], "i int, s string, v int")
    want = sorted(map(str, diff.differences(src, dst, ["i", "s"]).collect()))
    assert sorted(map(str, sketch.reconcile(src, dst, ["i", "s"], third=64).collect())) == want and len(want) == 2
    empty = src.limit(0)
    assert sketch.reconcile(empty, empty, ["i"]).collect() == []
    assert sketch.capacity() > 30_000


def brute(rows, names, most):
    found = []
    for width in range(1, most + 1):
        for s in combinations(range(len(names)), width):
            values = [tuple(r[i] for i in s) for r in rows]
            if len(set(values)) == len(values) and not any(None in v for v in values) and not any(set(f) <= set(s) for f in found):
                found.append(s)
    return [tuple(names[i] for i in s) for s in found]


@pytest.mark.parametrize("seed", range(4))
def test_minimal_keys_against_all_sets(spark, seed):
    rng = random.Random(seed)
    rows = [(i // 10, i % 10, rng.randrange(60), None if seed == 1 and i == 3 else i, rng.randrange(3), i // 50) for i in range(200)]
    rows = rows if seed < 3 else [*rows, rows[0]]
    names = ["a", "b", "c", "d", "e", "f.g"]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, e int, `f.g` int")
    assert keys.minimal_keys(df) == brute(rows, names, 3)


def test_keys_of_the_given_tables(spark, sf_dir):
    found = {t: keys.minimal_keys(spark.read.parquet(f"{sf_dir}/{t}.parquet"), most=2) for t in ("region", "nation", "customer", "orders", "events", "conversations")}
    assert ("c_custkey",) in found["customer"] and ("o_orderkey",) in found["orders"] and ("event_id",) in found["events"]
    assert ("conv_id", "turn") in found["conversations"] and ("conv_id",) not in found["conversations"]
