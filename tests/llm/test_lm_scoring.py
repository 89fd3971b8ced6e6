import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from concord.llm import lm_scoring as m


def brute(texts, backoff=0.4, min_count=2, order=2):
    docs = [tuple((t or "").encode().lower().split()) for t in texts]
    counts = Counter(d[i : i + k] for d in docs for k in range(1, order + 1) for i in range(len(d) - k + 1))
    n = sum(map(len, docs))

    def log(gram):
        if len(gram) == 1:
            return math.log(counts[gram] / n)
        if counts[gram] >= min_count:
            return math.log(counts[gram] / counts[gram[:-1]])
        return math.log(backoff) + log(gram[1:])

    return [(len(d), sum(log(d[max(0, i - order + 1) : i + 1]) for i in range(len(d)))) for d in docs]


@pytest.mark.parametrize("options", [{}, {"block_words": 30, "bucket_ngrams": 100}, {"block_words": 1}, {"backoff": 0.2, "min_count": 3}, {"order": 3, "block_words": 40, "bucket_ngrams": 50}, {"order": 1}, {"order": 4, "min_count": 1}])
def test_against_brute_force(documents, monkeypatch, options):
    rng = random.Random(1)
    monkeypatch.setattr(m, "SLICE", 4)
    texts = [None, "", "one", "ONE one", *[" ".join(rng.choice("a b c d e É é f-g h".split()) for _ in range(rng.randrange(30))) for _ in range(80)]]
    model = {k: v for k, v in options.items() if k in ("backoff", "min_count", "order")}
    found = {r["doc_id"]: r for r in m.score(documents(*enumerate(texts)), **options).collect()}
    for i, (n, total) in enumerate(brute(texts, **model)):
        assert found[i]["n_words"] == n and found[i]["log_score"] == pytest.approx(total, abs=1e-9)
        assert found[i]["per_word"] == (pytest.approx(total / n) if n else None)


def test_the_count_table_is_that_of_the_corpus(spark, documents):
    texts = ["a b a b c", "b a", "c", None, ""]
    encoded = m.blocks(documents(*enumerate(texts)), 3)
    rows = m.slices(encoded, 5, 2).selectExpr("part", "block", "inline(arrays_zip(hashes, counts)) as (hash, n)")
    found = sorted(r["total"] for r in m.counted(rows).collect())
    words = [(t or "").split() for t in texts]
    wanted = Counter(w for d in words for w in d) + Counter(p for d in words for p in zip(d, d[1:]))
    assert found == sorted(wanted.values())
    assert rows.groupBy("hash").agg({"part": "min", "hash": "count"}).count() == len(wanted)


def test_joins_need_no_shuffle_of_rows(spark, documents, monkeypatch):
    """Exploded rows are aggregated, joined and gathered where their slices arrived."""
    plans = []
    real = m.durable
    monkeypatch.setattr(m, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        m.score(documents(*[(i, f"a b c {i}") for i in range(50)]), block_words=600, bucket_ngrams=50).count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plans[0] and "hash#" not in "".join(x for x in plans[0].splitlines() if "Exchange" in x)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_packing_round_trip():
    rng = np.random.default_rng(1)
    for values in (np.empty(0, np.uint64), np.array([0, 2**64 - 1], np.uint64), rng.integers(0, 2**63, 1000).astype(np.uint64), np.arange(70_000, dtype=np.uint64)):
        assert (m.unpacked(m.packed(values)) == values).all()
        assert (m.unpacked(m.packed(m.narrow(values))).astype(np.uint64) == values).all()


def test_odd_rows(odd, empty, crowded_names):
    found = m.score(odd).collect()
    assert len(found) == 10 and sum(r["doc_id"] is None for r in found) == 2
    assert len({(r["n_words"], r["log_score"]) for r in found if r["doc_id"] in (5, 6)}) == 1
    assert m.score(empty).count() == 0
    assert m.score(crowded_names).columns == ["doc_id", "n_words", "log_score", "per_word"]


def test_counts_are_gathered_by_block_from_batches_of_any_size():
    rng = random.Random(2)
    rows = [(block, part, at, rng.choice([1, 300, 1 << 40])) for block in (7, 3, 9) for part in (2, 5) for at in range(40)]
    wanted = {(b, p): [t for x, y, _, t in rows if (x, y) == (b, p)] for b, p, _, _ in rows}
    for size in (1, 33, 80, 1000):
        mixed = sorted(rows, key=lambda r: ((7, 3, 9).index(r[0]), rng.random()))
        table = pa.table({"block": [r[0] for r in mixed], "place": [(r[1] << 32) + r[2] for r in mixed], "total": [r[3] for r in mixed]})
        found = [r for batch in m.gathered(iter([pa.RecordBatch.from_pylist([], table.schema)] + table.to_batches(max_chunksize=size))) for r in batch.to_pylist()]
        assert {(r["block"], r["part"]): m.unpacked(r["totals"]).tolist() for r in found} == wanted and len(found) == len(wanted)
    assert list(m.gathered(iter([]))) == []


def test_rows_are_sorted_by_one_number_for_python(spark, documents, monkeypatch):
    """A sort by block and part compares rows, and a group for each costs more than its rows."""
    plans = []
    real = m.durable
    monkeypatch.setattr(m, "durable", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    m.score(documents(*[(i, f"a b c {i}") for i in range(50)]), block_words=60, bucket_ngrams=50).count()
    lines = plans[0].splitlines()
    at = next(i for i, x in enumerate(lines) if "MapInArrow gathered" in x)
    assert "Sort [block#" in lines[at + 1] and lines[at + 1].count(" ASC ") == 1
    assert "arrays_zip" not in plans[0] and "FlatMapGroupsInArrow" not in plans[0]
