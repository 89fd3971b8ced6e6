import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from concord.llm import sharding as s


def brute(rows, limit):
    """Split a bucket on another bit while it is too large and has several rows."""
    address = lambda k: bin(int(hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:16], 16))[2:].zfill(64)
    out, todo = {}, [("", [(k, n, address(k)) for k, n in rows])]
    while todo:
        prefix, members = todo.pop()
        if sum(n for _, n, _ in members) <= limit or len(members) <= 1 or len(prefix) == 64:
            out |= {k: prefix for k, _, _ in members}
            continue
        halves = defaultdict(list)
        for m in members:
            halves[m[2][: len(prefix) + 1]].append(m)
        todo += halves.items()
    return out


def test_against_splitting_one_bucket_at_a_time(spark, documents):
    rows = [(i, i * 7919 % 900 + 1) for i in range(500)]
    docs = documents(*[(i, "x" * n) for i, n in rows])
    for limit, step in ((100_000, 12), (3000, 12), (1500, 2), (950, 3), (300, 5)):
        found = s.shard(docs, max_bytes=limit, step=step).collect()
        assert {r["doc_id"]: r["shard"] for r in found} == brute(rows, limit), (limit, step)
        assert all(r["shard_bytes"] <= limit or r["shard_rows"] == 1 for r in found)
        assert all(len(r["shard"]) == r["depth"] for r in found)


def test_equal_keys_overflow_into_pages(spark, documents):
    docs = documents(*[(7, "y" * (50 + i % 3)) for i in range(400)], *[(i, "z" * 10) for i in range(100, 150)], (None, "w" * 5000), (None, "v" * 20), (None, None))
    found = s.shard(docs, max_bytes=1000, step=12)
    assert found.count() == 453
    pages = found.groupBy("shard", "page").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n")).collect()
    assert all(p["b"] <= 1000 or p["n"] == 1 for p in pages)


def test_no_file_exceeds_the_limit(spark, documents, tmp_path):
    rows = [(7, "y" * (50 + i % 3)) for i in range(400)] + [(i, "z" * (i % 90)) for i in range(100, 900)] + [(None, "w" * 700), (None, "v" * 20), (None, None), (7, "u" * 5000)]
    docs = documents(*[(k, t, f"{i}") for i, (k, t) in enumerate(rows)]).repartition(6)
    s.write_shards(docs, str(tmp_path / "out"), 1000)
    read = spark.read.parquet(str(tmp_path / "out"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    files = read.groupBy(F.input_file_name().alias("file")).agg(F.sum(size).alias("bytes"), F.count("*").alias("n")).collect()
    assert len(files) > 30 and all(f["bytes"] <= 1000 or f["n"] == 1 for f in files)
    assert sorted((int(r["lang"]), r["doc_id"], r["text"]) for r in read.collect()) == [(i, k, t) for i, (k, t) in enumerate(rows)]
    # the files are the pages of the registered operator
    pages = lambda df, shard, n: sorted(map(tuple, df.groupBy(shard, F.col("page").cast("long"), n).count().collect()))
    wanted = s.shard(docs, max_bytes=1000)
    assert pages(read, F.col("shard"), size) == pages(wanted, F.concat(F.lit("s"), "shard"), F.col("n_bytes"))


def test_odd_rows(spark, odd, empty, crowded_names, tmp_path):
    assert s.shard(odd).count() == 10 and s.shard(empty).count() == 0
    assert s.shard(crowded_names, max_bytes=100).count() == 10
    assert {r["shard"] for r in s.shard(odd).collect()} == {""}
    named = odd.selectExpr("*", "doc_id as shard", "lang as PAGE", "1 as `a.b`")
    s.write_shards(named, str(tmp_path / "named"), 1 << 10)
    read = spark.read.parquet(str(tmp_path / "named"))
    assert read.count() == 10 and {"shard", "PAGE", "shard_", "page_", "a.b"} <= set(read.columns)
    s.write_shards(odd.dropDuplicates(), str(tmp_path / "out"), 1 << 10)
    assert spark.read.parquet(str(tmp_path / "out")).count() == odd.dropDuplicates().count()


def test_a_long_chain_is_unfolded_by_many_tasks(spark, documents):
    docs = documents((7, "y" * 10)).selectExpr("*", "explode(sequence(1, 50000)) as k")
    found = s.shard(docs, max_bytes=100_000)
    assert found.count() == 50_000 and found.groupBy("page").agg(F.sum("n_bytes").alias("b")).where("b > 100000").isEmpty()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
