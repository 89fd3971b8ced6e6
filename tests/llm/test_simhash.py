import random
import re

import numpy as np
import xxhash

from concord.llm import components, simhash as s


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Smallest index reachable over links of at most three differing bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def clusters(n, seed, spread=4):
    """Fingerprints around a few centres, most pairs at distances where a link may or may not hold."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randrange(spread + 1)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def roots(spark, fps, **options):
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    found = {r["node"]: r["root"] for r in components.connected_components(s.links(df, **options)).collect()}
    return [found.get(signed(x), signed(x)) for x in fps]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_fingerprints_against_brute_force():
    rng = random.Random(1)
    texts = [None, "", " \n", "One", "A b", "É à x", "a b c d", "A\x85b C"] + [" ".join(rng.choice("abcdé") for _ in range(rng.randrange(40))) for _ in range(100)]
    for text in texts:
        assert s.fingerprint(text.encode() if text is not None else None) == signed(brute_fingerprint(text)), text


def test_links_against_all_pairs(spark):
    fps = clusters(700, 1) + [0, 7, (1 << 64) - 1]
    assert same_partition(roots(spark, fps), brute_components(fps))


def test_crowded_buckets_lose_no_link(spark):
    fps = clusters(300, 2, spread=3)
    assert same_partition(roots(spark, fps, max_bucket=3), brute_components(fps))


def test_buckets_that_span_batches(spark):
    fps = clusters(300, 4, spread=3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        assert same_partition(roots(spark, fps), brute_components(fps))
        assert same_partition(roots(spark, fps, max_bucket=4), brute_components(fps))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_every_distance_up_to_three_meets(spark):
    rng = random.Random(7)
    for flips in ([0], [63], [0, 21], [0, 1, 2], [20, 21, 42], [41, 42, 63], [5, 30, 60]):
        a = rng.getrandbits(64)
        b = a
        for f in flips:
            b ^= 1 << f
        df = spark.createDataFrame([(signed(a),), (signed(b),)], "fp long")
        assert s.links(df).where("u <> v").count() >= 1, flips


def test_long_chain_settles(spark):
    n = 120
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 500), (7, 8)], "u long, v long")
    found = components.connected_components(edges).collect()
    assert {r["root"] for r in found} == {0} and len(found) == n + 1
    assert components.connected_components(edges.limit(0)).count() == 0


def test_query_rows(documents):
    base = " ".join(f"w{i}" for i in range(400))
    docs = documents((5, base), (3, base), (9, base + " end"), (1, "quite another text about other things entirely"), (2, None), (8, ""), (4, "  "))
    found = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in s.near_duplicates(docs).collect()}
    assert found[5] == found[3] and found[3][1] == 3 and found[9][1] == 3
    assert found[1][1] == 1 and found[2] == found[8] == found[4] == ("0" * 16, 2)
    assert found[5][0] == f"{brute_fingerprint(base):016x}"
    assert sorted(r["doc_id"] for r in s.keep_one(docs).collect()) == [1, 2, 3]


def test_odd_rows(odd, empty, crowded_names):
    found = s.near_duplicates(odd).collect()
    assert len(found) == 10 and {r["component_id"] for r in found if r["doc_id"] in (5, 6)} == {5}
    assert s.near_duplicates(empty).count() == 0 and s.keep_one(empty).count() == 0
    kept = s.keep_one(crowded_names)
    assert kept.columns == crowded_names.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 4, 5, 7] and ids.count(None) == 1


def test_pairs_of_a_bucket():
    u, v = s.pairs(np.array([0, 7, 15, -1], dtype=np.int64))
    assert {(a, b) for a, b in zip(u.tolist(), v.tolist())} == {(0, 7), (7, 15)}


def test_kept_rows_carry_their_own_values(spark, documents):
    docs = documents((1, "a b c d"), (2, "quite other words than that"), (1, "a b c d")).selectExpr("*", "doc_id * 70 + 7 as __row", "doc_id * 11 as __fp", "array(map('k', doc_id)) as `m.n`")
    for hot in (1, s.HOT_ROWS):
        found = {r["doc_id"]: (r["__row"], r["__fp"], r["m.n"]) for r in s.keep_one(docs, hot_rows=hot).collect()}
        assert found == {1: (77, 11, [{"k": 1}]), 2: (147, 22, [{"k": 2}])}


def test_a_key_on_most_rows_is_looked_up_by_broadcast(spark, documents, monkeypatch):
    docs = documents(*[(7, "same old words again")] * 50, *[(i, f"text {i} of {i * i} kinds") for i in range(20, 40)], (None, "same old words again"), *[(3, None)] * 9)
    plain = sorted(map(tuple, s.near_duplicates(docs).collect()), key=str)
    from concord.llm import common

    monkeypatch.setattr(common.joined, "__defaults__", (2,))
    assert sorted(map(tuple, s.near_duplicates(docs).collect()), key=str) == plain
    ids = [sorted((r["doc_id"] for r in s.keep_one(docs, hot_rows=h).collect()), key=str) for h in (2, 10, 1000)]
    assert ids[0] == ids[1] == ids[2] == sorted([3, 7, *range(20, 40)], key=str)
    edges = spark.createDataFrame([(0, i) for i in range(1, 60)] + [(100 + i, i) for i in range(50)], "u long, v long")
    assert {r["root"] for r in components.connected_components(edges, hot_edges=5).collect()} == {0}


def test_random_pairs_meet_in_every_block_split(spark):
    rng = random.Random(11)
    pairs = []
    for distance in (1, 2, 3):
        for _ in range(60):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), distance):
                b ^= 1 << bit
            pairs.append((signed(a), signed(b)))
    fps = spark.createDataFrame([(x,) for p in pairs for x in p], "fp long")
    keys = {}
    for r in s.variants(fps).collect():
        keys.setdefault(r["fp"], set()).add(r["key"])
    assert {len(v) for v in keys.values()} <= set(range(129, 132))  # 131 variants, some of them equal
    assert all(keys[a] & keys[b] for a, b in pairs)


def test_a_round_of_few_edges_is_few_files(spark, monkeypatch):
    files, plain = [], components.durable
    monkeypatch.setattr(components, "durable", lambda df: files.append((out := plain(df)).rdd.getNumPartitions()) or out)
    for key, value in (("spark.sql.shuffle.partitions", 97), ("spark.sql.adaptive.coalescePartitions.enabled", "false")):
        spark.conf.set(key, value)
    try:
        edges = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
        assert {r["root"] for r in components.connected_components(edges).collect()} == {0}
        assert len(files) > 2 and max(files[1:]) <= spark.sparkContext.defaultParallelism
        files.clear()
        monkeypatch.setattr(components, "TASK_EDGES", 10)
        assert {r["root"] for r in components.connected_components(edges).collect()} == {0}
        assert max(files[1:]) >= 30
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
