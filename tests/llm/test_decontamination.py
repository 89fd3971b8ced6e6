import hashlib
import random
import re

import duckdb

from concord.llm import decontamination as d
from concord.llm.oracles import DECONTAMINATION

WORD = "[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"


def words(text):
    return re.findall(WORD, "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, other in items:
        w = words(other)
        for window in {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else ():
            for i in range(len(own) - len(window) + 1):
                if tuple(own[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found.add("" if item is None else str(item))
    return len(own), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(own)


def case(seed):
    rng = random.Random(seed)
    vocabulary = "ab c dé e1 F g".split()
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(some(rng.choice([0, 1, 2, 5, 12, 13, 14, 20, 40])))) for i in range(12)] + [(3, " ".join(some(15))), (None, "zz yy"), (50, None)]
    docs = [(0, None), (1, ""), (2, "..."), (3, items[0][1])]
    for i in range(4, 60):
        text = some(rng.randrange(60))
        for _ in range(rng.randrange(3)):
            inserted = rng.choice(items)[1] or ""
            at = rng.randrange(len(text) + 1)
            text[at:at] = inserted.upper().split()
        docs.append((i, rng.choice([" ", ", ", "\n", "-"]).join(text)))
    return docs, items


def test_against_brute_force(spark, documents):
    for seed, options in ((1, {}), (2, {}), (3, {"max_bytes": 700})):
        docs, items = case(seed)
        benchmark = spark.createDataFrame(items, "item_id long, text string")
        found = d.contamination(documents(*docs), benchmark, **options)
        rows = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found.collect()}
        assert rows == {i: brute(t, items) for i, t in docs}, (seed, options)


def test_skips_never_jump_over_an_occurrence():
    rng = random.Random(9)
    for _ in range(300):
        m = rng.choice([1, 2, 3, 5, 13])
        patterns = {tuple(rng.choice([b"a", b"b", b"c"]) for _ in range(m)): frozenset("x") for _ in range(3)}
        text = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(80))]
        found = [i for i, _ in d.WuManber(patterns).occurrences(text)]
        assert found == [i for i in range(len(text) - m + 1) if tuple(text[i : i + m]) in patterns]


def test_most_words_are_skipped():
    machine = d.WuManber({tuple(b"p%d" % i for i in range(13)): frozenset("x")})
    looked = []
    get = machine.shift.get

    class Counting(dict):
        def get(self, key, default):
            looked.append(key)
            return get(key, default)

    machine.shift = Counting(machine.shift)
    list(machine.occurrences([b"w%d" % i for i in range(1200)]))
    assert len(looked) <= 1200 / 12 + 1


def test_share_at_its_edge(spark, documents):
    passage = [f"p{i}" for i in range(13)]
    benchmark = spark.createDataFrame([(1, " ".join(passage))], "item_id long, text string")
    docs = documents(*[(n, " ".join(passage + [f"w{i}" for i in range(n - 13)])) for n in (13, 260, 261)])
    assert {r["doc_id"]: r["contaminated"] for r in d.contamination(docs, benchmark).collect()} == {13: True, 260: True, 261: False}
    assert [r["doc_id"] for r in d.keep_clean(docs, benchmark).collect()] == [261]


def test_odd_rows(spark, odd, empty, crowded_names):
    benchmark = spark.createDataFrame([(1, "same words here"), (1, "same words here")], "item_id long, text string").selectExpr("*", "1 as words", "2 as items", "3 as item")
    found = d.contamination(odd, benchmark).collect()
    assert len(found) == 10 and sorted(r["doc_id"] for r in found if r["contaminated"]) == [5, 5, 6]
    assert d.contamination(empty, benchmark).count() == 0
    assert d.contamination(odd, benchmark.limit(0)).where("contaminated").count() == 0
    assert d.keep_clean(crowded_names, benchmark).columns == crowded_names.columns


def test_spans_and_oracle(spark, documents, sf_dir):
    docs = documents((1, "x same words here y same words here"))
    row = d.contamination(docs, spark.createDataFrame([(4, "same words here")], "item_id long, text string")).first()
    assert list(row["starts"]) == [1, 5] and list(row["ends"]) == [4, 8] and row["items"] == ["4"]
    db = duckdb.connect()
    for t in ("documents", "benchmark"):
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found = d.contamination(*[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark")]).drop("starts", "ends", "items")
    assert sorted(map(tuple, found.collect())) == sorted(db.sql(DECONTAMINATION).fetchall())


def test_a_block_is_freed_before_the_next(spark, documents, monkeypatch):
    docs, items = case(5)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, d.contamination(documents(*docs), benchmark).collect()), key=str)
    made, freed = [], []
    context = type(spark.sparkContext)
    real = context.broadcast

    def broadcast(self, value):
        found = real(self, value)
        made.append(len(value))
        gone = found.destroy
        found.destroy = lambda blocking=False: (freed.append(len(made)), gone(blocking))
        return found

    monkeypatch.setattr(context, "broadcast", broadcast)
    monkeypatch.setattr(d, "FEW_TEXTS", 0)  # spans come back by a shuffled join as well
    found = d.contamination(documents(*docs), benchmark, max_bytes=250)
    assert sorted(map(tuple, found.collect()), key=str) == whole
    assert len(made) > 3 and freed == list(range(1, len(made)))


def test_items_that_share_a_window_are_not_sent(spark, documents, monkeypatch):
    """Three thousand items of one text make one window, and their ids stay where they are."""
    sent = []
    context = type(spark.sparkContext)
    real = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda self, value: (sent.append(value), real(self, value))[1])
    benchmark = spark.range(3000).selectExpr("id as item_id", "'the' as text")
    found = d.contamination(documents((1, "see the dog"), (2, "the cat"), (3, "none")), benchmark).collect()
    assert [len(x) for x in sent] == [1]
    names = sorted(map(str, range(3000)))
    assert {r["doc_id"]: r["n_items"] for r in found} == {1: 3000, 2: 3000, 3: 0}
    assert {r["items_sha256"] for r in found if r["doc_id"] < 3} == {d.digest(names)} and {r["doc_id"]: list(r["items"]) for r in found}[1] == names
