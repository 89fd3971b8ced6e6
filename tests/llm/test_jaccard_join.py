import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from concord.llm import jaccard_join
from concord.llm.jaccard_join import _Hashes, folded, join, least_frequent, may_link, most_missing, parity, prefix_length, tokens_of


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs):
    """All pairs of documents, and the components of the links."""
    sets = [shingles(text) for _, text in docs]
    parent = list(range(len(docs)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[find(i)] = min(doc_id, least.get(find(i), doc_id))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def family(rng, base, members, edits):
    """Near copies of a text with up to so many words changed."""
    for _ in range(members):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        yield " ".join(words)


def corpus(seed, families=6, members=12):
    """Families of near copies, some with shared passages, exact copies, and short texts."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    passage = [word() for _ in range(30)]
    texts = []
    for k in range(families):
        base = [word() for _ in range(rng.choice((4, 5, 6, 9, 14, 40, 120)))]
        if k % 2:
            base = base[: len(base) // 2] + passage + base[len(base) // 2 :]
        texts += family(rng, base, members, 1 + len(base) // 40)
        texts += [" ".join(base)] * rng.randint(0, 3)
    texts += ["one two", "One  TWO", "", "one two three four five", "one two three four five six"]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("rare", [1, 3, 16])
def test_against_all_pairs(documents, rare):
    docs = corpus(rare)
    assert rows(join(documents(*docs), rare=rare)) == brute(docs)


@pytest.mark.parametrize("seed", [7, 8])
def test_large_group_whose_hub_does_not_link_all(documents, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "CELL", 7)
    monkeypatch.setattr(jaccard_join, "CHUNK", 300)
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    drift = list(family(rng, base, 25, 4))
    chain = [" ".join(f"c{i}" for i in range(s, s + 100)) for s in range(0, 60, 5)]  # each links with its neighbours alone
    docs = list(enumerate(drift + chain + [" ".join(base[k:] + base[:k]) for k in range(0, 60, 6)]))
    assert rows(join(documents(*docs), rare=2)) == brute(docs)


def test_linked_sets_share_neighbours_in_their_prefixes():
    """What the index relies on, for sets of all small sizes that only just link."""
    rng = np.random.default_rng(3)
    for n in range(1, 130):
        for more in range(0, n // 4 + 1):
            missing = (100 * n - 80 * (n + more)) // 100  # the most of the first set's tokens that may be missing
            if missing < 0:
                continue
            for _ in range(4):
                tokens = rng.permutation(10 * (n + more + 1))[: n + more]
                x, y = np.sort(tokens[:n]), np.sort(np.concatenate([tokens[missing:n], tokens[n:]]))
                shared = len(np.intersect1d(x, y))
                assert 100 * shared >= 80 * (len(x) + len(y) - shared)
                if np.array_equal(x, y):
                    continue
                a, b = x[: prefix_length(len(x))].tolist(), y[: prefix_length(len(y))].tolist()
                assert set(zip(a, a[1:])) & set(zip(b, b[1:]))
                common = len(set(a) & set(b))
                assert all(common >= (4 * k + 4) // 5 // 5 + 3 for k in (len(x), len(y)))
                assert n - shared <= most_missing(n)


def test_bitmaps_never_rule_out_a_link():
    rng = np.random.default_rng(4)
    for n in (3, 64, 65, 700, 5000):
        x = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        for extra in (0, n // 8, n // 4):
            y = np.unique(np.concatenate([x[: len(x) - extra // 3], rng.integers(0, 1 << 63, extra, dtype=np.uint64)]))
            shared = len(np.intersect1d(x, y))
            if 100 * shared >= 80 * (len(x) + len(y) - shared):
                assert may_link(len(x), parity(x), len(y), parity(y))
        z = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert n < 64 or not may_link(len(x), parity(x), len(z), parity(z))
    assert folded(0b1011_0110, 8, 4) == 0b1101


def test_least_frequent_in_spark(spark):
    got = spark.range(1, 400).select("id", least_frequent(F.col("id")).alias("x")).collect()
    assert all(x == (4 * n + 4) // 5 // 5 + 3 for n, x in got)


def test_tokens():
    hashes = _Hashes()
    assert len(tokens_of(b"a b c d e f a b c d e", hashes)) == len(tokens_of(b"a b c d e f a b c d e f", hashes)) == 6
    assert np.array_equal(tokens_of(b"A  b\tC", hashes), tokens_of(b"a b c", hashes))
    assert len(tokens_of(None, hashes)) == len(tokens_of(b" \n", hashes)) == 0
    assert tokens_of(b"a b", hashes)[0] != tokens_of(b"b a", hashes)[0]


def test_odd_rows(odd, empty, crowded_names):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert rows(join(odd)) == brute(docs)
    assert rows(join(crowded_names)) == brute(docs)
    assert join(empty).collect() == []
