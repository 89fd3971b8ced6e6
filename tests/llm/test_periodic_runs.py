import hashlib
import random

import numpy as np
import pytest
from conftest import rows

from concord.llm import periodic_runs
from concord.llm.periodic_runs import collapsed, digests, distances, extended, longest, planted, recurrences, runs, runs_of, smallest_period


def brute(words):
    """Every maximal stretch of every period, and of these the ones without a smaller period."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(6, 4 * q) and not any(all(words[k] == words[k + p] for k in range(i, i + length - p)) for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def made(seed, most=70, letters=4):
    """Random words with a few periodic parts."""
    rng = random.Random(seed)
    n = rng.randint(0, most)
    words = [rng.randrange(rng.randint(1, letters)) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 4:
            a = rng.randrange(n)
            p, end = rng.randint(1, max(1, (n - a) // 2)), rng.randint(a, n)
            for i in range(a, end):
                words[i] = words[a + (i - a) % p]
    return words


@pytest.mark.parametrize("key", [2, 32])
def test_runs_against_brute_force(monkeypatch, key):
    monkeypatch.setattr(periodic_runs, "KEY", key)
    for seed in range(1200):
        words = made(seed)
        assert runs_of(np.array(words, np.int64)) == brute(words), words


def test_long_periods_against_brute_force():
    for seed in range(12):
        words = made(seed, 700, 400)
        at = len(words) // 3
        period = max(1, (len(words) - at) // 5)
        words = words[:at] + [words[at + i % period] for i in range(len(words) - at)] if words else words
        assert runs_of(np.array(words, np.int64)) == brute(words)


def test_each_period_has_one_block_size():
    sizes = [2**k for k in range(1, 12)]
    assert [q for s in sizes for q in range(distances(s)[0], distances(s)[1] + 1)] == list(range(1, distances(sizes[-1])[1] + 1))
    assert all(2 * s <= 3 * distances(s)[0] + 1 for s in sizes)


@pytest.mark.parametrize("words", [np.zeros(100_000, np.int64), np.tile(np.arange(6), 20_000), np.tile(np.arange(9_000), 5)])
def test_very_repetitive_texts_are_one_run(words):
    period = int(words.max()) + 1
    assert runs_of(words) == [(0, len(words), period)]


def test_parts():
    words = np.array([9, 1, 2, 1, 2, 1, 2, 1, 2, 7], np.int64)
    assert recurrences(words).tolist() == [10, 2, 2, 2, 2, 2, 2, 10, 10, 10]
    assert extended(words, 3, 7, 2) == (1, 9)
    assert smallest_period(words, 1, 2) and not smallest_period(np.ones(9, np.int64), 0, 2)
    assert runs_of(words) == [(1, 8, 2)]
    assert longest([(4, 8, 2), (0, 8, 2), (0, 8, 1), (9, 7, 1)]) == (0, 8, 1)
    assert longest([]) is None
    assert collapsed(list("xababababy"), [(1, 8, 2)]) == list("xaby")


def test_planted_tails():
    words = [b"w%d" % i for i in range(40)]
    hit = next(i for i in range(1000) if periodic_runs.zlib.crc32(str(i).encode()) % 10 == 0)
    g = periodic_runs.zlib.crc32(str(hit).encode()) // 10
    at = g % 40
    period = 1 + (40 - at) // (3 + g % 8)
    assert planted(words, hit) == [words[i] if i < at else words[at + (i - at) % period] for i in range(40)]
    assert planted(words, None) == words and planted([], hit) == []


def test_digests_against_brute_force(documents):
    texts = [(i, " ".join(f"W{x}" for x in made(i))) for i in range(60)]
    got = {r["doc_id"]: r for r in digests(documents(*texts)).collect()}
    for doc_id, text in texts:
        words = [w.decode() for w in planted(text.encode().split(), doc_id)]
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        r = got[doc_id]
        assert r["n_runs"] == len(found)
        assert (r["start"], r["length"], r["period"]) == (best or (None, None, None))
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if best else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest()


def test_real_outputs(documents):
    got = runs(documents((1, "a b c a b c a b c a b c d"), (2, None), (3, "one two"))).collect()
    assert [tuple(r) for r in got[0]["runs"]] == [(0, 12, 3)] and got[0]["collapsed"] == "a b c d"
    assert [r["collapsed"] for r in got] == ["a b c d", "", "one two"]


def test_odd_rows(odd, empty, crowded_names):
    none = hashlib.sha256(b"").hexdigest()
    got = digests(odd).collect()
    assert len(got) == 10 and all(r["runs_sha256"] is not None and r["collapsed_sha256"] is not None for r in got)
    by_id = {r["doc_id"]: r for r in got}
    assert by_id[1]["n_runs"] == 0 and by_id[1]["start"] is None and by_id[1]["collapsed_sha256"] == none
    assert by_id[2]["collapsed_sha256"] == by_id[3]["collapsed_sha256"] == none
    assert by_id[4]["n_runs"] >= 1 and by_id[4]["period"] == 6
    assert rows(digests(crowded_names)) == rows(digests(odd))
    assert digests(empty).collect() == [] and runs(empty).collect() == []
