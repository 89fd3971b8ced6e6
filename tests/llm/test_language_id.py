import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from concord.llm import language_id as l

SYLLABLES = {"en": ["th", "ing", "er", "sh", "wh"], "fr": ["eau", "oi", "é", "tre", "que"], "de": ["sch", "ung", "ü", "ein", "ß"]}


def corpus(documents, n=300):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = list(SYLLABLES)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(20)), lang))
    return documents(*rows)


def test_held_out_accuracy(documents):
    docs = corpus(documents)
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = l.identify(docs).collect()
    held = [r for r in found if r["held_out"]]
    assert len(found) == 300 and len(held) > 30
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_held_out_languages_are_never_used(documents):
    docs = corpus(documents)
    lied = docs.selectExpr("doc_id", "text", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 'xx' else lang end as lang", "source", "n_chars")
    a, b = l.train(docs), l.train(lied)
    assert a.classes == b.classes and (a.weights == b.weights).all() and a.temperature == b.temperature


def test_weights_are_sparse(documents):
    model = l.train(corpus(documents))
    assert (model.weights != 0).mean() < 0.2


def test_grams_of_long_texts_do_not_depend_on_chunks(monkeypatch):
    text = ("ab cé " * 500).encode()
    whole = l.gram_counts(text)
    monkeypatch.setattr(l, "CHUNK", 7)
    assert all((a == b).all() for a, b in zip(whole, l.gram_counts(text)))
    points = 1 + len(text.decode()) + 1  # a space on either side
    assert whole[1].sum() == points + (points - 1) + (points - 2)


def test_odd_rows(documents, odd, empty, crowded_names):
    known = {r["doc_id"]: r for r in l.identify(odd.unionByName(corpus(documents).selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "n_chars"))).where("doc_id < 1000").collect()}
    assert known[1]["lang_pred"] == known[2]["lang_pred"] == known[3]["lang_pred"] == "und" and known[1]["score"] == 0
    assert known[4]["lang_pred"] in ("en", "fr", "de")
    assert l.identify(empty).count() == 0 and l.identify(odd).count() == 10
    assert l.keep_identified(crowded_names).columns == crowded_names.columns
    assert {r["lang_pred"] for r in l.identify(odd.where("doc_id is null")).collect()} == {"und"}


def test_the_fit_sees_about_six_thousand_rows(documents, monkeypatch):
    seen = []
    monkeypatch.setattr(l, "fit", lambda names, idf, rows: seen.extend(rows) or l.Model(names, idf[None, :].repeat(len(names), 0), idf[: len(names)], idf))
    l.train(documents(*[(i, f"text number {i}", "en" if i % 2 else "fr") for i in range(9000)]))
    assert 5500 < len(seen) < 6500


def feature(gram):
    """One n-gram's feature, in plain integers."""
    x, mask = 0, (1 << 32) - 1
    for k, c in enumerate(gram):
        if not k:
            x = (ord(c) * 0x9E3779B1 + len(gram)) & mask
        else:
            x = ((x ^ ord(c)) * 0x85EBCA6B) & mask
            x ^= x >> 15
    return ((x * 0xC2B2AE35) & mask) >> 16


@pytest.mark.parametrize("limit", [0, 6000])
def test_gram_counts_against_a_dictionary(monkeypatch, limit):
    monkeypatch.setattr(l, "SORTED", limit)
    rng = random.Random(4)
    for _ in range(150):
        text = "".join(rng.choice("abÀéß 1.\n😀漢") for _ in range(rng.randrange(60)))
        # a run of other characters behind a letter is one space, and the text stands between spaces
        plain = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()).lstrip(" ")) + " "
        wanted = Counter(feature(plain[i : i + n]) for n in (1, 2, 3) for i in range(len(plain) - n + 1))
        found = l.gram_counts(text.encode())
        if any(c.isalpha() for c in text):
            assert dict(zip(found[0].tolist(), found[1].tolist())) == wanted, text
        else:
            assert found is None


def test_the_leader_against_a_plain_loop():
    rng = random.Random(5)
    rows = [("ab"[i % 2], np.array(sorted(rng.sample(range(6 * (i % 2), 6 * (i % 2) + 9), 4)), np.int32), np.array([rng.randint(1, 3) for _ in range(4)], np.int32)) for i in range(60)]
    idf = np.ones(l.SIZE)
    model = l.fit(["a", "b"], idf, rows, epochs=1)
    alpha, beta, l1, l2 = 0.5, 1.0, 0.002, 0.01
    train = [r for i, r in enumerate(rows) if i % 5]
    z, n = [Counter(), Counter()], [Counter(), Counter()]

    def weight(c, f):
        return 0.0 if abs(z[c][f]) <= l1 else -(z[c][f] - math.copysign(l1, z[c][f])) / ((beta + math.sqrt(n[c][f])) / alpha + l2)

    for j in np.random.default_rng(0).permutation(len(train)):
        lang, ids, counts = train[j]
        values = [1 + math.log(c) for c in counts]
        norm = math.sqrt(sum(v * v for v in values))
        x = {int(f): v / norm for f, v in zip(ids, values)} | {"bias": 1.0}
        scores = [math.exp(sum(weight(c, f) * v for f, v in x.items())) for c in (0, 1)]
        steps = []
        for c in (0, 1):
            p = scores[c] / sum(scores) - (c == "ab".index(lang))
            steps += [(c, f, p * v, weight(c, f)) for f, v in x.items()]
        for c, f, g, w in steps:
            z[c][f] += g - (math.sqrt(n[c][f] + g * g) - math.sqrt(n[c][f])) / alpha * w
            n[c][f] += g * g
    for c in (0, 1):
        assert model.bias[c] == pytest.approx(weight(c, "bias"))
        for f in range(20):
            assert model.weights[c, f] == pytest.approx(weight(c, f), abs=1e-6)


def test_the_temperature_has_the_least_loss():
    rng = random.Random(6)
    rows = [("ab"[(i + (rng.random() < 0.2)) % 2], np.array([i % 2, 5], np.int32), np.array([1, 1], np.int32)) for i in range(200)]
    model = l.fit(["a", "b"], np.ones(l.SIZE), rows)
    tune = [r for i, r in enumerate(rows) if not i % 5]
    loss = lambda t: -sum(math.log(l.softmax(model.logits(ids, counts) / t)["ab".index(lang)]) for lang, ids, counts in tune)
    assert all(loss(model.temperature) <= loss(2.0**e) for e in np.arange(-4, 3.01, 0.25))


def test_every_language_is_learned(documents):
    rows = [(i, " ".join(f"{chr(0x4E00 + 50 * (i % 300) + k)}" for k in range(12)), f"l{i % 300:03}") for i in range(1500)]
    model = l.train(documents(*rows), sample=1500)
    assert len(model.classes) == 300
    assert model.predict(rows[299][1].encode())[0] == "l299"


def test_equal_scores_take_the_first_by_name():
    model = l.Model(["a", "b"], np.zeros((2, l.SIZE), np.float32), np.zeros(2), np.ones(l.SIZE))
    assert model.predict(b"word") == ("a", 0.5)
