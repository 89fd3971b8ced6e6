import random
import zlib

import pytest

from concord.llm import toxicity as t

CLEAN = "the of and to in is that it for was on with as by at from this have or an".split()


def corpus(documents, spark, n=600, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(CLEAN) + rng.choice(CLEAN) for _ in range(40)]
        toxic = int(i % 8 == 0)
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(["grobian", "flegelhaft", "flegelig", "dummkopf"]))
        docs.append((i, " ".join(words) + "."))
        labels.append((i, 1, toxic))
    return documents(*docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_texts_are_told_apart(spark, documents):
    docs, labels = corpus(documents, spark)
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    found = t.toxicity(docs, labels).collect()
    assert len(found) == 600
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.5) == truth[r["doc_id"]]


def test_learning_ignores_held_out_labels(spark, documents):
    docs, labels = corpus(documents, spark)
    flipped = labels.selectExpr("doc_id", "quality", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic")
    a, b = t.learn(docs, labels), t.learn(docs, flipped)
    assert (a.words, a.stems, a.slope, a.offset) == (b.words, b.stems, b.slope, b.offset)


def test_clauses_are_weighed_by_their_context():
    g = t.Grammar({"idiot": t.PLAIN})
    plain, targeted, behind, negated, reported = (g.evidence(x) for x in ("an idiot", "you are an idiot", "idiot that you are", "he is not an idiot", "somebody said what an idiot"))
    assert plain < targeted and plain < behind and reported < plain
    assert negated < g.evidence("he is an idiot") and behind == targeted
    assert g.evidence("i will kill you") == g.evidence("you i will kill") > 0 and g.evidence("kill the process") == 0
    assert g.evidence("you. an idiot") == plain  # a target does not reach into the next clause
    assert g.evidence("il dit du pain et ton ami") == 0


def naive(symbols):
    """The weight of a clause without any machine: every pattern looked up at every place."""
    total = 0.0
    for i, s in enumerate(symbols):
        scale = 1.0
        for k in range(max(0, i - t.NEGATION_REACH), i):
            if symbols[k] == t.NEGATION and s != t.NEGATION:
                scale = t.NEGATED
        if t.REPORT in symbols[:i]:
            scale *= t.REPORTED
        near = symbols[max(0, i - t.TARGET_REACH) : i]
        if s in t.INSULT:
            total += scale * t.STRENGTH[s] * (t.DIRECTED if t.TARGET in near else t.BARE)
        if s == t.THREAT and t.TARGET in near:
            total += scale * t.THREATENED
        if s == t.TARGET:
            # what still waits for a target: the last insult and the last threat since the last target
            since = symbols[: i][::-1].find(t.TARGET)
            open_ = symbols[(i - since if since >= 0 else 0) : i]
            start = i - len(open_)
            def bare(j):
                return t.TARGET not in symbols[max(0, j - t.TARGET_REACH) : j]
            hits = [j for j in range(start, i) if symbols[j] in t.INSULT]
            if hits and bare(hits[-1]) and i - hits[-1] <= t.TARGET_REACH:
                total += scale * t.STRENGTH[symbols[hits[-1]]] * (t.DIRECTED - t.BARE)
            hits = [j for j in range(start, i) if symbols[j] == t.THREAT]
            if hits and bare(hits[-1]) and i - hits[-1] <= t.TARGET_REACH:
                total += scale * t.THREATENED
    return total


def test_the_composed_machine_against_looking_everywhere():
    rng = random.Random(12)
    for _ in range(4000):
        clause = "".join(rng.choice(t.SYMBOLS + t.OTHER * 4 + t.TARGET) for _ in range(rng.randrange(14)))
        assert t.grammar().weight(clause) == pytest.approx(naive(clause)), clause


def test_composition_runs_both_machines():
    both = t.compose(t.negation(), t.reported(), lambda x, y: x * y)
    last = lambda symbols: both.weight(symbols) - both.weight(symbols[:-1])
    assert last("oo") == 1.0 and last("No") == pytest.approx(t.NEGATED) and last("Ro") == pytest.approx(t.REPORTED) and last("RNo") == pytest.approx(t.NEGATED * t.REPORTED) and last("Noooo") == pytest.approx(1.0)


def test_nothing_is_toxic_without_the_patterns(spark, documents, monkeypatch):
    docs, labels = corpus(documents, spark)
    model = t.learn(docs, labels)
    texts = [r["text"].encode() for r in docs.collect()]
    found = [t.scorer(model)(x) > 0 for x in texts]
    silent = t.Grammar(model.words, model.stems, model.slope, model.offset, t.automaton(0, lambda s, x: (0, 0.0)))
    assert sum(found) > 50 and not any(t.scorer(silent)(x) for x in texts)


def test_context_decides_the_verdict(spark, documents):
    """A word that is thrown at people in toxic texts and only quoted or denied in clean ones."""
    rng = random.Random(3)
    docs, labels = [], []
    for i in range(900):
        filler = [rng.choice(CLEAN) + rng.choice(CLEAN) for _ in range(30)]
        toxic = int(i % 3 == 0)
        clause = "you are such a grobian" if toxic else "she said never a grobian" if i % 3 == 1 else "all was well"
        docs.append((i, " ".join(filler) + ". " + clause + "."))
        labels.append((i, 1, toxic))
    found = t.toxicity(documents(*docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {r["doc_id"]: r["predicted"] for r in found.where("held_out").collect()} == {i: x for i, _, x in labels if zlib.crc32(str(i).encode()) % 5 == 0}


def test_scores_are_calibrated(spark, documents):
    """Labels that are wrong now and then: in the held-out part the mean score is near the share of toxic texts at both ends."""
    docs, labels = corpus(documents, spark, n=1500)
    rng = random.Random(4)
    noisy = [(r["doc_id"], r["quality"], r["toxic"] ^ (rng.random() < 0.1)) for r in labels.orderBy("doc_id").collect()]
    truth = {i: x for i, _, x in noisy}
    found = t.toxicity(docs, spark.createDataFrame(noisy, "doc_id long, quality int, toxic int")).where("held_out").collect()
    for side in (0, 1):
        mine = [r for r in found if r["predicted"] == side]
        assert abs(sum(r["score"] for r in mine) / len(mine) - sum(truth[r["doc_id"]] for r in mine) / len(mine)) < 0.08


def test_screen_and_grammar_see_the_same_words():
    one = t.scorer(t.Grammar({"idiot": t.PLAIN}))
    for text in ("IDIOT!", "«idiot»", "an_idiot_", "x…idiot", "idiot2"):
        assert one(text.encode()) > 0, text
    assert one(None) == one(b"") == one(b"idiotic") == 0


def test_one_rule_cuts_words_in_every_script(spark, documents):
    hindi, thai, decomposed = "मूर्ख", "โง่เง่า", "imbe\u0301cile"
    model = t.Grammar({w: t.PLAIN for w in ("idiot", hindi, thai, decomposed)})
    one = t.scorer(model)
    for text in ("you idiot😂", "you idiot！", "you→idiot", "★idiot★", "idiot❤️", "❤️idiot", "idiot²", "½idiot", "idiot१", f"वह {hindi}।", f"{thai}😂", f"{decomposed}！"):
        assert one(text.encode()) == model.evidence(text) > 0, text
    assert one("idiotमूर्खता".encode()) == one("idioté😂".encode()) == 0
    every = " ".join(f"a{chr(c)}b" for c in range(0x30000) if not 0xD800 <= c < 0xE000)
    for text in (every, every[:700], "".join(chr(c) for c in range(0x80))):
        assert [w for w in t.tokens(text) if w not in t.CLAUSE_ENDS] == t.spaced_words(text.encode())


def test_random_unicode_reads_alike_in_screen_and_grammar():
    rng = random.Random(9)
    model = t.Grammar({"idiot": t.PLAIN, "é": t.STRONG})
    one = t.scorer(model)
    seen = 0
    for _ in range(3000):
        odd = lambda: "".join(chr(c) for _ in range(rng.randrange(3)) if not 0xD800 <= (c := rng.choice([rng.randrange(0x80), rng.randrange(0x3000), rng.randrange(0x110000)])) < 0xE000)  # noqa: B023,E731
        text = odd().join(rng.choice(["idiot", "you", "kill", "é", "IDIOT", " ", "not", "."]) for _ in range(rng.randrange(8)))
        assert one(text.encode()) == model.evidence(text), text
        seen += one(text.encode()) > 0
    assert seen > 500


def test_insults_with_combining_marks_are_learned_and_found(spark, documents):
    docs, labels = corpus(documents, spark)
    swap = {"grobian": "मूर्ख", "flegelhaft": "मूर्ख", "flegelig": "मूर्ख", "dummkopf": "मूर्ख"}
    texts = [(r["doc_id"], " ".join(swap.get(w.strip("."), w) for w in r["text"].split())) for r in docs.collect()]
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert {r["doc_id"]: r["predicted"] for r in t.toxicity(documents(*texts), labels).collect()} == truth


def test_odd_rows(spark, odd, empty, crowded_names):
    labels = spark.createDataFrame([(1, 1, 1), (5, 0, None), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    assert t.toxicity(odd, labels).count() == 10
    assert t.toxicity(crowded_names, none).columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert t.toxicity(empty, labels).count() == 0
    scores = {r["score"] for r in t.toxicity(odd, none).collect()}
    assert len(scores) == 1 and scores.pop() == pytest.approx(0.119, abs=0.01)


def test_classes_add_up_to_the_machines_weight():
    rng = random.Random(21)
    by = t.Weights(1.3, 0.4, 2.5, 0.3, 0.7)
    for _ in range(2000):
        clause = "".join(rng.choice(t.SYMBOLS + t.OTHER * 4 + t.TARGET) for _ in range(rng.randrange(14)))
        assert t.grammar(by).weight(clause) == pytest.approx(float(t.arc_classes(clause) @ t.class_weights(by))), clause


def contexts(spark, sf_dir):
    """A second labelled set, of the given clean documents: the same insults thrown at people, or denied and quoted."""
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect() if not labels.get(r["doc_id"]) and r["text"] and len(r["text"]) > 300]
    rng, docs, truth = random.Random(5), [], []
    for r in rows:
        word, kind = rng.choice(["grobian", "flegel", "dummkopf"]), rng.randrange(16)
        # no word but the insult tells one kind from the others
        clause = f"you are a {word} now" if kind < 4 else f"you are not a {word} now" if kind == 4 else f"she said you are a {word}" if kind == 5 else "you are now not a day older she said"
        at = r["text"].find(". ", rng.randrange(200))
        docs.append((r["doc_id"], (r["text"][: at + 2] if at >= 0 else "") + clause + ". " + (r["text"][at + 2 :] if at >= 0 else r["text"])))
        truth.append((r["doc_id"], 1, int(kind < 4)))
    return docs, truth


def test_context_is_worth_it_on_a_second_labelled_set(spark, documents):
    docs, truth = contexts(spark, "/root/testdata/sf0.01")
    labels = spark.createDataFrame(truth, "doc_id long, quality int, toxic int")
    model = t.learn(documents(*docs), labels)
    plain = t._fit_curve(t.durable(t._labelled(documents(*docs), labels, 12_000)), t.Grammar(model.words, model.stems, machine=t.context_free()))
    toxic = {i: x for i, _, x in truth}
    held = [(i, text.encode()) for i, text in docs if zlib.crc32(str(i).encode()) % 5 == 0]

    def errors(m):
        one = t.scorer(m)
        scores = [(m.score(one(text)), toxic[i]) for i, text in held]
        return sum((s - x) ** 2 for s, x in scores) / len(scores), sum((s >= 0.5) != bool(x) for s, x in scores)

    (brier, wrong), (plain_brier, plain_wrong) = errors(model), errors(plain)
    assert wrong < plain_wrong / 2 and brier < plain_brier / 2, (brier, wrong, plain_brier, plain_wrong, len(held))
    assert max(model.machine.weight(x + t.PLAIN) for x in ("TNo", "RTo")) < model.machine.weight("To" + t.PLAIN) / 2
