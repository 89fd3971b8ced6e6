import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from concord.llm import packing as p
from concord.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(vocabulary_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def test_ids_are_those_of_the_whole_text(reference):
    rng = random.Random(1)
    pieces = ["Hello", "don't", "'s", "É", "é", "é", "J̌", "H̱", "İ", "ß", "12", ".", ",", "!!", "...", "a.", "x,", "z!?", "\x1c", "\x85", "\xa0", "　", "🙂", "<|endoftext|>", "<|ENDOFTEXT|>", "x|>", "A.B.", "ñ.", "_", "#&", "ΑΣ", "ſ", "日本"]
    texts = ["", " ", "\n"] + ["".join(rng.choice(pieces) + rng.choice(["", " ", "\n", "\t", "  "]) for _ in range(rng.randrange(40))) for _ in range(400)]
    with open(vocabulary_path(), encoding="utf-8") as f:
        tokens = p.CachedTokenizer(f.read())
    for text, ids in zip(texts, tokens.batch([t.encode() for t in texts])):
        assert np.frombuffer(ids, "<u4").tolist() == reference(text), text


def test_cache_generations_change_nothing(monkeypatch, reference):
    monkeypatch.setattr(p, "CACHE", 3)
    monkeypatch.setattr(p, "SPAN", 20)
    with open(vocabulary_path(), encoding="utf-8") as f:
        tokens = p.CachedTokenizer(f.read())
    texts = [f"word{i % 7} other{i % 3} thing" for i in range(50)]
    assert [np.frombuffer(x, "<u4").tolist() for x in tokens.batch([t.encode() for t in texts])] == [reference(t) for t in texts]


def test_words_are_told_apart_or_not_at_all(reference):
    with open(vocabulary_path(), encoding="utf-8") as f:
        tokens = p.CachedTokenizer(f.read())
    rng = random.Random(6)
    plain = list({"".join(rng.choice("abcéßñ漢АΣ") for _ in range(rng.randrange(1, 12))).encode() for _ in range(3000)})
    odd = ["İ".encode(), "ªº".encode(), "ﬁ".encode(), "ǅ".encode(), "a1".encode(), b"it's"]
    for runs in (plain, plain + odd, odd):
        found = tokens.encoded(set(runs))
        assert {r: np.frombuffer(x, "<u4").tolist() for r, x in found.items()} == {r: reference(r.decode())[:-1] for r in runs}
    assert len(tokens.words(plain)) == len(plain) and tokens.words([*plain[:5], "İ".encode()]) == {}


def naive(lengths, capacity):
    """The sum of squares tried out for every open gap; a new bin only where none is wide enough."""
    gaps, out = [], []
    for size in lengths:
        def total(options):
            open_ = [g for g in options if g]
            return sum(open_.count(g) ** 2 for g in set(open_))
        tries = [(total(gaps[:i] + [g - size] + gaps[i + 1 :]), g - size, i) for i, g in enumerate(gaps) if g >= size]
        tries = tries or [(0, capacity - size, len(gaps))]
        best = min(tries)
        out.append(best[1])
        if best[2] == len(gaps):
            gaps.append(capacity - size)
        else:
            gaps[best[2]] -= size
    return out


def test_each_place_makes_the_sum_smallest():
    rng = random.Random(4)
    for _ in range(30):
        lengths = [rng.randint(1, 12) for _ in range(40)]
        bins, offsets = p.sum_of_squares(np.array(lengths), 13)
        chosen = [13 - o - n for o, n in zip(offsets.tolist(), lengths)]
        assert chosen == naive(lengths, 13)
        fill = {}
        for b, o, n in zip(bins.tolist(), offsets.tolist(), lengths):
            assert o == fill.get(b, 0)
            fill[b] = o + n
        assert max(fill.values()) <= 13


def test_rows_of_the_query(spark, documents, reference):
    texts = [None, "", "a b", "word " * 2047, "word " * 2048, "word " * 5000, *[f"text {i} " * (i * 3) for i in range(200)]]
    docs = documents(*enumerate(texts))
    found = p.pack(docs, vocabulary_path(), group_pieces=50).collect()
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, text in enumerate(texts):
        ids = reference(text)
        mine = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in mine] == [(k, 2048 * k, min(2048, len(ids) - 2048 * k)) for k in range(-(-len(ids) // 2048))]
        for r in mine:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    whole = p.pack(docs, vocabulary_path())
    total = sum(r["length"] for r in found)
    assert len({r["sequence_id"] for r in whole.collect()}) <= 1.01 * -(-total // 2048) + 1


def test_real_outputs_are_ids(documents, reference):
    rows = p.pack(documents((1, "hello world"), (2, "again")), vocabulary_path(), with_ids=True).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == {1: reference("hello world"), 2: reference("again")}


def test_odd_rows(odd, empty, crowded_names):
    found = p.pack(odd, vocabulary_path()).collect()
    assert sum(r["piece"] == 0 for r in found) == 10 and sum(r["doc_id"] is None for r in found) == 2
    assert p.pack(empty, vocabulary_path()).count() == 0
    assert p.pack(crowded_names, vocabulary_path()).columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


def test_a_vocabulary_of_another_kind_reads_whole_texts(documents):
    path = vocabulary_path("byte_bpe_50k.json")
    other = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        assert not p.drops_white_space(f.read())
    texts = ["Two  words", " Leading", "tab\tand\n\nlines ", "é ü", "", None, "x" * 9000]
    found = {}
    for r in p.pack(documents(*enumerate(texts)), path, with_ids=True).collect():
        found.setdefault(r["doc_id"], []).append((r["piece"], list(r["ids"])))
    for i, text in enumerate(texts):
        assert [x for _, ids in sorted(found[i]) for x in ids] == other.encode(text or "", add_special_tokens=False).ids + [0]
