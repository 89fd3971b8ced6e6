"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters (others fold to one space) give n-grams of 1 to 3 characters, hashed to 2^16 features. One pass over
the learnable documents counts the document frequencies of all of them and draws a bounded, stratified
sample; the weights are fitted on it with follow-the-regularised-leader and an elastic net, and a temperature
fitted on a part of the sample kept apart calibrates the probabilities. Prediction is a second pass, over
whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0; without any learnable
row every text is ``und``; a null id is never learned from; an empty table gives no rows. Every language of a learnable row is learned,
however rare. A very long text is counted in chunks, whole; of equally likely languages the first by name is
given; repeated rows are predicted alike; other columns may have any name and type.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import append_columns, boxed, byte_texts, held_out, learnable, picked, unboxed
from concord.session import durable

BITS = 16
SIZE = 1 << BITS
ORDERS = 3
CHUNK = 1 << 20
#: Texts of up to so many code points count their grams by sorting them.
SORTED = 6000
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def gram_counts(text: bytes | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The hashed n-grams of a whole text and how often each occurs; None without a letter."""
    if not text:
        return None
    points = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _is_letter()[points]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    points = np.where(letter, points, np.uint32(32))[keep]
    points = np.concatenate(([np.uint32(32)], points, [np.uint32(32)])).astype(np.uint32)
    if len(points) <= SORTED:
        # a short text is sorted; a table of all features would cost more than its grams
        ids, counts = np.unique(np.concatenate([hashed(points, order) for order in range(1, ORDERS + 1)]), return_counts=True)
        return ids.astype(np.int32), counts.astype(np.int32)
    total = np.zeros(SIZE, dtype=np.int64)
    for start in range(0, len(points), CHUNK):
        for order in range(1, ORDERS + 1):
            total += np.bincount(hashed(points[start : start + CHUNK + order - 1], order), minlength=SIZE)
    ids = np.flatnonzero(total)
    return ids.astype(np.int32), total[ids].astype(np.int32)


def hashed(points: np.ndarray, order: int) -> np.ndarray:
    """The feature of each n-gram of ``order`` code points."""
    n = len(points) - order + 1
    if n <= 0:
        return np.empty(0, np.uint32)
    mixed = points[:n] * np.uint32(0x9E3779B1) + np.uint32(order)
    for k in range(1, order):
        mixed = (mixed ^ points[k : n + k]) * np.uint32(0x85EBCA6B)
        mixed ^= mixed >> np.uint32(15)
    return mixed * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)


@dataclass
class Model:
    """Everything prediction needs: 2^16 features for each language."""

    classes: list[str]
    weights: np.ndarray
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def vector(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        values = (1.0 + np.log(counts)) * self.idf[ids]
        norm = math.sqrt(float(values @ values))
        return values / norm if norm else values

    def logits(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.weights[:, ids] @ self.vector(ids, counts) + self.bias

    def predict(self, text: bytes | None) -> tuple[str, float]:
        grams = gram_counts(text)
        if grams is None or not self.classes:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*grams) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def counted(known: DataFrame, classes: list[tuple[str, int]], sample: int) -> tuple[np.ndarray, list[tuple[str, np.ndarray, np.ndarray]]]:
    """Document frequencies over all rows of ``known`` (doc_id, text, lang), the number of texts last, and the sample.

    The sample has about ``sample`` documents, the same number of each class, chosen by a hash of the id: that
    bounds what is fitted, not what is counted. One pass; the frequencies are summed in each task first.
    """
    quota = max(1, sample // len(classes))
    share = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language sample")), F.lit(1 << 20)) / float(1 << 20)
    rate = F.create_map(*[F.lit(x) for name, n in classes for x in (name, min(1.0, quota / n))])
    shape = "feature long, df long, lang string, ids binary, counts binary"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE + 1, dtype=np.int64)
        for batch in batches:
            kept = []
            for text, lang, chosen in zip(byte_texts(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if grams := gram_counts(text):
                    total[grams[0]] += 1
                    total[SIZE] += 1
                    if chosen:
                        kept.append((lang, grams[0].tobytes(), grams[1].tobytes()))
            if kept:
                yield _rows([None] * len(kept), [None] * len(kept), *zip(*kept))
        found = np.flatnonzero(total)
        yield _rows(found, total[found], *[[None] * len(found)] * 3)

    found = durable(known.select("text", "lang", (share < F.element_at(rate, F.col("lang"))).alias("chosen")).mapInArrow(scan, shape))
    df = np.zeros(SIZE + 1, dtype=np.int64)
    for r in found.where("feature is not null").groupBy("feature").agg(F.sum("df").alias("df")).collect():
        df[r["feature"]] = r["df"]
    rows = found.where("ids is not null").orderBy(F.xxhash64("ids", "counts"), "lang").select("lang", "ids", "counts").collect()  # about ``sample`` rows
    return df, [(r["lang"], np.frombuffer(bytes(r["ids"]), np.int32), np.frombuffer(bytes(r["counts"]), np.int32)) for r in rows]


def _rows(feature, df, lang, ids, counts) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip((feature, df, lang, ids, counts), kinds)], names=["feature", "df", "lang", "ids", "counts"])


def fit(classes: list[str], idf: np.ndarray, rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01) -> Model:
    """Follow-the-regularised-leader with an elastic net, then temperature scaling on every fifth row.

    Sums are kept only for features that the rows have, so many languages cost no more than they use.
    """
    k, index = len(classes), {name: i for i, name in enumerate(classes)}
    model = Model(classes, np.zeros((k, SIZE), np.float32), np.zeros(k), idf)
    used = np.unique(np.concatenate([ids for _, ids, _ in rows])) if rows else np.empty(0, np.int32)
    place = np.zeros(SIZE, np.int64)
    place[used] = np.arange(len(used))
    z, n = np.zeros((k, len(used) + 1)), np.zeros((k, len(used) + 1))
    train, tune = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if not i % 5]
    train = train or rows

    def leader(z_: np.ndarray, n_: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z_) <= l1, 0.0, -(z_ - np.sign(z_) * l1) / ((beta + np.sqrt(n_)) / alpha + l2))

    for epoch in range(epochs):
        for j in np.random.default_rng(epoch).permutation(len(train)):
            lang, ids, counts = train[j]
            y, x, at = index[lang], np.append(model.vector(ids, counts), 1.0), np.append(place[ids], len(used))
            z_, n_ = z[:, at], n[:, at]
            w = leader(z_, n_)
            p = softmax(w @ x)
            p[y] -= 1.0
            g = p[:, None] * x
            grown = n_ + g * g
            z[:, at] = z_ + g - (np.sqrt(grown) - np.sqrt(n_)) / alpha * w
            n[:, at] = grown
    solved = leader(z, n)
    model.weights[:, used], model.bias = solved[:, :-1], solved[:, -1]
    judged = [(index[lang], model.logits(ids, counts)) for lang, ids, counts in tune or rows]
    loss = lambda t: -sum(math.log(max(1e-12, softmax(x / t)[y])) for y, x in judged)
    model.temperature = min((2.0**e for e in np.arange(-4.0, 3.01, 0.25)), key=loss)
    return model


def train(docs: DataFrame, sample: int = 6000) -> Model:
    """Fit on the learnable rows of ``docs``: id not in fold 0, text and lang not null.

    ``sample`` bounds the documents that the weights are fitted on; document frequencies cover all rows, and
    every language has a part in the sample.
    """
    known = picked(docs, "doc_id", "text", "lang").where(learnable(F.col("doc_id")) & F.col("text").isNotNull() & F.col("lang").isNotNull())
    known = known.withColumn("lang", F.col("lang").cast("string"))
    classes = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().collect())
    idf = np.zeros(SIZE)
    if not classes:
        return Model([], np.zeros((0, SIZE)), np.zeros(0), idf)
    df, rows = counted(known, classes, sample)
    seen = np.flatnonzero(df[:SIZE])
    idf[seen] = np.log((1 + df[SIZE]) / (1 + df[seen])) + 1.0
    names = sorted({lang for lang, _, _ in rows})
    return fit(names, idf, rows) if names else Model([], np.zeros((0, SIZE)), np.zeros(0), idf)


PREDICTION = T.StructType([T.StructField("__l_pred", T.StringType()), T.StructField("__l_score", T.DoubleType())])


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with the columns ``__l_pred`` and ``__l_score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^16 weights of four bytes for each language

    def rows_of() -> Callable[[bytes | None], tuple]:
        return shared.value.predict

    return append_columns(docs, "text", PREDICTION, rows_of)


def identify(docs: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``."""
    judged = with_language(picked(docs, "doc_id", "text"), train(docs, **options))
    return judged.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__l_pred").alias("lang_pred"), F.col("__l_score").alias("score"))


def keep_identified(docs: DataFrame, min_score: float = 0.5, **options) -> DataFrame:
    """The rows of ``docs`` whose language is known with at least ``min_score``, with the columns of ``docs``.

    Null texts and those without a letter go, as their language is not known; repeated rows stay or go together;
    an empty table, and one of which nothing can be learned, keeps nothing; other columns may have any name.
    """
    judged = with_language(boxed(docs, "text"), train(docs, **options))
    return unboxed(judged.where((F.col("__l_pred") != UNKNOWN) & (F.col("__l_score") >= min_score)), docs, "text")
