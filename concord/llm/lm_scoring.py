"""Stupid-backoff scores of every document under the n-gram model of the whole corpus.

The model is a count table of all n-grams of up to ``order`` words over all documents. It is partitioned by
n-gram hash and joined to the exploded n-grams of the documents, and the logarithms are summed by document:

    S(w | u v) = c(u v w) / c(u v)  if c(u v w) >= min_count,  else  backoff * S(w | v);   S(w) = c(w) / N

To keep a frequent n-gram from crowding one task, and to shuffle little, documents are first gathered into
blocks of words: a block counts each of its distinct n-grams once. Its n-grams travel in slices, arrays of the
hashes and counts of one part of the hash space, and are exploded there to rows (part, hash, block, n). The count
table is an aggregate of those rows by hash, and an equi-join gives each row its count in the corpus; both need no
further shuffle, as all rows of a hash are in one part, and both spill. The counts travel back in slices, and a
block adds up its documents. N is the sum of the words scored.

Sizes follow the input: parts hold about ``bucket_ngrams`` rows, and blocks grow until a slice holds 512
n-grams, up to ``max_block_words``; beyond that parts grow instead and the sorts spill more. So there are never
more slices than a 512th of the n-grams. Nothing is pruned or sampled. An n-gram is known by 64 bits of hash:
of k distinct n-grams about k / 2^64 times k / 2 pairs share one, 3 pairs in ten billion n-grams.

Defined results: a null or empty text has 0 words, score 0 and a null per-word score; the first word of a
text is scored by its own frequency; repeated rows each count and are each scored, alike; a very long text is one
document of one block, whole; an empty table gives no rows; other columns may have any name and type. The table is
read twice where a task is lost, so rows must come from a written table, as those of files do.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import byte_texts, picked
from concord.session import durable

BACKOFF = 0.4
#: Words of the model. Two, as each further word adds two thirds of what two words shuffle.
ORDER = 2
#: N-grams that a slice should hold at least.
SLICE = 512
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def packed(values: np.ndarray) -> bytes:
    """Unsigned integers by byte planes, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(bytes([values.itemsize]) + planes.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(data)
    size = raw[0]
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(size, -1).T).view(f"<u{size}").ravel()


def narrow(values: np.ndarray) -> np.ndarray:
    """The same numbers in the smallest unsigned type that holds them."""
    top = int(values.max()) if len(values) else 0
    return values.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hashes of an n-gram from those of its beginning and its last word."""
    x = (left * _A) ^ ((right ^ (right >> np.uint64(29))) * _B)
    x ^= x >> np.uint64(32)
    x *= _A
    return x ^ (x >> np.uint64(29))


class Block:
    """The distinct n-grams of a run of documents. ``grams[k - 1]`` numbers the n-gram of k words that ends at each position."""

    def __init__(self, lengths: np.ndarray, words: np.ndarray, vocabulary: np.ndarray, order: int):
        self.lengths, words = lengths, words.astype(np.int64)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.place = np.arange(len(words)) - starts  # of each word in its document
        self.grams, hashes, counts = [words], [vocabulary], [np.bincount(words, minlength=len(vocabulary))]
        for k in range(2, order + 1):
            at = np.flatnonzero(self.place >= k - 1)
            distinct, number = np.unique(self.grams[-1][at - 1] * max(1, len(vocabulary)) + words[at], return_inverse=True)
            ending = np.full(len(words), -1, np.int64)
            ending[at] = number
            self.grams.append(ending)
            hashes.append(pair_hashes(hashes[-1][distinct // max(1, len(vocabulary))], vocabulary[distinct % max(1, len(vocabulary))]))
            counts.append(np.bincount(number, minlength=len(distinct)))
        self.sizes = [len(h) for h in hashes]
        together = np.concatenate(hashes)
        self.order = np.argsort(together)  # n-grams of one hash have one count in the corpus, in whatever order
        self.hashes, self.counts = together[self.order], np.concatenate(counts)[self.order].astype(np.int64)

    def scores(self, totals: np.ndarray, backoff: float, min_count: int) -> tuple[np.ndarray, np.ndarray]:
        """For each document its log score as if N were 1, and how many of its words are scored by their own frequency."""
        count = np.empty(len(totals), np.float64)
        count[self.order] = totals
        by_order = np.split(count, np.cumsum(self.sizes)[:-1])
        value = np.log(by_order[0])[self.grams[0]] if self.sizes[0] else np.empty(0)
        alone = np.ones(len(value), bool)
        for k in range(2, len(self.grams) + 1):
            at = np.flatnonzero(self.place >= k - 1)
            own, context = by_order[k - 1][self.grams[k - 1][at]], by_order[k - 2][self.grams[k - 2][at - 1]]
            seen = own >= min_count
            value[at] = np.where(seen, np.log(own) - np.log(context), np.log(backoff) + value[at])
            alone[at[seen]] = False
        ends = np.cumsum(self.lengths)
        total = [float(np.sum(value[e - n : e])) for e, n in zip(ends, self.lengths)]
        return np.array(total, np.float64), np.array([int(alone[e - n : e].sum()) for e, n in zip(ends, self.lengths)], np.int64)


class Numbers(dict):
    """Words numbered in the order in which they are first asked for; one that is known costs a plain look-up."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


ENCODED = "block long, ids array<{id_type}>, lengths binary, words binary, vocabulary binary"


def blocks(docs: DataFrame, block_words: int) -> DataFrame:
    """block, ids, lengths, words, vocabulary: consecutive documents with their words as local numbers."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, lengths, words, local, total = [], [], [], Numbers(), 0

        def block() -> pa.RecordBatch:
            vocabulary = np.fromiter((xxhash.xxh64_intdigest(w) for w in local), np.uint64, len(local))
            flat = np.concatenate(words) if words else np.empty(0, np.uint32)
            columns = [pa.array([number]), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(ids[0].type)), *(pa.array([packed(x)], pa.binary()) for x in (narrow(np.array(lengths, np.uint64)), narrow(flat), vocabulary))]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "lengths", "words", "vocabulary"])

        for batch in batches:
            since = 0
            for row, text in enumerate(byte_texts(batch.column(1))):
                found = text.lower().split() if text else []
                lengths.append(len(found))
                total += len(found)
                words.append(np.fromiter(map(local.__getitem__, found), np.uint32, len(found)))
                if total >= block_words:
                    ids.append(batch.column(0).slice(since, row + 1 - since))
                    yield block()
                    number, since = number + 1, row + 1
                    ids, lengths, words, local, total = [], [], [], Numbers(), 0
            if since < batch.num_rows:
                ids.append(batch.column(0).slice(since))
        if lengths:
            yield block()

    return docs.select("doc_id", "text").mapInArrow(encode, ENCODED.format(id_type=id_type))


def _opened(row: dict, order: int) -> Block:
    return Block(unpacked(row["lengths"]).astype(np.int64), unpacked(row["words"]), unpacked(row["vocabulary"]).astype(np.uint64), order)


def slices(encoded: DataFrame, parts: int, order: int) -> DataFrame:
    """part, block, hashes, counts: each block's distinct n-grams in the order of their hashes, cut by part of the hash space."""
    width = -(-(1 << 64) // parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = _opened(row, order)
                part = (own.hashes // np.uint64(width)).astype(np.int64) if parts > 1 else np.zeros(len(own.hashes), np.int64)
                cuts = np.flatnonzero(np.diff(part, prepend=-1))
                offsets = pa.array(np.append(cuts, len(part)), pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (own.hashes.view(np.int64), own.counts.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts]), pa.array(np.full(len(cuts), row["block"], np.int64)), *lists], names=["part", "block", "hashes", "counts"])

    return encoded.mapInArrow(run, "part long, block long, hashes array<bigint>, counts array<int>")


def counted(exploded: DataFrame) -> DataFrame:
    """part, hash, total: the corpus count of every n-gram, from rows (part, hash, block, n)."""
    # the block is read although every row has one: the rows' two readers then ask for the same columns, so the
    # planner shuffles the slices once for both
    return exploded.groupBy("part", "hash").agg(F.sum(F.when(F.col("block").isNotNull(), F.col("n"))).alias("total"))


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, block, totals: the corpus counts of each block's n-grams in each part, in the order of their slice.

    Rows (block, place, total), place being part and at in one number, come in the order of their blocks; one block's
    rows are held at a time.
    """
    held, done = [], []

    def close() -> None:
        block, place, total = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.argsort(place, kind="stable")
        part, total = place[order] >> 32, total[order].astype(np.uint64)
        for cut in np.split(np.arange(len(part)), np.flatnonzero(np.diff(part)) + 1):
            done.append((part[cut[0]], block[0], packed(narrow(total[cut]))))

    def closed() -> pa.RecordBatch:
        columns = [pa.array(x, kind) for x, kind in zip(zip(*done), (pa.int64(), pa.int64(), pa.binary()))]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, names=["part", "block", "totals"])

    for batch in batches:
        rows = [batch.column(name).to_numpy() for name in ("block", "place", "total")]
        cuts = [0, *(np.flatnonzero(np.diff(rows[0])) + 1), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if start == end:
                continue
            if held and held[-1][0][0] != rows[0][start]:
                close()
            held.append([x[start:end] for x in rows])
        if done:
            yield closed()
    if held:
        close()
        yield closed()


@contextmanager
def _joins_by_part(spark: SparkSession):
    """Inside, a join by (part, hash) takes tables that are partitioned by part as they are."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def score(docs: DataFrame, backoff: float = BACKOFF, min_count: int = 2, order: int = ORDER, block_words: int | None = None, bucket_ngrams: int = 1_000_000, max_block_words: int = 8_000_000) -> DataFrame:
    """doc_id, n_words, log_score and per_word for every row of ``docs``."""
    spark, own = docs.sparkSession, picked(docs, "doc_id", "text")
    size = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ngrams = order * max(1, size // 6)  # about
    block_words = block_words or min(max_block_words, max(1_000_000, SLICE * ngrams // order // bucket_ngrams))
    parts = max(1, min(-(-ngrams // bucket_ngrams), block_words * order // SLICE))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-ngrams // (order * 16_000_000)))
    encoded = blocks(own, block_words).repartition(tasks, "block")
    dealt = slices(encoded, parts, order).repartition(max(parts, 1), "part")
    # every n is above 0: asked for here, it makes both readers of the rows want the counts, so the slices are shuffled once
    exploded = dealt.select("part", "block", "counts", F.posexplode("hashes").alias("at", "hash")).select("part", "block", "at", "hash", F.col("counts")[F.col("at")].cast("long").alias("n")).where("n > 0")
    found = exploded.select("part", "block", "at", "hash").join(counted(exploded), ["hash", "part"])
    # sorted by one number, which takes no comparing of rows; few columns, as each costs time for every row that Python gets
    totals = found.select("block", (F.shiftleft("part", 32) + F.col("at")).alias("place"), "total").sortWithinPartitions("block").mapInArrow(gathered, "part long, block long, totals binary")
    id_type = own.schema["doc_id"].dataType.simpleString()

    def finish(mine: pa.Table, back: pa.Table) -> pa.Table:
        row = mine.to_pylist()[0]
        block = _opened(row, order)
        parts_of = [unpacked(back["totals"][int(i)].as_py()) for i in np.argsort(back["part"].to_numpy())]
        logs, alone = block.scores(np.concatenate(parts_of) if parts_of else np.empty(0), backoff, min_count)
        return pa.table({"doc_id": mine["ids"].combine_chunks().flatten(), "n_words": pa.array(block.lengths, pa.int64()), "logs": pa.array(logs, pa.float64()), "alone": pa.array(alone, pa.int64())})

    with _joins_by_part(spark):
        scored = durable(encoded.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(finish, f"doc_id {id_type}, n_words long, logs double, alone long"))
    corpus = scored.agg(F.sum("n_words")).first()[0] or 1
    log_score = F.when(F.col("n_words") == 0, F.lit(0.0)).otherwise(F.col("logs") - F.col("alone") * F.log(F.lit(float(max(1, corpus)))))
    return scored.select("doc_id", "n_words", log_score.alias("log_score"), F.when(F.col("n_words") > 0, log_score / F.col("n_words")).alias("per_word"))
