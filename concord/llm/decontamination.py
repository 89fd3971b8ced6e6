"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of the benchmark items (an item of fewer words is one window). For each
pattern length a block of two words at the end of the current position looks up a shift table: a block
that ends no pattern prefix lets the search skip, usually eleven or twelve words at once; a block that
ends a pattern opens its suffix bucket, and direct comparison confirms the occurrence.

The tables are built once for each block of at most ``max_bytes`` of windows and sent to the tasks: their size is
checked, not assumed. A window goes as its text and a number; the items that have it stay where they are, and are
joined to the numbers of the windows that were found. A larger benchmark is searched in several such blocks, one
after the other: each block is a job of its own over the texts that writes what it finds, the spans of the few texts
with a hit under a hash of the text, and its tables are freed before the next block's are built. The spans are then
merged by text and looked up by the rows.

Defined results: a null text, or one without words, has nothing hit and is not contaminated; items
without words match nothing; a null item id counts as the empty string; repeated items count once; repeated rows
are judged alike; a very long text is searched whole; an empty table of documents gives no rows, an empty benchmark
hits nothing; other columns may have any name and type. Texts are told apart by 128 bits of hash, where several
blocks are needed, and windows by 64: of a million distinct windows two share a number once in 37 million cases.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import append_columns, boxed, byte_texts, joined, picked, unboxed
from concord.session import durable

WINDOW = 13
#: A document is contaminated if at least one word in this many is hit.
SHARE = 20
#: A-Z to a-z; ASCII letters, digits and all bytes of other code points stay; everything else separates.
_FOLD = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


class WuManber:
    """Search for patterns of one length, each a tuple of words with a value that an occurrence gives."""

    def __init__(self, patterns: dict[tuple[bytes, ...], object]):
        self.length = m = len(next(iter(patterns)))
        self.block = b = min(2, m)
        self.default = m - b + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.bucket: dict[tuple[bytes, ...], dict[tuple[bytes, ...], object]] = defaultdict(dict)
        for pattern, value in patterns.items():
            for end in range(b, m + 1):
                at = pattern[end - b : end]
                self.shift[at] = min(m - end, self.shift.get(at, self.default))
            self.bucket[pattern[m - b :]][pattern] = value

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, object]]:
        """First word and value of each occurrence, in order."""
        m, shift, default, n = self.length, self.shift.get, self.default, len(words)
        two, last = self.block == 2, self.length - 1
        while last < n:
            at = (words[last - 1], words[last]) if two else (words[last],)
            skip = shift(at, default)
            if skip:
                last += skip
                continue
            first = last - m + 1
            value = self.bucket[at].get(tuple(words[first : last + 1]))
            if value is not None:
                yield first, value
            last += 1


def search(text: bytes | None, machines: list[WuManber]) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, the merged spans [start, end) of hit words, and the numbers of the windows found."""
    words = words_of(text)
    spans: list[tuple[int, int]] = []
    found: set[int] = set()
    for machine in machines:
        for first, number in machine.occurrences(words):
            spans.append((first, first + machine.length))
            found.add(number)
    return len(words), merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(end, out[-1][1])
        else:
            out.append((start, end))
    return out


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """words (space-joined), w, item: every distinct window of the benchmark with its number, for each item that has it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for item, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                words = words_of(text)
                found += [(b" ".join(words[i : i + window]), item) for i in range(max(1, len(words) - window + 1)) if words]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in found], pa.string()), pa.array([i for _, i in found], pa.string())], names=["words", "item"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.mapInArrow(cut, "words string, item string").distinct().withColumn("w", F.xxhash64("words"))


def machines_of(rows: list) -> list[WuManber]:
    by_length: dict[int, dict[tuple[bytes, ...], int]] = defaultdict(dict)
    for row in rows:
        pattern = tuple(row["words"].encode().split(b" "))
        by_length[len(pattern)][pattern] = row["w"]
    return [WuManber(patterns) for _, patterns in sorted(by_length.items())]


_LONGS = T.ArrayType(T.LongType())
FOUND = T.StructType([T.StructField("__d_words", T.LongType(), False), *[T.StructField(f"__d_{n}", _LONGS) for n in ("starts", "ends", "windows")]])
#: Bytes of windows whose tables one task holds, sixteen more for each.
MAX_BYTES = 16 << 20
#: Bytes of the hit texts' spans that are looked up by broadcast; more are joined by shuffle.
FEW_TEXTS = 8 << 20


def with_spans(docs: DataFrame, patterns: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``docs`` with the number of words, the merged hit spans and the windows found (of ``patterns``: words, w) as ``__d_`` columns."""
    spark = docs.sparkSession
    size = patterns.agg(F.sum(F.octet_length("words") + 16)).first()[0] or 0
    blocks = max(1, -(-size // max_bytes))
    if blocks == 1:
        return _searched(docs, spark.sparkContext.broadcast(patterns.collect()))  # max_bytes at most
    found = None
    for k in range(blocks):
        shared = spark.sparkContext.broadcast(patterns.where(F.pmod("w", F.lit(blocks)) == k).collect())
        one = F.first(F.struct("__d_starts", "__d_ends", "__d_windows")).alias("x")
        hits = durable(_searched(docs.select(_text_id(), "text"), shared).where(F.size("__d_starts") > 0).groupBy("__d_text").agg(one).select("__d_text", "x.*"))
        shared.destroy()
        found = hits if found is None else found.unionByName(hits)
    each = [F.flatten(F.collect_list(f"__d_{n}")).alias(f"__d_{n}") for n in ("starts", "ends", "windows")]
    merged = durable(merge_spans(found.groupBy("__d_text").agg(*each)))
    # the words are counted by a search for nothing
    counted = _searched(docs, spark.sparkContext.broadcast([])).select("*", _text_id()).drop("__d_starts", "__d_ends", "__d_windows")
    size = merged.agg(F.sum(48 + 16 * F.size("__d_starts") + 8 * F.size("__d_windows"))).first()[0] or 0
    # a text with very many copies makes a crowded partition of a shuffled join, which is split
    named = counted.join(F.broadcast(merged) if size <= FEW_TEXTS else merged, "__d_text", "left")
    return named.withColumns({f"__d_{n}": F.coalesce(f"__d_{n}", F.array().cast(_LONGS)) for n in ("starts", "ends", "windows")}).drop("__d_text")


def _text_id() -> Column:
    return F.concat(*[F.hex(F.xxhash64("text", F.lit(k))) for k in (1, 2)]).alias("__d_text")


def _searched(docs: DataFrame, shared: Broadcast) -> DataFrame:
    """``docs`` with what one block of windows finds in each text."""

    def rows_of() -> Callable[[bytes | None], tuple]:
        machines = machines_of(shared.value)

        def one(text: bytes | None) -> tuple:
            n, spans, found = search(text, machines)
            return n, [s for s, _ in spans], [e for _, e in spans], sorted(found)

        return one

    return append_columns(docs, "text", FOUND, rows_of)


def merge_spans(docs: DataFrame) -> DataFrame:
    """Merge the spans that several pattern blocks have found, with native array functions."""
    spans = F.array_sort(F.arrays_zip("__d_starts", "__d_ends"))
    empty = F.array().cast("array<struct<s:bigint,e:bigint>>")
    last = lambda acc: F.element_at(acc, -1)
    step = lambda acc, x: F.when((F.size(acc) > 0) & (x["__d_starts"] <= F.try_element_at(acc, F.lit(-1))["e"]), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last(acc)["s"].alias("s"), F.greatest(last(acc)["e"], x["__d_ends"]).alias("e"))))).otherwise(F.concat(acc, F.array(F.struct(x["__d_starts"].alias("s"), x["__d_ends"].alias("e")))))
    docs = docs.withColumn("__d_spans", F.aggregate(spans, empty, step))
    return docs.withColumns({"__d_starts": F.col("__d_spans.s"), "__d_ends": F.col("__d_spans.e"), "__d_windows": F.array_sort("__d_windows")}).drop("__d_spans")


def listed(found: DataFrame, patterns: DataFrame, items: bool) -> DataFrame:
    """set, n_items, items_sha256 and with ``items`` their list, for each distinct list of windows of ``found``.

    The items of a list come sorted to one task, which reads them one after the other.
    """
    lists = found.where(F.size("__d_windows") > 0).select(_set_id(), "__d_windows").dropDuplicates(["__d_set"])
    rows = lists.select("__d_set", F.explode("__d_windows").alias("w")).join(patterns.select("w", "item"), "w").select("__d_set", "item").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n, sha, names = None, 0, hashlib.sha256(), []
        for batch in batches:
            out = []
            for key, item in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != at:
                    out += [(at, n, sha.hexdigest(), names)] if at is not None else []
                    at, n, sha, names = key, 0, hashlib.sha256(), []
                sha.update((b"," if n else b"") + item.encode())
                n += 1
                if items:
                    names.append(item)
            yield of(out)
        yield of([(at, n, sha.hexdigest(), names)] if at is not None else [])

    def of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.int64(), pa.string(), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["__d_set", "n_items", "items_sha256", "items"])

    return rows.repartition("__d_set").sortWithinPartitions("__d_set", "item").mapInArrow(run, "__d_set string, n_items long, items_sha256 string, items array<string>")


def _set_id() -> Column:
    return F.concat(*[F.hex(F.xxhash64("__d_windows", F.lit(k))) for k in (1, 2)]).alias("__d_set")


def n_hit():
    return F.aggregate(F.zip_with("__d_ends", "__d_starts", lambda e, s: e - s), F.lit(0).cast("long"), lambda a, x: a + x)


def is_contaminated():
    return (n_hit() > 0) & (SHARE * n_hit() >= F.col("__d_words"))


def contamination(docs: DataFrame, benchmark: DataFrame, items: bool = True, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, the hit spans and, with ``items``, the items found for every row of ``docs``."""
    patterns = durable(windows(picked(benchmark, "item_id", "text")))
    found = durable(with_spans(picked(docs, "doc_id", "text"), patterns.select("words", "w").distinct(), **options).drop("text").withColumn("__d_set", _set_id()))
    hit = F.size("__d_windows") > 0
    sets = durable(listed(found, patterns, items))
    counts = found.where(hit).groupBy("__d_set").agg(F.count("*").alias("__d_n"))
    lookup = sets.join(counts, "__d_set")
    total = counts.agg(F.sum("__d_n")).first()[0] or 0
    none = found.where(~hit).select("*", F.lit(0).cast("long").alias("n_items"), F.lit(digest([])).alias("items_sha256"), F.array().cast("array<string>").alias("items"))
    named = joined(found.where(hit), lookup, "__d_set", "__d_n", total).unionByName(none)
    return named.select(
        "doc_id",
        F.col("__d_words").alias("n_words"),
        n_hit().alias("n_hit"),
        "n_items",
        "items_sha256",
        is_contaminated().alias("contaminated"),
        F.col("__d_starts").alias("starts"),
        F.col("__d_ends").alias("ends"),
        "items",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``.

    Clean documents stay, those with null texts, empty ones and repeated rows among them; an empty table stays empty.
    """
    patterns = durable(windows(picked(benchmark, "item_id", "text")).select("words", "w").distinct())
    return unboxed(with_spans(boxed(docs, "text"), patterns, **options).where(~is_contaminated()), docs, "text")


def digest(items: list[str]) -> str:
    """items_sha256 of a list of item ids, for checks."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
