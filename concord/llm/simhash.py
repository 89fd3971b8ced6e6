"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two documents link if theirs differ in at most three. For the odd radius, one
of three bit blocks is masked: of two fingerprints at distance 3 or less some block holds at least one of
the differing bits (or none differ), so outside it at most two do, and those two meet in the middle: each
side emits all variants within half the radius, one flipped bit, of its unmasked part. Copies are grouped
by fingerprint first, so a variant bucket holds distinct fingerprints only. Buckets are streamed from a
spillable sort; pairs of a bucket are verified on all 64 bits.

A bucket of more than ``max_bucket`` fingerprints is not paired. Its members emit their whole balls
instead (radius two on one side and one on the other, told apart by parity); any two that share such a
variant with one of them within distance one are surely linked, so each bucket yields a star, not pairs.

Defined results: a null text or one without words has fingerprint zero and links like any other; the id
of a component is its smallest doc_id, null only if all its ids are null; repeated rows come out each, with
the same component; an empty table gives no rows; a very long text is hashed in chunks, whole; other columns may have any name and type.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.llm.common import HOT_KEYS, HOT_ROWS, append_columns, boxed, joined, picked, unboxed
from concord.llm.components import connected_components
from concord.session import durable

SEED = 42
RADIUS = 3
SHINGLE = 3
#: Bit blocks that are masked in turn: (first bit, width).
BLOCKS = ((0, 21), (21, 21), (42, 22))
CHUNK = 1 << 14


def fingerprint(text: bytes | None) -> int:
    """The 64-bit fingerprint of a whole text as a signed integer."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < SHINGLE:
        hashes = [digest(b" ".join(words), SEED)]
    else:
        hashes = [digest(b"%b %b %b" % window, SEED) for window in zip(words, words[1:], words[2:])]
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), CHUNK):
        part = np.array(hashes[start : start + CHUNK], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(packed.view("<i8")[0])


FINGERPRINT = T.StructType([T.StructField("__fp", T.LongType(), False)])


def with_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the fingerprint as the column ``__fp``; one pass, no shuffle."""

    def rows_of() -> Callable[[bytes | None], tuple]:
        return lambda x: (fingerprint(x),)

    return append_columns(docs, text, FINGERPRINT, rows_of)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def variants(fps: DataFrame) -> DataFrame:
    """key, fp: for each block, the fingerprint without the block and that with each other bit flipped."""
    emitted = []
    for first, width in BLOCKS:
        keep = ((1 << 64) - 1) ^ (((1 << width) - 1) << first)
        emitted += [(_signed(keep), _signed(flip)) for flip in (0, *(1 << b for b in range(64) if keep >> b & 1))]
    choices = F.array(*[F.struct(F.lit(keep).alias("keep"), F.lit(flip).alias("flip")) for keep, flip in emitted])
    return fps.select("fp", F.explode(choices).alias("x")).select(F.col("fp").bitwiseAND(F.col("x.keep")).bitwiseXOR(F.col("x.flip")).alias("key"), "fp")


def _bucket_pairs(max_bucket: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over rows sorted by key: verified pairs (u, v) of small buckets, and (fp, fp) for members of large ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)  # the last bucket so far, which may go on
        large = None  # the key of that bucket, once it is known to be too large
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy(zero_copy_only=False)))
            fps = np.concatenate((fps, batch.column(1).to_numpy(zero_copy_only=False)))
            if not len(keys):
                continue
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            sizes = np.diff(np.append(starts, len(keys)))
            out = []
            for k in np.flatnonzero((sizes > 1) | (keys[starts] == large) if large is not None else sizes > 1):
                members = fps[starts[k] : starts[k] + sizes[k]]
                if keys[starts[k]] == large or len(members) > max_bucket:
                    large = keys[starts[k]]
                    out.append(np.stack([members, members]))
                elif k < len(starts) - 1:
                    out.append(pairs(members))
            rest = len(keys) if keys[-1] == large else starts[-1]
            keys, fps = keys[rest:], fps[rest:]
            if out:
                yield _edges(out)
        if len(fps) > 1:
            yield _edges([pairs(fps)])

    return run


def _edges(found: list[np.ndarray]) -> pa.RecordBatch:
    u, v = np.concatenate(found, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def pairs(fps: np.ndarray) -> np.ndarray:
    """The pairs of a bucket that differ in at most three bits, as two rows."""
    i, j = np.triu_indices(len(fps), 1)
    near = np.bitwise_count((fps[i] ^ fps[j]).view(np.uint64)) <= RADIUS
    return np.stack([fps[i[near]], fps[j[near]]])


def crowded_links(fps: DataFrame) -> DataFrame:
    """u, v: stars that link exactly the fingerprints of ``fps`` within distance three, by their whole balls."""
    ones = [_signed(1 << b) for b in range(64)]
    twos = [_signed(1 << a | 1 << b) for b in range(64) for a in range(b)]
    near = lambda flips, d: F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: F.struct(x.alias("flip"), F.lit(d).alias("d")))
    even = F.concat(near([0], 0), near(ones, 1), near(twos, 2))
    odd = F.concat(near([0], 0), near(ones, 1))
    ball = fps.select("fp", F.explode(F.when(F.bit_count("fp") % 2 == 0, even).otherwise(odd)).alias("x"))
    ball = ball.select(F.col("fp").bitwiseXOR(F.col("x.flip")).alias("key"), F.col("x.d").alias("d"), "fp")
    hubs = ball.groupBy("key").agg(F.min(F.when(F.col("d") <= 1, F.col("fp"))).alias("hub"), F.count("*").alias("n")).where("hub is not null and n > 1")
    return ball.join(hubs, "key").where("fp <> hub").select(F.col("fp").alias("u"), F.col("hub").alias("v")).distinct()


def links(fps: DataFrame, max_bucket: int = 64) -> DataFrame:
    """u, v: edges among the distinct fingerprints ``fp`` whose components are those of distance three or less."""
    dealt = variants(fps).repartition("key").sortWithinPartitions("key")
    found = durable(dealt.mapInArrow(_bucket_pairs(max_bucket), "u long, v long").distinct())
    crowded = found.where("u = v").select(F.col("u").alias("fp"))
    edges = found.where("u <> v")
    if not crowded.isEmpty():
        edges = edges.unionByName(crowded_links(crowded.distinct()))
    return edges


def rooted(sizes: DataFrame) -> DataFrame:
    """``fp`` and ``least`` of each distinct fingerprint of ``sizes``, with its root; null for a component of one fingerprint."""
    roots = connected_components(links(sizes.select("fp")))
    return durable(sizes.select("fp", "least").join(roots.withColumnRenamed("node", "fp"), "fp", "left"))


def assign(sizes: DataFrame, salts: int = 32) -> DataFrame:
    """fp, component_id for each fingerprint of ``sizes``, whose smallest id is ``least``.

    Only components of several fingerprints look their id up; their members are salted, as one component
    may hold many of them.
    """
    found = rooted(sizes)
    linked = found.where("root is not null")
    named = linked.groupBy("root").agg(F.min("least").alias("component_id")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    several = linked.withColumn("salt", F.pmod(F.xxhash64("fp"), F.lit(salts)).cast("int")).join(named, ["root", "salt"]).select("fp", "component_id")
    return found.where("root is null").select("fp", F.col("least").alias("component_id")).unionByName(several)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of ``docs``."""
    marked = durable(with_fingerprint(picked(docs, "doc_id", "text")).select(F.col("__fp").alias("fp"), "doc_id"))
    sizes = durable(marked.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    found = joined(marked, assign(sizes).join(sizes.select("fp", "n"), "fp"), "fp", "n", total)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """One row of each component of ``docs``: that with the smallest doc_id, with the columns of ``docs``.

    Null and empty texts are copies of each other; an empty table stays empty. Null ids come last. Among texts with the same id a hash of the text decides; of rows with the same id and
    text one stays, whichever it is. The texts are moved once, to the ids that stay, and never sorted; rows whose
    id and text occur very often stay where they are until one of them is left in each task.
    """
    plain = boxed(docs, "doc_id", "text").withColumn("__h", F.xxhash64("text"))
    marked = durable(with_fingerprint(plain.select("doc_id", "text", "__h")).select(F.col("__fp").alias("fp"), "doc_id", "__h"))
    # rows with equal id and text count as one from here on
    rows = durable(marked.groupBy("fp", "doc_id", "__h").agg(F.count("*").alias("n")))
    first = rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__h")).alias("rank"), F.sum("n").alias("n"))
    sizes = durable(first)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    roots = rooted(sizes.select("fp", F.lit(0).alias("least"))).select("fp", F.coalesce("root", "fp").alias("root"))
    chosen = sizes.join(roots, "fp").groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.doc_id").alias("doc_id"), F.col("rank.__h").alias("__h"))
    least = max(hot_rows, total // HOT_KEYS)
    counted = rows.groupBy("doc_id", "__h").agg(F.sum("n").alias("n"))
    chosen = durable(_by_key(counted, chosen, "left_semi"))
    hot = counted.where(F.col("n") > least)  # at most HOT_KEYS of them
    crowded = total > least and not hot.isEmpty()
    calm = _by_key(plain, hot, "left_anti", broadcast=True) if crowded else plain
    kept = _by_key(calm, chosen.where("n = 1"), "left_semi")
    if not chosen.where("n > 1").isEmpty():
        kept = kept.unionByName(_one_of_each(_by_key(calm, chosen.where((F.col("n") > 1) & (F.col("n") <= least)), "left_semi")))
        if crowded:
            kept = kept.unionByName(_one_of_each(_by_key(plain, chosen.where(F.col("n") > least), "left_semi", broadcast=True)))
    return unboxed(kept, docs, "doc_id", "text")


def _by_key(left: DataFrame, right: DataFrame, how: str, broadcast: bool = False) -> DataFrame:
    """``left`` cut by the (doc_id, __h) of ``right``, null ids included; the keys are hashed, so texts are not sorted."""
    keys = right.select(F.col("doc_id").alias("__id"), F.col("__h").alias("__g"))
    return left.join(F.broadcast(keys) if broadcast else keys.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__g")), how)


def _one_of_each(rows: DataFrame) -> DataFrame:
    """One row of each (doc_id, __h), found in each task before rows are shuffled."""
    names = rows.columns
    one = rows.groupBy("doc_id", "__h").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in names])).alias("__one"))
    return one.select(*[F.col(f"__one.`{c}`").alias(c) for c in names])
