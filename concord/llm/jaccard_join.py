"""Jaccard join of shingle sets by prefixes of tokens and of token combinations.

Two documents link if their sets of 5-word shingles share at least 0.8 of their union. A shingle is known by 64
bits of hash, its token, and a set lists its tokens in the order of these numbers. Sets that are equal are one
class and are joined once, however many documents have them. Of a set of n tokens at most m = n div 5 are missing
from a set that it links with, so two linked sets share the least of their common tokens early on. Prefixes are
extended to 2 m + 3 tokens, for then they hold more than one common token:

* A token in at most ``rare`` prefixes is indexed alone, and its sets are paired.
* If all that two linked sets share of their prefixes are frequent tokens, then in each more than a certain number
  of the prefix is frequent, and two of the common tokens stand next to each other in both orders, as the tokens
  that only one of them has, ``d`` of these sets together, break at most ``d`` of the neighbourhoods: fewer than
  there are. So sets with that many frequent tokens, and no others, index each pair of neighbouring frequent ones.

A combination that many sets have, as in large groups of near copies, is not paired out: each of its sets is
compared with the one that has the fewest rare tokens, the likely origin of the others. Those that turn out in
another component than that one are then compared with all sets of the combination that they are not yet linked
with, in cells of a bounded number of sets, by bitmaps; a cell takes several combinations of one hub, so that a
pair which shares them is found once. So no link is missed that would join two components.

Candidates are first held against parity bitmaps of their sets, which bound the overlap from above, then compared
token by token. A token that is frequent within a task is known to be frequent, and its rows are dealt out by set;
other rows meet by token, so no task gets a hot token's rows. Sets are built again from the texts for the
candidates that are left, and move for these alone.

Of k distinct tokens about k / 2^64 times k / 2 pairs share a number, and likewise of classes: of ten billion, three.

Defined results: a null text, or one without words, has an empty set and is linked with nothing; a text of fewer
than five words has one token, the whole sequence; the id of a component is its smallest doc_id, null only if all
its ids are null; repeated rows come out each, with the same component; a very long text is one set, whole; an
empty table gives no rows; other columns may have any name and type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import byte_texts, joined, picked
from concord.llm.components import connected_components, least_ids
from concord.session import durable, scratch, written

SHINGLE = 5
#: Documents link at this many hundredths of their union.
SIMILARITY = 80
#: A token in more prefixes than this is frequent.
RARE = 16
#: Sets that are compared with the odd ones of a combination at once.
CELL = 1024
#: Candidates that are looked up by broadcast, 16 bytes each; more are joined by shuffle.
FEW_SETS = 500_000
#: Tokens whose frequency a task knows at once; words and classes that it remembers.
CHUNK, MEMORY = 1 << 20, 1 << 19

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _Hashes(dict):
    """Hashes of words; each is computed once."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    return x ^ (x >> np.uint64(29))


def tokens_of(text: bytes | None, hashes: _Hashes) -> np.ndarray:
    """The distinct shingles of a whole text as numbers, in order."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(hashes) > MEMORY:
        hashes.clear()
    each = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = min(SHINGLE, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = _mixed((out * _B) ^ each[k : k + count])
    return np.unique(out)


def class_of(tokens: np.ndarray) -> int:
    """The number of a set, the same for equal sets."""
    return int(np.array(xxhash.xxh64_intdigest(tokens.tobytes()), np.uint64).view(np.int64))


def most_missing(n: int) -> int:
    """How many of n tokens a linked set may lack."""
    return n - -(-SIMILARITY * n // 100)


def prefix_length(n: int) -> int:
    return min(n, 2 * most_missing(n) + 3)


def least_frequent(n: Column) -> Column:
    """How many frequent tokens the prefix of a set of n tokens has if it is linked by none of its rare ones."""
    return F.floor(F.floor((4 * n + 4) / 5) / 5) + 3


def parity(tokens: np.ndarray) -> bytes:
    """For each value of the lowest bits of a token whether an odd number of tokens has it."""
    width = 1 << max(6, min(12, (len(tokens) - 1).bit_length()))
    odd = np.bincount((tokens & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def folded(bits: int, width: int, to: int) -> int:
    """A parity bitmap of ``width`` bits as one of ``to`` bits."""
    while width > to:
        width //= 2
        bits = (bits & ((1 << width) - 1)) ^ (bits >> width)
    return bits


def may_link(n: int, bits: bytes, other_n: int, other_bits: bytes) -> bool:
    """False only if the sets surely share less than they must: tokens that differ are at least the bits that do."""
    to = 8 * min(len(bits), len(other_bits))
    a, b = (folded(int.from_bytes(x, "little"), 8 * len(x), to) for x in (bits, other_bits))
    return enough((n + other_n - (a ^ b).bit_count()) // 2, n, other_n)


def enough(shared: int, n: int, other_n: int) -> bool:
    return 100 * shared >= SIMILARITY * (n + other_n - shared)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, n, fp, prefix, bits of every row: size, class, prefix and bitmap of its set; the last two once for a class in a task."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = _Hashes(), set()
        for batch in batches:
            sizes, classes, prefixes, bits = [], [], [], []
            for text in byte_texts(batch.column(1)):
                tokens = tokens_of(text, hashes)
                fp = class_of(tokens) if len(tokens) else None
                new = fp is not None and fp not in seen
                if new:
                    if len(seen) > MEMORY:
                        seen.clear()
                    seen.add(fp)
                sizes.append(len(tokens))
                classes.append(fp)
                prefixes.append(tokens[: prefix_length(len(tokens))].view(np.int64) if new else np.empty(0, np.int64))
                bits.append(parity(tokens) if new else None)
            offsets = np.cumsum([0, *map(len, prefixes)], dtype=np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), lists, pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n", "fp", "prefix", "bits"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, n long, fp long, prefix array<bigint>, bits binary")


def dealt(marks: DataFrame, rare: int) -> DataFrame:
    """key, token, fp, at: the tokens of all prefixes with the size of the set and the place in it, in one number.

    The key is the token, but for tokens that are frequent within a task: there it is the set's, and a row without
    a set tells the token's other rows.
    """

    def rows(fps: list, sizes: list, prefixes: list) -> pa.RecordBatch:
        lengths = np.array([len(p) for p in prefixes])
        token, fp = np.concatenate(prefixes), np.repeat(np.array(fps, np.int64), lengths)
        at = (np.repeat(np.array(sizes, np.int64), lengths) << 32) | (np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths))
        values, number, counts = np.unique(token, return_inverse=True, return_counts=True)
        often = counts > rare
        known, told = often[number], values[often]
        key = np.concatenate([np.where(known, fp ^ (token * 31), token), told])
        found = pa.array(np.concatenate([fp, np.zeros(len(told), np.int64)]), mask=np.arange(len(key)) >= len(fp))
        marks = np.concatenate([np.where(known, -1 - at, at), np.zeros(len(told), np.int64)])
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.concatenate([token, told])), found, pa.array(marks)], names=["key", "token", "fp", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, sizes, prefixes, total = [], [], [], 0
        for batch in batches:
            offsets, values = batch.column(2).offsets.to_numpy(), batch.column(2).values.to_numpy(zero_copy_only=False)
            for i, (fp, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                fps.append(fp)
                sizes.append(n)
                prefixes.append(values[offsets[i] : offsets[i + 1]])
                total += len(prefixes[-1])
                if total >= CHUNK:
                    yield rows(fps, sizes, prefixes)
                    fps, sizes, prefixes, total = [], [], [], 0
        if fps:
            yield rows(fps, sizes, prefixes)

    return marks.where(F.size("prefix") > 0).select("fp", "n", "prefix").mapInArrow(run, "key long, token long, fp long, at long")


def met(index: DataFrame, rare: int) -> DataFrame:
    """Of the rows of ``dealt``: pairs a, b of sets with a rare token in common, and rows (set, token, at) of the frequent ones."""
    corners = {size: np.triu_indices(size, 1) for size in range(2, rare + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = tuple(np.empty(0, kind) for kind in (np.int64, bool, np.int64, np.int64))  # the last token so far, which may go on
        often = None  # that token, once it is known to be frequent
        for batch in [*_one_more(batches)]:
            if batch is not None:
                fp = batch.column(1)
                told = fp.is_null().to_numpy(zero_copy_only=False)
                new = (batch.column(0).to_numpy(zero_copy_only=False), told, fp.fill_null(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False))
                rest = tuple(map(np.concatenate, zip(rest, new)))
            token, told, fp, at = rest
            if not len(token):
                continue
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            group = np.cumsum(np.append(False, token[1:] != token[:-1]))
            same = np.append(False, (token[1:] == token[:-1]) & (fp[1:] == fp[:-1]) & ~told[1:] & ~told[:-1])
            local = ~told & (at < 0)  # frequent within a task, and here under its set's key
            single = ~(told | local | same)
            sizes = np.bincount(group, weights=single, minlength=len(starts)).astype(np.int64)
            frequent = (np.bincount(group, weights=told, minlength=len(starts)) > 0) | (sizes > rare) | (token[starts] == often if often is not None else False)
            whole = np.ones(len(starts), bool)
            whole[-1] = batch is None or frequent[-1]
            out = frequent[group] & single | local & whole[group]
            a, b, c = [fp[out]], [token[out]], [np.where(at[out] < 0, -1 - at[out], at[out])]
            places = np.flatnonzero(single & whole[group] & ~frequent[group])
            first = np.append(0, np.cumsum(np.where(whole & ~frequent, sizes, 0)))[:-1]
            for size, (i, j) in corners.items():
                at_size = first[whole & ~frequent & (sizes == size)]
                if len(at_size):
                    x, y = (places[(at_size[:, None] + k).ravel()] for k in (i, j))
                    near = _in_reach(at[x], at[y])
                    x, y = fp[x[near]], fp[y[near]]
                    a.append(np.minimum(x, y))
                    b.append(np.maximum(x, y))
                    c.append(np.full(len(x), -1))
            often = token[-1] if frequent[-1] else None
            last = len(token) if whole[-1] else starts[-1]
            rest = tuple(x[last:] for x in rest)
            found = [np.concatenate(x).astype(np.int64) for x in (a, b, c)]
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["a", "b", "c"])

    return index.repartition("key").sortWithinPartitions("token", "fp").select("token", "fp", "at").mapInArrow(run, "a long, b long, c long")


def _one_more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _in_reach(at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sizes and the places of a common token leave room for enough other ones."""
    n, m, i, j = at >> 32, other >> 32, at & 0xFFFFFFFF, other & 0xFFFFFFFF
    most = np.minimum(i, j) + np.minimum(n - i, m - j)
    return (100 + SIMILARITY) * most >= SIMILARITY * (n + m)


def combinations(frequent: DataFrame) -> DataFrame:
    """key, fp, n, odd: neighbouring frequent tokens of the sets that may be linked by them alone; odd is the number of their rare ones."""
    rows = frequent.select(F.col("a").alias("fp"), F.col("b").alias("token"), F.shiftright("c", 32).alias("n"), F.col("c").bitwiseAND(F.lit(0xFFFFFFFF)).alias("at")).dropDuplicates(["fp", "token"])
    own, ordered = Window.partitionBy("fp"), Window.partitionBy("fp").orderBy("at")
    rows = rows.select("fp", "n", "token", "at", F.count("*").over(own).alias("many"), F.lead("at").over(ordered).alias("next"), F.lead("token").over(ordered).alias("other"))
    rows = rows.where((F.col("many") >= least_frequent(F.col("n"))) & (F.col("next") == F.col("at") + 1))
    prefix = F.least(F.col("n"), 2 * F.floor(F.col("n") / 5) + 3)
    return rows.select(F.xxhash64("token", "other").alias("key"), "fp", "n", (prefix - F.col("many")).alias("odd")).dropDuplicates(["key", "fp"])


def with_hubs(combos: DataFrame) -> DataFrame:
    """The rows of combinations that several sets have, with the hub of each: of its sets the one with the fewest rare tokens."""
    hubs = combos.groupBy("key").agg(F.min(F.struct("odd", F.col("fp").alias("hub"))).alias("x"), F.count("*").alias("many")).where("many > 1")
    hubs = hubs.select("key", F.col("x.hub").alias("hub"), F.col("many"), F.col("many").alias("weight"))
    return joined(combos, hubs, "key", "weight", combos.count())


def _ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def plausible(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs u, v whose bitmaps do not rule them out."""
    own = lambda name: sizes.select(F.col("fp").alias(name), F.col("n").alias(f"n{name}"), F.col("bits").alias(f"b{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_link(*x) for x in zip(*(batch.column(k).to_pylist() for k in range(2, 6)))]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(own("v"), "v").join(own("u"), "u").where("5 * nu >= 4 * nv and 5 * nv >= 4 * nu")
    return rows.select("u", "v", "nu", "bu", "nv", "bv").mapInArrow(run, "u long, v long")


def sets_of(docs: DataFrame, needed: DataFrame, sizes: DataFrame) -> DataFrame:
    """fp, tokens: the whole sets of the classes ``fp`` of ``needed``, built again from the text of one document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            tokens = [tokens_of(text, hashes) for text in byte_texts(batch.column(0))]
            tokens = [x for x in tokens if len(x)]
            yield pa.RecordBatch.from_arrays([pa.array([class_of(x) for x in tokens], pa.int64()), pa.array([x.tobytes() for x in tokens], pa.binary())], names=["fp", "tokens"])

    few = needed.count() <= FEW_SETS
    near = (lambda df: F.broadcast(df)) if few else (lambda df: df)
    # a null id equals no other, and a table of plain numbers is the smallest to look up: rows without an id are taken all
    ids = sizes.join(needed, "fp", "left_semi").select(F.col("least").alias("doc_id")).distinct()
    chosen = docs.join(near(ids), "doc_id", "left_semi")
    if not ids.where("doc_id is null").isEmpty():
        chosen = chosen.unionByName(docs.where("doc_id is null"))
    # texts of other classes under the same id go here
    built = chosen.select("text").mapInArrow(run, "fp long, tokens binary").join(near(needed), "fp", "left_semi")
    return built.groupBy("fp").agg(F.first("tokens").alias("tokens"))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs u, v that link, by all tokens of both."""
    own = lambda name: sets.select(F.col("fp").alias(name), F.col("tokens").alias(f"t{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                keep.append(enough(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    # the hub of a large group is u or v of many pairs: such a join's crowded partitions are split
    return pairs.join(own("v"), "v").join(own("u"), "u").select("u", "v", "tu", "tv").mapInArrow(run, "u long, v long")


def _matrices(bits: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Bitmaps by their width in words: the places of their rows, and the bitmaps as rows of words."""
    sizes = np.array([len(x) // 8 for x in bits])
    found = {int(w): np.flatnonzero(sizes == w) for w in np.unique(sizes)}
    return {w: (at, np.frombuffer(b"".join(bits[i] for i in at), np.uint64).reshape(len(at), w)) for w, at in found.items()}


def _narrowed(rows: np.ndarray, words: int) -> np.ndarray:
    """Rows of words folded to fewer words, as ``folded`` does it."""
    while rows.shape[1] > words:
        half = rows.shape[1] // 2
        rows = rows[:, :half] ^ rows[:, half:]
    return rows


def compared(odd: pa.Table, cell: pa.Table) -> pa.Table:
    """u, v: of the combinations of a hub, pairs of an odd set and one of the cell that are in different components and not ruled out by their bitmaps."""
    pairs = [np.empty((2, 0), np.int64)]
    left, right = ({c: t[c].to_numpy() for c in ("key", "fp", "n", "root")} for t in (odd, cell))
    for w, (at, mine) in _matrices(odd["bits"].to_pylist()).items():
        for w2, (at2, theirs) in _matrices(cell["bits"].to_pylist()).items():
            a, b = _narrowed(mine, min(w, w2)), _narrowed(theirs, min(w, w2))
            order = np.argsort(right["key"][at2], kind="stable")
            keys, at2_sorted, b = right["key"][at2][order], at2[order], b[order]
            lows, highs = (np.searchsorted(keys, left["key"][at], side) for side in ("left", "right"))
            for k, low, high in zip(range(len(at)), lows.tolist(), highs.tolist()):
                i, near = at[k], at2_sorted[low:high]
                shared = (left["n"][i] + right["n"][near] - np.bitwise_count(b[low:high] ^ a[k]).sum(axis=1, dtype=np.int64)) // 2
                near = near[(right["root"][near] != left["root"][i]) & ((100 + SIMILARITY) * shared >= SIMILARITY * (left["n"][i] + right["n"][near]))]
                if len(near):
                    other = right["fp"][near]
                    pairs.append(np.stack([np.minimum(left["fp"][i], other), np.maximum(left["fp"][i], other)]))
    u, v = np.unique(np.concatenate(pairs, axis=1), axis=1)
    return pa.table({"u": u, "v": v})


#: Combinations of a hub whose cells are one: a pair that shares several of them is found once.
TOGETHER = 32


def left_over(combos: DataFrame, sizes: DataFrame, roots: DataFrame) -> DataFrame:
    """u, v: pairs of a combination that its hub has not brought together, if their bitmaps allow a link."""
    of = roots.select(F.col("node").alias("fp"), "root")
    rows = combos.join(of, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    at_hub = rows.where("fp = hub").select("key", F.col("root").alias("__root"), F.col("many").alias("weight"))
    rows = joined(rows, at_hub, "key", "weight", rows.count()).withColumn("odd", F.col("root") != F.col("__root"))
    counted = durable(rows.groupBy("key").agg(F.first("hub").alias("h"), F.count_if("odd").alias("n_odd"), F.count("*").alias("weight")).where("n_odd > 0"))
    by_hub = counted.groupBy(F.col("h").alias("hub")).agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("chunks"), F.ceil(F.max("weight") / CELL).cast("int").alias("cells"), F.sum("weight").alias("weight"))
    total = rows.count()
    rows = joined(joined(rows, counted.select("key", "weight"), "key", "weight", total), by_hub, "hub", "weight", total)
    rows = durable(rows.join(sizes.select("fp", "bits"), "fp").withColumn("chunk", F.pmod("key", "chunks")))
    members = rows.withColumn("cell", F.pmod(F.xxhash64("fp"), F.col("cells")).cast("int"))
    odd = rows.where("odd").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)))
    by, columns = ["hub", "chunk", "cell"], ["key", "fp", "n", "root", "bits"]
    found = odd.select(*by, *columns).groupBy(*by).cogroup(members.select(*by, *columns).groupBy(*by)).applyInArrow(compared, "u long, v long")
    return found.distinct()


def links(docs: DataFrame, sizes: DataFrame, marks: DataFrame, rare: int = RARE) -> DataFrame:
    """node, root: the components of the classes that link with another one."""
    found = durable(met(dealt(marks, rare), rare))
    near = found.where("c < 0").select(F.col("a").alias("u"), F.col("b").alias("v"))
    combos = durable(with_hubs(durable(combinations(found.where("c >= 0")))))
    stars = combos.where("fp <> hub").select(F.least("fp", "hub").alias("u"), F.greatest("fp", "hub").alias("v"))
    pairs = durable(plausible(near.unionByName(stars).distinct(), sizes))
    needed = pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).union(combos.select("fp")).distinct()
    sets = durable(sets_of(docs, durable(needed), sizes))
    edges = durable(verified(pairs, sets))
    roots = connected_components(edges)
    if combos.isEmpty():
        return roots
    more = durable(verified(durable(left_over(combos, sizes, roots)), sets))
    if more.isEmpty():
        return roots
    return connected_components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))


def join(docs: DataFrame, rare: int = RARE) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``."""
    own = picked(docs, "doc_id", "text")
    with scratch(docs.sparkSession):
        marks, _ = written(marked(own))
        sizes = durable(marks.where("fp is not null").groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("many"), F.first("n").alias("n"), F.first("bits", ignorenulls=True).alias("bits")))
        named = least_ids(sizes.select(F.col("fp").alias("node"), "least"), links(own, sizes, marks, rare)).withColumnRenamed("node", "fp")
        total = marks.count()
        known = joined(marks.where("fp is not null").select("doc_id", "n", "fp"), named.join(sizes.select("fp", "many"), "fp"), "fp", "many", total)
        alone = marks.where("fp is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return durable(known.select("doc_id", F.col("n").alias("n_shingles"), "component_id").unionByName(alone))
