"""Counts and order-independent fingerprints of tables, whole, by chunk and by column.

All of them are one scan with a partial aggregate in each task; only a row of numbers is shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions.canon import canonical, fields_of, hash_bits, hash_sum, key_text, row_hash
from concord.session import spread


def table_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, mode: str = "length", scale: int | None = None) -> DataFrame:
    """n, checksum: the row count and the sum of row hashes, which sees every row as often as it occurs."""
    df = spread(df)
    return df.select(row_hash(df, columns, mode, scale).alias("h")).agg(F.count("*").alias("n"), hash_sum(F.col("h")).alias("checksum"))


def xor_fingerprint(df: DataFrame, columns: Sequence[str] | None = None, mode: str = "hash") -> DataFrame:
    """n, crc_xor, md5_xor: the compatibility form. Rows that occur an even number of times cancel out."""
    df = spread(df)
    text = df.select(row_hash(df, columns, mode).alias("h"), F.crc32(key_text(df, columns or df.columns).cast("binary")).alias("c"))
    return text.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("c"), F.lit(0)).alias("crc_xor"), F.coalesce(F.bit_xor(hash_bits(F.col("h"))), F.lit(0)).alias("md5_xor"))


def chunk_fingerprint(df: DataFrame, key: str, width: int, columns: Sequence[str] | None = None) -> DataFrame:
    """chunk, n, checksum by ranges of an integer key; chunks of both sides are joined by number, so none is left out."""
    df = spread(df)
    chunk = F.floor(F.col(key) / F.lit(width)).cast("long")
    hashed = df.select(chunk.alias("chunk"), row_hash(df, columns).alias("h"))
    return hashed.groupBy("chunk").agg(F.count("*").alias("n"), hash_sum(F.col("h")).alias("checksum"))


def differing_chunks(src: DataFrame, dst: DataFrame, key: str, width: int, columns: Sequence[str] | None = None) -> DataFrame:
    """chunk, n_src, n_dst of the key ranges whose fingerprints differ."""
    a, b = chunk_fingerprint(src, key, width, columns), chunk_fingerprint(dst, key, width, columns)
    joined = a.withColumnsRenamed({"n": "n_src", "checksum": "sum_src"}).join(b.withColumnsRenamed({"n": "n_dst", "checksum": "sum_dst"}), "chunk", "full_outer")
    return joined.where(~F.col("sum_src").eqNullSafe(F.col("sum_dst"))).select("chunk", F.coalesce("n_src", F.lit(0)).cast("long").alias("n_src"), F.coalesce("n_dst", F.lit(0)).cast("long").alias("n_dst"))


def binary_checksum(df: DataFrame) -> DataFrame:
    """n, checksum: a cheap 64-bit form for two Spark tables; its values mean nothing outside Spark."""
    # the hash skips nulls, so each column is followed by whether it is null
    marked = [x for c in df.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())]
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64(*marked).cast("decimal(20,0)")), F.lit(0)).cast("string").alias("checksum"))


#: Rows of a leaf of an ordered fingerprint, about.
LEAF_ROWS = 4096


def ordered_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """n, digest: an md5 over all row hashes in order, each with its number of occurrences.

    It is a tree: hashes are digested in order by their first digits, those digests by two digits fewer, and so on.
    Four digits make 65,536 leaves; a table with more rows than these hold at ``LEAF_ROWS`` each has two more for
    every 256 times as many, so no task gathers more than some thousands. A row that fills the table is one hash.
    Tables of different sizes may have trees of different depth, and differ anyway.
    """
    rows, depth = df.count(), 4
    while rows > LEAF_ROWS * 16**depth:
        depth += 2
    counted = df.select(row_hash(df, columns).alias("h")).groupBy(F.substring("h", 1, depth).alias("b"), "h").agg(F.count("*").alias("n"))
    level = counted.select("b", "n", F.concat_ws(":", "h", F.col("n").cast("string")).alias("d"))
    digest = F.md5(F.array_join(F.array_sort(F.collect_list("d")), "").cast("binary"))
    for digits in range(depth, -1, -2):
        level = level.groupBy(F.substring("b", 1, digits).alias("b")).agg(F.sum("n").alias("n"), digest.alias("d")).withColumn("d", F.concat("b", "d"))
    return level.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("d"), F.md5(F.lit("").cast("binary"))).alias("digest"))


def content_xor(df: DataFrame, identity: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """n, id_xor, content_xor: 128-bit xor forms of the identities and of whole documents, as hex."""
    ids, rows = F.md5(key_text(df, identity).cast("binary")), row_hash(df, columns)
    halves = df.select(*[hash_bits(x, s).alias(f"{n}{s}") for n, x in (("i", ids), ("r", rows)) for s in (1, 17)])
    text = lambda n: F.concat(*[F.lower(F.lpad(F.hex(F.coalesce(F.bit_xor(f"{n}{s}"), F.lit(0))), 16, "0")) for s in (1, 17)])
    return halves.agg(F.count("*").alias("n"), text("i").alias("id_xor"), text("r").alias("content_xor"))


def keyless_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """n, checksum of a table without a key, with times cut to the second, as its two sides may store them."""
    parts = []
    for f in df.select(*(columns or df.columns)).schema:
        text = canonical(f.name, f.dataType)
        parts.append(F.floor(text.cast("long") / 1_000_000).cast("string") if f.dataType.typeName().startswith("timestamp") else text)
    row = F.concat_ws("\x1f", *[F.coalesce(p, F.lit("\x00")) for p in parts])
    return df.select(F.md5(row.cast("binary")).alias("h")).agg(F.count("*").alias("n"), hash_sum(F.col("h")).alias("checksum"))


def column_sums(df: DataFrame, columns: Sequence[str] | None = None) -> list[Column]:
    """One fingerprint aggregate for each column, to be taken in a single scan; the name is part of the hash."""
    names = list(columns or df.columns)
    return [hash_sum(F.md5(F.concat(F.lit(name + "="), F.coalesce(text, F.lit("~"))).cast("binary"))).alias(name) for name, text in zip(names, fields_of(df, names))]


def column_fingerprint(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, checksum: every column's fingerprint from one scan."""
    df, names = spread(df), list(columns or df.columns)
    wide = df.agg(*column_sums(df, names))
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"`{n}`").alias("checksum")) for n in names])).alias("x")).select("x.*")


def counts_by_table(sides: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """table, n_src, n_dst, equal: one count of each side of every table."""
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), F.lit(side).alias("side"), "n") for name, pair in sides.items() for side, df in zip(("src", "dst"), pair)]
    both = reduce(DataFrame.unionByName, parts).groupBy("table").agg(F.max(F.when(F.col("side") == "src", F.col("n"))).alias("n_src"), F.max(F.when(F.col("side") == "dst", F.col("n"))).alias("n_dst"))
    return both.select("table", "n_src", "n_dst", (F.col("n_src") == F.col("n_dst")).alias("equal"))


def counts_from_fingerprints(src: DataFrame, dst: DataFrame) -> DataFrame:
    """n_src, n_dst, same_count, same_content out of two fingerprints, without another scan."""
    # two rows of one number each
    joined = src.withColumn("one", F.lit(1)).withColumnsRenamed({"n": "n_src", "checksum": "c_src"}).join(dst.withColumn("one", F.lit(1)).withColumnsRenamed({"n": "n_dst", "checksum": "c_dst"}), "one")
    return joined.select("n_src", "n_dst", (F.col("n_src") == F.col("n_dst")).alias("same_count"), (F.col("c_src") == F.col("c_dst")).alias("same_content"))


def key_bounds(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.min(key).alias("low"), F.max(key).alias("high"))


def max_per_table(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """table, high: the largest key of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.max(key).cast("long").alias("high")).select(F.lit(name).alias("table"), "high") for name, (df, key) in tables.items()])


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).distinct()
