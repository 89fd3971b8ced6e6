"""Sharding by extendible hashing: only buckets over the byte limit split on another bit.

A row's address is the leading bits of the md5 of its key. The directory is built from byte totals, not
from rows: rows are summed by their first ``step`` bits, the sums of all shorter prefixes follow from
those, and a bucket is the shortest prefix whose total fits the limit. Prefixes that are still too large
at full length are refined by the next ``step`` bits, for their rows alone, until all bits are used. All
native expressions; the directory is joined, never collected.

Rows that one address cannot part (equal keys) overflow, as in any hash file: such a bucket is chained
into numbered pages by a running total over the counts of its row sizes. A row larger than the limit has a
shard or page of its own.

Defined results: a null key hashes as the empty string; a null text has 0 bytes; an empty table has no
shards; repeated rows may share a shard or a chain; a text longer than the limit has a shard or page of its own;
rows of equal size in a chain are interchangeable; other columns may have any name and type, and where one is
called shard or page the folders' names get an underscore.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import boxed, free_name
from concord.session import durable

MAX_BYTES = 256 << 20
HASH_BITS = 64


def address(key: Column) -> Column:
    """The first 64 bits of the key's md5 as a text of 0 and 1."""
    half = lambda start: F.lpad(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), start, 8), 16, 2), 32, "0")
    return F.concat(half(1), half(9))


def directory(rows: DataFrame, max_bytes: int, step: int = 12) -> list[tuple[int, DataFrame]]:
    """For each round its address width and cell, shard, depth, shard_bytes, shard_rows, chained.

    A round has at most 2^step cells for each bucket left over by the round before. ``chained`` marks
    buckets that are too large although all bits are used.
    """
    rounds, stuck, done = [], None, 0
    while done < HASH_BITS:
        width = min(HASH_BITS, done + step)
        cell = F.substring("address", 1, width).alias("cell")
        inner = rows if stuck is None else rows.join(stuck, F.substring("address", 1, done) == F.col("stuck"), "left_semi")
        cells = inner.groupBy(cell).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        cells = durable(cells)
        depths = F.explode(F.sequence(F.lit(done + 1 if done else 0), F.lit(width))).alias("depth")
        prefixes = cells.select("*", depths).groupBy(F.expr("substr(cell, 1, depth)").alias("shard"), "depth").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
        full = (F.col("shard_bytes") > max_bytes) & (F.col("shard_rows") > 1)
        last = (F.col("depth") == width) & F.lit(width == HASH_BITS)
        # the bucket of a cell is its shortest prefix that fits; prefixes above it are all too large
        fits = prefixes.where(~full | last).withColumn("chained", full)
        fits = fits if done or step > 16 else F.broadcast(fits)  # the first round has fewer than 2^(step + 1) prefixes
        named = cells.select("cell", depths).select("cell", F.expr("substr(cell, 1, depth)").alias("shard"), "depth")
        best = F.min(F.struct("depth", "shard", "shard_bytes", "shard_rows", "chained")).alias("best")
        rounds.append((width, named.join(fits, ["shard", "depth"]).groupBy("cell").agg(best).select("cell", "best.*")))
        left = prefixes.where(full & (F.col("depth") == width)).select(F.col("shard").alias("stuck"))
        done = width
        if done == HASH_BITS or left.isEmpty():
            break
        stuck = left
    return rounds


def shard(docs: DataFrame, key: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES, step: int = 12) -> DataFrame:
    """The key, n_bytes, shard, depth, page, shard_bytes and shard_rows for every row of ``docs``.

    ``shard`` is the bucket's bits (empty while everything fits one); ``page`` is 0 but for the pages of
    an overflowing bucket. The totals are those of the bucket.
    """
    own = boxed(docs, key, text)
    rows = own.select(F.col(f"`{key}`").alias("__key"), _bytes(F.col(f"`{text}`")), address(F.col(f"`{key}`")).alias("address"))
    rounds = directory(rows, max_bytes, step)
    placed = _placed(rows, rounds, step)
    if rounds[-1][0] == HASH_BITS:
        placed = _chained(placed, max_bytes)
    else:
        placed = placed.withColumn("page", F.lit(0).cast("long"))
    return placed.select(F.col("__key").alias(key), F.col("bytes").alias("n_bytes"), F.col("bucket.shard").alias("shard"), F.col("bucket.depth").alias("depth"), "page", F.col("bucket.shard_bytes").alias("shard_bytes"), F.col("bucket.shard_rows").alias("shard_rows"))


def _bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")


def _placed(rows: DataFrame, rounds: list[tuple[int, DataFrame]], step: int) -> DataFrame:
    """``rows`` with their ``bucket``, found by the leading bits of ``address``."""
    placed = rows.withColumn("bucket", F.lit(None).cast("struct<depth:int,shard:string,shard_bytes:bigint,shard_rows:bigint,chained:boolean>"))
    for k, (width, cells) in enumerate(rounds):
        own = cells.select(F.col("cell").alias(f"cell{k}"), F.struct("depth", "shard", "shard_bytes", "shard_rows", "chained").alias(f"bucket{k}"))
        own = F.broadcast(own) if not k and step <= 16 else own  # the first round has at most 2^step cells
        placed = placed.join(own, F.substring("address", 1, width) == F.col(f"cell{k}"), "left").withColumn("bucket", F.coalesce("bucket", f"bucket{k}")).drop(f"cell{k}", f"bucket{k}")
    return placed


def _chained(placed: DataFrame, max_bytes: int) -> DataFrame:
    """Number the pages of buckets whose rows one address cannot part.

    Rows with equal key and size are interchangeable here, so they are counted first; a window over the
    counts gives each size its first byte in the chain, and arithmetic gives each row its page. A page
    holds the rows that begin in one half of the limit; rows of more than half have pages of their own.
    """
    half = max(1, max_bytes // 2)
    key = placed.columns[0]
    chain = placed.where("bucket.chained").groupBy(key, "bytes", "address", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("address").orderBy("bytes", key).rowsBetween(Window.unboundedPreceding, -1)
    chain = chain.withColumns({"first": F.coalesce(F.sum(F.col("bytes") * F.col("n")).over(before), F.lit(0)), "number": F.coalesce(F.sum("n").over(before), F.lit(0))})
    span = F.lit(1 << 14).cast("long")  # numbers are unfolded in two steps, so no array is long
    chain = chain.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, span)).alias("low"))
    # a long chain is dealt to all tasks before it is unfolded
    chain = chain.repartition("address", "bytes", "low")
    chain = chain.select("*", F.explode(F.sequence("low", F.least(F.col("low") + span, F.col("n")) - 1)).alias("i"))
    paged = chain.select(*placed.columns, _page(half).alias("page"))
    return placed.where("not bucket.chained").withColumn("page", F.lit(0).cast("long")).unionByName(paged)


def _page(half: int) -> Column:
    """The page of the row ``i`` of equal rows that begin at byte ``first`` and row ``number`` of their chain."""
    page = F.when(F.col("bytes") > half, (1 << 40) + F.col("number") + F.col("i")).otherwise(F.floor((F.col("first") + F.col("i") * F.col("bytes")) / half))
    return page.cast("long")


def _chained_rows(placed: DataFrame, max_bytes: int) -> DataFrame:
    """The rows of chained buckets, each with its page; as many rows of a size are on a page as ``_chained`` counts.

    Rows of a chain are numbered within their input partition, and the window over the counts of partitions
    and sizes tells where each partition's rows begin, so no task reads a whole chain. The numbers are drawn
    from a written copy, as a retried task may deal rows differently.
    """
    rows = durable(placed.where("bucket.chained").withColumns({"part": F.spark_partition_id(), "id": F.monotonically_increasing_id()}))
    before = Window.partitionBy("address").orderBy("bytes", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("address", "bytes", "part").agg(F.count("*").alias("n"))
    starts = starts.select("address", "bytes", "part", F.coalesce(F.sum(F.col("bytes") * F.col("n")).over(before), F.lit(0)).alias("first"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("number"))
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("address", "bytes", "part").orderBy("id")) - 1)
    return numbered.join(starts, ["address", "bytes", "part"]).select(*placed.columns, _page(max(1, max_bytes // 2)).alias("page"))


def write_shards(docs: DataFrame, path: str, max_bytes: int = MAX_BYTES, step: int = 12) -> None:
    """Write ``docs`` to ``path``, one file for each shard and page, in folders shard=s.../page=...

    The texts of a file have at most ``max_bytes`` bytes, or it holds a single row. Rows of equal keys share a
    shard; an overflowing shard has several pages, any other only page 0.
    """
    own = boxed(docs, "doc_id", "text")
    rows = own.select(F.struct("*").alias("row"), _bytes(F.col("text")), address(F.col("doc_id")).alias("address"))
    rounds = directory(rows.select("bytes", "address"), max_bytes, step)
    placed = _placed(rows, rounds, step)
    if rounds[-1][0] == HASH_BITS:
        paged = placed.where("not bucket.chained").withColumn("page", F.lit(0).cast("long")).unionByName(_chained_rows(placed, max_bytes))
    else:
        paged = placed.withColumn("page", F.lit(0).cast("long"))
    folders = [free_name(docs, n) for n in ("shard", "page")]
    moved = paged.select("row.*", F.concat(F.lit("s"), F.col("bucket.shard")).alias("__shard"), F.col("page").alias("__page")).toDF(*docs.columns, *folders)
    moved.repartition(*folders).write.partitionBy(*folders).mode("overwrite").parquet(path)
