"""Set reconciliation by invertible Bloom lookup tables.

A side is summed up in cells: each row is an item of two numbers, the hash of its key and of its text, and goes to
three cells, one of each third of the table. A cell keeps how many items it holds, the xor of both numbers and the
xor of a check of them. Subtracting two sides' tables leaves the items that only one of them has, however large the
sides are; a cell that holds one item tells it, taking it out of its other cells leaves more such cells, and so on.
With about one and a half times as many cells as items nearly all tables come out; of one that does not, nothing is
believed and the tables are compared whole.

A table is one aggregate with a partial sum in each task, so only its cells are shuffled and brought together:
their number is a parameter, not a measure of the data.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.functions.canon import fields_of, measured, row_text
from concord.operators import diff
from concord.session import spread

#: Cells of a third of the table, a power of two.
THIRD = 1 << 14


def items(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """k and v of every row: the hashes of its key and of its text."""
    return df.select(F.xxhash64(measured(*fields_of(df, key))).alias("k"), F.xxhash64(row_text(df, columns)).alias("v"))


def table_of(df: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, third: int = THIRD) -> DataFrame:
    """cell, n, k, v, c: the table of one side."""
    checked = items(spread(df), key, columns).withColumn("c", F.xxhash64("k", "v"))
    places = F.array(*[F.shiftrightunsigned("c", 21 * j).bitwiseAND(F.lit(third - 1)) + F.lit(j * third) for j in range(3)])
    cells = checked.select(F.explode(places).alias("cell"), "k", "v", "c")
    return cells.groupBy("cell").agg(F.count("*").alias("n"), *[F.bit_xor(x).alias(x) for x in ("k", "v", "c")])


def subtracted(src: DataFrame, dst: DataFrame) -> DataFrame:
    """The cells of the items that only one side has; empty ones are left out."""
    both = src.union(dst.select("cell", (-F.col("n")).alias("n"), "k", "v", "c")).groupBy("cell").agg(F.sum("n").alias("n"), *[F.bit_xor(x).alias(x) for x in ("k", "v", "c")])
    return both.where("n <> 0 or k <> 0 or v <> 0 or c <> 0")


def check_of(k: int, v: int) -> int:
    """The check of an item, as Spark's xxhash64 of two numbers gives it."""
    seed = 42
    for x in (k, v):
        seed = xxhash.xxh64_intdigest(struct.pack("<q", x), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def peeled(cells: dict[int, tuple[int, int, int, int]], third: int = THIRD) -> list[tuple[int, int, int]] | None:
    """side (1 or -1), k and v of every item of a subtracted table, or None if it does not come out.

    ``cells`` has n, k, v, c of each; there are 3 ``third`` of them at most.
    """
    left = {at: list(cell) for at, cell in cells.items()}
    ready, out = list(left), []
    while ready:
        at = ready.pop()
        n, k, v, c = left.get(at, (0, 0, 0, 0))
        if n not in (1, -1) or check_of(k, v) != c:
            continue
        out.append((n, k, v))
        unsigned = c & (1 << 64) - 1
        for j in range(3):
            place = (unsigned >> 21 * j & third - 1) + j * third
            cell = left.setdefault(place, [0, 0, 0, 0])
            cell[0] -= n
            for i, x in enumerate((k, v, c), 1):
                cell[i] ^= x
            ready.append(place)
    return None if any(any(cell) for cell in left.values()) else out


def reconcile(src: DataFrame, dst: DataFrame, key: Sequence[str], columns: Sequence[str] | None = None, third: int = THIRD) -> DataFrame:
    """The keys that differ, with their kind, as ``diff.differences`` gives them.

    From the two tables come the hashes of the keys that differ; the rows of these keys alone are then compared.
    Where the tables do not come out, as with more differences than cells, all rows are.
    """
    shared = list(columns or [c for c in src.columns if c in dst.columns])
    left = subtracted(table_of(src, key, shared, third), table_of(dst, key, shared, third))
    found = peeled({r["cell"]: (r["n"], r["k"], r["v"], r["c"]) for r in left.collect()}, third)  # 3 x third cells at most
    if found is None:
        return diff.differences(src, dst, key, shared)
    ids = src.sparkSession.createDataFrame([(k,) for k in sorted({k for _, k, _ in found})], "__id long")
    near = lambda df: df.withColumn("__k", F.xxhash64(measured(*fields_of(df, key)))).join(F.broadcast(ids), F.col("__k") == F.col("__id"), "left_semi").drop("__k")
    return diff.differences(near(src), near(dst), key, shared)


def capacity(third: int = THIRD) -> int:
    """About how many items a table of three thirds tells apart."""
    return int(np.floor(3 * third * 0.75))
