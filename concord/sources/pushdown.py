"""Fingerprints computed where the rows are, and the descent into the ranges where they differ.

A side of a table tells the count and the sum of row hashes of ranges of its key. An engine computes them by its
own SQL, so a row for each range comes back and no row of the table; files and tables that Spark reads are summed
by Spark. Both give the same numbers, so it does not matter who counts which side. (Java before 19 writes some
doubles beyond 2^53 with a digit too many; a range with one differs then, and is found equal when it is read.)

The descent compares a few wide ranges, splits those that differ and asks again for their parts alone, until a
range has few rows. Then the rows of these ranges are read, of both sides, and nothing else. Where the sides
differ in more ranges than a query can name, it stops early and the ranges are wider.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.canon import hash_sum, row_hash
from concord.functions.dialects import Dialect, NotExpressible
from concord.operators import diff

Range = tuple[int, int]
#: Ranges that a query names at most.
MAX_RANGES = 500


def within(name: str, ranges: Sequence[Range]) -> str:
    """The condition that a key, written ``name``, lies in one of the ranges [low, high)."""
    return "(" + " or ".join(f"{name} >= {low} and {name} < {high}" for low, high in ranges) + ")" if ranges else "1 = 0"


def fingerprint_sql(own: Dialect, table: str, schema: T.StructType, key: str, width: int, start: int = 0, ranges: Sequence[Range] | None = None) -> str:
    """chunk, n and checksum of each range of ``width`` keys from ``start`` on, in an engine's SQL; of all rows or those of some ranges."""
    name = own.column(key)
    where = f" where {within(name, ranges)}" if ranges is not None else ""
    rows = f"select {own.floor.format(f'({name} - {start})', width)} as chunk, {own.row_md5(schema)} as h from {own.name_of(table)}{where}"
    return f"select chunk, count(*) as n, {own.hash_sum.format('h')} as checksum from ({rows}) hashed group by chunk"


class Side(Protocol):
    """One side of a table with an integer key."""

    def bounds(self) -> tuple[int | None, int | None]: ...

    def fingerprints(self, width: int, start: int, ranges: Sequence[Range] | None) -> dict[int | None, tuple[int, str]]:
        """The count and checksum of each range that has rows; None stands for rows without a key."""

    def rows(self, ranges: Sequence[Range], nulls: bool) -> DataFrame: ...


@dataclass
class FrameSide:
    """A table that Spark reads; ranges reach its scan as filters."""

    df: DataFrame
    key: str

    def bounds(self) -> tuple[int | None, int | None]:
        return tuple(self.df.agg(F.min(f"`{self.key}`"), F.max(f"`{self.key}`")).first())

    def _in(self, ranges: Sequence[Range]) -> Column:
        k = F.col(f"`{self.key}`")
        return reduce(lambda a, b: a | b, [(k >= low) & (k < high) for low, high in ranges], F.lit(False))

    def chunks(self, width: int, start: int = 0, ranges: Sequence[Range] | None = None) -> DataFrame:
        """chunk, n, checksum, by one scan with a partial sum in each task."""
        df = self.df if ranges is None else self.df.where(self._in(ranges))
        chunk = F.floor((F.col(f"`{self.key}`") - F.lit(start)) / F.lit(width)).cast("long")
        return df.select(chunk.alias("chunk"), row_hash(df).alias("h")).groupBy("chunk").agg(F.count("*").alias("n"), hash_sum(F.col("h")).alias("checksum"))

    def fingerprints(self, width: int, start: int, ranges: Sequence[Range] | None) -> dict[int | None, tuple[int, str]]:
        return {r["chunk"]: (r["n"], r["checksum"]) for r in self.chunks(width, start, ranges).collect()}

    def rows(self, ranges: Sequence[Range], nulls: bool) -> DataFrame:
        kept = self._in(ranges)
        return self.df.where(kept | F.col(f"`{self.key}`").isNull() if nulls else kept)


@dataclass
class SqlSide:
    """A table of an engine. ``ask`` gives a query's rows as tuples, ``read`` the table's rows for a condition."""

    own: Dialect
    table: str
    schema: T.StructType
    key: str
    ask: Callable[[str], list[tuple]]
    read: Callable[[str], DataFrame]

    def expressible(self) -> bool:
        """Whether the engine has the canonical text of every column."""
        try:
            self.own.row_md5(self.schema)
        except NotExpressible:
            return False
        return True

    def bounds(self) -> tuple[int | None, int | None]:
        name = self.own.column(self.key)
        return tuple(self.ask(f"select min({name}) as low, max({name}) as high from {self.own.name_of(self.table)}")[0])

    def fingerprints(self, width: int, start: int, ranges: Sequence[Range] | None) -> dict[int | None, tuple[int, str]]:
        rows = self.ask(fingerprint_sql(self.own, self.table, self.schema, self.key, width, start, ranges))
        return {None if chunk is None else int(chunk): (int(n), str(total)) for chunk, n, total in rows}

    def rows(self, ranges: Sequence[Range], nulls: bool) -> DataFrame:
        name = self.own.column(self.key)
        kept = self.read(within(name, ranges) + (f" or {name} is null" if nulls else ""))
        return kept.select(*[F.col(f"`{f.name}`") for f in self.schema])


@dataclass
class Descent:
    """What a descent has found: counts and one checksum a side, the ranges that differ, and what it took."""

    n: tuple[int, int]
    checksums: tuple[int, int]
    ranges: list[Range]
    nulls: bool
    levels: int
    #: Rows of both sides in the ranges that differ: all that is read of the tables.
    rows_to_read: int

    @property
    def equal(self) -> bool:
        return not self.ranges and not self.nulls


def descend(src: Side, dst: Side, fanout: int = 16, leaf_rows: int = 1000, max_ranges: int = MAX_RANGES) -> Descent:
    """The ranges of the key where the sides differ, each with ``leaf_rows`` rows of a side at most where the key allows it.

    Widths are powers of ``fanout``, so each range is a whole number of the next smaller ones.
    """
    known = [x for side in (src, dst) for x in side.bounds() if x is not None]
    start, end = (min(known), max(known) + 1) if known else (0, 1)
    width = 1
    while width * fanout < end - start:
        width *= fanout
    a, b = src.fingerprints(width, start, None), dst.fingerprints(width, start, None)
    found = Descent((sum(n for n, _ in a.values()), sum(n for n, _ in b.values())), (_total(a), _total(b)), [], a.get(None) != b.get(None), 1, 0)
    found.rows_to_read = sum(x[None][0] for x in (a, b) if found.nulls and None in x)
    while True:
        split = []
        for chunk in sorted({*a, *b} - {None}):
            sides = [x.get(chunk, (0, "0")) for x in (a, b)]
            if sides[0] == sides[1]:
                continue
            low = start + chunk * width
            if width > 1 and max(n for n, _ in sides) > leaf_rows:
                split.append((low, low + width))
            else:
                found.ranges.append((low, low + width))
                found.rows_to_read += sum(n for n, _ in sides)
        split = joined(split)
        if len(split) > max_ranges:
            found.ranges += split
            found.rows_to_read += sum(x.get(chunk, (0, ""))[0] for low, high in split for chunk in range((low - start) // width, (high - start) // width) for x in (a, b))
            split = []
        if not split:
            found.ranges = joined(sorted(found.ranges))
            return found
        width //= fanout
        found.levels += 1
        a, b = src.fingerprints(width, start, split), dst.fingerprints(width, start, split)


def _total(chunks: dict[int | None, tuple[int, str]]) -> int:
    return sum(int(x) for _, x in chunks.values())


def joined(ranges: Sequence[Range]) -> list[Range]:
    """Sorted ranges with those that touch in one."""
    out: list[Range] = []
    for low, high in ranges:
        if out and low == out[-1][1]:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def grouped(ranges: Sequence[Range], most: int = MAX_RANGES) -> list[Range]:
    """At most so many ranges that hold the given ones: the narrowest gaps between them are closed."""
    ranges = list(ranges)
    if len(ranges) <= most:
        return ranges
    gaps = sorted(range(1, len(ranges)), key=lambda i: ranges[i][0] - ranges[i - 1][1])[: len(ranges) - most]
    closed, out = set(gaps), []
    for i, (low, high) in enumerate(ranges):
        if i in closed:
            out[-1] = (out[-1][0], high)
        else:
            out.append((low, high))
    return out


def damaged(src: Side, dst: Side, found: Descent) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides in the ranges that differ."""
    ranges = grouped(found.ranges)
    return src.rows(ranges, found.nulls), dst.rows(ranges, found.nulls)


def differences(src: Side, dst: Side, key: str, **options) -> DataFrame:
    """The keys that differ, with their kind: those of ``diff.differences``, from the ranges that differ."""
    return diff.differences(*damaged(src, dst, descend(src, dst, **options)), [key])


# ---- SQLite, which runs where its file is


def java_double(x: float | None) -> str | None:
    """A double's shortest digits in the form of the canonical text."""
    if x is None:
        return None
    x = float(x) + 0.0
    if x != x or x in (float("inf"), float("-inf")):
        return "NaN" if x != x else "Infinity" if x > 0 else "-Infinity"
    if x == 0:
        return "0.0"
    sign, digits, exponent = Decimal(repr(x)).normalize().as_tuple()
    places = len(digits) + exponent - 1
    if 1e-3 <= abs(x) < 1e7:
        text = format(Decimal(repr(abs(x))), "f")
        text = text if "." in text else text + ".0"
    else:
        text = f"{digits[0]}.{''.join(map(str, digits[1:])) or '0'}E{places}"
    return "-" * sign + text


class _HashSum:
    def __init__(self):
        self.total = 0

    def step(self, md5: str | None) -> None:
        self.total += int(md5[:16], 16) if md5 else 0

    def finalize(self) -> str:
        return str(self.total)


def with_functions(db) -> None:
    """The functions that SQLite's dialect uses, on a connection."""
    db.create_function("md5", 1, lambda text: None if text is None else hashlib.md5(text.encode()).hexdigest(), deterministic=True)
    db.create_function("double_text", 1, java_double, deterministic=True)
    db.create_function("floor_div", 2, lambda a, b: None if a is None else a // b, deterministic=True)
    db.create_aggregate("hash_sum", 1, _HashSum)


def sqlite_ask(spark: SparkSession, path: str, tasks: int = 1) -> Callable[[str], list[tuple]]:
    """Runs a query in a task, beside the file; its rows are one for each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from concord.sources.readers import sqlite_connection

        for batch in batches:
            for sql in batch.column(0).to_pylist():
                with sqlite_connection(path) as db:
                    with_functions(db)
                    rows = [tuple(None if v is None else str(v) for v in r) for r in db.execute(sql)]
                yield pa.RecordBatch.from_arrays([pa.array([list(r) for r in rows], pa.list_(pa.string()))], names=["row"])

    def ask(sql: str) -> list[tuple]:
        found = spark.createDataFrame([(sql,)], "sql string").mapInArrow(run, "row array<string>").collect()
        return [tuple(int(v) if v is not None and v.lstrip("-").isdigit() else v for v in r["row"]) for r in found]

    return ask
