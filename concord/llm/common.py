"""Helpers shared by the text operators: row-wise Arrow passes and ASCII word rules.

Texts are handled as UTF-8 bytes: ``bytes.lower`` folds A-Z alone, ``bytes.split``
splits on exactly ``[\\x20\\x09-\\x0D]``, and ``bytes.translate`` classifies at memory speed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The white space of ``bytes.split``, written out for translate().
ASCII_SPACE = b" \t\n\r\x0b\x0c"
#: UTF-8 continuation bytes: every byte of a text but these begins a code point.
CONTINUATION = bytes(range(0x80, 0xC0))
#: Learning never sees rows whose crc32(doc_id) falls into fold 0 of this many.
FOLDS = 5


def fold(doc_id: Column) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id: Column) -> Column:
    """True for ids of fold 0. A null id has no fold: never held out, and never learned from either."""
    return F.coalesce(fold(doc_id) == 0, F.lit(False))


def learnable(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) != 0, F.lit(False))


def boxed(df: DataFrame, *needed: str) -> DataFrame:
    """``df`` with its columns named by their place, ``__c0`` and so on, but for the first of each name in ``needed``.

    Names that hold dots, differ from a needed one in case alone, or are those of an operator's own columns
    can then not clash with any of them. ``unboxed`` gives the names back.
    """
    own = {df.columns.index(n): n for n in needed}
    return df.toDF(*[own.get(i, f"__c{i}") for i in range(len(df.columns))])


def unboxed(df: DataFrame, like: DataFrame, *needed: str) -> DataFrame:
    """The columns that ``boxed(like, *needed)`` had, under the names of ``like``."""
    return df.select(*[F.col(f"`{c}`") for c in boxed(like, *needed).columns]).toDF(*like.columns)


def picked(df: DataFrame, *needed: str) -> DataFrame:
    """The needed columns alone, whatever the others are called."""
    return boxed(df, *needed).select(*needed)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is called so in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Keys with more than one row in this many are joined by broadcast, so there are at most this many of them.
HOT_KEYS = 20_000
#: A key with fewer rows is never hot: one task reads them in a moment.
HOT_ROWS = 500_000


def joined(rows: DataFrame, lookup: DataFrame, key: str, weight: str, total: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The inner join of ``rows`` with ``lookup``, which has one row for each ``key`` and its number of rows in ``weight``.

    A key that holds many of the ``total`` rows would crowd one task, so such keys are looked up by broadcast:
    each has more than ``total`` / HOT_KEYS rows, which bounds their number. All others are shuffled.
    """
    least = max(hot_rows, total // HOT_KEYS)
    if total <= least or lookup.where(F.col(weight) > least).isEmpty():
        return rows.join(lookup.drop(weight), key)
    hot, rest = lookup.where(F.col(weight) > least), lookup.where(F.col(weight) <= least)
    near = rows.join(F.broadcast(hot.drop(weight)), key)
    far = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest.drop(weight), key)
    return near.unionByName(far)


def byte_texts(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding them."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.cast(column, kind).to_pylist() if not pa.types.is_null(column.type) else [None] * len(column)


def append_columns(df: DataFrame, source: str, fields: T.StructType, rows_of: Callable[[], Callable[[bytes | None], tuple]]) -> DataFrame:
    """Add ``fields`` to every row of ``df``, computed from the text column ``source``.

    ``rows_of()`` is called once in each task and returns the function of one text. All other columns
    pass through as they are; names in ``fields`` must not exist in ``df``.
    """
    arrow_types = [_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = rows_of()
        for batch in batches:
            made = [one(text) for text in byte_texts(batch.column(batch.schema.get_field_index(source)))]
            columns = [pa.array(values, type=kind) for values, kind in zip(zip(*made), arrow_types)] if made else [pa.array([], type=kind) for kind in arrow_types]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *names])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *fields.fields]))


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return simple[kind.simpleString()]
