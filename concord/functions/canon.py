"""Canonical text and hashes of rows: the same value gives the same text in every engine.

Doubles are written with all the digits that tell them apart, timestamps as epoch microseconds, booleans and
integers by their digits, nulls as a token. The default row text prefixes each text with its length and ends
each number, so no separator can be forged. Arrays, maps and structs are written by the same rules at every
level, between marks of their kind: an array in its order, a map by its sorted entries, a struct with its names.
A ``scale`` rounds doubles instead, for pairs of engines that store them with fewer digits; nothing rounds
unless it is asked to.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL = "~"
_PLAIN = (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_LIMB = (1 << 22) - 1


def canonical(name: str, kind: T.DataType, scale: int | None = None) -> Column:
    """One column as canonical text, null for null. Doubles are exact unless ``scale`` rounds them."""
    return text_of(F.col(f"`{name}`"), kind, scale)


def text_of(column: Column, kind: T.DataType, scale: int | None = None) -> Column:
    """A value as canonical text, null for null; values of nested types end where their closing mark is."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        if scale is not None:
            return F.coalesce(column.try_cast(f"decimal(38,{scale})").cast("string"), column.cast("string"))
        # adding zero makes the two zeros one, as they are equal in SQL
        return (column + F.lit(0).cast(kind)).cast("string")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(column.cast("timestamp")).cast("string")
    if isinstance(kind, T.DateType):
        return F.datediff(column, F.lit("1970-01-01").cast("date")).cast("string")
    if isinstance(kind, T.BooleanType):
        return F.when(column, F.lit("t")).when(~column, F.lit("f"))
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(column))
    if isinstance(kind, T.ArrayType):
        return _between("[]", F.array_join(F.transform(column, lambda x: part_of(x, kind.elementType, scale)), ""))
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.concat(part_of(e["key"], kind.keyType, scale), part_of(e["value"], kind.valueType, scale)))
        return _between("{}", F.array_join(F.array_sort(entries), ""))
    if isinstance(kind, T.StructType):
        fields = [x for f in kind.fields for x in (measured(F.lit(f.name)), part_of(column.getField(f.name), f.dataType, scale))]
        return F.when(column.isNotNull(), _between("()", F.concat(F.lit(""), *fields)))
    if isinstance(kind, T.VariantType):
        # its writer sorts the names of objects
        return _between("<>", measured(F.to_json(column)))
    return column.cast("string")


def _between(marks: str, text: Column) -> Column:
    return F.concat(F.lit(marks[0]), text, F.lit(marks[1]))


def part_of(column: Column, kind: T.DataType, scale: int | None = None) -> Column:
    """A value as a part of a longer text, never null: it tells where it ends, and no value of another kind reads like it."""
    text = text_of(column, kind, scale)
    if isinstance(kind, _NESTED):
        return F.coalesce(text, F.lit(NULL))
    # the text of a number holds no mark, so a mark ends it; only other texts need their length
    return F.coalesce(F.concat(text, F.lit(";")), F.lit(NULL)) if isinstance(kind, _PLAIN) else measured(text)


def fields_of(df: DataFrame, columns: Sequence[str] | None = None, scale: int | None = None) -> list[Column]:
    kinds = {f.name: f.dataType for f in df.schema}
    return [canonical(c, kinds[c], scale) for c in columns or df.columns]


def marked_fields(df: DataFrame, columns: Sequence[str] | None = None, scale: int | None = None) -> list[Column]:
    """Each column's text behind = or, for nested types, behind their own mark; ~ for null. For hashes of single columns."""
    kinds = {f.name: f.dataType for f in df.schema}
    names = list(columns or df.columns)
    return [F.coalesce(x if isinstance(kinds[c], _NESTED) else F.concat(F.lit("="), x), F.lit(NULL)) for c, x in zip(names, fields_of(df, names, scale))]


def measured(*texts: Column) -> Column:
    """Texts in one, each behind its length and null as a token: no two lists of texts give the same one."""
    return F.concat(*[F.coalesce(F.concat(F.length(x).cast("string"), F.lit(":"), x), F.lit(NULL)) for x in texts])


def row_text(df: DataFrame, columns: Sequence[str] | None = None, mode: str = "length", scale: int | None = None) -> Column:
    """The text of a row. Modes: ``length`` (default, injective), ``pipe`` (| and ~), ``hash`` (# and ~null~), ``json``."""
    if mode == "length":
        kinds = {f.name: f.dataType for f in df.schema}
        return F.concat(*[part_of(F.col(f"`{c}`"), kinds[c], scale) for c in columns or df.columns])
    parts = fields_of(df, columns, scale)
    if mode == "pipe":
        return F.concat_ws("|", *[F.coalesce(p, F.lit(NULL)) for p in parts])
    if mode == "hash":
        return F.concat_ws("#", *[F.coalesce(p, F.lit("~null~")) for p in parts])
    if mode == "json":
        names = list(columns or df.columns)
        return F.to_json(F.struct(*[p.alias(n) for p, n in zip(parts, names)]), {"ignoreNullFields": "false"})
    raise ValueError(f"unknown row text {mode!r}")


def row_hash(df: DataFrame, columns: Sequence[str] | None = None, mode: str = "length", scale: int | None = None) -> Column:
    return F.md5(row_text(df, columns, mode, scale).cast("binary"))


def row_ids(df: DataFrame, columns: Sequence[str] | None = None, scale: int | None = None) -> list[Column]:
    """128 bits that stand for a row, as two integers.

    They mean nothing outside Spark and never leave it, so they need not be md5.
    """
    text = row_text(df, columns, scale=scale)
    return [F.xxhash64(text, F.lit(seed)) for seed in (1, 2)]


def limbs(h: Column) -> list[Column]:
    """A 64-bit hash in three integers of 22 bits at most, whose plain sums 2^41 rows do not overflow."""
    return [h.bitwiseAND(_LIMB), F.shiftrightunsigned(h, 22).bitwiseAND(_LIMB), F.shiftrightunsigned(h, 44)]


def hash_number(md5: Column, start: int = 1) -> Column:
    """Sixteen hex digits of an md5, from ``start``, as DECIMAL(20,0): sums neither overflow nor lose digits."""
    return F.conv(F.substring(md5, start, 16), 16, 10).cast("decimal(20,0)")


def hash_sum(md5: Column) -> Column:
    """The sum of ``hash_number`` over a group, as text.

    It is taken in four limbs of 16 bits, each a plain integer sum that 2^47 rows do not overflow, and put
    together at the end.
    """
    limb = lambda start: F.conv(F.substring(md5, start, 4), 16, 10).cast("long")
    total = F.lit(0).cast("decimal(38,0)")
    for start, weight in ((1, 1 << 48), (5, 1 << 32), (9, 1 << 16), (13, 1)):
        total = (total + F.coalesce(F.sum(limb(start)), F.lit(0)).cast("decimal(19,0)") * F.lit(weight).cast("decimal(16,0)")).cast("decimal(38,0)")
    return total.cast("string")


def hash_bits(md5: Column, start: int = 1) -> Column:
    """The same digits as a signed 64-bit integer, for xor."""
    high = F.conv(F.substring(md5, start, 8), 16, 10).cast("long")
    low = F.conv(F.substring(md5, start + 8, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low)


def key_text(df: DataFrame, key: Sequence[str]) -> Column:
    """A composite key as TAB-joined text, for output; joins use the typed columns.

    As in a database's text dump, null is \\N and a backslash, TAB or line break in a value is escaped, so two
    keys never read alike.
    """
    escaped = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "\t", r"\\t"), "\n", r"\\n"), "\r", r"\\r")
    kinds = {f.name: f.dataType for f in df.schema}
    return F.concat_ws("\t", *[F.coalesce(text if isinstance(kinds[k], _PLAIN) else escaped(text), F.lit("\\N")) for k, text in zip(key, fields_of(df, key))])
