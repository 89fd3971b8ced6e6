"""One type and one name for what two engines store in their own ways.

Types of one value form a lattice. Numbers meet where neither side's digits count against it: integers and
booleans as integers, decimals in the wider decimal, and a number against a binary float in that float, which
is as much as the other side could keep. Times meet as timestamps, so a date is its midnight. A text meets any
other type in the canonical text of that type: what reads as such a value is that value, anything else stays the
text it is. Arrays, maps and structs meet part by part, and a text of JSON meets them as a variant.

Names of tables and columns are matched as they are written, then without regard to case; tables also without
the schema that an engine takes for granted. A name that more than one of the other side's could match is left
alone rather than guessed.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.canon import text_of

#: Schemas that engines leave out of a table's name.
DEFAULT_SCHEMAS = ("public", "dbo", "main")
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19, T.BooleanType: 1}
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
_PARTS = (T.ArrayType, T.MapType, T.StructType, T.VariantType)
_JSON_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


@dataclass(frozen=True)
class Spelled:
    """The meeting of a text and a value of ``kind``: the canonical text of that kind."""

    kind: T.DataType


def meet(a: T.DataType, b: T.DataType) -> T.DataType | Spelled | None:
    """The type in which values of both compare; None where they have nothing in common but their text."""
    if a == b:
        return a
    if isinstance(a, T.StringType) != isinstance(b, T.StringType):
        other = b if isinstance(a, T.StringType) else a
        return T.VariantType() if isinstance(other, _PARTS) else Spelled(other)
    if isinstance(a, _TIMES) and isinstance(b, _TIMES):
        return T.TimestampType()
    if _number(a) and _number(b):
        return _meet_numbers(a, b)
    if T.VariantType() in (a, b) and isinstance(a, _PARTS) and isinstance(b, _PARTS):
        return T.VariantType()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return _of([meet(a.elementType, b.elementType)], lambda e: T.ArrayType(e))
    if isinstance(a, T.MapType) and isinstance(b, T.MapType):
        return _of([meet(a.keyType, b.keyType), meet(a.valueType, b.valueType)], lambda k, v: T.MapType(k, v))
    if isinstance(a, T.StructType) and isinstance(b, T.StructType):
        names = matches(a.names, b.names)
        if len(names) == len(a.names) == len(b.names):
            return _of([meet(a[x].dataType, b[names[x]].dataType) for x in a.names], lambda *kinds: T.StructType([T.StructField(x, k) for x, k in zip(a.names, kinds)]))
    return None


def _of(kinds: list, make) -> T.DataType | None:
    """A nested type of types that meet as types; parts that meet as texts only make no nested type."""
    return make(*kinds) if all(isinstance(k, T.DataType) for k in kinds) else None


def _number(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def _meet_numbers(a: T.DataType, b: T.DataType) -> T.DataType:
    for binary in (T.FloatType, T.DoubleType):
        if isinstance(a, binary) or isinstance(b, binary):
            return binary()
    if not isinstance(a, T.DecimalType) and not isinstance(b, T.DecimalType):
        return T.LongType()
    size = lambda k: (k.precision - k.scale, k.scale) if isinstance(k, T.DecimalType) else (_DIGITS[type(k)], 0)
    (whole, scale), (whole2, scale2) = size(a), size(b)
    digits = max(whole, whole2)
    return T.DecimalType(min(38, digits + max(scale, scale2)), min(max(scale, scale2), 38 - min(38, digits)))


def as_met(column: Column, have: T.DataType, want: T.DataType | Spelled | None) -> Column:
    """A value of type ``have`` in the type where it meets the other side's."""
    if want is None:
        return text_of(column, have)
    if isinstance(want, Spelled):
        if isinstance(have, T.StringType):
            return F.coalesce(text_of(F.trim(column).try_cast(want.kind), want.kind), column)
        return text_of(column, have)
    if have == want:
        return column
    if isinstance(want, T.VariantType):
        if isinstance(have, T.StringType):
            return F.coalesce(F.try_parse_json(column), column.cast("variant"))
        return F.parse_json(F.to_json(column, _JSON_TIMES))
    if isinstance(want, T.StructType):
        names = matches(want.names, have.names)
        fields = [as_met(column.getField(names[f.name]), have[names[f.name]].dataType, f.dataType).alias(f.name) for f in want]
        return F.when(column.isNotNull(), F.struct(*fields))
    if isinstance(want, T.ArrayType):
        return F.transform(column, lambda x: as_met(x, have.elementType, want.elementType))
    if isinstance(want, T.MapType):
        entries = F.transform(F.map_entries(column), lambda e: F.struct(as_met(e["key"], have.keyType, want.keyType).alias("key"), as_met(e["value"], have.valueType, want.valueType).alias("value")))
        return F.map_from_entries(entries)
    if isinstance(have, T.BooleanType) and not isinstance(want, (T.LongType, T.IntegerType)):
        return column.cast("int").cast(want)
    return column.cast(want)


def matches(names: Sequence[str], others: Sequence[str]) -> dict[str, str]:
    """For each name the other side's name of the same thing: as written, else the only one that differs in case alone."""
    found = {n: n for n in names if n in set(others)}
    return found | _unique({n: n.casefold() for n in names if n not in found}, {n: n.casefold() for n in others if n not in set(found.values())})


def _unique(mine: dict[str, str], theirs: dict[str, str]) -> dict[str, str]:
    """Names whose forms are equal and belong to one name of each side."""
    left, right = ({form: [n for n in side if side[n] == form] for form in side.values()} for side in (mine, theirs))
    return {left[form][0]: right[form][0] for form in left if len(left[form]) == 1 and len(right.get(form, ())) == 1}


def plain_name(table: str) -> str:
    """A table's name without the schema that goes without saying, in one case."""
    schema, _, name = table.rpartition(".")
    return name.casefold() if schema.casefold() in DEFAULT_SCHEMAS else table.casefold()


def resolve(tables: Sequence[str], others: Sequence[str]) -> dict[str, str]:
    """For each table the other side's name of it: as written, else in another case or without a default schema, if only one fits."""
    found = {t: t for t in tables if t in set(others)}
    taken = set(found.values())
    return found | _unique({t: plain_name(t) for t in tables if t not in found}, {t: plain_name(t) for t in others if t not in taken})


@dataclass
class Aligned:
    """Both sides under the source's names and in types that compare; ``alone`` are columns of one side, ``apart`` those that meet as text only."""

    src: DataFrame
    dst: DataFrame
    alone: list[str]
    apart: list[str]


def align(src: DataFrame, dst: DataFrame) -> Aligned:
    """The shared columns of two tables of different engines, in one order, under one name and in one type."""
    kinds, others = {f.name: f.dataType for f in src.schema}, {f.name: f.dataType for f in dst.schema}
    names = matches(src.columns, dst.columns)
    left, right, apart = [], [], []
    for c in (c for c in src.columns if c in names):
        a, b = kinds[c], others[names[c]]
        common = meet(a, b)
        if common is None:
            apart.append(f"{c} {a.simpleString()} / {b.simpleString()}")
        left.append(as_met(F.col(f"`{c}`"), a, common).alias(c))
        right.append(as_met(F.col(f"`{names[c]}`"), b, common).alias(c))
    alone = sorted([c for c in src.columns if c not in names] + [c for c in dst.columns if c not in set(names.values())])
    return Aligned(src.select(*left), dst.select(*right), alone, apart)
