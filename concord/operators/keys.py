"""Minimal keys of a table: the smallest sets of columns whose values tell its rows apart.

The search goes up by levels. Of each set of columns an approximate count of distinct values, all sets of a level
in one scan, says whether it can be a key at all; the sets that can are counted exactly. A set that is a key is not
grown, and a set of which no column adds anything is not either, so few levels are looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.canon import part_of

#: Relative error of the approximate counts; a set within three of it may be a key.
ERROR = 0.02
#: Sets that one scan counts.
AT_ONCE = 64


def _value(df: DataFrame, names: Sequence[str]):
    kinds = {f.name: f.dataType for f in df.schema}
    return F.xxhash64(F.concat(*[part_of(F.col(f"`{n}`"), kinds[n]) for n in names]))


def _approximate(df: DataFrame, sets: Sequence[tuple[str, ...]]) -> dict[tuple[str, ...], int]:
    """About how many values each set has, by one scan for ``AT_ONCE`` of them."""
    out = {}
    for i in range(0, len(sets), AT_ONCE):
        part = sets[i : i + AT_ONCE]
        row = df.agg(*[F.approx_count_distinct(_value(df, names), ERROR).alias(f"n{k}") for k, names in enumerate(part)]).first()
        out |= {names: row[f"n{k}"] for k, names in enumerate(part)}
    return out


def repeated(df: DataFrame, names: Sequence[str]) -> bool:
    """Whether two rows share the values of these columns, nulls being values; rows are combined before they move."""
    groups = df.groupBy(*[F.col(f"`{n}`") for n in names]).agg(F.count("*").alias("__n"))
    return not groups.where("__n > 1").isEmpty()


def minimal_keys(df: DataFrame, columns: Iterable[str] | None = None, most: int = 3) -> list[tuple[str, ...]]:
    """The minimal keys of up to ``most`` columns, in order; none proves that no such set is one.

    Columns with a null are no part of a key, and neither are those of types that are not compared.
    """
    kinds = {f.name: f.dataType for f in df.schema}
    names = [c for c in (columns or df.columns) if not isinstance(kinds[c], (T.MapType, T.VariantType))]
    facts = df.agg(F.count("*").alias("n"), *[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(names)]).first()
    n = facts["n"]
    names = [c for i, c in enumerate(names) if facts[f"c{i}"] == n]
    found: list[tuple[str, ...]] = []
    sizes: dict[tuple[str, ...], int] = {(): 1}
    level = [(c,) for c in names]
    for width in range(1, most + 1):
        counted = _approximate(df, level)
        sizes |= counted
        likely = [s for s in level if counted[s] >= (1 - 3 * ERROR) * n]
        found += [s for s in likely if not repeated(df, s)]
        if width == most:
            break
        # a set grows unless it is a key, or adds nothing to one of its parts
        growing = {s for s in level if s not in found and sizes[s] > 1}
        level = [s for s in combinations(names, width + 1) if all(part in growing for part in combinations(s, width)) and _product(sizes, s) >= (1 - 3 * ERROR) * n]
        if not level:
            break
    return sorted(found, key=lambda s: (len(s), [names.index(c) for c in s]))


def _product(sizes: dict[tuple[str, ...], int], names: tuple[str, ...]) -> float:
    """The most values that a set can have, by those of its columns and parts."""
    most = min(sizes[part] * max(1, sizes[(rest,)]) for rest in names for part in [tuple(c for c in names if c != rest)])
    return most * (1 + 3 * ERROR) ** 2
