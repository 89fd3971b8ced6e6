"""Detectors of damage that row counts hide. All look at whole tables; none samples."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from concord.functions.canon import canonical
from concord.functions.text import normalized_expression
from concord.operators.diff import set_difference

REPLACEMENT = "�"
#: Bytes of an integer type.
INTEGER_WIDTH = {"tinyint": 1, "smallint": 2, "mediumint": 3, "int": 4, "integer": 4, "bigint": 8}
#: Bytes a character can take in a charset.
CHARSET_WIDTH = {"utf8mb4": 4, "utf8mb3": 3, "utf8": 3, "latin1": 1, "ascii": 1}


def all_not_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"`{c}`").isNotNull() for c in columns])


def orphans(child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]) -> DataFrame:
    """Child rows whose reference, all of it not null, has no parent."""
    known = parent.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(parent_columns)]).distinct()
    condition = reduce(lambda a, b: a & b, [child[c] == known[f"__p{i}"] for i, c in enumerate(columns)])
    return child.where(all_not_null(columns)).join(known, condition, "left_anti")


def time_shift(src: DataFrame, dst: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """n, mean_s, min_s, max_s of target minus source, and ``uniform``: the mark of a time zone read wrongly."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    a = src.where(F.col(column).isNotNull()).select(*key, F.col(column).alias("__s"))
    b = dst.where(F.col(column).isNotNull()).select(*key, F.col(column).alias("__d"))
    found = a.join(b, list(key)).select((seconds("__d") - seconds("__s")).alias("delta"))
    stats = found.agg(F.count("*").alias("n"), F.avg("delta").alias("mean_s"), F.min("delta").alias("min_s"), F.max("delta").alias("max_s"))
    return stats.withColumn("uniform", F.coalesce((F.col("n") >= 3) & (F.col("max_s") - F.col("min_s") < 1) & (F.abs("mean_s") >= 1), F.lit(False)))


def float_drift(src: DataFrame, dst: DataFrame, key: Sequence[str], column: str, tolerance: float = 1e-9) -> DataFrame:
    """n, n_beyond, max_diff of values that differ by more than the relative tolerance."""
    a, b = src.select(*key, F.col(column).alias("__a")), dst.select(*key, F.col(column).alias("__b"))
    diff = F.abs(F.col("__a") - F.col("__b"))
    beyond = diff > tolerance * F.greatest(F.abs("__a"), F.abs("__b"), F.lit(1.0))
    found = a.join(b, list(key)).where(F.col("__a").isNotNull() & F.col("__b").isNotNull())
    return found.agg(F.count("*").alias("n"), F.count_if(beyond).alias("n_beyond"), F.max(F.when(beyond, diff)).alias("max_diff"))


def paired_drift(src: DataFrame, dst: DataFrame, key: Sequence[str], times: Sequence[str], numbers: Sequence[str], tolerance: float = 1e-9) -> dict[str, dict]:
    """By column, what ``time_shift`` and ``float_drift`` find, from one join of the two sides and one row of numbers."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1e6
    names = [*times, *numbers]
    a = src.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(key)], *[F.col(f"`{c}`").alias(f"__s{i}") for i, c in enumerate(names)])
    b = dst.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(key)], *[F.col(f"`{c}`").alias(f"__d{i}") for i, c in enumerate(names)])
    found, aggregates = a.join(b, [f"__k{i}" for i in range(len(key))]), []
    for i in range(len(names)):
        s, d = F.col(f"__s{i}"), F.col(f"__d{i}")
        if i < len(times):
            delta = seconds(f"__d{i}") - seconds(f"__s{i}")
            aggregates += [F.count(delta).alias(f"n{i}"), F.avg(delta).alias(f"mean{i}"), F.min(delta).alias(f"low{i}"), F.max(delta).alias(f"high{i}")]
        else:
            gap = F.abs(s - d)
            beyond = gap > tolerance * F.greatest(F.abs(s), F.abs(d), F.lit(1.0))
            aggregates += [F.count_if(beyond).alias(f"n{i}"), F.max(F.when(beyond, gap)).alias(f"high{i}")]
    row = found.agg(*aggregates).first().asDict() if aggregates else {}
    out = {}
    for i, c in enumerate(names):
        n, high = row[f"n{i}"], row[f"high{i}"]
        if i < len(times):
            out[c] = {"n": n, "mean_s": row[f"mean{i}"], "uniform": n >= 3 and high - row[f"low{i}"] < 1 and abs(row[f"mean{i}"]) >= 1}
        else:
            out[c] = {"n_beyond": n, "max_diff": high}
    return out


def repeated_keys(df: DataFrame, key: Sequence[str]) -> int:
    """How many keys without null occur more than once."""
    groups = df.where(all_not_null(key)).groupBy(*[F.col(f"`{k}`") for k in key]).agg(F.count("*").alias("__n"))
    return groups.agg(F.count_if(F.col("__n") > 1)).first()[0]


def type_facts(df: DataFrame) -> DataFrame:
    """column, type, char_length, scale, precision, unsigned of a table's own schema, for ``narrowed``."""
    rows = []
    for f in df.schema:
        kind, size = f.dataType.simpleString(), f.metadata.get("__CHAR_VARCHAR_TYPE_STRING", "")
        length = int(size.split("(")[1].rstrip(")")) if "(" in size else 0
        decimal = f.dataType.typeName() == "decimal"
        rows.append((f.name, kind.split("(")[0], length, f.dataType.scale if decimal else 0, f.dataType.precision if decimal else 0, False))
    return df.sparkSession.createDataFrame(rows, "column string, type string, char_length long, scale long, precision long, unsigned boolean")


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() == "string"]


def _per_column(df: DataFrame, columns: Sequence[str], measures: dict) -> DataFrame:
    """column and each measure, from one scan for all columns."""
    wide = df.agg(*[make(c).alias(f"{m}__{c}") for c in columns for m, make in measures.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), *[F.col(f"`{m}__{c}`").alias(m) for m in measures]) for c in columns])).alias("x")).select("x.*")


def null_empty_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _per_column(df, columns or text_columns(df), {"nulls": lambda c: F.count_if(F.col(c).isNull()), "empties": lambda c: F.count_if(F.col(c) == "")})


def null_empty_flip(src: DataFrame, dst: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, counts of both sides and ``flipped``: nulls and empty strings traded places."""
    a = null_empty_counts(src, columns).withColumnsRenamed({"nulls": "src_nulls", "empties": "src_empties"})
    b = null_empty_counts(dst, columns).withColumnsRenamed({"nulls": "dst_nulls", "empties": "dst_empties"})
    flipped = (F.col("src_nulls") != F.col("dst_nulls")) & (F.col("src_nulls") + F.col("src_empties") == F.col("dst_nulls") + F.col("dst_empties"))
    return a.join(b, "column").withColumn("flipped", flipped)


def replacement_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return _per_column(df, columns or text_columns(df), {"n": lambda c: F.coalesce(F.sum(F.length(c) - F.length(F.replace(F.col(c), F.lit(REPLACEMENT), F.lit("")))), F.lit(0)).cast("long")})


def replacement_excess(src: DataFrame, dst: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, n_src, n_dst where the target has more U+FFFD than the source: text broken on the way."""
    a, b = replacement_counts(src, columns).withColumnRenamed("n", "n_src"), replacement_counts(dst, columns).withColumnRenamed("n", "n_dst")
    return a.join(b, "column").where("n_dst > n_src")


def collapsing(df: DataFrame, column: str, collation: str | None = None) -> DataFrame:
    """folded, n: values that become equal under a looser collation; ``None`` folds by lower()."""
    value = F.col(f"`{column}`")
    folded = F.lower(value) if collation is None else F.collate(value, collation)
    values = df.where(value.isNotNull()).select(value.alias("v"), folded.alias("folded"))
    return values.groupBy("folded").agg(F.count("*").alias("n")).where("n > 1").select(F.col("folded").cast("string").alias("folded"), "n")


def narrowed(src: DataFrame, dst: DataFrame) -> DataFrame:
    """column, reason for target columns that cannot hold what the source's can.

    Both are tables of (column, type, char_length, scale, precision, unsigned); the first reason counts in
    the order characters, scale, precision, integer width, sign.
    """
    names = ("type", "char_length", "scale", "precision", "unsigned")
    j = src.select("column", *[F.col(n).alias(f"s_{n}") for n in names]).join(dst.select("column", *[F.col(n).alias(f"d_{n}") for n in names]), "column")
    width = lambda c: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in INTEGER_WIDTH.items() for x in p]), F.lower(F.col(c))), F.lit(None).cast("int"))
    decimal = F.lower("s_type").isin("decimal", "numeric")
    less = lambda n: (F.col(f"s_{n}") > 0) & (F.col(f"d_{n}") < F.col(f"s_{n}"))
    arrow = lambda label, n: F.concat(F.lit(label), F.col(f"s_{n}").cast("string"), F.lit(" -> "), F.col(f"d_{n}").cast("string"))
    reason = (
        F.when((F.col("d_char_length") > 0) & less("char_length"), arrow("char ", "char_length"))
        .when(decimal & less("scale"), arrow("scale ", "scale"))
        .when(decimal & less("precision"), arrow("precision ", "precision"))
        .when(width("d_type") < width("s_type"), arrow("integer ", "type"))
        .when(F.col("s_unsigned") & ~F.col("d_unsigned") & width("s_type").isNotNull(), F.lit("unsigned -> signed"))
    )
    return j.select("column", reason.alias("reason")).where("reason is not null")


def charset_downgrade(src: DataFrame, dst: DataFrame) -> DataFrame:
    """column, src_charset, dst_charset where the target's characters take fewer bytes."""
    width = lambda c: F.element_at(F.create_map(*[F.lit(x) for p in CHARSET_WIDTH.items() for x in p]), F.lower(F.col(c)))
    j = src.select("column", F.col("charset").alias("src_charset")).join(dst.select("column", F.col("charset").alias("dst_charset")), "column")
    return j.where(width("dst_charset") < width("src_charset"))


def evaluable(df: DataFrame, expression: str) -> bool:
    """Whether Spark can evaluate an expression of another engine over a table: it knows its functions and its columns."""
    try:
        df.select(F.expr(expression))
    except Exception:  # a parser's, an analyser's or a type's error
        return False
    return True


def generated_mismatch(df: DataFrame, column: str, expression: str) -> DataFrame:
    """Rows whose stored value is not what the expression gives, nulls compared as values."""
    return df.where(~F.col(f"`{column}`").eqNullSafe(F.expr(expression)))


def row_local(df: DataFrame, rules: dict[str, str], generated: dict[str, str]) -> dict[tuple[str, str], int]:
    """How many rows break each rule and each generated column's expression, all by one scan: (checks, name) and (generated, column) to n."""
    looks = {("checks", name): F.count_if(~F.expr(rule)) for name, rule in rules.items()}
    looks |= {("generated", column): F.count_if(~F.col(f"`{column}`").eqNullSafe(F.expr(rule))) for column, rule in generated.items()}
    if not looks:
        return {}
    found = df.agg(*[look.alias(f"n{i}") for i, look in enumerate(looks.values())]).first()
    return dict(zip(looks, found))


def generation_drift(src: DataFrame, dst: DataFrame) -> DataFrame:
    """table, column, src_expr, dst_expr where generation expressions differ beyond spacing and case."""
    j = src.withColumnRenamed("expression", "src_expr").join(dst.withColumnRenamed("expression", "dst_expr"), ["table", "column"], "full_outer")
    return j.where(~normalized_expression(F.col("src_expr")).eqNullSafe(normalized_expression(F.col("dst_expr"))))


def partition_drift(src: DataFrame, dst: DataFrame) -> DataFrame:
    """table, bound, side: partition bounds that only one side has."""
    return set_difference(src, dst, "table", "bound")


def merged_bounds(bounds: Sequence[tuple]) -> list[tuple]:
    """The declared ranges [low, high), in order, with those that overlap or touch in one; empty ranges hold nothing."""
    out: list[list] = []
    for low, high in sorted((a, b) for a, b in bounds if a < b):
        if out and low <= out[-1][1]:
            out[-1][1] = max(high, out[-1][1])
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def _place(value: Column, kind: T.DataType) -> Column | None:
    """A value on a line of doubles that keeps its order, or None for types that have no distances."""
    if isinstance(kind, T.NumericType):
        return value.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")).cast("double")
    return None


def stranded(df: DataFrame, column: str, bounds: Sequence[tuple]) -> DataFrame:
    """Rows that no declared range [low, high) holds, so they lie in the default partition.

    An interval join: the line from the least to the greatest bound is cut into as many cells as there are
    ranges, a range is listed under the cells that it covers, which are three for each range at most on the
    whole, and a row looks its cell up. The plan stays the same however many ranges there are.
    """
    spark, value, kind = df.sparkSession, F.col(f"`{column}`"), df.schema[column].dataType
    kind = T.LongType() if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)) else kind  # an open range ends beyond small types
    ranges = merged_bounds(bounds)
    place = _place(value, kind)
    if not ranges:
        return df
    if place is None:  # texts: few ranges, as lists of partitions have
        held = reduce(lambda a, b: a | b, [(value >= low) & (value < high) for low, high in ranges])
        return df.where(~F.coalesce(held, F.lit(False)))
    table = spark.createDataFrame([(str(a), str(b)) for a, b in ranges], "low string, high string").select(F.col("low").cast(kind).alias("__low"), F.col("high").cast(kind).alias("__high"))
    first, last = table.agg(F.min(_place(F.col("__low"), kind)).alias("a"), F.max(_place(F.col("__high"), kind)).alias("b")).first()
    width = (last - first) / len(ranges)
    cell = lambda x: F.floor((x - F.lit(first)) / F.lit(width))
    cells = table.withColumn("__cell", F.explode(F.sequence(cell(_place(F.col("__low"), kind)), cell(_place(F.col("__high"), kind)))))
    return df.withColumn("__at", cell(place)).join(F.broadcast(cells), (F.col("__at") == F.col("__cell")) & (value >= F.col("__low")) & (value < F.col("__high")), "left_anti").drop("__at")


def boundary(src: DataFrame, dst: DataFrame) -> DataFrame:
    """table, src_max, dst_max, status: a target ahead of its source is a difference, one behind is on its way."""
    j = src.withColumnRenamed("high", "src_max").join(dst.withColumnRenamed("high", "dst_max"), "table", "left")
    status = F.when(F.col("dst_max") > F.coalesce("src_max", F.lit(-1)), "diff").otherwise("ok")
    note = F.when(F.col("dst_max") > F.coalesce("src_max", F.lit(-1)), "ahead").when(F.col("dst_max").eqNullSafe(F.col("src_max")), "level").otherwise("behind")
    return j.select("table", "src_max", "dst_max", status.alias("status"), note.alias("position"))


def rendered_difference(src: DataFrame, dst: DataFrame, key: Sequence[str], column: str) -> DataFrame:
    """key columns, src_text, dst_text where a value of an unusual type reads differently on the target."""
    kinds = {f.name: f.dataType for f in src.schema}, {f.name: f.dataType for f in dst.schema}
    a = src.where(F.col(column).isNotNull()).select(*key, canonical(column, kinds[0][column]).alias("src_text"))
    b = dst.select(*key, canonical(column, kinds[1][column]).alias("dst_text"))
    return a.join(b, list(key)).where(~F.col("src_text").eqNullSafe(F.col("dst_text")))


def stale_view(stored: DataFrame, query: DataFrame) -> DataFrame:
    """stored_n, fresh_n, populated, current: a stored view against its own query."""
    from concord.operators.fingerprint import counts_from_fingerprints, table_fingerprint

    both = counts_from_fingerprints(table_fingerprint(stored), table_fingerprint(query.select(*stored.columns)))
    return both.select(F.col("n_src").alias("stored_n"), F.col("n_dst").alias("fresh_n"), (F.col("n_src") > 0).alias("populated"), F.col("same_content").alias("current"))


def constraint_violations(df: DataFrame, checks: dict[str, str]) -> DataFrame:
    """constraint, n: rows that make a check false; a check that is unknown for a row holds, as in SQL."""
    wide = df.agg(*[F.count_if(~F.expr(rule)).alias(name) for name, rule in checks.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("constraint"), F.col(f"`{n}`").alias("n")) for n in checks])).alias("x")).select("x.*")


def candidate_keys(df: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """columns, usable: whether a set of columns is without nulls and duplicates over the whole table."""
    parts = []
    for names in candidates:
        groups = df.groupBy(*names).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("d"), F.count_if(~all_not_null(names)).alias("z"))
        parts.append(groups.select(F.lit(",".join(names)).alias("columns"), ((F.col("d") == 0) & (F.col("z") == 0)).alias("usable")))
    return reduce(DataFrame.unionByName, parts)
