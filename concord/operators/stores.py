"""Comparisons of logs, key-value entries and documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions.canon import measured
from concord.operators.diff import differences

TAIL = 200
TTL_FLOOR_MS, TTL_SHARE = 60_000, 0.1
LAG_ALLOWED = 10_000
#: One vocabulary for the value types of documents.
TYPE_NAMES = {"VOID": "null", "BOOLEAN": "bool", "BIGINT": "int", "DOUBLE": "double", "STRING": "string"}


def log_tail(log: DataFrame, n: int = TAIL) -> DataFrame:
    """topic, part, n, digest: an ordered md5 over key and value of the last ``n`` records of each partition.

    Ranks above ``n`` are dropped before the shuffle (a window group limit), so a long partition sends ``n``
    records from each task and gathers ``n`` digests.
    """
    record = F.md5(measured(F.col("key").cast("string"), F.col("v").cast("string")).cast("binary"))
    rank = F.row_number().over(Window.partitionBy("topic", "part").orderBy(F.desc("off")))
    tail = log.select("topic", "part", "off", record.alias("m")).withColumn("rank", rank).where(F.col("rank") <= n)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("off", "m"))), lambda x: x["m"])
    return tail.groupBy("topic", "part").agg(F.count("*").alias("n"), F.md5(F.array_join(ordered, "").cast("binary")).alias("digest"))


def log_counts(log: DataFrame) -> DataFrame:
    """topic, n: end minus begin offsets of all partitions, as a broker counts."""
    each = log.groupBy("topic", "part").agg((F.max("off") - F.min("off") + 1).alias("n"))
    return each.groupBy("topic").agg(F.sum("n").alias("n"))


def new_records(ends: DataFrame, baseline: DataFrame) -> DataFrame:
    """topic, part, n: records since the baseline; a partition that is new starts at 0."""
    j = ends.join(baseline.withColumnRenamed("off", "base"), ["topic", "part"], "left")
    return j.select("topic", "part", (F.col("off") - F.coalesce("base", F.lit(0))).alias("n"))


def group_lag(ends: DataFrame, committed: DataFrame) -> DataFrame:
    """grp, lag: records that each consumer group has not read."""
    j = committed.join(ends.withColumnRenamed("off", "end_off"), ["topic", "part"])
    return j.groupBy("grp").agg(F.sum(F.greatest(F.lit(0), F.col("end_off") - F.col("off"))).alias("lag"))


def group_lag_status(src: DataFrame, dst: DataFrame) -> DataFrame:
    """grp, src_lag, dst_lag, status: groups missing on the target, or lagging there by much more."""
    j = src.withColumnRenamed("lag", "src_lag").join(dst.withColumnRenamed("lag", "dst_lag"), "grp", "left")
    return j.withColumn("status", F.when(F.col("dst_lag").isNull(), "missing").when(F.col("dst_lag") > F.col("src_lag") + LAG_ALLOWED, "diff").otherwise("ok"))


def entry_text(df: DataFrame) -> Column:
    """One text for a typed entry (type, str, hash, items, scores): maps by key, sets and scores in order, lists as they are.

    Every member stands behind its length, so no comma or equals sign in one can pass for another member.
    """
    joined = lambda parts: F.array_join(F.transform(parts, lambda x: measured(x)), "")
    pairs = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: measured(e["key"], e["value"].cast("string"))), "")
    kind = F.col("type")
    return (
        F.when(kind == "string", F.col("str"))
        .when(kind == "hash", pairs(F.col("hash")))
        .when(kind == "zset", pairs(F.col("scores")))
        .when(kind == "set", joined(F.array_sort("items")))
        .when(kind == "list", joined(F.col("items")))
        .otherwise(F.size("items").cast("string"))
    )


def entries_difference(src: DataFrame, dst: DataFrame) -> DataFrame:
    """key, kind: entries of both sides by key; type and value must agree."""
    a = src.select("key", F.col("type").alias("s_type"), entry_text(src).alias("s"))
    b = dst.select("key", F.col("type").alias("d_type"), entry_text(dst).alias("d"))
    kind = F.when(F.col("d_type").isNull(), "missing").when(F.col("s_type").isNull(), "extra").when(F.col("s_type") != F.col("d_type"), "type").when(~F.col("s").eqNullSafe(F.col("d")), "changed")
    return a.join(b, "key", "full_outer").select("key", kind.alias("kind")).where("kind is not null")


def ttl_drift(src: DataFrame, dst: DataFrame) -> DataFrame:
    """key, kind, src_ttl, dst_ttl (ms): lifetimes lost, or off by more than a minute and a tenth."""
    j = src.select("key", F.col("ttl").alias("src_ttl")).join(dst.select("key", F.col("ttl").alias("dst_ttl")), "key")
    lost = (F.col("src_ttl") > 0) & ~(F.coalesce("dst_ttl", F.lit(-1)) > 0)
    off = F.abs(F.col("src_ttl") - F.col("dst_ttl")) > F.greatest(F.lit(float(TTL_FLOOR_MS)), TTL_SHARE * F.col("src_ttl"))
    return j.select("key", F.when(lost, "lost").when((F.col("src_ttl") > 0) & off, "drift").alias("kind"), "src_ttl", "dst_ttl").where("kind is not null")


def largest_entries(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy(F.desc("bytes"), "key").limit(n)


def sampled_keys(df: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """A repeatable share of keys, by hash."""
    return df.where(F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1_000_000)) < int(share * 1_000_000))


def field_types(docs: DataFrame, column: str = "doc") -> DataFrame:
    """field, type, n: value types of each top-level field over all JSON documents."""
    parsed = docs.select(F.try_parse_json(F.col(column)).alias("v"))
    each = parsed.selectExpr("v", "explode(json_object_keys(to_json(v))) as field").selectExpr("field", "schema_of_variant(try_variant_get(v, concat('$[\"', field, '\"]'), 'variant')) as kind")
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in TYPE_NAMES.items() for x in p]), F.col("kind")), F.when(F.col("kind").startswith("DECIMAL"), "double").when(F.col("kind").startswith("ARRAY"), "array").when(F.col("kind").startswith("OBJECT"), "object"), F.lower("kind"))
    return each.select("field", name.alias("type")).groupBy("field", "type").agg(F.count("*").alias("n"))


def dominant_types(types: DataFrame) -> DataFrame:
    """field, type: the most frequent type of each field, the first by name on a tie."""
    return types.groupBy("field").agg(F.max_by("type", F.struct(F.col("n"), F.col("type"))).alias("type"))


def type_drift(src: DataFrame, dst: DataFrame, column: str = "doc") -> DataFrame:
    """field, src_type, dst_type where the dominant types differ."""
    a, b = dominant_types(field_types(src, column)).withColumnRenamed("type", "src_type"), dominant_types(field_types(dst, column)).withColumnRenamed("type", "dst_type")
    return a.join(b, "field").where("src_type <> dst_type")


def null_or_absent(docs: DataFrame, fields: list[str], column: str = "doc") -> DataFrame:
    """field, nulls, absent: fields that hold null against fields that are not there."""
    keys, value = F.json_object_keys(column), lambda f: F.get_json_object(column, f"$.{f}")
    wide = docs.agg(*[F.count_if(F.array_contains(keys, f) & value(f).isNull()).alias(f"n__{f}") for f in fields], *[F.count_if(~F.coalesce(F.array_contains(keys, f), F.lit(False))).alias(f"a__{f}") for f in fields])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n__{f}").alias("nulls"), F.col(f"a__{f}").alias("absent")) for f in fields])).alias("x")).select("x.*")


def null_absent_drift(src: DataFrame, dst: DataFrame, fields: list[str], column: str = "doc") -> DataFrame:
    """field and both sides' counts where nulls became absent or the other way."""
    a = null_or_absent(src, fields, column).withColumnsRenamed({"nulls": "src_nulls", "absent": "src_absent"})
    b = null_or_absent(dst, fields, column).withColumnsRenamed({"nulls": "dst_nulls", "absent": "dst_absent"})
    return a.join(b, "field").where("src_nulls <> dst_nulls or src_absent <> dst_absent")


def documents_difference(src: DataFrame, dst: DataFrame, identity: str = "id", column: str = "doc") -> DataFrame:
    """id, kind: documents by identity, equal up to the order of their fields.

    A text that is no JSON is compared as it is; null, or an identity that occurs more than once, needs no care.
    """
    plain = lambda df: df.select(F.col(identity).alias("id"), F.coalesce(F.concat(F.lit("json:"), F.to_json(F.try_parse_json(F.col(column)))), F.concat(F.lit("text:"), F.col(column))).alias("doc"))
    return differences(plain(src), plain(dst), ["id"], ["doc"])


def duplicate_ids(shards: DataFrame) -> DataFrame:
    """id, n: identities that more than one shard holds."""
    return shards.groupBy("id").agg(F.count("*").alias("n")).where("n > 1")


# ---- nested documents


def path_types(docs: DataFrame, column: str = "doc") -> DataFrame:
    """path, type, n: the types of the values at each path of JSON documents, nested ones too, and of how many documents.

    A path is a JSON path: $ is the document, [*] the elements of an array, and a name that is no plain word stands
    in brackets and quotes. Documents are first counted by their shape, which is one text for all of them, so a
    shape that fills the table is taken apart once for each task. Texts that are no JSON have the type none.
    """
    shape = F.coalesce(F.schema_of_variant(F.try_parse_json(F.col(column))), F.lit("NONE"))
    counted = docs.where(F.col(column).isNotNull()).groupBy(shape.alias("shape")).agg(F.count("*").alias("n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, kind, n) for text, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for path, kind in shape_paths(text)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.int64()))], names=["path", "type", "n"])

    return counted.mapInArrow(run, "path string, type string, n long").groupBy("path", "type").agg(F.sum("n").alias("n"))


_WORD = re.compile(r"[A-Za-z_]\w*$")
_SHAPE = re.compile(r"`(?:[^`]|``)*`|[A-Za-z_][\w]*(?:\(\d+,\s*\d+\))?|[<>:,]|\S")


def shape_paths(shape: str) -> list[tuple[str, str]]:
    """The path and type of every part of a shape such as OBJECT<a: ARRAY<BIGINT>>, the whole first."""
    words, out = _SHAPE.findall(shape), []

    def part(at: int, path: str) -> int:
        kind = words[at]
        name = TYPE_NAMES.get(kind, "double" if kind.startswith(("DECIMAL", "FLOAT")) else kind.lower())
        out.append((path, name))
        at += 1
        if kind not in ("OBJECT", "ARRAY") or at >= len(words) or words[at] != "<":
            return at
        at += 1
        if kind == "ARRAY":
            return part(at, f"{path}[*]") + 1
        while words[at] != ">":
            field = words[at][1:-1].replace("``", "`") if words[at][0] == "`" else words[at]
            at = part(at + 2, path + (f".{field}" if _WORD.match(field) else "['" + field.replace("'", "\\'") + "']"))
            at += words[at] == ","
        return at + 1

    part(0, "$")
    return out


#: Types that another one holds: whole numbers among doubles, and nothing at all among anything.
WIDER = {("int", "double"): "double"}


def merged_types(types: DataFrame) -> DataFrame:
    """path, type, n: one type for each path that holds all of its types: null gives way, int widens to double, others are mixed."""
    kinds = F.array_sort(F.collect_set(F.when(F.col("type") != "null", F.col("type"))))
    wider = F.create_map(*[F.lit(x) for pair, wide in WIDER.items() for x in (",".join(sorted(pair)), wide)])
    whole = F.when(F.size("kinds") == 0, "null").when(F.size("kinds") == 1, F.get("kinds", F.lit(0))).otherwise(F.coalesce(F.element_at(wider, F.array_join("kinds", ",")), F.lit("mixed")))
    return types.groupBy("path").agg(kinds.alias("kinds"), F.sum("n").alias("n")).select("path", whole.alias("type"), "n")


def path_drift(src: DataFrame, dst: DataFrame, column: str = "doc") -> DataFrame:
    """path, src_type, dst_type of every path whose merged type differs or that one side alone has, elements and nested names included."""
    a, b = (merged_types(path_types(df, column)).select("path", F.col("type").alias(name)) for df, name in ((src, "src_type"), (dst, "dst_type")))
    return a.join(b, "path", "full_outer").where(~F.col("src_type").eqNullSafe(F.col("dst_type")))
