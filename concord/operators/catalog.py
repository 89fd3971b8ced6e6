"""Differences of catalogs: objects, columns, settings, permissions, counters, indexes, topics, logins.

Catalog facts come as small tables with one row a fact; every comparison is an outer, semi or anti join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.functions.text import normalized_expression
from concord.operators.diff import set_difference

#: Settings whose difference changes what data means, by engine.
CRITICAL_SETTINGS = {
    "postgres": (
        "TimeZone", "client_encoding", "server_encoding", "lc_collate", "lc_ctype", "lc_monetary", "lc_numeric", "lc_time", "DateStyle", "IntervalStyle", "standard_conforming_strings", "bytea_output",
        "default_transaction_isolation", "extra_float_digits", "wal_level", "integer_datetimes", "backslash_quote", "check_function_bodies", "array_nulls", "search_path", "default_text_search_config",
    ),
    "mysql": (
        "time_zone", "system_time_zone", "character_set_server", "character_set_database", "collation_server", "collation_database", "collation_connection", "sql_mode", "lower_case_table_names",
        "default_storage_engine", "transaction_isolation", "explicit_defaults_for_timestamp", "character_set_connection", "character_set_client", "character_set_results", "max_allowed_packet", "group_concat_max_len", "version",
    ),
    "mongodb": ("featureCompatibilityVersion",),
    "mssql": (),
}
#: Topic settings whose difference changes what a topic means.
CRITICAL_TOPIC_SETTINGS = ("cleanup.policy", "retention.ms", "retention.bytes", "max.message.bytes", "min.insync.replicas", "compression.type", "delete.retention.ms", "segment.ms")


def objects_difference(src: DataFrame, dst: DataFrame, ignore_invalid: bool = True) -> DataFrame:
    """obj_type, missing, extra, same: objects of each kind by side; invalid indexes are noted elsewhere."""
    kinds = (lambda df: df.where("obj_type <> 'invalid_index'")) if ignore_invalid else (lambda df: df)
    a = kinds(src).select("obj_type", "obj_name", F.lit(1).alias("s")).distinct()
    b = kinds(dst).select("obj_type", "obj_name", F.lit(1).alias("d")).distinct()
    both = a.join(b, ["obj_type", "obj_name"], "full_outer")
    return both.groupBy("obj_type").agg(F.count_if(F.col("d").isNull()).alias("missing"), F.count_if(F.col("s").isNull()).alias("extra"), F.count_if(F.col("s").isNotNull() & F.col("d").isNotNull()).alias("same"))


def definitions_difference(src: DataFrame, dst: DataFrame) -> DataFrame:
    """obj_type, obj_name, kind: objects by name whose definitions differ beyond spacing and case."""
    digest = lambda c: F.sha2(normalized_expression(F.col(c)).cast("binary"), 256)
    j = src.withColumnRenamed("definition", "s").join(dst.withColumnRenamed("definition", "d"), ["obj_type", "obj_name"], "full_outer")
    kind = F.when(F.col("d").isNull(), "missing").when(F.col("s").isNull(), "extra").when(digest("s") != digest("d"), "changed")
    return j.select("obj_type", "obj_name", kind.alias("kind")).where("kind is not null")


def columns_drift(src: DataFrame, dst: DataFrame, attributes: Sequence[str] = ("type", "nullable", "default")) -> DataFrame:
    """table, column, attribute, src_value, dst_value for columns of both sides."""
    a = src.select("table", "column", *[F.col(x).alias(f"s_{x}") for x in attributes])
    b = dst.select("table", "column", *[F.col(x).alias(f"d_{x}") for x in attributes])
    cells = F.array(*[F.struct(F.lit(x).alias("attribute"), F.col(f"s_{x}").cast("string").alias("src_value"), F.col(f"d_{x}").cast("string").alias("dst_value")) for x in attributes])
    return a.join(b, ["table", "column"]).select("table", "column", F.explode(cells).alias("x")).select("table", "column", "x.*").where(~F.col("src_value").eqNullSafe(F.col("dst_value")))


def schema_table(df: DataFrame, table: str) -> DataFrame:
    """table, column, position, type, nullable of a DataFrame's own schema."""
    rows = [(table, f.name, i, f.dataType.simpleString(), f.nullable) for i, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "table string, column string, position int, type string, nullable boolean")


def settings_difference(src: DataFrame, dst: DataFrame, critical: Sequence[str]) -> DataFrame:
    """name, src_value, dst_value, critical for settings that differ or that one side lacks."""
    j = src.select("name", F.col("value").alias("src_value")).join(dst.select("name", F.col("value").alias("dst_value")), "name", "full_outer")
    return j.where(~F.col("src_value").eqNullSafe(F.col("dst_value"))).withColumn("critical", F.lower("name").isin([c.lower() for c in critical]))


def settings_status(difference: DataFrame) -> DataFrame:
    """n_different, n_critical, status: only a critical setting makes a difference."""
    counts = difference.agg(F.count("*").alias("n_different"), F.count_if("critical").alias("n_critical"))
    return counts.withColumn("status", F.when(F.col("n_critical") > 0, "diff").otherwise("ok"))


def settings_classes(src: DataFrame, dst: DataFrame, critical: Sequence[str], harmless: Sequence[str]) -> DataFrame:
    """name, class: A critical and different or one-sided, B different but known harmless, C anything else that differs."""
    j = src.select("name", F.col("value").alias("s"), F.lit(True).alias("has_s")).join(dst.select("name", F.col("value").alias("d"), F.lit(True).alias("has_d")), "name", "full_outer")
    norm = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    both, name = F.col("has_s").isNotNull() & F.col("has_d").isNotNull(), F.lower("name")
    is_critical, is_harmless = name.isin(*[c.lower() for c in critical]), name.isin(*[c.lower() for c in harmless])
    kind = (
        F.when(both & (norm("s") == norm("d")), None)
        .when(both & is_harmless, "B")
        .when(both & is_critical, "A_value")
        .when(both, "C_value")
        .when(is_critical, "A_presence")
        .when(F.col("has_s").isNotNull(), "C_only_src")
        .otherwise("C_only_dst")
    )
    return j.select("name", kind.alias("class")).where("class is not null")


def grants_difference(src: DataFrame, dst: DataFrame, src_roles: DataFrame, dst_roles: DataFrame) -> DataFrame:
    """grantee, object, privilege, side: permissions of one side alone, for roles that the other side has too."""
    found = set_difference(src, dst, "grantee", "object", "privilege")
    both = src_roles.select(F.col("role").alias("grantee")).intersect(dst_roles.select("role"))
    return found.join(both, "grantee", "left_semi").select("grantee", "object", "privilege", "side")


def missing_grants(src: DataFrame, dst: DataFrame) -> DataFrame:
    """Source permissions that the target lacks, one way."""
    return set_difference(src, dst, "grantee", "object", "privilege").where("side = 'src'").drop("side")


def grants_by_grantee(missing: DataFrame) -> DataFrame:
    return missing.groupBy("grantee").agg(F.count("*").alias("n"))


def _quoted_name(name: Column, marks: str) -> Column:
    """A name in an engine's quotes, each part of a dotted one by itself."""
    left, right = marks[0], marks[-1]
    part = lambda x: F.concat(F.lit(left), F.replace(x, F.lit(right), F.lit(right * 2)), F.lit(right))
    return F.array_join(F.transform(F.split(name, r"\."), part), ".")


def grant_statements(missing: DataFrame, engine: str = "postgres") -> DataFrame:
    """statement, undo for each missing permission, names in the engine's quotes; MySQL's accounts come quoted from its catalog."""
    marks = {"mysql": "`", "mssql": "[]"}.get(engine, '"')
    grantee = F.col("grantee") if engine == "mysql" else _quoted_name(F.col("grantee"), marks)
    tail = lambda word: F.concat(F.col("privilege"), F.lit(" ON "), _quoted_name(F.col("object"), marks), F.lit(word), grantee, F.lit(";"))
    return missing.select(F.concat(F.lit("GRANT "), tail(" TO ")).alias("statement"), F.concat(F.lit("REVOKE "), tail(" FROM ")).alias("undo"))


def extensions_difference(src: DataFrame, dst: DataFrame) -> DataFrame:
    """name, kind, src_version, dst_version: extensions that the target lacks or has in another version."""
    j = src.select("name", F.col("version").alias("src_version")).join(dst.select("name", F.col("version").alias("dst_version")), "name", "full_outer")
    kind = F.when(F.col("dst_version").isNull(), "missing").when(F.col("src_version").isNull(), "extra").when(F.col("src_version") != F.col("dst_version"), "version")
    return j.select("name", kind.alias("kind"), "src_version", "dst_version").where("kind is not null")


def next_value(engine: str) -> Column:
    """The next value a counter hands out, as each engine counts."""
    last, step = F.col("last_value"), F.coalesce("increment", F.lit(1))
    if engine == "postgres":
        return F.when(F.col("is_called"), last + step).otherwise(last)
    if engine == "mysql":
        return last  # its counter is the next value already
    return last + step  # others keep the last value


def counters_usable(counters: DataFrame, maxima: DataFrame, engine: str = "postgres") -> DataFrame:
    """table, next_value, max_value, status: a counter whose next value is taken is a difference."""
    j = counters.join(maxima, "table").select("table", next_value(engine).alias("next_value"), F.col("high").alias("max_value"))
    return j.withColumn("status", F.when((F.col("max_value") > 0) & (F.col("next_value") <= F.col("max_value")), "diff").otherwise("ok"))


def counters_parity(src: DataFrame, dst: DataFrame) -> DataFrame:
    """table, src_value, dst_value, status of the source's counters on the target; a missing one shows as MISSING."""
    j = src.select("table", F.col("last_value").alias("s")).join(dst.select("table", F.col("last_value").alias("d")), "table", "left")
    return j.select("table", F.col("s").cast("string").alias("src_value"), F.coalesce(F.col("d").cast("string"), F.lit("MISSING")).alias("dst_value"), F.when(F.col("s") == F.col("d"), "ok").otherwise("diff").alias("status"))


def indexes_difference(src: DataFrame, dst: DataFrame, attributes: Sequence[str] = ("is_unique", "ttl", "partial", "collation")) -> DataFrame:
    """table, index, reason: indexes that the target lacks or has with other attributes."""
    a = src.select("table", "index", *[F.col(x).cast("string").alias(f"s_{x}") for x in attributes], F.lit(1).alias("s"))
    b = dst.select("table", "index", *[F.col(x).cast("string").alias(f"d_{x}") for x in attributes], F.lit(1).alias("d"))
    lost = F.when(F.col("d").isNull(), F.lit("missing"))
    changed = [F.when(~F.col(f"s_{x}").eqNullSafe(F.col(f"d_{x}")) & F.col("d").isNotNull(), F.lit(x)) for x in attributes]
    return a.join(b, ["table", "index"], "left").select("table", "index", F.concat_ws(",", lost, *changed).alias("reason")).where("reason <> ''")


def deferrable_drift(src: DataFrame, dst: DataFrame) -> DataFrame:
    """table, constraint, src_flags, dst_flags: constraints that may be deferred on one side alone."""
    flags = lambda p: F.concat_ws("/", F.col("deferrable").cast("string"), F.col("deferred").cast("string")).alias(p)
    j = src.select("table", "constraint", flags("src_flags")).join(dst.select("table", "constraint", flags("dst_flags")), ["table", "constraint"])
    return j.where("src_flags <> dst_flags")


def flagged(meta: DataFrame, condition: str, *names: str) -> DataFrame:
    """Catalog entries in a bad state, such as disabled triggers or constraints that were never validated."""
    return meta.where(condition).select(*names)


def row_security(tables: DataFrame, policies: DataFrame, bypass: bool = False) -> DataFrame:
    """table, n_policies, blind: tables with row security that hides all rows from a reader."""
    counted = tables.where("row_security").join(policies.groupBy("table").agg(F.count("*").alias("n")), "table", "left").select("table", F.coalesce("n", F.lit(0)).alias("n_policies"))
    return counted.withColumn("blind", (F.col("n_policies") == 0) | ~F.lit(bypass))


def capped_drift(src: DataFrame, dst: DataFrame) -> DataFrame:
    """collection, reason: capped collections that are not, or are smaller, on the target."""
    j = src.where("capped").select("collection", F.col("size").alias("s")).join(dst.select("collection", F.col("capped").alias("c"), F.col("size").alias("d")), "collection")
    return j.select("collection", F.when(~F.col("c"), "flag lost").when(F.col("d") < F.col("s"), "smaller").alias("reason")).where("reason is not null")


def topics_difference(src: DataFrame, dst: DataFrame) -> DataFrame:
    """topic, kind: topics that one side lacks or whose partition counts differ."""
    j = src.select("topic", F.col("partitions").alias("s")).join(dst.select("topic", F.col("partitions").alias("d")), "topic", "full_outer")
    kind = F.when(F.col("d").isNull(), "missing").when(F.col("s").isNull(), "extra").when(F.col("s") != F.col("d"), "partitions")
    return j.select("topic", kind.alias("kind")).where("kind is not null")


def topic_settings_difference(src: DataFrame, dst: DataFrame) -> DataFrame:
    """topic, name, src_value, dst_value of critical settings that differ on topics of both sides."""
    keep = F.col("name").isin(*CRITICAL_TOPIC_SETTINGS)
    j = src.where(keep).withColumnRenamed("value", "src_value").join(dst.where(keep).withColumnRenamed("value", "dst_value"), ["topic", "name"])
    return j.where(~F.col("src_value").eqNullSafe(F.col("dst_value")))


def keyless_tables(columns: DataFrame) -> DataFrame:
    """Tables without an index of unique, non-null columns. Rows: table, index (null for none), nullable."""
    usable = columns.where("index is not null").groupBy("table", "index").agg(F.count_if("nullable").alias("n")).where("n = 0").select("table").distinct()
    return columns.select("table").distinct().join(usable, "table", "left_anti")


def routines_by_kind(objects: DataFrame) -> DataFrame:
    """schema, obj_type, n."""
    return objects.groupBy("schema", "obj_type").agg(F.count("*").alias("n"))


def logins_difference(src: DataFrame, dst: DataFrame) -> DataFrame:
    """login, kind: logins that one side lacks, or whose password hash or roles differ; no secret leaves."""
    j = src.select("login", F.col("secret").alias("s"), F.array_sort("roles").alias("sr")).join(dst.select("login", F.col("secret").alias("d"), F.array_sort("roles").alias("dr")), "login", "full_outer")
    kind = F.when(F.col("d").isNull() & F.col("dr").isNull(), "missing").when(F.col("s").isNull() & F.col("sr").isNull(), "extra").when(~F.col("s").eqNullSafe(F.col("d")), "password").when(~F.col("sr").eqNullSafe(F.col("dr")), "roles")
    return j.select("login", kind.alias("kind")).where("kind is not null")


def role_gap(src: DataFrame, dst: DataFrame, ignore: Sequence[str] = (), all_covering: Sequence[str] = ("root", "__system")) -> DataFrame:
    """login, missing: source roles that the target login lacks; a role that covers all leaves no gap."""
    j = src.select("login", F.col("roles").alias("s")).join(dst.select("login", F.col("roles").alias("d")), "login")
    gap = F.array_sort(F.array_except(F.array_except("s", "d"), F.array(*[F.lit(x) for x in ignore]).cast("array<string>")))
    covered = F.arrays_overlap("d", F.array(*[F.lit(x) for x in all_covering]))
    return j.select("login", F.when(covered, F.array().cast("array<string>")).otherwise(gap).alias("gap")).where(F.size("gap") > 0).select("login", F.array_join("gap", ",").alias("missing"))


def open_transactions(sessions: DataFrame, allowed_s: float = 3600.0) -> DataFrame:
    """n, longest_s, level of open transactions (rows: id, age_s)."""
    found = sessions.agg(F.count("*").alias("n"), F.coalesce(F.max("age_s"), F.lit(0.0)).alias("longest_s"))
    return found.withColumn("level", F.when(F.col("longest_s") > allowed_s, "warn").otherwise("pass"))


def name_lists(entries: DataFrame, group: str, name: str, shown: int = 10) -> DataFrame:
    """The group, n and its first names in order, as one text; no task gathers more than ``shown`` names of a group."""
    sizes = entries.groupBy(group).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(name))
    first = entries.select(group, name).distinct().withColumn("__rank", rank).where(F.col("__rank") <= shown)
    names = first.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(name)), ", ").alias("names"))
    return sizes.join(names, group)


def references(constraints: DataFrame) -> DataFrame:
    """table, columns, position: multi-column references unfolded with their order."""
    return constraints.select("table", F.posexplode("columns").alias("position", "column"))
