"""Composite checks over a pair: fused scans, staged refinement, verdict rules and readiness rules.

A table is fingerprinted once for each side, and its count and content come from the same scan; only
tables that differ are joined by key, and only those that differ there are looked at by column.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.model import RESULT_SCHEMA, Pair, TableMeta
from concord.operators import align, catalog, diff, drift, fingerprint, stores
from concord.session import durable
from concord.sources.retry import RETRIES, retried
from concord.sources import pushdown

CHECKS = ("schema", "objects", "params", "counts", "autoinc", "data", "deep")
#: Advice for the usual routes, in order.
PLAYBOOKS = {
    "same-engine": ("assess both sides", "set up the target's schema", "copy in bulk", "verify counts and data", "repair counters", "watch until safe", "switch over"),
    "cross-engine": ("convert the schema", "review narrowed types", "copy by ranges", "verify on common types", "tail changes", "switch over"),
    "live": ("start change capture", "copy in bulk", "verify touched keys", "watch until safe", "fence and recheck", "switch over"),
    "documents": ("compare shapes and indexes", "copy collections", "verify by identity", "tail changes", "switch over"),
}


def fused(df: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Everything one scan can tell of a table: n, checksum, key bounds, and by text column its nulls, empties and U+FFFD."""
    from concord.functions.canon import hash_sum, row_hash
    from concord.session import spread

    df = spread(df)
    texts = drift.text_columns(df)
    aggregates = [F.count("*").alias("n"), hash_sum(row_hash(df)).alias("checksum")]
    if key and len(key) == 1:
        bound = F.col(f"`{key[0]}`")
        aggregates += [F.min(bound).cast("string").alias("low"), F.max(bound).cast("string").alias("high")]
    for c in texts:
        aggregates += [F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{c}"), F.count_if(F.col(f"`{c}`") == "").alias(f"empties_{c}"), F.coalesce(F.sum(F.length(F.col(f"`{c}`")) - F.length(F.replace(F.col(f"`{c}`"), F.lit(drift.REPLACEMENT), F.lit("")))), F.lit(0)).alias(f"fffd_{c}")]
    return df.agg(*aggregates)


def sides(pair: Pair, table: str) -> align.Aligned:
    """Both sides of a table in comparable form: under the source's names, and for two engines in types that meet."""
    src, dst = pair.table("src", table), pair.table("dst", table)
    if pair.engine in ("hetero", "sqlite"):  # in which a column has the type of its values
        return align.align(src, dst)
    names = align.matches(src.columns, dst.columns)
    shared = [c for c in src.columns if c in names]
    alone = sorted({*src.columns} - {*names} | {*dst.columns} - {*names.values()})
    return align.Aligned(src.select(*[F.col(f"`{c}`") for c in shared]), dst.select(*[F.col(f"`{names[c]}`").alias(c) for c in shared]), alone, [])


#: Engines whose rows are compared by their own rules: the identity of a row, how both sides differ, and the hint.
STORES = {
    "mongodb": ("id", stores.documents_difference, "copy the documents again"),
    "redis": ("key", stores.entries_difference, "copy the entries again"),
    "kafka": ("topic", lambda src, dst: diff.differences(*(stores.log_tail(df) for df in (src, dst)), ["topic", "part"]), "mirror the records again"),
}


def _store_results(pair: Pair, table: str, only: tuple[str, ...]) -> list[tuple]:
    """Results of documents, entries or a log: each is compared as what it is, not as rows of text."""
    identity, differ, hint = STORES[pair.engine]
    src, dst = pair.table("src", table), pair.table("dst", table)
    out = []
    if "counts" in only:
        a, b = ((stores.log_counts(df).agg(F.coalesce(F.sum("n"), F.lit(0))) if pair.engine == "kafka" else df.agg(F.count("*"))).first()[0] for df in (src, dst))
        out.append(("counts", table, "ok" if a == b else "diff", f"src={a} dst={b}", "", "" if a == b else hint))
    if "data" in only:
        found = {r["kind"]: r["n"] for r in differ(src, dst).groupBy("kind").agg(F.count("*").alias("n")).collect()}
        # kinds of their own, such as an entry of another type, come behind the usual ones
        kinds = [*("missing", "extra", "changed"), *sorted(found.keys() - {"missing", "extra", "changed"})]
        out.append(("data", table, "diff" if found else "ok", " ".join(f"{k}={found.get(k, 0)}" for k in kinds), "", hint if found else ""))
    if "deep" in only:
        out += _store_looks(pair, table, src, dst, identity)
    return out


def _store_looks(pair: Pair, table: str, src: DataFrame, dst: DataFrame, identity: str) -> list[tuple]:
    """What only documents or entries have: types by path, repeated identities, lifetimes."""
    out = []
    if pair.engine == "mongodb":
        out += [("deep", f"{table} types", "diff", f"{r['path']}: {r['src_type']} -> {r['dst_type']}", "", "write the source's types") for r in stores.path_drift(src, dst).orderBy("path").limit(20).collect()]
        twice = stores.duplicate_ids(dst.select(F.col(identity).alias("id"))).count()
        if twice:
            out.append(("deep", f"{table} duplicates", "diff", f"{twice} identities occur more than once on the target", "", "remove the copies"))
    if pair.engine == "redis":
        lives = {r["kind"]: r["n"] for r in stores.ttl_drift(src, dst).groupBy("kind").agg(F.count("*").alias("n")).collect()}
        out += [("deep", f"{table} lifetimes", "diff", f"{n} {kind}", "", "set the lifetimes again") for kind, n in sorted(lives.items())]
    return out or [("deep", table, "ok", "the looks found nothing", "", "")]


def check_table(pair: Pair, table: str, only: tuple[str, ...] = CHECKS) -> list[tuple]:
    """Results of one table as rows of the result schema."""
    if pair.engine in STORES:
        return _store_results(pair, table, only)
    out = []
    both = sides(pair, table)
    src, dst = both.src, both.dst
    meta = pair.meta.get(table) or TableMeta()
    key = list(meta.key) if all(k in src.columns for k in meta.key) else []
    if "schema" in only:
        lines = lambda side: [f"{f.name} {f.dataType.simpleString()}" for f in pair.table(side, table).schema]
        # two engines name their types in their own ways: only columns that do not meet are differences
        changed = [*(f"{c} on one side" for c in both.alone), *both.apart] if pair.engine == "hetero" else diff.line_difference(lines("src"), lines("dst"))
        out.append(("schema", table, "diff" if changed else "ok", "; ".join(changed[:10]), "", "align the target's columns" if changed else ""))
    if not {"counts", "data", "deep"} & set(only):
        return out
    if "deep" not in only and len(key) == 1 and not both.alone and (found := pushed(pair, table, key[0])):
        return out + [r for r in found if r[0] in only]
    if not src.columns:
        return [*out, ("data", table, "error", "the sides share no column", "", "align the target's columns")]
    a, b = fused(src, key).first(), fused(dst, key).first()
    if "counts" in only:
        out.append(("counts", table, "ok" if a["n"] == b["n"] else "diff", f"src={a['n']} dst={b['n']}", "", "" if a["n"] == b["n"] else "copy the missing rows"))
    if "data" in only:
        result = _data_result(pair, table, src, dst, key, a, b)
        if both.alone:  # equal in what both have, but not the same table
            result = ("data", table, "diff", f"columns of one side: {','.join(both.alone)}; shared columns: {result[3]}", "", "align the target's columns")
        out.append(result)
    if "deep" in only:
        out += _deep_results(pair, table, src, dst, meta, key, a, b)
    return out


def pushed(pair: Pair, table: str, key: str) -> list[tuple] | None:
    """Counts and data of a table that both engines sum up themselves, from fingerprints of ranges; None where they cannot.

    Rows are read only of ranges that differ.
    """
    ends = [pair.push(side, table, key) if pair.push else None for side in ("src", "dst")]
    if None in ends or ends[0].schema != ends[1].schema or ends[0].schema[key].dataType.typeName() not in ("byte", "short", "integer", "long") or not all(end.expressible() for end in ends):
        return None
    found = pushdown.descend(*ends)
    n_src, n_dst = found.n
    counts = ("counts", table, "ok" if n_src == n_dst else "diff", f"src={n_src} dst={n_dst}", "", "" if n_src == n_dst else "copy the missing rows")
    if found.equal:
        return [counts, ("data", table, "ok", f"rows={n_src} checksum={found.checksums[0]}", "", "")]
    src, dst = pushdown.damaged(*ends, found)
    (a, b) = (fused(df, [key]).first() for df in (src, dst))
    check, scope, status, detail, report, hint = _data_result(pair, table, src, dst, [key], a, b)
    return [counts, (check, scope, status, f"{detail} (of {n_src} rows, {found.rows_to_read} read in {len(found.ranges)} ranges)", report, hint)]


def _data_result(pair: Pair, table: str, src: DataFrame, dst: DataFrame, key: list[str], a, b) -> tuple:
    if a["checksum"] == b["checksum"] and a["n"] == b["n"]:
        return ("data", table, "ok", f"rows={a['n']} checksum={a['checksum']}", "", "")
    if not key:
        return _keyless_result(table, src, dst)
    counts = diff.summary(src, dst, key).first()
    if counts["missing"] + counts["extra"] + counts["changed"] == 0:
        # no key differs now: rows were in flight, or else the second look must say so too
        again = fingerprint_pair(src, dst).collect()
        if len({(r["n"], r["checksum"]) for r in again}) == 1:
            return ("data", table, "ok", "settled: a second look finds both sides equal", "", "")
        return _keyless_result(table, src, dst)
    where = [r["column"] for r in diff.column_drift(src, dst, key).orderBy("column").collect()] if counts["changed"] else []
    return ("data", table, "diff", f"missing={counts['missing']} extra={counts['extra']} changed={counts['changed']}" + (f" columns={','.join(where)}" if where else ""), "", "repair rows by key")


def _keyless_result(table: str, src: DataFrame, dst: DataFrame) -> tuple:
    lost = diff.multiset_difference(src, dst).first()
    bad = lost["only_in_src"] + lost["only_in_dst"] > 0
    return ("data", table, "diff" if bad else "ok", f"rows compared whole: only_in_src={lost['only_in_src']} only_in_dst={lost['only_in_dst']}", "", "copy the table again" if bad else "")


def _deep_results(pair: Pair, table: str, src: DataFrame, dst: DataFrame, meta: TableMeta, key: list[str], a, b) -> list[tuple]:
    """What the detectors find in one table; a last row says how many looked."""
    out: list[tuple] = []
    looked = 0

    def found(name: str, bad: bool, detail: str, hint: str) -> None:
        nonlocal looked
        looked += 1
        if bad:
            out.append(("deep", f"{table} {name}", "diff", detail, "", hint))

    found("keys", not key, "no key known", "declare a key")
    unique = not key
    if key:
        repeats = drift.repeated_keys(dst, key)
        found("duplicates", repeats > 0, f"{repeats} keys occur more than once on the target", "remove the copies")
        unique = repeats == 0 and drift.repeated_keys(src, key) == 0
    for c in drift.text_columns(src):
        moved = a[f"nulls_{c}"] != b[f"nulls_{c}"] and a[f"nulls_{c}"] + a[f"empties_{c}"] == b[f"nulls_{c}"] + b[f"empties_{c}"]
        found("nullempty", moved, f"{c}: null {a[f'nulls_{c}']} -> {b[f'nulls_{c}']}", "load nulls as nulls")
        found("encoding", b[f"fffd_{c}"] > a[f"fffd_{c}"], f"{c}: {b[f'fffd_{c}'] - a[f'fffd_{c}']} replacement characters more", "load with the source's charset")
    declared = [drift.type_facts(pair.table(side, table)) for side in ("src", "dst")]
    for r in drift.narrowed(*declared).collect() if pair.engine != "hetero" else ():
        found("narrowing", True, f"{r['column']}: {r['reason']}", "widen the target's column")
    if len(key) == 1 and a["low"] is not None and b["low"] is not None and dict(dst.dtypes)[key[0]] in ("tinyint", "smallint", "int", "bigint"):
        found("boundary", int(b["high"]) > int(a["high"]), f"largest key {a['high']} -> {b['high']}", "find out who writes to the target")
    if key and unique:
        kinds = dict(dst.dtypes)
        numbers = [n for n, k in src.dtypes if k in ("float", "double") and kinds[n] in ("float", "double") and n not in key]
        times = [n for n, k in src.dtypes if k.startswith("timestamp") and kinds[n].startswith("timestamp") and n not in key]
        for c, r in drift.paired_drift(src, dst, key, times, numbers, float(pair.options.get("float_tolerance", 1e-9))).items():
            if "uniform" in r:
                found("timeshift", bool(r["uniform"]), f"{c}: every row is {r['mean_s']} s off", "read times in the source's zone")
            else:
                found("float", r["n_beyond"] > 0, f"{c}: {r['n_beyond']} values off by up to {r['max_diff']}", "store with the source's precision")
    for columns, parent, parent_columns in meta.foreign:
        n = drift.orphans(dst, columns, pair.table("dst", parent), parent_columns).count()
        found("fk", n > 0, f"{','.join(columns)}: {n} rows without a row in {parent}", "copy the parents")
    rules = {name: rule for name, rule in meta.checks.items() if drift.evaluable(dst, rule)}
    generated = {column: rule for column, rule in meta.generated.items() if column in dst.columns and drift.evaluable(dst, rule)}
    for (look, name), n in drift.row_local(dst, rules, generated).items():
        if look == "checks":
            found("checks", n > 0, f"{name}: {n} rows break it", "fix the rows")
        else:
            found("generated", n > 0, f"{name}: {n} stored values are not what the expression gives", "compute the column again")
    if meta.partition_bounds:
        n = drift.stranded(dst, meta.partition_column, meta.partition_bounds).count()
        found("partitions", n > 0, f"{n} rows lie in no declared range", "add the missing partitions")
    for columns in {*meta.unique, tuple(key)}:
        if len(columns) == 1 and columns[0] in drift.text_columns(src):
            n = drift.collapsing(src, columns[0]).count()
            found("collation", n > 0, f"{columns[0]}: {n} values become equal if case is ignored", "give the target a binary collation")
    return out or [("deep", table, "ok", f"{looked} looks found nothing", "", "")]


def catalog_results(pair: Pair, only: tuple[str, ...]) -> list[tuple]:
    """Objects, settings and counters of both catalogs; a side that tells nothing is skipped, and said to be."""
    out: list[tuple] = []

    def sides(check: str, kind: str) -> tuple[DataFrame, DataFrame] | None:
        if check not in only:
            return None
        a, b = ((pair.facts(side, kind) if pair.facts else None) for side in ("src", "dst"))
        if a is None or b is None:
            out.append((check, pair.name, "skip", "a side's catalog cannot be read", "", ""))
            return None
        return a, b

    if both := sides("objects", "objects"):
        for r in catalog.objects_difference(*both).orderBy("obj_type").collect():
            bad = r["missing"] + r["extra"] > 0
            out.append(("objects", f"{pair.name} {r['obj_type']}", "diff" if bad else "ok", f"missing={r['missing']} extra={r['extra']} same={r['same']}", "", "create what is missing" if r["missing"] else ""))
    if both := sides("params", "params"):
        r = catalog.settings_status(catalog.settings_difference(*both, catalog.CRITICAL_SETTINGS.get(pair.engine, ()))).first()
        out.append(("params", pair.name, r["status"], f"{r['n_different']} differ, {r['n_critical']} of them critical", "", "align the critical settings" if r["n_critical"] else ""))
    if both := sides("autoinc", "counters"):
        out += _counter_results(pair, *both)
    if "deep" in only and pair.facts:
        out += _deep_catalog(pair)
    return out


def _deep_catalog(pair: Pair) -> list[tuple]:
    """Columns, extensions and permissions, of engines whose catalogs tell them."""
    out: list[tuple] = []
    both = lambda kind: [pair.facts(side, kind) for side in ("src", "dst")]
    columns = both("columns")
    if None not in columns:
        # lengths and precisions as the catalog declares them, which a table's own schema may not carry
        named = [c.select(F.concat_ws(".", "table_name", "column_name").alias("column"), "type", F.coalesce("char_length", F.lit(0)).cast("long").alias("char_length"), F.coalesce("num_scale", F.lit(0)).cast("long").alias("scale"), F.coalesce("num_precision", F.lit(0)).cast("long").alias("precision"), F.lit(False).alias("unsigned")) for c in columns]
        out += [("deep", f"{pair.name} narrowing", "diff", f"{r['column']}: {r['reason']}", "", "widen the target's column") for r in drift.narrowed(*named).orderBy("column").collect()]
        shaped = [c.select(F.col("table_name").alias("table"), F.col("column_name").alias("column"), "type", F.col("is_nullable").alias("nullable"), F.col("column_default").alias("default")) for c in columns]
        out += [("deep", f"{pair.name} columns", "diff", f"{r['table']}.{r['column']} {r['attribute']}: {r['src_value']} -> {r['dst_value']}", "", "align the target's columns") for r in catalog.columns_drift(*shaped).orderBy("table", "column").collect()]
    extensions = both("extensions")
    if None not in extensions:
        out += [("deep", f"{pair.name} extensions", "diff", f"{r['name']}: {r['kind']}", "", "install it on the target") for r in catalog.extensions_difference(*extensions).where("kind <> 'extra'").orderBy("name").collect()]
    grants = both("grants")
    if None not in grants:
        out += [("deep", f"{pair.name} grants", "diff", f"{r['grantee']}: {r['n']} permissions missing", "", "users prints the statements") for r in catalog.grants_by_grantee(catalog.missing_grants(*grants)).orderBy("grantee").collect()]
    return out


def counter_maxima(pair: Pair, counters: DataFrame) -> DataFrame:
    """table, high: the target's largest key for each counter whose table is compared and has one integer key."""
    owners = {r["table"]: r["owner_table"] for r in found.collect()} if pair.facts and (found := pair.facts("dst", "owned_by")) is not None else {}
    rows = []
    for r in counters.select("table").collect():
        table = owners.get(r["table"], r["table"])
        meta = pair.meta.get(table)
        if table in pair.kept_tables() and meta and len(meta.key) == 1:
            high = pair.table("dst", table).agg(F.max(meta.key[0])).first()[0]
            rows.append((r["table"], high if isinstance(high, int) else 0))
    return counters.sparkSession.createDataFrame(rows, "table string, high long")


def _counter_results(pair: Pair, src: DataFrame, dst: DataFrame) -> list[tuple]:
    out = []
    usable = catalog.counters_usable(dst, counter_maxima(pair, dst), pair.engine)
    for r in usable.orderBy("table").collect():
        out.append(("autoinc", r["table"], r["status"], f"next={r['next_value']} largest={r['max_value']}", "", "raise the counter" if r["status"] == "diff" else ""))
    for r in catalog.counters_parity(src, dst).where("dst_value = 'MISSING'").collect():
        out.append(("autoinc", r["table"], "diff", "the target has no such counter", "", "create the counter"))
    return out or [("autoinc", pair.name, "ok", "no counters", "", "")]


def position(pair: Pair, side: str) -> str:
    """Where a side's log of changes stands, for engines that tell; noted beside a snapshot."""
    facts = pair.facts(side, "position") if pair.facts else None
    return "" if facts is None else str(facts.first()["position"])


def snapshot(pair: Pair) -> Pair:
    """``pair`` with every table read once and written to the shared folder, so that all checks see the same rows."""
    kept: dict[tuple[str, str], DataFrame] = {}
    read = pair.read

    def once(side: str, table: str) -> DataFrame:
        if (side, table) not in kept:
            kept[side, table] = durable(read(side, table))
        return kept[side, table]

    pair.read = once
    return pair


def check(spark: SparkSession, pair: Pair, only: tuple[str, ...] = CHECKS, skip: frozenset[str] = frozenset()) -> DataFrame:
    """All results of a pair. Tables run side by side on driver threads; each adds a few rows.

    A pair of which no table is found is an error: nothing was compared. Tables in ``skip`` are left out, as a
    resumed run has their results already.
    """
    pair.validate()
    tables = pair.kept_tables()

    def one(table: str) -> list[tuple]:
        try:
            return retried(lambda: check_table(pair, table, only), pair.options.get("retries", RETRIES))
        except Exception as error:
            return [("data", table, "error", str(error).split("\n")[0][:300], "", "")]

    rows: list[tuple] = []
    if not tables:
        rows.append(("counts", pair.name, "error", "no table found: nothing was compared", "", "check the path, the database and the exclusions"))
    if pair.target_tables is not None:
        there = set(pair.kept_tables(pair.target_tables))
        rows += [("schema", t, "diff", "the target has no such table", "", "create the table") for t in tables if t not in there]
        rows += [("schema", t, "diff", "the source has no such table", "", "drop the table or exclude it") for t in sorted(there - set(tables))]
        tables = [t for t in tables if t in there]
    with ThreadPoolExecutor(max(1, pair.workers)) as pool:
        rows += [r for found in pool.map(one, [t for t in tables if t not in skip]) for r in found]
    try:
        rows += catalog_results(pair, only)
    except Exception as error:
        rows.append(("objects", pair.name, "error", str(error).split("\n")[0][:300], "", ""))
    return spark.createDataFrame(rows, RESULT_SCHEMA)


def authority(results: DataFrame, trusted: str = "structural") -> DataFrame:
    """Where a trusted structural check of a scope is ok, textual schema differences of that scope only inform; object differences stand."""
    clean = results.where((F.col("check") == trusted) & (F.col("status") == "ok")).select(F.col("scope").alias("__clean")).distinct()
    j = results.join(clean, results["scope"] == clean["__clean"], "left")
    demoted = (F.col("check") == "schema") & (F.col("status") == "diff") & F.col("__clean").isNotNull()
    return j.withColumn("status", F.when(demoted, "ok").otherwise(F.col("status"))).drop("__clean")


def reclassified(results: DataFrame, drilled: DataFrame) -> DataFrame:
    """Data differences whose keyed comparison (scope, n) found nothing are ok: the rows were in flight."""
    j = results.join(drilled, "scope", "left")
    return j.withColumn("status", F.when((F.col("check") == "data") & (F.col("status") == "diff") & (F.col("n") == 0), "ok").otherwise(F.col("status"))).drop("n")


def assess(facts: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """rule, level, detail from facts (name, value) and rules (name, SQL condition that passes, level otherwise, advice)."""
    parts = []
    for name, condition, level, advice in rules:
        value = facts.where(F.col("name") == name).agg(F.max("value").alias("value"))
        passed = F.coalesce(F.expr(condition), F.lit(False))
        parts.append(value.select(F.lit(name).alias("rule"), F.when(passed, "pass").otherwise(level).alias("level"), F.when(passed, "").otherwise(advice).alias("detail")))
    return reduce(DataFrame.unionByName, parts)


def level_counts(assessed: DataFrame) -> DataFrame:
    return assessed.groupBy("level").agg(F.count("*").alias("n"))


#: Readiness of both sides: fact, condition on ``value``, level if it fails, advice.
READINESS = [
    ("wal_level", "value = 'logical'", "fail", "set wal_level to logical"),
    ("binlog_format", "value = 'ROW'", "fail", "set binlog_format to ROW"),
    ("is_replica", "value = 'false'", "warn", "point at the primary for change capture"),
    ("inactive_slots", "cast(value as int) = 0", "warn", "drop inactive slots, they hold the log"),
    ("longest_transaction_s", "cast(value as double) < 3600", "warn", "end long transactions before the copy"),
    ("tables_without_key", "cast(value as int) = 0", "warn", "such tables are compared whole"),
    ("unlogged_tables", "cast(value as int) = 0", "warn", "unlogged tables are not replicated"),
    ("invalid_indexes", "cast(value as int) = 0", "fail", "rebuild invalid indexes"),
    ("encoding", "upper(value) in ('UTF8', 'UTF8MB4')", "warn", "check the text of other charsets"),
]


def setup_plan(pair: Pair, database: str) -> list[str]:
    """Ordered steps that prepare a target; text only, nothing is run."""
    target = pair.target_db(database)
    steps = [f"create database {target} on {pair.target.host or 'the target'}"]
    steps.append("convert the schema, then review narrowed types" if pair.engine == "hetero" else "load the schema without secondary indexes and triggers")
    return [*steps, f"move {pair.name} --db {database}", "build indexes, then enable triggers and constraints", f"check {pair.name}"]


def playbook(name: str) -> tuple[str, ...]:
    if name not in PLAYBOOKS:
        raise KeyError(f"unknown playbook {name!r}; known: {', '.join(PLAYBOOKS)}")
    return PLAYBOOKS[name]


def fingerprint_pair(src: DataFrame, dst: DataFrame) -> DataFrame:
    """side, n, checksum of both tables."""
    side = lambda df, s: fingerprint.table_fingerprint(df).select(F.lit(s).alias("side"), "n", "checksum")
    return side(src, "src").unionByName(side(dst, "dst"))


def repairable(results: DataFrame) -> DataFrame:
    """check, scope, status of everything that a repair should look at: the worst status of each check and scope."""
    rank = F.max_by("status", F.when(F.col("status") == "error", 3).when(F.col("status") == "diff", 2).otherwise(0))
    return results.groupBy("check", "scope").agg(rank.alias("status")).where("status in ('diff', 'error')")


def heterogeneous(src: DataFrame, dst: DataFrame, key: list[str], pairs: bool = False) -> DataFrame:
    """only_in_src, only_in_dst, updated, status of two tables of different engines, on common types; counts of keys, or of ``pairs``."""
    a, b = diff.cast_to_common(src, dst)
    counts = diff.summary(a, b, key, pairs=pairs)
    return counts.select(F.col("missing").alias("only_in_src"), F.col("extra").alias("only_in_dst"), F.col("changed").alias("updated"), F.when(F.col("missing") + F.col("extra") + F.col("changed") == 0, "ok").otherwise("diff").alias("status"))
