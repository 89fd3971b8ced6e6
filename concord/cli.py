"""Command line: assess, schema, check, sync, move, watch, report, history, rollback, users, doctor, advise.

    python -m concord.cli --config hops.json check NAME --only counts,data

Commands that change a target only say what they would do unless ``--go`` is given; they write new
versions next to the target and keep a restore point first.
"""

from __future__ import annotations

import argparse
import json
import shlex
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.model import RESULT_SCHEMA, Pair, get_pair, load_pairs
from concord.functions import dialects
from concord.operators import align, catalog, diff, repair, watch
from concord.plans import checks
from concord.sources import readers, sinks, tools, writer
from concord.streaming import delta, source

#: Former names of commands: the command that has their meaning now, and the options that give it.
ALIASES = {
    "hops": ("doctor", {}), "setup-target": ("schema", {}), "convert-schema": ("schema", {"convert": True}), "gen-migration": ("schema", {"migration": "migrations"}), "repair": ("sync", {}),
    "replicate": ("move", {"replicate": True}), "tail": ("watch", {"follow": True}), "sample-diff": ("check", {"sample": 500}), "ui": ("report", {"serve": True}), "state": ("history", {}), "monitor": ("watch", {"rerun": True}),
}


def _session() -> SparkSession:
    return SparkSession.builder.appName("concord").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _databases(args: argparse.Namespace, spark: SparkSession) -> list[str]:
    """The databases of a run: the one asked for, else all of the pair's; * stands for all that the source's catalog lists."""
    pair = get_pair(args.config, args.name)
    if args.db or not pair.databases:
        return [args.db]
    if "*" not in pair.databases:
        return list(pair.databases)
    listed = readers.bind(spark, pair, "").facts("src", "databases")
    names = [] if listed is None else [r["name"] for r in listed.collect()]
    return sorted(n for n in names if n not in readers.SYSTEM_DATABASES and not pair.excluded(n))


def _pair(args: argparse.Namespace, spark: SparkSession, database: str | None = None) -> Pair:
    pair = get_pair(args.config, args.name)
    if args.exclude:
        pair.exclude = (*pair.exclude, *args.exclude.split(","))
    pair.validate()
    bound = readers.bind(spark, pair, args.db if database is None else database)
    if args.table:
        bound.tables = tuple(t for t in bound.tables if t == args.table)
        bound.target_tables = None if bound.target_tables is None else tuple(t for t in bound.target_tables if t == args.table)
    return bound


def _reports(args: argparse.Namespace) -> str:
    return f"{args.reports.rstrip('/')}/{args.name}"


def doctor(args: argparse.Namespace) -> int:
    """The configured pairs, whether both sides are set and, with ``--reach``, whether their tables can be listed."""
    bad = 0
    if args.tools:
        for program, place in tools.inventory().items():
            print(f"{program}\t{place or 'not installed'}")
    for name, pair in load_pairs(args.config).items():
        state = "not configured" if pair.source.missing(pair.side_engine("source")) or pair.target.missing(pair.side_engine("target")) else "ok"
        if state == "ok" and args.reach:
            try:
                state = f"ok\t{len(readers.bind(_session(), pair).tables)} tables"
            except Exception as error:
                state, bad = f"unreachable\t{str(error).splitlines()[0][:200]}", 1
        print(f"{name}\t{pair.engine}\t{state}")
    return bad


def advise(args: argparse.Namespace) -> int:
    for i, step in enumerate(checks.playbook(args.playbook), 1):
        print(f"{i}. {step}")
    return 0


def assess(args: argparse.Namespace) -> int:
    """Readiness by rules: over a file of facts (name, value), or over what both sides' catalogs say."""
    spark = _session()
    if args.facts:
        sides = {"": spark.read.json(args.facts)}
    else:
        pair = _pair(args, spark)
        sides = {side: facts for side in ("src", "dst") if (facts := pair.facts(side, "facts")) is not None}
        keyless = [t for t in pair.kept_tables() if t not in pair.meta or not pair.meta[t].key]
        sides["tables"] = spark.createDataFrame([("tables_without_key", str(len(keyless)))], "name string, value string")
    failed = 0
    for side, facts in sides.items():
        known = {r["name"] for r in facts.select("name").distinct().collect()}
        rules = [r for r in checks.READINESS if r[0] in known]
        if rules:
            for r in checks.assess(facts, rules).collect():
                print("\t".join(x for x in (side, r["rule"], r["level"], r["detail"]) if x))
                failed |= r["level"] == "fail"
    return int(failed)


def _target_engine(pair: Pair) -> str:
    return readers.engine_of(pair.options["target_engine"] if pair.engine == "hetero" else pair.engine)


def _declared(pair: Pair) -> dict[tuple[str, str], str]:
    """The source catalog's own types by table and column, where both sides speak one dialect and it tells them."""
    found = pair.facts("src", "columns") if pair.facts and pair.engine != "hetero" else None
    if found is None:
        return {}
    size = lambda r: f"({r['char_length']})" if r["char_length"] and r["char_length"] > 0 and "char" in r["type"] else f"({r['num_precision']},{r['num_scale']})" if r["type"] in ("numeric", "decimal") and r["num_precision"] else ""
    return {(r["table_name"], r["column_name"]): r["type"] + size(r) for r in found.collect()}


def _schema_actions(pair: Pair) -> list[dict]:
    """Statements that add the columns which the target lacks, in its dialect and by the source catalog's types; one for each such column."""
    missing, declared = [], _declared(pair)
    for table in pair.kept_tables():
        src, dst = (pair.table(side, table) for side in ("src", "dst"))
        known = align.matches(src.columns, dst.columns)
        missing += [(pair.names.get(table, table), f.name, declared.get((table, f.name), f.dataType)) for f in src.schema if f.name not in known]
    engine = _target_engine(pair)
    return repair.schema_actions(missing, engine if engine in dialects.DIALECTS else "duckdb")


def schema(args: argparse.Namespace) -> int:
    """The target's setup plan and the columns that differ; ``--migration`` writes them as versioned files.

    ``--convert`` reads definitions from ``--ddl`` instead and prints them in the target's dialect.
    """
    if args.convert:
        from concord.functions.ddl import convert, notes

        for statement in Path(args.ddl).read_text().split(";\n"):
            if statement.strip():
                print("".join(f"-- {note}\n" for note in notes(statement)) + convert(statement.strip().rstrip(";")) + ";")
        return 0
    spark = _session()
    pair = _pair(args, spark)
    for step in checks.setup_plan(pair, args.db):
        print(step)
    actions = _schema_actions(pair)
    for action in actions:
        print("\n".join(action["statements"]))
    if args.migration and actions:
        print(*sinks.migration_files(actions, args.migration, int(time.time()), "schema"))
    return 0


def _summary(spark: SparkSession, args: argparse.Namespace) -> list:
    """The results of earlier runs; a few rows for each table."""
    path = f"{_reports(args)}/summary"
    return spark.read.schema(RESULT_SCHEMA).json(path).collect() if sinks.exists(spark, path) else []


def _run_checks(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """One run of the wanted checks over all databases, merged into the pair's summary.

    Where there are several databases, each scope begins with its database.
    """
    only = tuple(args.only.split(",")) if args.only else checks.CHECKS
    only = (*only, "deep") if args.deep and "deep" not in only else only
    unknown = set(only) - set(checks.CHECKS)
    if unknown:
        raise SystemExit(f"unknown checks: {', '.join(sorted(unknown))}; known: {', '.join(checks.CHECKS)}")
    old, databases, rows, bound = _summary(spark, args), _databases(args, spark), [], {}
    for database in databases:
        mark = f"{database} " if len(databases) > 1 else ""
        bound[mark] = pair = _pair(args, spark, database)
        if args.consistent:
            # the log positions before the first read: what came later is in flight
            print("\t".join([f"{mark}snapshot", *(f"{side}={place}" for side in ("src", "dst") if (place := checks.position(pair, side)))]))
            pair = checks.snapshot(pair)
        mine = [r for r in old if r["scope"].startswith(mark)]
        table = lambda r: r["scope"][len(mark) :].split(" ")[0]  # noqa: B023, E731
        clean = {t for t in pair.tables if (seen := [r["status"] for r in mine if table(r) == t]) and set(seen) <= {"ok", "skip"}}
        for r in checks.check(spark, pair, only, frozenset(clean if args.resume else ())).collect():
            rows.append((r["check"], mark + r["scope"], *r[2:]))
        if args.resume:
            rows += [tuple(r) for r in mine if table(r) in clean and r["check"] in only]
    found = spark.createDataFrame(rows, RESULT_SCHEMA)
    if old:
        found = sinks.merged_summary(spark.createDataFrame(old, RESULT_SCHEMA), found)
    rows = found.orderBy("check", "scope").collect()
    kept = spark.createDataFrame(rows, RESULT_SCHEMA)
    kept.coalesce(1).write.mode("overwrite").json(f"{_reports(args)}/summary")
    if args.drill:
        differing = {r["scope"] for r in rows if r["check"] == "data" and r["status"] == "diff"}
        for mark, pair in bound.items():
            _drill(pair, args, {scope.removeprefix(mark) for scope in differing if scope.startswith(mark)}, mark.strip() or args.db or "default")
    return kept


def _drill(pair: Pair, args: argparse.Namespace, tables: set[str], database: str) -> None:
    """Key files and evidence of every keyed table that differs."""
    for table in sorted(tables & set(pair.kept_tables())):
        key = list(pair.meta[table].key) if table in pair.meta else []
        if key:
            both = checks.sides(pair, table)
            src, dst = both.src, both.dst
            sinks.write_keys(diff.differences(src, dst, key), f"{_reports(args)}/keys", table if database == "default" else f"{database}.{table}")
            sinks.write_evidence(diff.sample_compare(src, dst, key), args.reports.rstrip("/"), args.name, database, f"data-{table}")


def check(args: argparse.Namespace) -> int:
    """Run the checks; results merge into the pair's summary. Exit status 1 if any is neither ok nor skipped.

    ``--sample N`` only probes N rows of each keyed table, ``--consistent`` reads each table once for all checks,
    ``--resume`` leaves out tables that were clean before, ``--drill`` writes the differing keys.
    """
    spark = _session()
    if args.sample:
        return _probe(spark, args)
    kept = _run_checks(spark, args)
    for r in kept.collect():
        print(f"{r['check']}\t{r['scope']}\t{r['status']}\t{r['detail']}")
    sinks.changelog(spark, f"{_reports(args)}/changelog", command="check", only=args.only)
    return sinks.exit_status(kept)


def _probe(spark: SparkSession, args: argparse.Namespace) -> int:
    pair, bad, looked = _pair(args, spark), 0, 0
    for table in pair.kept_tables():
        key = list(pair.meta[table].key) if table in pair.meta else []
        if key:
            both = checks.sides(pair, table)
            found = {r["kind"]: r["n"] for r in diff.probe(both.src, both.dst, key, args.sample).collect()}
            bad, looked = bad + sum(n for k, n in found.items() if k != "same"), looked + 1
            print(f"{table}\t" + " ".join(f"{k}={n}" for k, n in sorted(found.items())))
    return int(bad > 0 or not looked)


def sync(args: argparse.Namespace) -> int:
    """Repairs by ``--kind``: rows of keyed tables, counters or the schema. Only a plan without ``--go``.

    Rows are repaired into a new version beside a restore point; counters and schema yield statements with their
    undo. One sync of a pair runs at a time, and tables that an interrupted sync has done are not done again.
    """
    spark = _session()
    pair = _pair(args, spark)
    kinds = ("rows", "sequences", "schema") if args.kind == "all" else (args.kind,)
    if not args.go:
        return max(_sync(spark, pair, args, kind) for kind in kinds)
    Path(args.reports, args.name).mkdir(parents=True, exist_ok=True)
    with sinks.Lock(spark, f"{_reports(args)}/sync.lock"):
        code = max(_sync(spark, pair, args, kind) for kind in kinds)
    sinks.changelog(spark, f"{_reports(args)}/changelog", command="sync", kind=args.kind, tag=args.tag)
    return code


def _sync(spark: SparkSession, pair: Pair, args: argparse.Namespace, kind: str) -> int:
    if kind == "rows":
        return _sync_rows(spark, pair, args)
    if kind == "schema":
        actions = _schema_actions(pair)
    else:
        src, dst = pair.facts("src", "counters"), pair.facts("dst", "counters")
        if src is None or dst is None:
            print("sequences: a side's counters cannot be read")
            return 1
        plan = repair.sequence_repair(src, dst, checks.counter_maxima(pair, dst), pair.engine)
        for r in plan.orderBy("table").collect():
            print(f"{r['table']}: {r['action']} {r['undo_value']} -> {r['target_value']}")
        actions = repair.sequence_actions(plan, _target_engine(pair))
    for action in actions:
        print("\n".join(action["statements"] or [f"{action['scope']}: {action['note']}"]))
    actions = [action for action in actions if action["statements"]]
    if args.go and actions:
        print(*sinks.migration_files(actions, f"{_reports(args)}/migrations", int(time.time()), kind))
    return 0


def _live(pair: Pair) -> writer.SQLiteTarget | None:
    """The target as one that changes can be applied to; None for files, which get new versions instead."""
    return writer.SQLiteTarget(pair.target.options["path"]) if _target_engine(pair) == "sqlite" else None


def _parents(pair: Pair) -> dict[str, list[str]]:
    return {t: [parent for _, parent, _ in meta.foreign] for t, meta in pair.meta.items()}


def _sync_rows(spark: SparkSession, pair: Pair, args: argparse.Namespace) -> int:
    """Row repairs of keyed tables: a live target is changed in one transaction, of files a new version is written."""
    store, live, wanted = sinks.StateStore(spark, f"{_reports(args)}/state"), _live(pair), {}
    progress = sinks.MoveCheckpoint(f"{_reports(args)}/sync.json", spark) if args.go and not live else None
    for table in pair.kept_tables():
        key = list(pair.meta[table].key) if table in pair.meta else []
        if not key:
            print(f"{table}: no key, copy it again")
            continue
        if args.resume and progress and (progress.state.get(table) or {}).get("done"):
            print(f"{table}: done before")
            continue
        both = checks.sides(pair, table)
        src, dst = (both.src, both.dst) if live else (pair.table("src", table), pair.table("dst", table))
        plan = repair.row_plan(diff.differences(src, dst, key), key, args.on_conflict).collect()
        print(f"{table}: " + (", ".join(f"{r['operation']} {r['n']}" for r in plan) or "nothing to do"))
        if args.go and plan and live:
            wanted[table] = (writer.changes(src, dst, key, args.on_conflict), key)
        elif args.go and plan:
            done = repair.repair_rows(src, dst, key, args.on_conflict)
            store.save(args.name, args.db, {f"{table}.preimage": done.preimage, f"{table}.touched": done.touched}, args.tag)
            done.repaired.write.mode("overwrite").parquet(f"{_reports(args)}/repaired/{table}")
        if progress:
            progress.save(table, None, True)
    if wanted:
        print(f"applied; rollback --tag {writer.apply(live, wanted, _parents(pair), f'{_reports(args)}/staging', args.tag)} undoes it")
    return 0


def users(args: argparse.Namespace) -> int:
    """What to do about logins and permissions that differ. A plan only: no secret is printed or written."""
    spark = _session()
    pair = _pair(args, spark)
    src, dst = pair.facts("src", "logins"), pair.facts("dst", "logins")
    if src is None or dst is None:
        print("logins of a side cannot be read")
        return 1
    roles = lambda df: df.select("login", "secret", F.coalesce(F.col("roles").cast("array<string>"), F.array().cast("array<string>")).alias("roles"))
    plan = repair.login_plan(catalog.logins_difference(roles(src), roles(dst))).orderBy("login").collect()
    for r in plan:
        print(f"{r['login']}\t{r['step']}")
    granted = pair.facts("src", "grants"), pair.facts("dst", "grants")
    if None not in granted:
        for r in catalog.grant_statements(catalog.missing_grants(*granted), _target_engine(pair)).orderBy("statement").collect():
            print(r["statement"])
    return int(bool(plan))


def move(args: argparse.Namespace) -> int:
    """Copy tables by ranges of their integer key, resuming where an earlier run stopped."""
    spark = _session()
    pair = _pair(args, spark)
    if args.via:
        if not sinks.mover_supported(pair.engine, args.via):
            raise SystemExit(f"{args.via} does not serve {pair.engine}")
        for command in tools.move_commands(pair, args.db, args.via):
            print(shlex.join(command) + ("" if tools.which(command[0]) else "  # not installed here"))
        return 0
    if args.replicate:
        for side, statement in tools.replication_statements(pair, args.db):
            print(f"{side}: {statement}")
        return 0
    if live := _live(pair):
        return _move_live(pair, args, live)
    done = sinks.MoveCheckpoint(f"{_reports(args)}/move.json", spark)
    for table, state in sinks.move_plan(pair, done):
        print(f"{table}: {state}")
        if not args.go or state == "done":
            continue
        src = pair.table("src", table)
        key = readers.integer_key(src, list(pair.meta[table].key) if table in pair.meta else [])
        if key:
            sinks.move_table(src, key, f"{_reports(args)}/moved/{table}", done, table, args.chunk)
        else:
            sinks.copy_table(src, f"{_reports(args)}/moved/{table}")
            done.save(table, None, True)
    return 0


def _move_live(pair: Pair, args: argparse.Namespace, live: writer.SQLiteTarget) -> int:
    """Copy whole keyed tables into a live target that has them, all in one transaction, rows of the same keys replaced."""
    wanted = {}
    for table in pair.kept_tables():
        key = list(pair.meta[table].key) if table in pair.meta else []
        print(f"{table}: {'whole' if key else 'no key, create one first'}")
        if key:
            both = checks.sides(pair, table)
            wanted[table] = (both.src.select(F.lit(writer.PUT).alias("__do"), *[F.col(f"`{c}`") for c in both.src.columns]), key)
    if args.go and wanted:
        print(f"applied; rollback --tag {writer.apply(live, wanted, _parents(pair), f'{_reports(args)}/staging', args.tag)} undoes it")
    return 0


def sample(pair: Pair, database: str) -> tuple:
    """One watch sample: counts of both sides and of each source table."""
    counts = {t: (pair.table("src", t).count(), pair.table("dst", t).count()) for t in pair.kept_tables()}
    return database or "default", int(time.time()), sum(a for a, _ in counts.values()), sum(b for _, b in counts.values()), {t: a for t, (a, _) in counts.items()}


def _rerun(spark: SparkSession, args: argparse.Namespace) -> int:
    """Run the checks every cycle and say of each result whether it healed, persists or broke."""
    rows, code = [], 0
    for cycle in range(args.cycles):
        rows += [(r["check"], r["scope"], cycle, r["status"]) for r in _run_checks(spark, args).collect()]
        seen = watch.heal_or_persist(spark.createDataFrame(rows, "check string, scope string, cycle long, status string"))
        now = seen.where(F.col("cycle") == cycle).orderBy("check", "scope").collect()
        for r in now:
            if r["change"] != "clean":
                print(f"{cycle}\t{r['check']}\t{r['scope']}\t{r['change']}")
        code = int(any(r[3] not in ("ok", "skip") for r in rows if r[2] == cycle))
        if cycle + 1 < args.cycles:
            time.sleep(args.interval)
    return code


def _follow(spark: SparkSession, args: argparse.Namespace) -> int:
    """Verify the keys that a change log touches; the cursor moves only after a clean cycle.

    The folder of changes holds segments of a log or Parquet files with the table's key columns. A log that no
    longer reaches back to the cursor ends in status 2: compare whole, then start anew.
    """
    pair = _pair(args, spark)
    if not args.table or not args.changes:
        raise SystemExit("following changes needs --table and --changes, a folder of a log's segments or of Parquet files with the table's key columns")
    key, code = list(pair.meta[args.table].key), 0
    shape = pair.table("src", args.table).select(*[F.col(f"`{k}`") for k in key]).schema
    cursor = f"{_reports(args)}/cursor/{args.table}"
    verifier = delta.batch_verifier(lambda: pair.table("src", args.table), lambda: pair.table("dst", args.table), key, f"{_reports(args)}/delta/{args.table}")
    for cycle in range(args.cycles):
        try:
            clean, said = delta.verification_cycle(_changes(spark, args, key, shape, cursor), verifier, cursor)
        except Exception as error:
            if "LostHistory" not in str(error):
                raise
            print(f"{cycle}\t{args.table}\thistory lost: {str(error).split('LostHistory')[1].splitlines()[0].strip(': ')}")
            return 2
        print(f"{cycle}\t{args.table}\t{said}")
        code = int(not clean)
        if cycle + 1 < args.cycles:
            time.sleep(args.interval)
    return code


def _changes(spark: SparkSession, args: argparse.Namespace, key: list[str], shape, cursor: str) -> DataFrame:
    """The keys that changes touch, as a stream."""
    if not any(name.endswith(".log") for name in readers.folder(spark, args.changes)):
        return spark.readStream.schema(shape).parquet(args.changes)
    spark.dataSource.register(source.ChangeLogSource)
    lines = spark.readStream.format("changelog").option("path", str(Path(args.changes).resolve()) if "://" not in args.changes else args.changes).option("checkpoint", str(Path(cursor).resolve()) if "://" not in cursor else cursor).load()
    touched = delta.parse_changes(lines, {args.table: key}).where((F.col("table") == args.table) & F.col("key").isNotNull())
    parts = F.split("key", "\t")
    return touched.select(*[parts[i].try_cast(f.dataType).alias(f.name) for i, f in enumerate(shape)])


def watch_(args: argparse.Namespace) -> int:
    """Sample counts and give the cutover verdict; ``--rerun`` repeats the checks, ``--follow`` verifies touched keys."""
    spark = _session()
    if args.rerun or args.follow:
        return _rerun(spark, args) if args.rerun else _follow(spark, args)
    pair, rows = _pair(args, spark), []
    schema_ = "db string, ts long, src_rows long, dst_rows long, src_tables map<string,long>"
    for cycle in range(args.cycles):
        rows.append(sample(pair, args.db))
        taken = spark.createDataFrame(rows, schema_)
        last = watch.rates(taken).join(watch.verdicts(taken), ["db", "ts"]).orderBy(F.desc("ts")).first()
        print(f"{last['pct']}%\trate={last['rate'] or 0:.1f}/s\teta={last['eta_s'] or 0:.0f}s\t{last['verdict']}")
        if cycle + 1 < args.cycles:
            time.sleep(args.interval)
    return 0


def report(args: argparse.Namespace) -> int:
    spark = _session()
    results = spark.read.schema(RESULT_SCHEMA).json(f"{_reports(args)}/summary")
    if args.serve:
        from concord.dashboard import server

        server(spark, args.reports.rstrip("/"), sorted(load_pairs(args.config)), args.port).serve_forever()
    if args.metrics:
        for r in sinks.metrics(results, args.name).collect():
            print(r["line"])
    else:
        out = Path(_reports(args), "report.html")
        out.write_text(sinks.html_report(results, args.name))
        print(out)
    return 0


def history(args: argparse.Namespace) -> int:
    spark = _session()
    for r in sinks.StateStore(spark, f"{_reports(args)}/state").points(args.name).limit(args.limit or 1 << 30).collect():
        print(json.dumps(r.asDict()))
    return 0


def rollback(args: argparse.Namespace) -> int:
    """Bring back the rows that a sync touched: from the journal of a live target, or from a restore point."""
    spark = _session()
    pair = _pair(args, spark)
    if live := _live(pair):
        tags = [args.tag] if args.tag else live.tags()[-1:]
        for tag in tags:
            print(f"{tag}: {', '.join(live.journalled(tag)) or 'nothing noted'}")
            if args.go:
                writer.undo(live, tag, {t: meta.key for t, meta in pair.meta.items()}, _parents(pair))
        return 0
    store = sinks.StateStore(spark, f"{_reports(args)}/state")
    for table in pair.kept_tables():
        points: DataFrame = store.points(args.name).where(F.array_contains("tables", f"{table}.preimage"))
        point = (points.where(F.col("tag") == args.tag) if args.tag else points).orderBy(F.desc("ts")).first()
        if point is None:
            continue
        touched, before = (store.table(args.name, point["ts"], f"{table}.{part}") for part in ("touched", "preimage"))
        print(f"{table}: {touched.count()} keys back to {point['ts']}")
        if args.go:
            key = [c for c in touched.columns if c != "kind"]
            after = spark.read.parquet(f"{_reports(args)}/repaired/{table}")
            repair.restore(after, repair.RowRepair(after, touched, before), key).write.mode("overwrite").parquet(f"{_reports(args)}/restored/{table}")
    return 0


COMMANDS = {"doctor": doctor, "advise": advise, "assess": assess, "schema": schema, "check": check, "sync": sync, "move": move, "watch": watch_, "report": report, "history": history, "rollback": rollback, "users": users}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="concord", description=__doc__.split("\n")[0])
    p.add_argument("--config", default="hops.json")
    p.add_argument("--reports", default="reports")
    commands = p.add_subparsers(dest="command", required=True)
    for name in [*COMMANDS, *ALIASES]:
        c = commands.add_parser(name)
        real, preset = ALIASES.get(name, (name, {}))
        if real == "advise":
            c.add_argument("playbook", nargs="?", default="same-engine")
            continue
        if real == "doctor":
            c.add_argument("--reach", action="store_true")
            c.add_argument("--tools", action="store_true")
            continue
        if real == "assess":
            c.add_argument("name", nargs="?", default="")
            c.add_argument("--facts", default="")
        elif preset.get("convert"):
            c.add_argument("name", nargs="?", default="")
        else:
            c.add_argument("name")
        c.add_argument("--db", default="")
        c.add_argument("--table", default="")
        c.add_argument("--exclude", default="")
        c.add_argument("--only", default="")
        c.add_argument("--tag", default="")
        c.add_argument("--kind", default="rows", choices=["rows", "sequences", "schema", "all"])
        c.add_argument("--on-conflict", default=repair.SOURCE_WINS, choices=[repair.SOURCE_WINS, repair.KEEP_TARGET])
        c.add_argument("--chunk", type=int, default=1_000_000)
        c.add_argument("--cycles", type=int, default=1)
        c.add_argument("--interval", type=float, default=5.0)
        c.add_argument("--limit", type=int, default=15)
        c.add_argument("--port", type=int, default=8484)
        c.add_argument("--migration", default="")
        c.add_argument("--ddl", default="schema.sql")
        c.add_argument("--changes", default="")
        c.add_argument("--via", default="", choices=["", *sinks.MOVERS])
        c.add_argument("--sample", type=int, default=0)
        for flag in ("go", "metrics", "serve", "deep", "drill", "consistent", "resume", "convert", "rerun", "follow", "replicate"):
            c.add_argument(f"--{flag}", action="store_true")
        c.set_defaults(**preset)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return COMMANDS[ALIASES.get(args.command, (args.command,))[0]](args)


if __name__ == "__main__":
    sys.exit(main())
