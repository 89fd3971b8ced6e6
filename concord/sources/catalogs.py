"""What a live engine's catalog says: tables, keys, columns, counters, settings, objects, permissions, logins.

Each kind of fact is one read-only query in the engine's dialect whose columns are those that the comparisons
of ``operators.catalog`` take. Queries over ``information_schema`` are shared where engines have it.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from concord.model import Endpoint, TableMeta

_HIDDEN = "('information_schema', 'pg_catalog', 'pg_toast', 'performance_schema', 'mysql', 'sys')"
_OWN = {"duckdb": "{0}.table_schema = 'main'", "postgres": f"{{0}}.table_schema not in {_HIDDEN}", "mysql": "{0}.table_schema = database()", "mssql": "{0}.table_schema not in ('sys', 'INFORMATION_SCHEMA')"}
#: How a table is named: with its schema where a database holds several.
_TABLE = {"duckdb": "{0}.table_name", "postgres": "{0}.table_schema || '.' || {0}.table_name", "mysql": "{0}.table_name", "mssql": "concat({0}.table_schema, '.', {0}.table_name)"}


def _standard(engine: str) -> dict[str, str]:
    """The queries that ``information_schema`` answers in every engine."""
    own, table = _OWN[engine], _TABLE[engine]
    joined = "k.constraint_name = c.constraint_name and k.table_schema = c.table_schema and k.table_name = c.table_name"
    return {
        "tables": f"select {table.format('t')} as name from information_schema.tables t where t.table_type = 'BASE TABLE' and {own.format('t')}",
        "keys": f"select {table.format('k')} as table_name, k.constraint_name as key_name, c.constraint_type as kind, k.column_name, k.ordinal_position as place from information_schema.key_column_usage k join information_schema.table_constraints c on {joined} where c.constraint_type in ('PRIMARY KEY', 'UNIQUE') and {own.format('k')}",
        "columns": f"select {table.format('c')} as table_name, c.column_name, c.ordinal_position as place, c.data_type as type, c.is_nullable, c.column_default, c.character_maximum_length as char_length, c.numeric_precision as num_precision, c.numeric_scale as num_scale from information_schema.columns c where {own.format('c')}",
        "views": f"select 'view' as obj_type, {table.format('t')} as obj_name from information_schema.views t where {own.format('t')}",
        "foreign": f"select {table.format('k')} as table_name, k.constraint_name as key_name, k.column_name, k.ordinal_position as place, {table.format('p')} as parent, p.column_name as parent_column from information_schema.key_column_usage k join information_schema.referential_constraints r on r.constraint_schema = k.constraint_schema and r.constraint_name = k.constraint_name join information_schema.key_column_usage p on p.constraint_schema = r.unique_constraint_schema and p.constraint_name = r.unique_constraint_name and p.ordinal_position = {'k.ordinal_position' if engine == 'mssql' else 'k.position_in_unique_constraint'} where {own.format('k')}",
        "checks": f"select {table.format('t')} as table_name, c.constraint_name as name, c.check_clause as rule from information_schema.check_constraints c join information_schema.table_constraints t on t.constraint_schema = c.constraint_schema and t.constraint_name = c.constraint_name where t.constraint_type = 'CHECK' and {own.format('t')}",
        "generated": f"select {table.format('c')} as table_name, c.column_name, c.generation_expression as rule from information_schema.columns c where c.generation_expression is not null and c.generation_expression <> '' and {own.format('c')}",
        "grants": f"select g.grantee, {table.format('g')} as object, g.privilege_type as privilege from information_schema.table_privileges g where {own.format('g')}",
    }


#: Kinds of objects: the manual's view of them, its column of schemas, and the name of one.
_POSTGRES_OBJECTS = {
    "table": ("pg_tables", "schemaname", "schemaname || '.' || tablename"),
    "view": ("pg_views", "schemaname", "schemaname || '.' || viewname"),
    "materialized view": ("pg_matviews", "schemaname", "schemaname || '.' || matviewname"),
    "index": ("pg_indexes", "schemaname", "schemaname || '.' || indexname"),
    "sequence": ("pg_sequences", "schemaname", "schemaname || '.' || sequencename"),
    "invalid_index": ("(select n.nspname as own, n.nspname || '.' || c.relname as label from pg_index x join pg_class c on c.oid = x.indexrelid join pg_namespace n on n.oid = c.relnamespace where not x.indisvalid) unusable", "own", "label"),
    # specific names hold numbers of the server's own, so a routine is told by its parameters
    "routine": ("(select r.routine_schema as own, r.routine_schema || '.' || r.routine_name || '(' || coalesce(string_agg(p.data_type, ', ' order by p.ordinal_position), '') || ')' as label from information_schema.routines r left join information_schema.parameters p on p.specific_schema = r.specific_schema and p.specific_name = r.specific_name group by r.specific_name, r.routine_schema, r.routine_name) signatures", "own", "label"),
    "trigger": ("information_schema.triggers", "trigger_schema", "event_object_table || '.' || trigger_name || ' ' || event_manipulation"),
    # and so do the names of not-null rules, which are columns' own
    "constraint": ("(select * from information_schema.table_constraints where constraint_name not like '%\\_not\\_null') named", "table_schema", "table_schema || '.' || table_name || '.' || constraint_name"),
}


def _listed(objects: dict[str, tuple[str, str, str]]) -> str:
    """One query of all kinds of objects."""
    return " union all ".join(f"select '{kind}' as obj_type, {name} as obj_name from {view} where {schema} not in {_HIDDEN}" for kind, (view, schema, name) in objects.items())


QUERIES: dict[str, dict[str, str]] = {
    "duckdb": _standard("duckdb"),
    "postgres": _standard("postgres")
    | {
        "partitions": "select n.nspname || '.' || p.relname as table_name, a.attname as column_name, pg_get_expr(c.relpartbound, c.oid) as bound from pg_inherits i join pg_class c on c.oid = i.inhrelid join pg_class p on p.oid = i.inhparent join pg_namespace n on n.oid = p.relnamespace join pg_partitioned_table t on t.partrelid = p.oid and t.partstrat = 'r' and t.partnatts = 1 join pg_attribute a on a.attrelid = p.oid and a.attnum = t.partattrs[0]",
        "databases": "select datname as name from pg_database where not datistemplate and datname <> 'postgres'",
        "params": "select name, setting as value from pg_settings",
        "counters": "select s.schemaname || '.' || s.sequencename as \"table\", coalesce(s.last_value, s.start_value) as last_value, s.increment_by as increment, s.last_value is not null as is_called, exists (select 1 from pg_depend d where d.objid = (quote_ident(s.schemaname) || '.' || quote_ident(s.sequencename))::regclass and d.deptype in ('a', 'i')) as owned from pg_sequences s",
        "owned_by": "select n.nspname || '.' || s.relname as \"table\", tn.nspname || '.' || t.relname as owner_table, a.attname as owner_column from pg_class s join pg_namespace n on n.oid = s.relnamespace join pg_depend d on d.objid = s.oid and d.deptype in ('a', 'i') join pg_class t on t.oid = d.refobjid join pg_namespace tn on tn.oid = t.relnamespace join pg_attribute a on a.attrelid = t.oid and a.attnum = d.refobjsubid where s.relkind = 'S'",
        "objects": _listed(_POSTGRES_OBJECTS),
        "extensions": "select extname as name, extversion as version from pg_extension",
        "logins": "select rolname as login, rolpassword as secret, array(select b.rolname from pg_auth_members m join pg_roles b on b.oid = m.roleid where m.member = a.oid)::text[] as roles from pg_authid a where rolname not like 'pg\\_%'",
        "position": "select pg_current_wal_lsn()::text as position",
        "facts": "select 'wal_level' as name, current_setting('wal_level') as value union all select 'is_replica', pg_is_in_recovery()::text union all select 'encoding', pg_encoding_to_char(encoding) from pg_database where datname = current_database() union all select 'inactive_slots', count(*)::text from pg_replication_slots where not active union all select 'longest_transaction_s', coalesce(max(extract(epoch from now() - xact_start)), 0)::text from pg_stat_activity where xact_start is not null union all select 'unlogged_tables', count(*)::text from pg_class where relpersistence = 'u' and relkind = 'r' union all select 'invalid_indexes', count(*)::text from pg_index where not indisvalid",
    },
    "mysql": _standard("mysql")
    | {
        "foreign": "select table_name, constraint_name as key_name, column_name, ordinal_position as place, referenced_table_name as parent, referenced_column_name as parent_column from information_schema.key_column_usage where referenced_table_name is not null and table_schema = database()",
        "partitions": "select table_name, partition_expression as column_name, partition_description as bound from information_schema.partitions where partition_method like 'RANGE%' and table_schema = database() order by table_name, partition_ordinal_position",
        "databases": "select schema_name as name from information_schema.schemata where schema_name not in ('information_schema', 'performance_schema', 'mysql', 'sys')",
        "params": "select variable_name as name, variable_value as value from performance_schema.global_variables",
        "counters": "select table_name as `table`, auto_increment as last_value, 1 as increment, true as is_called, true as owned from information_schema.tables where table_schema = database() and auto_increment is not null",
        "owned_by": "select table_name as `table`, table_name as owner_table, column_name as owner_column from information_schema.columns where table_schema = database() and extra like '%auto_increment%'",
        "objects": "select lower(table_type) as obj_type, table_name as obj_name from information_schema.tables where table_schema = database() union all select lower(routine_type), routine_name from information_schema.routines where routine_schema = database() union all select 'trigger', trigger_name from information_schema.triggers where trigger_schema = database() union all select distinct 'index', concat(table_name, '.', index_name) from information_schema.statistics where table_schema = database() union all select 'event', event_name from information_schema.events where event_schema = database()",
        "logins": "select concat(user, '@', host) as login, authentication_string as secret, null as roles from mysql.user where user not like 'mysql.%'",
        "position": "select @@global.gtid_executed as position",
        "facts": "select 'binlog_format' as name, @@global.binlog_format as value union all select 'is_replica', if(@@global.read_only, 'true', 'false') union all select 'encoding', @@global.character_set_server",
    },
    "mssql": _standard("mssql")
    | {
        "generated": "select concat(schema_name(o.schema_id), '.', o.name) as table_name, c.name as column_name, c.definition as rule from sys.computed_columns c join sys.tables o on o.object_id = c.object_id",
        "databases": "select name from sys.databases where database_id > 4",
        "params": "select name, cast(value_in_use as nvarchar(4000)) as value from sys.configurations",
        "counters": "select concat(schema_name(o.schema_id), '.', o.name) as [table], cast(coalesce(i.last_value, i.seed_value) as bigint) as last_value, cast(i.increment_value as bigint) as increment, cast(case when i.last_value is null then 0 else 1 end as bit) as is_called, cast(1 as bit) as owned from sys.identity_columns i join sys.tables o on o.object_id = i.object_id",
        "owned_by": "select concat(schema_name(o.schema_id), '.', o.name) as [table], concat(schema_name(o.schema_id), '.', o.name) as owner_table, i.name as owner_column from sys.identity_columns i join sys.tables o on o.object_id = i.object_id",
        "objects": "select lower(type_desc) as obj_type, concat(schema_name(schema_id), '.', name) as obj_name from sys.objects where is_ms_shipped = 0 union all select 'index', concat(object_name(object_id), '.', name) from sys.indexes where name is not null and objectproperty(object_id, 'IsMSShipped') = 0",
        "logins": "select name as login, convert(varchar(512), password_hash, 1) as secret, null as roles from sys.sql_logins where name not like '##%'",
        "position": "select cast(change_tracking_current_version() as varchar(40)) as position",
        "facts": "select 'is_replica' as name, case when databasepropertyex(db_name(), 'Updateability') = 'READ_ONLY' then 'true' else 'false' end as value",
    },
}

#: ``read(end, database, sql)`` gives the rows of a query.
Read = Callable[[Endpoint, str, str], DataFrame]


def table_names(read: Read, end: Endpoint, database: str, engine: str) -> list[str]:
    return sorted(r["name"] for r in read(end, database, QUERIES[engine]["tables"]).collect())


def table_meta(read: Read, end: Endpoint, database: str, engine: str) -> dict[str, TableMeta]:
    """What a catalog says of each table: key, unique sets, references, rules, generated columns and ranges of partitions.

    A table without a primary key takes its first unique set. Kinds that the engine has no query for are left out, and
    so are those, but for keys, that a server refuses, as older ones or accounts of few rights do: a warning says so.
    """

    def rows(kind: str) -> list:
        sql = QUERIES[engine].get(kind)
        try:
            return read(end, database, sql).collect() if sql else []
        except Exception as error:
            if kind == "keys":
                raise
            warnings.warn(f"the catalog tells no {kind}: {str(error).splitlines()[0][:200]}", stacklevel=2)
            return []

    sets: dict[str, dict[tuple[str, str], list[tuple[int, str]]]] = {}
    for r in rows("keys"):
        sets.setdefault(r["table_name"], {}).setdefault((r["kind"], r["key_name"]), []).append((int(r["place"]), r["column_name"]))
    found: dict[str, dict] = {}
    for table, kinds in sets.items():
        ordered = [(kind, tuple(c for _, c in sorted(columns))) for (kind, _), columns in sorted(kinds.items())]  # primary before unique
        found[table] = {"key": ordered[0][1], "unique": tuple(columns for kind, columns in ordered if kind == "UNIQUE")}
    references: dict[tuple[str, str], list[tuple]] = {}
    for r in rows("foreign"):
        references.setdefault((r["table_name"], r["key_name"]), []).append((int(r["place"]), r["column_name"], r["parent"], r["parent_column"]))
    for (table, _), columns in sorted(references.items()):
        columns.sort()
        one = (tuple(c[1] for c in columns), columns[0][2], tuple(c[3] for c in columns))
        found.setdefault(table, {})["foreign"] = (*found.get(table, {}).get("foreign", ()), one)
    for r in rows("checks"):
        if not _NOT_NULL.search(r["rule"] or ""):
            found.setdefault(r["table_name"], {}).setdefault("checks", {})[r["name"]] = portable(r["rule"])
    for r in rows("generated"):
        found.setdefault(r["table_name"], {}).setdefault("generated", {})[r["column_name"]] = portable(r["rule"])
    ranges: dict[str, list[tuple[str, str]]] = {}
    for r in rows("partitions"):
        ranges.setdefault(r["table_name"], []).append((r["column_name"], r["bound"]))
    for table, parts in ranges.items():
        found.setdefault(table, {}).update(partition_column=parts[0][0].strip("`\""), partition_bounds=partition_ranges([bound for _, bound in parts]))
    return {table: TableMeta(**facts) for table, facts in found.items()}


_NOT_NULL = re.compile(r"(?i)^\W*[\w.\"`]+\W+is\s+not\s+null\W*$")
#: A cast by two colons with its type, as one engine prints them.
_CAST = re.compile(r"::\s*[A-Za-z_]\w*(?:\s+(?:varying|precision|with(?:out)? time zone))?(?:\(\d+(?:,\s*\d+)?\))?(?:\[\])?")
_FROM_TO = re.compile(r"(?i)from \((.*)\) to \((.*)\)")


def portable(rule: str) -> str:
    """An expression of a catalog without casts of its printing and in Spark's quotes; whether Spark knows its functions is for its caller to see."""
    text = re.sub(r"(?i)^\s*check\s*(?=\()", "", rule)
    return re.sub(r'"((?:[^"]|"")*)"', lambda m: "`" + m[1].replace('""', '"') + "`", _CAST.sub("", text))


def partition_ranges(bounds: list[str]) -> tuple[tuple, ...]:
    """Ranges [low, high) of partitions, declared by FROM and TO or, in order, by what they are less than."""
    out, last = [], "MINVALUE"
    for bound in bounds:
        if both := _FROM_TO.search(bound):
            out.append((both[1], both[2]))
        elif "default" not in bound.lower():
            out.append((last, bound))
            last = bound
    return tuple((_bound(low, high, -1), _bound(high, low, 1)) for low, high in out)


def _bound(text: str, other: str, side: int) -> int | str:
    """One end of a range as a number or a text; an open one lies beyond what the other end's type can be."""
    plain = lambda x: x.strip().strip("'")
    if plain(text).upper() in ("MINVALUE", "MAXVALUE"):
        number = plain(other).lstrip("-").isdigit() or plain(other).upper() in ("MINVALUE", "MAXVALUE")
        return side * (1 << 62) if number else "0001-01-01" if side < 0 else "9999-12-31"
    return int(plain(text)) if plain(text).lstrip("-").isdigit() else plain(text)


def facts(spark: SparkSession, read: Read, end: Endpoint, database: str, engine: str, kind: str) -> DataFrame | None:
    """One kind of facts, or None where the engine has no query for it."""
    sql = QUERIES.get(engine, {}).get(kind)
    return read(end, database, sql) if sql else None
